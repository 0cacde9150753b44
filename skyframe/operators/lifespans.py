"""Schema drift: lifespans of the fields of delivered files, change report and one consistent table.

Method: a column lifespan catalogue. The header text is exploded to one row per file and field; per stream, header unit,
field and type, ``lag``/``lead`` over the file positions give the islands of consecutive files that have it; island
starts and endings are the changes, and the renames among them form the alias table from which casts are generated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.operators.sequence import rank_in_groups, with_halo
from skyframe.session import cut

KEY = ["stream", "hdu"]


def _split(line: Column) -> Column:
    """struct(key, rest) of a line; key '' where it has no '='."""
    at = F.instr(line, "=")
    return F.struct(F.trim(F.substr(line, F.lit(1), F.greatest(at - 1, F.lit(0)))).alias("key"), F.ltrim(F.substr(line, at + 1)).alias("rest"))


def _card(c: Column) -> Column:
    """struct(key, rest) → struct(key, raw, quoted, note). String functions do the work; only quoted values need a pattern."""
    rest = c["rest"]
    quoted = F.startswith(rest, F.lit("'"))
    form = r"(?s)^'((?:[^']|'')*)'\s*(?:/(.*))?$"
    text = F.rtrim(F.replace(F.regexp_extract(rest, form, 1), F.lit("''"), F.lit("'")))
    slash = F.instr(rest, "/")
    note = F.when(quoted, F.regexp_extract(rest, form, 2)).when(slash > 0, F.substr(rest, slash + 1)).otherwise("")
    return F.struct(
        c["key"].alias("key"),
        F.when(quoted, text).otherwise(F.trim(F.substring_index(rest, "/", 1))).alias("raw"),
        quoted.alias("quoted"),
        F.lower(F.translate(note, " \t\r", "")).alias("note"),
    )


def _kind(card: Column) -> Column:
    raw = card["raw"]
    return (
        F.when(card["quoted"], "string").when(raw == "", "").when(raw.isin("T", "F"), "boolean")
        .when(raw.rlike(r"^[+-]?\d+$"), "integer").otherwise("real")
    )


def header_fields(df: DataFrame) -> DataFrame:
    """Add ``fields``: array of struct(field, kind, note, raw), for either form of body.

    A primary body has one field per card; a table body has one per TTYPEn, with the code of TFORMn as its kind. ``kind``
    is '' where a field has no type; ``note`` is the description in lower case without spaces. Lines without '=' hold no
    field. Of a field that a body has twice, the first counts.
    """
    cards = F.transform(F.filter(F.transform(F.split("body", "\n"), _split), lambda c: c["key"] != ""), _card)
    primary = F.transform("_cards", lambda c: F.struct(c["key"].alias("field"), _kind(c).alias("kind"), c["note"].alias("note"), c["raw"].alias("raw")))

    def column(c: Column) -> Column:
        number = F.substring(c["key"], 6, 9)
        code = F.get(F.filter("_cards", lambda f: f["key"] == F.concat(F.lit("TFORM"), number)), 0)["raw"]
        return F.struct(c["raw"].alias("field"), F.coalesce(code, F.lit("")).alias("kind"), c["note"].alias("note"), number.alias("raw"))

    columns = F.transform(F.filter("_cards", lambda c: c["key"].rlike(r"^TTYPE\d+$")), column)
    fields = F.when(F.col("hdu") == "primary", primary).otherwise(columns)
    names = F.transform("_fields", lambda f: f["field"])
    return (
        df.withColumn("_cards", cards).withColumn("_fields", fields).withColumn("_names", names)
        .withColumn("fields", F.filter("_fields", lambda f, i: F.array_position("_names", f["field"]) == i + 1))
        .drop("_cards", "_fields", "_names")
    )


def header_files(raw: DataFrame) -> DataFrame:
    """One row per file and header unit: stream, hdu, file_no, smf_fn, loaded_at, fields.

    Redelivered files count once (the latest ``loaded_at``, then the greatest body). Rows without stream, hdu, file_no or
    body take no part; an empty body is a header without fields.
    """
    latest = F.max_by(F.struct("smf_fn", "loaded_at", "body"), F.struct(F.col("loaded_at"), F.col("body")))
    files = raw.where(" AND ".join(f"{c} IS NOT NULL" for c in ["stream", "hdu", "file_no", "body"])).groupBy(*KEY, "file_no").agg(latest.alias("_last"))
    return header_fields(files.select(*KEY, "file_no", "_last.*")).drop("body")


def islands(files: DataFrame, block: int = 4096) -> DataFrame:
    """Starts and endings of each field's islands: stream, hdu, field, kind, note, pos, is_start, is_end.

    ``files`` has pos (position of the file among those of its stream and hdu). The windows are cut into blocks of
    ``block`` positions with one position's copies over each border, so none holds more rows than that and no island seems
    to start or end at a border. One shuffle.
    """
    if block < 2:
        raise ValueError("a block holds two positions or more")
    life = [*KEY, "field", "kind"]
    rows = files.select(*KEY, "pos", F.explode("fields").alias("f")).select(*KEY, "pos", "f.field", "f.kind", "f.note")
    w = Window.partitionBy(*life, "_block").orderBy("pos")
    marks = with_halo(rows, "pos", block, 1).select(
        *life, "note", "pos", "_own",
        (F.coalesce(F.lag("pos").over(w), F.lit(-9)) != F.col("pos") - 1).alias("is_start"),
        (F.coalesce(F.lead("pos").over(w), F.lit(-9)) != F.col("pos") + 1).alias("is_end"),
    )
    return marks.where("_own AND (is_start OR is_end)").drop("_own")


def changes(files: DataFrame, block: int = 4096) -> DataFrame:
    """Every difference of a file to the one before it: stream, hdu, file_no, field, new_name, change.

    ``renamed``: gone and new with the same description (not empty); ``field`` is the old name. ``retyped``: in both with
    another type. ``added``/``removed``: any other. The first file of a stream and hdu has no changes. Of several fields
    with one description that change names at once, the first old name goes with the first new one, and so on.

    The events are shuffled once, by file; everything after is within a file.
    """
    spot = [*KEY, "pos"]
    began = F.when(F.col("is_start") & (F.col("pos") > 0), F.struct(F.col("pos").alias("at"), F.lit(1).alias("new"), F.lit(0).alias("gone")))
    ended = F.when(F.col("is_end"), F.struct((F.col("pos") + 1).alias("at"), F.lit(0).alias("new"), F.lit(1).alias("gone")))
    events = islands(files, block).select(*KEY, "field", "note", F.explode(F.array_compact(F.array(began, ended))).alias("e"))
    events = events.select(*KEY, F.col("e.at").alias("pos"), "field", "note", "e.new", "e.gone").repartition(*spot)
    once = events.groupBy(*spot, "field").agg(F.max("new").alias("new"), F.max("gone").alias("gone"), F.max("note").alias("note"))
    both = F.col("new") + F.col("gone") == 2
    k = F.row_number().over(Window.partitionBy(*spot, "note", "gone", "new").orderBy("field"))
    alone = F.when(both, F.concat_ws("|", "field", F.lit("both"))).when(F.col("note") == "", F.concat_ws("|", "field", "gone"))
    pairs = (
        once.withColumn("k", k).withColumn("alone", alone).groupBy(*spot, "note", "k", "alone")
        .agg(F.max(F.when(F.col("gone") == 1, F.col("field"))).alias("old"), F.max(F.when(F.col("new") == 1, F.col("field"))).alias("new_name"), F.max(both).alias("both"))
        .select(*spot, F.coalesce("old", "new_name").alias("field"), F.when(F.col("old").isNotNull() & ~F.col("both"), F.col("new_name")).alias("new_name"),
                F.when(F.col("both"), "retyped").when(F.col("old").isNull(), "added").when(F.col("new_name").isNull(), "removed").otherwise("renamed").alias("change"))
    )
    # endings at the last file have no next file and fall out here
    return pairs.join(files.select(*KEY, "pos", "file_no"), spot).drop("pos")


def lifespans(files: DataFrame, block: int = 4096) -> DataFrame:
    """The catalogue: one row per island, with its first and last file: stream, hdu, field, kind, first_file, last_file, n_files."""
    w = Window.partitionBy(*KEY, "field", "kind").orderBy("pos")
    spans = (
        islands(files, block).withColumn("last_pos", F.when(F.col("is_end"), F.col("pos")).otherwise(F.lead("pos").over(w)))
        .where("is_start").select(*KEY, "field", "kind", F.col("pos").alias("first_pos"), "last_pos")
    )
    first = files.select(*KEY, F.col("pos").alias("first_pos"), F.col("file_no").alias("first_file"))
    last = files.select(*KEY, F.col("pos").alias("last_pos"), F.col("file_no").alias("last_file"))
    return (
        spans.join(first, [*KEY, "first_pos"]).join(last, [*KEY, "last_pos"])
        .select(*KEY, "field", "kind", "first_file", "last_file", (F.col("last_pos") - F.col("first_pos") + 1).alias("n_files"))
    )


def ranked_files(raw: DataFrame) -> DataFrame:
    """header_files with ``pos``. The parsed headers are stored once: ranking samples its input, and would parse twice."""
    return rank_in_groups(cut(header_files(raw)), KEY, ["file_no"], "pos")


#: repeat count and letter of a TFORM code
CODE = r"^(\d*)([LXBIJKAEDCM])$"


def _wide_code(codes: Column) -> Column:
    """The TFORM code whose type holds the values of all ``codes``: 'string' where there is none, '' for no codes.

    A long beside reals has none, as a double would round it; nor have logicals, texts, bits, complex numbers and arrays of
    variable length beside anything else. A code alone stays as written.
    """
    codes = F.filter(codes, lambda c: c != "")
    letters = F.array_distinct(F.transform(codes, lambda c: F.regexp_extract(c, CODE, 2)))
    repeat = F.array_max(F.transform(codes, lambda c: F.coalesce(F.regexp_extract(c, CODE, 1).try_cast("int"), F.lit(1))))
    array = lambda names: F.array(*[F.lit(n) for n in names])
    has = lambda names: F.arrays_overlap(letters, array(names))
    only = lambda names: F.size(F.array_except(letters, array(names))) == 0
    letter = (
        F.when(F.size(letters) == 1, F.nullif(F.get(letters, 0), F.lit("")))
        .when(only("BIJK"), F.when(has("K"), "K").when(has("J"), "J").otherwise("I"))
        .when(only("BIJED"), F.when(has("JD"), "D").otherwise("E")).when(only("CM"), "M")
    )
    mixed = F.coalesce(F.concat(F.when(repeat != 1, repeat.cast("string")).otherwise(""), letter), F.lit("string"))
    return F.when(F.size(codes) == 0, "").when(F.size(codes) == 1, F.get(codes, 0)).otherwise(mixed)


def alias_table(files: DataFrame) -> DataFrame:
    """hdu, field, canonical, kind: fields with one description belong together; the name in most files is canonical.

    ``kind`` is the narrowest that holds every value seen under any of the names: boolean, integer, real, string, or ''
    (never typed). Booleans beside numbers, and numbers that neither a long nor a double can hold, make it string. Of a
    table's columns it is a TFORM code, or string where no code holds all of them.
    """
    number = F.when(F.col("f.kind") == "integer", F.col("f.raw").try_cast("bigint").isNotNull()).when(F.col("f.kind") == "real", F.col("f.raw").try_cast("double").isNotNull())
    kind = F.when((F.col("hdu") == "primary") & ~number, "string").otherwise(F.col("f.kind"))
    seen = files.select("hdu", F.explode("fields").alias("f")).groupBy("hdu", "f.field", "f.note", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    family = F.when(F.col("note") == "", F.concat(F.lit("="), F.col("field"))).otherwise(F.col("note"))
    per_name = seen.withColumn("family", family).groupBy("hdu", "family", "field").agg(F.sum("n").alias("n"), F.collect_set("kind").alias("kinds"))
    w = Window.partitionBy("hdu", "family")
    kinds = F.array_distinct(F.flatten(F.collect_list("kinds").over(w)))
    has = lambda *names: F.arrays_overlap(kinds, F.array(*[F.lit(n) for n in names]))
    wide = (
        F.when(has("string") | has("boolean") & has("integer", "real"), "string")
        .when(has("real"), "real").when(has("integer"), "integer").when(has("boolean"), "boolean").otherwise("")
    )
    wide = F.when(F.col("hdu") == "primary", wide).otherwise(_wide_code(kinds))
    return per_name.select("hdu", "field", F.min_by("field", F.struct(-F.col("n"), F.col("field"))).over(w).alias("canonical"), wide.alias("kind"))


SPARK_TYPES = {"string": "string", "real": "double", "integer": "bigint", "boolean": "boolean", "": "string"}


def consistent_columns(files: DataFrame) -> DataFrame:
    """All files' table units: stream, file_no, hdu, smf_fn, loaded_at, columns.

    ``columns`` has a struct(column, kind, name, code, number) per column of the unit, in order of number: the canonical
    name and its type in all files (of ``alias_table``), then the name, TFORM code and number that the file has.
    """
    units = files.where("hdu <> 'primary'")
    entry = F.struct("field", F.struct(F.col("canonical").alias("column"), "kind"))
    names = alias_table(units).groupBy("hdu").agg(F.map_from_entries(F.collect_list(entry)).alias("_names"))
    known = lambda f: F.col("_names")[f["field"]]
    column = lambda f: F.struct(f["raw"].cast("int").alias("number"), known(f)["column"].alias("column"), known(f)["kind"].alias("kind"), f["field"].alias("name"), f["kind"].alias("code"))
    placed = F.transform(F.array_sort(F.transform("fields", column)), lambda c: F.struct(*[c[n].alias(n) for n in ("column", "kind", "name", "code", "number")]))
    return units.join(F.broadcast(names), "hdu", "left").select("stream", "file_no", "hdu", "smf_fn", "loaded_at", placed.alias("columns"))


def all_units(files: DataFrame) -> DataFrame:
    """Primary headers and table units as one table: a row has the keywords of its header, or the columns of its unit.

    Keywords that are named as ``hdu`` or ``columns`` are have a suffix.
    """
    headers = consistent_table(files, taken=("hdu", "columns")).withColumn("hdu", F.lit("primary"))
    return consistent_columns(files).unionByName(headers, allowMissingColumns=True)


def consistent_table(files: DataFrame, hdu: str = "primary", max_columns: int = 4000, taken: tuple[str, ...] = ()) -> DataFrame:
    """All files' primary headers as one wide table, one typed column per canonical field.

    Table units have columns and no values: they are for ``consistent_columns``. Names in ``taken`` are given to no column.

    The alias table is the schema of the result, so the driver holds it, up to ``max_columns`` names; where there are more,
    the values of the others, in order of their canonical names, stand as text in a map column ``more_``.
    The column's type holds every value, so only empty values become null; where a file has several names of one column,
    the first non-null one in name order counts. Column names keep their letter case and are made distinct by a
    suffix where two differ in case only.
    """
    if hdu != "primary":
        raise ValueError(f"{hdu} is a table unit; its fields have no values")
    aliases = alias_table(files.where(F.col("hdu") == hdu)).orderBy("canonical", "field").limit(max_columns + 1).collect()
    beyond = len(aliases) > max_columns
    aliases = aliases[:max_columns]
    groups: dict[str, list] = {}
    for row in sorted(aliases, key=lambda r: (r["canonical"], r["field"])):
        groups.setdefault(row["canonical"], []).append(row)
    columns, taken = [], {"stream", "file_no", "smf_fn", "loaded_at", *taken}
    for canonical, rows in groups.items():
        to = SPARK_TYPES[rows[0]["kind"]]
        values = [F.col("_cards")[r["field"]] for r in rows]
        typed = [F.when(v.isin("T", "F"), v == "T") if to == "boolean" else F.nullif(v, F.lit("")).try_cast(to) for v in values]
        name = canonical
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        columns.append(F.coalesce(*typed).alias(name))
    if beyond:
        named = [r["field"] for r in aliases]
        columns.append(F.map_filter("_cards", lambda k, _: ~k.isin(named)).alias("more_"))
    cards = F.map_from_arrays(F.transform("fields", lambda f: f["field"]), F.transform("fields", lambda f: f["raw"]))
    return files.where(F.col("hdu") == hdu).withColumn("_cards", cards).select("stream", "file_no", "smf_fn", "loaded_at", *columns)
