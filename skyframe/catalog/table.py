"""A stored table: schema with keys, cells, snapshots, appends and upserts.

Layout: schema.json; data/_SNAP=<snapshot>/_CELL=../_T=../part files; cells/<snapshot> (one row per cell: where its newest
rows are, how many, and the highest index used) with a COMMITTED mark. A snapshot rewrites only the cells it touches. A read
opens the folders of the live cells it needs, by name where they are few, else in one scan beside the list of live cells.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyframe.catalog.storage import Folder
from skyframe.functions import sky
from skyframe.operators.sequence import rank_in_groups
from skyframe.plans.joins import q
from skyframe.session import cut, setting
from skyframe.types import dtype_of, spark_type, string_width, zero

CELL_SCHEMA = "cell long, t long, snapid string, nrows long, top long"
#: Up to so many cells a read names its folders one by one (and so lists no others).
NAMED_CELLS = 4096


class CatalogError(ValueError):
    """An operation that the catalogue does not allow."""


@dataclass
class Schema:
    """Columns in groups (name → dtype), keys, aliases and the rest of a table's definition."""

    groups: dict[str, dict[str, str]] = field(default_factory=dict)
    primary_key: str | None = None
    spatial_keys: list[str] | None = None
    temporal_key: str | None = None
    exposure_key: str | None = None
    aliases: dict[str, str] = field(default_factory=dict)
    blobs: list[str] = field(default_factory=list)
    fgroups: dict = field(default_factory=dict)
    filters: dict = field(default_factory=dict)
    commit_hooks: list = field(default_factory=list)
    level: int = sky.LEVEL
    t0: float = sky.T0
    dt: float = sky.DT

    @classmethod
    def from_definition(cls, definition: dict) -> Schema:
        """From {schema: {group: {columns: [(name, dtype), ...], primary_key, spatial_keys, temporal_key, exposure_key, blobs}}, aliases, ...}."""
        out = cls(aliases=dict(definition.get("aliases", {})), fgroups=dict(definition.get("fgroups", {})), filters=dict(definition.get("filters", {})), commit_hooks=list(definition.get("commit_hooks", [])))
        for name in ("level", "t0", "dt"):
            if name in definition:
                setattr(out, name, definition[name])
        for group, d in definition["schema"].items():
            out.add_group(group, d)
        return out

    def add_group(self, group: str, definition: dict) -> None:
        if group in self.groups:
            raise CatalogError(f"column group {group} exists")
        columns = {}
        for entry in definition["columns"]:
            name, kind = (entry[0], entry[1]) if isinstance(entry, (list, tuple)) else tuple(entry.items())[0]
            if name.startswith("_"):
                raise CatalogError(f"a stored column's name may not begin with an underscore: {name}")
            if name in self.columns() or name in columns:
                raise CatalogError(f"column {name} exists")
            spark_type(kind)
            columns[name] = kind
        first = not self.groups
        self.groups[group] = columns
        for key in ("primary_key", "spatial_keys", "temporal_key"):
            if definition.get(key):
                if not first:
                    raise CatalogError(f"{key} belongs to the first column group")
                setattr(self, key, list(definition[key]) if key == "spatial_keys" else definition[key])
        self.exposure_key = definition.get("exposure_key") or self.exposure_key
        self.blobs += list(definition.get("blobs", []))
        for key in [self.primary_key, self.temporal_key, self.exposure_key, *(self.spatial_keys or [])]:
            if key and key not in self.columns():
                raise CatalogError(f"key {key} is not a column")

    def columns(self) -> dict[str, str]:
        return {c: k for g in self.groups.values() for c, k in g.items()}

    def resolve(self, name: str) -> str | None:
        """Column of a name: itself, a built-in alias (_ID _LON _LAT _TIME _EXP) or a user's alias; None if there is none."""
        if name in self.columns():
            return name
        keys = {"_ID": self.primary_key, "_LON": (self.spatial_keys or [None])[0], "_LAT": (self.spatial_keys or [None, None])[1], "_TIME": self.temporal_key, "_EXP": self.exposure_key}
        if keys.get(name):
            return keys[name]
        return self.aliases.get(name) if self.aliases.get(name) in self.columns() else None


class Frame:
    """A DataFrame with keys, usable in queries like a stored table."""

    def __init__(self, name: str, df: DataFrame, primary_key: str | None = None, spatial_keys: list[str] | None = None, temporal_key: str | None = None, exposure_key: str | None = None, aliases: dict | None = None):
        self.name, self.df = name, df
        kinds = {f.name: dtype_of(f.dataType) for f in df.schema.fields}
        self.schema = Schema({"main": kinds}, primary_key, spatial_keys, temporal_key, exposure_key, aliases or {})

    def read(self, bounds=None) -> DataFrame:
        return self.df

    def key_cell(self, key: Column) -> None:
        """Rows of a frame lie in no cells."""
        return None


class Table:
    """One stored table of a database root. Writing goes through Database transactions."""

    def __init__(self, spark: SparkSession, root: str, name: str, snapid: str | None = None):
        self.spark, self.name, self.folder = spark, name, Folder(spark, f"{root}/{name}")
        if not self.folder.exists("schema.json"):
            raise CatalogError(f"no table {name}")
        self.schema = Schema(**json.loads(self.folder.read("schema.json")))
        self.snapid = snapid

    @staticmethod
    def create(spark: SparkSession, root: str, name: str, schema: Schema) -> Table:
        folder = Folder(spark, f"{root}/{name}")
        folder.make()
        if not folder.create("schema.json", json.dumps(asdict(schema), indent=1)):
            raise CatalogError(f"table {name} exists")
        return Table(spark, root, name)

    def save_schema(self) -> None:
        self.folder.write("schema.json", json.dumps(asdict(self.schema), indent=1))

    # -------------------------------------------------------------- snapshots
    def snapshots(self) -> list[tuple[str, bool]]:
        """(snapshot id, whether committed), oldest first."""
        ids = sorted({n.removeprefix("_SNAP=").split("-")[0] for n in self.folder.names("data")} | set(self.folder.names("cells")))
        return [(i, self.folder.exists(f"cells/{i}/COMMITTED")) for i in ids]

    def current(self, pending: str | None = None) -> str | None:
        """Newest committed snapshot not after ``snapid``; within a transaction its own one if it has written."""
        if pending and self.folder.exists(f"cells/{pending}/WRITTEN"):
            return pending
        done = [i for i, ok in self.snapshots() if ok and (self.snapid is None or i <= self.snapid)]
        return done[-1] if done else None

    def cells(self, pending: str | None = None) -> DataFrame:
        """One row per cell: cell (static), t (slice, 0 static), snapid (where its rows are), nrows, top (highest index)."""
        now = self.current(pending)
        if now is None:
            return self.spark.createDataFrame([], CELL_SCHEMA)
        return self.spark.read.schema(CELL_SCHEMA).parquet(self.folder.at(f"cells/{now}/rows"))

    def cells_in_snapshot(self, snapid: str) -> DataFrame:
        """The cells that one snapshot wrote."""
        if not self.folder.exists(f"cells/{snapid}/rows"):
            return self.spark.createDataFrame([], CELL_SCHEMA)
        return self.spark.read.schema(CELL_SCHEMA).parquet(self.folder.at(f"cells/{snapid}/rows")).where(F.startswith(F.col("snapid"), F.lit(snapid)))

    def nrows(self) -> int:
        """Row count from the cell catalogue, without reading data."""
        return self.cells().agg(F.coalesce(F.sum("nrows"), F.lit(0))).first()[0]

    def check_catalog(self) -> DataFrame:
        """Cells whose recorded row count differs from the stored rows; empty if all is well."""
        real = self._stored().groupBy(F.col("_CELL").alias("cell"), F.col("_T").alias("t")).agg(F.count(F.lit(1)).alias("found"))
        return self.cells().select("cell", "t", "nrows").join(real, ["cell", "t"], "full").where("NOT (coalesce(nrows, 0) <=> coalesce(found, 0))")

    def rebuild_catalog(self) -> None:
        """Count the newest rows of every cell again and replace the current snapshot's catalogue."""
        now = self.current()
        if now is None:
            return
        rows = self._stored()
        top = F.max(q(self.schema.primary_key).bitwiseAND(F.lit(sky.OBJECT_BITS))) if self.schema.primary_key else F.max(F.lit(0))
        fresh = rows.groupBy(F.col("_CELL").alias("cell"), F.col("_T").alias("t"), F.col("_SNAP").alias("snapid")).agg(F.count(F.lit(1)).alias("nrows"), top.cast("long").alias("top"))
        fresh.coalesce(1).write.mode("overwrite").parquet(self.folder.at(f"cells/{now}/rows-new"))
        self.folder.delete(f"cells/{now}/rows")
        self.folder.rename(f"cells/{now}/rows-new", f"cells/{now}/rows")

    def vacuum(self) -> list[str]:
        """Delete what failed transactions left behind."""
        gone = [i for i, ok in self.snapshots() if not ok]
        for i in gone:
            self.rollback(i)
        return gone

    # -------------------------------------------------------------- reading
    def _data_schema(self) -> T.StructType:
        fields = [T.StructField(c, spark_type(k) if not k.startswith("[") else _array_type(k)) for c, k in self.schema.columns().items()]
        return T.StructType([*fields, T.StructField("_CELL", T.LongType()), T.StructField("_T", T.LongType())])

    def _stored(self, bounds=None, pending: str | None = None, touched: DataFrame | None = None, cells: list[tuple[int, int]] | None = None) -> DataFrame:
        """Newest rows with _SNAP, _CELL and _T.

        Only the folders of live cells are opened that can meet ``bounds``, are in ``touched`` (_CELL, _T) and in ``cells``
        (pixel, slice). Up to NAMED_CELLS of them are named, with a partition filter besides; beyond that one scan of the
        live snapshots is semi-joined with the list of live cells, which prunes its partitions dynamically.
        """
        live = self.cells(pending)
        if bounds is not None and (found := bounds.static_pixels(self.schema.level)) is not None:
            live = live.where(F.col("cell").isin(found[0])) if found[0] else live.where("false")
        if bounds is not None and self.schema.temporal_key and not bounds.cells and all(i is not None for _, i in bounds.parts):
            spans = [(p[0], p[1]) for _, i in bounds.parts for p in i]
            start = F.col("t") * self.schema.dt + self.schema.t0
            hit = F.col("t") == 0
            for a, b in spans:
                hit = hit | ((start + self.schema.dt > F.lit(a)) & (start <= F.lit(b)))
            live = live.where(hit)
        if touched is not None:
            these = touched.select(F.col("_CELL").alias("_pixel"), F.col("_T").alias("_slice")).distinct()
            live = live.join(these, (F.col("cell") == F.col("_pixel")) & (F.col("t") == F.col("_slice")), "left_semi")
        if cells is not None:
            wanted = [(F.col("cell") == c) & (F.col("t") == s) for c, s in cells]
            live = live.where(_any(wanted))
        schema = T.StructType([*self._data_schema().fields, T.StructField("_SNAP", T.StringType())])
        named = live.select("snapid", "cell", "t").limit(NAMED_CELLS + 1).collect()
        if not named:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", self.folder.at("data"))
        if len(named) <= NAMED_CELLS:
            rows = reader.parquet(*sorted(self.folder.at(f"data/_SNAP={r['snapid']}/_CELL={r['cell']}/_T={r['t']}") for r in named))
            return rows.where(F.col("_CELL").isin(sorted({r["cell"] for r in named})))
        snaps = sorted(r["snapid"] for r in live.select("snapid").distinct().collect())
        rows = reader.parquet(*[self.folder.at(f"data/_SNAP={s}") for s in snaps])
        mine = live.select(F.col("snapid").alias("_of"), F.col("cell").alias("_pixel"), F.col("t").alias("_slice"))
        return rows.join(mine, (F.col("_SNAP") == F.col("_of")) & (F.col("_CELL") == F.col("_pixel")) & (F.col("_T") == F.col("_slice")), "left_semi")

    def read(self, bounds=None, pending: str | None = None, cells: list[tuple[int, int]] | None = None, with_cell: bool = False) -> DataFrame:
        """The table's columns; ``with_cell``: and _CELL and _T."""
        return self._filled(self._stored(bounds, pending, cells=cells)).select(*[q(c) for c in self.schema.columns()], *(["_CELL", "_T"] if with_cell else []))

    def key_cell(self, key: Column) -> tuple[Column, Column] | None:
        """_CELL and _T of the row with this primary key; None if rows have no keys. A key that is set says where its row is."""
        if not self.schema.primary_key:
            return None
        full = sky.cell_of_id(key, self.schema.level)
        return sky.static_cell(full), _slice(full)

    def _filled(self, df: DataFrame) -> DataFrame:
        """Zeros in the columns of later groups, which older files lack (the first group's stay bare for pushed filters)."""
        later = {c for g in list(self.schema.groups)[1:] for c in self.schema.groups[g]}
        kinds = {f.name: f.dataType for f in df.schema.fields}
        plain = (T.NumericType, T.BooleanType, T.StringType)
        return df.select(*[F.coalesce(q(c), zero(kinds[c])).alias(c) if c in later and isinstance(kinds[c], plain) else q(c) for c in df.columns])

    # -------------------------------------------------------------- writing
    def position(self) -> tuple[Column | None, Column | None, Column | None]:
        s = self.schema.spatial_keys
        lon, lat = (q(s[0]), q(s[1])) if s else (None, None)
        return lon, lat, q(self.schema.temporal_key) if self.schema.temporal_key else None

    def _row_cell(self, df: DataFrame) -> DataFrame:
        """Add _CELL and _T from the primary key if it is set, else from the position."""
        lon, lat, t = self.position()
        place = sky.position_id(lon, lat, t, t0=self.schema.t0, dt=self.schema.dt) if lon is not None else F.lit(0).cast("long")
        key = q(self.schema.primary_key) if self.schema.primary_key else F.lit(0)
        full = sky.cell_of_id(F.when((key == 0) | key.isNull(), place).otherwise(key), self.schema.level)
        return df.withColumn("_place", place).withColumn("_CELL", sky.static_cell(full)).withColumn("_T", _slice(full))

    def _conform(self, df: DataFrame) -> DataFrame:
        """All columns in order and type; absent ones and nulls are zero, text is cut to its width."""
        out = []
        for c, k in self.schema.columns().items():
            kind = spark_type(k) if not k.startswith("[") else _array_type(k)
            if c in df.columns:
                v = q(c).cast(kind)
                v = F.substring(v, 1, w) if (w := string_width(k)) else v
                out.append((F.coalesce(v, zero(kind)) if isinstance(kind, (T.NumericType, T.BooleanType, T.StringType)) else v).alias(c))
            else:
                out.append((zero(kind) if isinstance(kind, (T.NumericType, T.BooleanType, T.StringType)) else F.lit(None).cast(kind)).alias(c))
        return df.select(*out)

    def _with_ids(self, df: DataFrame, pending: str | None) -> DataFrame:
        """Give rows without a key one: position, and an index after the highest of their cell.

        Numbering ranks each cell's new rows with rank_in_groups, so a cell with most of the rows is no hot task.
        """
        key = self.schema.primary_key
        placed = self._row_cell(df)
        if not key:
            return placed.drop("_place")
        bad = placed.where(((q(key) == 0) | q(key).isNull()) & (F.col("_place").isNull()))
        if self.schema.spatial_keys and bad.limit(1).count():
            raise CatalogError("rows without a key need a position and a time that the cells can hold")
        placed = placed.withColumn("_row", F.monotonically_increasing_id())
        new = rank_in_groups(placed.where((q(key) == 0) | q(key).isNull()), ["_CELL", "_T"], ["_row"], "_k")
        top = self.cells(pending).select(F.col("cell").alias("_pixel"), F.col("t").alias("_slice"), "top")
        new = new.join(top, (F.col("_CELL") == F.col("_pixel")) & (F.col("_T") == F.col("_slice")), "left")
        index = F.coalesce(F.col("top"), F.lit(-1)) + 1 + F.col("_k")
        new = new.withColumn(key, F.col("_place").bitwiseAND(F.lit(~sky.OBJECT_BITS)).bitwiseOR(index)).drop("_pixel", "_slice", "top", "_k")
        return new.unionByName(placed.where((q(key) != 0) & q(key).isNotNull())).drop("_place", "_row")

    def append(self, df: DataFrame, snapid: str) -> DataFrame:
        """Add rows; returns the keys they got. Keys that are given must be new; they are looked for in their own cells."""
        self._check_columns(df)
        rows = cut(self._with_ids(self._conform(df), snapid))
        key = self.schema.primary_key
        if key:
            if rows.groupBy(q(key)).count().where("count > 1").limit(1).count():
                raise CatalogError("keys are not unique")
            there = self._stored(pending=snapid, touched=rows).select(q(key).alias("_old"))
            if rows.join(there, q(key) == F.col("_old"), "left_semi").limit(1).count():
                raise CatalogError("keys exist already; use an update")
        self._replace(rows, snapid)
        return rows.select(q(key)) if key else rows.limit(0)

    def upsert(self, df: DataFrame, on: str, snapid: str, insert: bool = True) -> DataFrame:
        """Rows of ``df`` overwrite those with the same ``on`` in the given columns only; others are added if ``insert``.

        Keys must be unique in ``df``, and in the stored rows they match. Returns the primary keys of the rows written.
        By primary key only the cells of the given keys are opened. By another column, that column alone is read of all
        cells to see which cells hold matches; of those cells the rows are read.
        """
        self._check_columns(df)
        if df.groupBy(q(on)).count().where("count > 1").limit(1).count():
            raise CatalogError(f"{on} is not unique in the rows to write")
        key = self.schema.primary_key or on
        new = cut(df)
        if on == self.schema.primary_key:
            spot = self.key_cell(q(on))
            near = new.where(q(on).isNotNull()).select(spot[0].alias("_CELL"), spot[1].alias("_T"))
        else:
            near = self._stored(pending=snapid).select(q(on).alias("_old"), "_CELL", "_T").join(new.select(q(on).alias("_on")), F.col("_old") == F.col("_on"), "left_semi")
        near = cut(near.select("_CELL", "_T").distinct())
        old = self._filled(self._stored(pending=snapid, touched=near))
        given = [c for c in new.columns if c != on]
        renamed = new.select(q(on).alias("_on"), *[q(c).alias(f"_new_{c}") for c in given])
        met = old.join(renamed, q(on) == F.col("_on"))
        fixed = met.select(*[(F.col(f"`_new_{c}`").cast(old.schema[c].dataType) if c in given and c != key else q(c)).alias(c) for c in self.schema.columns()])
        fixed = cut(self._row_cell(fixed).drop("_place"))
        if fixed.groupBy(q(key)).count().where("count > 1").limit(1).count():
            raise CatalogError(f"{on} is not unique in the table")
        written = fixed
        if insert:
            fresh = new.join(old.select(q(on).alias("_old")), q(on) == F.col("_old"), "left_anti")
            written = fixed.unionByName(cut(self._with_ids(self._conform(fresh), snapid)))
        self._replace(written, snapid, key=key, near=near)
        return written.select(q(key))

    def remove(self, keys: DataFrame, snapid: str) -> None:
        """Take out the rows whose primary key is in ``keys`` (one column of that name). Unknown keys are passed over."""
        key = self.schema.primary_key
        if not key:
            raise CatalogError("rows without a key cannot be removed")
        gone = cut(keys.select(q(key)).where(q(key).isNotNull()).distinct())
        spot = self.key_cell(q(key))
        near = cut(gone.select(spot[0].alias("_CELL"), spot[1].alias("_T")).distinct())
        nothing = self.spark.createDataFrame([], self._data_schema())
        self._replace(nothing, snapid, key=key, near=near, gone=gone)

    def _check_columns(self, df: DataFrame) -> None:
        unknown = [c for c in df.columns if c not in self.schema.columns()]
        if unknown:
            raise CatalogError(f"no such columns: {unknown}")

    def _replace(self, rows: DataFrame, snapid: str, key: str | None = None, near: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """Write the touched cells anew into the snapshot: their old rows and ``rows``.

        Touched: the cells of ``rows`` and, with ``key``, those of ``near`` in which an old row has a key that is in
        ``rows`` or ``gone`` (these old rows are left out).
        """
        before = cut(self.cells(snapid))
        touched = rows.select("_CELL", "_T").distinct()
        if key:
            again = (gone if gone is not None else rows).select(q(key).alias("_k"))
            old = self._stored(pending=snapid, touched=near)
            moved = old.join(again, q(key) == F.col("_k"), "left_semi").select("_CELL", "_T")
            touched = touched.unionByName(moved).distinct()
        touched = cut(touched)
        old = self._stored(pending=snapid, touched=touched)
        if key:
            old = old.join(again, q(key) == F.col("_k"), "left_anti")
        old = old.drop("_SNAP")
        rows = old.unionByName(rows.select(*old.columns))
        aside = f"data/_SNAP={snapid}-{len(self.folder.names('data'))}"
        # one file per small cell; adaptive execution splits a cell with most of the rows over several tasks and files
        # (and leaves many small cells on all cores: their files, not their bytes, take time)
        with setting(self.spark, "spark.sql.adaptive.coalescePartitions.minPartitionSize", "1b"):
            rows.hint("rebalance", "_CELL", "_T").write.partitionBy("_CELL", "_T").parquet(self.folder.at(aside))
        self._adopt(aside, snapid, before, touched)

    def _adopt(self, aside: str, snapid: str, before: DataFrame, touched: DataFrame) -> None:
        name = aside.rpartition("=")[2]
        written = self.spark.read.schema(self._data_schema()).parquet(self.folder.at(aside)) if self.folder.names(aside) != ["_SUCCESS"] else self.spark.createDataFrame([], self._data_schema())
        key = self.schema.primary_key
        top = F.max(q(key).bitwiseAND(F.lit(sky.OBJECT_BITS))).cast("long") if key else F.lit(0).cast("long")
        fresh = written.groupBy(F.col("_CELL").alias("cell"), F.col("_T").alias("t")).agg(F.count(F.lit(1)).alias("nrows"), top.alias("top"))
        same = touched.select(F.col("_CELL").alias("cell"), F.col("_T").alias("t"))
        rest = before.join(same, ["cell", "t"], "left_anti").select("cell", "t", "snapid", "nrows", "top")
        tops = before.select("cell", "t", F.col("top").alias("_old"))
        fresh = fresh.join(tops, ["cell", "t"], "left").select("cell", "t", F.lit(name).alias("snapid"), "nrows", F.greatest("top", "_old").alias("top"))
        cut(rest.unionByName(fresh)).coalesce(1).write.mode("overwrite").parquet(self.folder.at(f"cells/{snapid}/rows"))
        self.folder.write(f"cells/{snapid}/WRITTEN", "")

    def commit(self, snapid: str) -> None:
        if self.folder.exists(f"cells/{snapid}/WRITTEN"):
            self.folder.write(f"cells/{snapid}/COMMITTED", "")

    def rollback(self, snapid: str) -> None:
        for n in self.folder.names("data"):
            if n.removeprefix("_SNAP=").startswith(snapid):
                self.folder.delete(f"data/{n}")
        self.folder.delete(f"cells/{snapid}")

    def describe(self) -> str:
        s = self.schema
        lines = [f"table {self.name}: {self.nrows()} rows, {self.cells().count()} cells, level {s.level}, t0 {s.t0:g}, dt {s.dt:g}"]
        for g, columns in s.groups.items():
            lines.append(f"  {g}: " + ", ".join(f"{c}:{k}" for c, k in columns.items()))
        lines.append(f"  keys: primary {s.primary_key}, spatial {s.spatial_keys}, temporal {s.temporal_key}, exposure {s.exposure_key}")
        lines += [f"  alias {a} = {c}" for a, c in s.aliases.items()]
        return "\n".join(lines)


def _array_type(k: str) -> T.DataType:
    """'[n]base' (from dtype_of): n-fold array."""
    depth, base = k[1:].split("]")
    kind = spark_type(base)
    for _ in range(int(depth)):
        kind = T.ArrayType(kind)
    return kind


def _slice(cell: Column) -> Column:
    """Time slice of a cell or row id."""
    return F.shiftrightunsigned(cell, 32).bitwiseAND(F.lit(0xFFF)).cast("long")


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
