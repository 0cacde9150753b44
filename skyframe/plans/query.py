"""From a query text to one DataFrame plan, and the ways to run it."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.catalog.table import Table
from skyframe.functions import borders, pixels, sky
from skyframe.plans import joins
from skyframe.plans.bounds import Bounds, make_canonical
from skyframe.plans.expr import Translator
from skyframe.plans.joins import q
from skyframe.plans.parser import QueryError, Source, parse
from skyframe.types import zero

PSEUDO = ("_CELLID", "_CELLPATH", "_ROWNUM", "_ROWID", "_ROWIDX", "_CACHED")


class BoundQuery:
    """A parsed query over a database. Options everywhere: bounds, cells, testbounds, include_cached, compat_nulls."""

    def __init__(self, db, text: str, variables: dict):
        self.db, self.text, self.variables = db, text, variables
        self.query = parse(text)
        self.tables = {s.name: db.table(s.table) for s in self.query.sources}

    # -------------------------------------------------------------- join tree
    def tree(self) -> tuple[str, list[tuple[str, str, dict]]]:
        """Root, and (parent, child, how) in an order in which parents come first."""
        sources = {s.name: s for s in self.query.sources}
        parent: dict[str, tuple[str, dict]] = {}
        for s in self.query.sources:
            if "matchedto" in s.args:
                if s.args["matchedto"] not in sources:
                    raise QueryError(f"{s.name} is matched to {s.args['matchedto']}, which the query does not name")
                parent[s.name] = (s.args["matchedto"], {"type": "xmatch"})
        for a in self.query.sources:
            for b in self.query.sources:
                if a.name != b.name and b.name not in parent and parent.get(a.name, ("",))[0] != b.name:
                    if (d := self.db.default_join(a.table, b.table)) and not self._above(parent, a.name, b.name):
                        parent[b.name] = (a.name, d)
        roots = [n for n in sources if n not in parent]
        if len(roots) != 1:
            raise QueryError(f"the tables need one root, and joins to all others; roots: {roots or 'none'}")
        if sources[roots[0]].optional:
            raise QueryError("the root table may not be outer")
        order, done = [], [roots[0]]
        while len(done) <= len(parent):
            step = [(p, c, d) for c, (p, d) in parent.items() if p in done and c not in done]
            if not step:
                raise QueryError("the joins run in a circle")
            order += step
            done += [c for _, c, _ in step]
        return roots[0], order

    @staticmethod
    def _above(parent: dict, start: str, wanted: str) -> bool:
        while start in parent:
            start = parent[start][0]
            if start == wanted:
                return True
        return False

    # -------------------------------------------------------------- plan
    def _frame(self, s: Source, bounds: Bounds | None, cells: list[int] | None = None, near: bool = False, with_cell: bool = False) -> DataFrame:
        spots = None
        if cells and isinstance(self.tables[s.name], Table):
            spots = [(c & ~(0xFFF << 32), (c >> 32) & 0xFFF) for c in map(int, cells)]
            if near:
                beside = pixels.adjacency(self.tables[s.name].schema.level)
                spots = sorted({(o, t) for c, t in spots for o in (c, *beside.get(c, ()))})
        df = self.db.read(s.table, bounds, spots, with_cell)
        return df.select(*[q(c).alias(f"{s.name}.{c}") for c in df.columns])

    def _key(self, name: str, what: str = "primary_key") -> str:
        s = self.tables[name].schema
        value = getattr(s, what)
        if not value:
            raise QueryError(f"table {name} has no {what}")
        return value

    def _joined(self, bounds: Bounds | None, compat_nulls: bool, cells: list[int] | None = None, near: bool = False, exact: bool = True) -> tuple[DataFrame, str]:
        """The join tree as one plan. A table matched by position is pruned to the bounds and the reach of the match; every
        table that must be there to the intervals; one joined by key to the cells of the keys (as partitions of the join)."""
        root, order = self.tree()
        sources = {s.name: s for s in self.query.sources}
        df = self._frame(sources[root], bounds, cells, near).withColumn(f"{root}._ISNULL", F.lit(False))
        # degrees that a table's rows can lie from a row in bounds; untested rows of a touched cell reach one pixel farther
        reach: dict[str, float | None] = {root: 0.0 if exact else 2 * pixels.pixel_radius(self.tables[root].schema.level)}
        for parent, child, d in order:
            s = sources[child]
            kind = {**d, **{k: v for k, v in s.args.items() if k in ("nmax", "dmax")}}
            outer = s.optional or (kind.get("outer", False) and "inner" not in s.args)
            matched = kind["type"] == "xmatch"
            reach[child] = reach[parent] + float(kind.get("dmax", 1.0)) / 3600 if matched and reach[parent] is not None else None
            limits = bounds.padded(reach[child], times=not outer) if bounds is not None and not near else None
            stored = isinstance(self.tables[child], Table)
            right = self._frame(s, limits, with_cell=stored)
            a = lambda c: f"{parent}.{c}"  # noqa: E731, B023
            b = lambda c: f"{child}.{c}"  # noqa: E731, B023
            place = self.tables[child].key_cell if stored and self.tables[child].schema.primary_key else None
            if matched:
                pos = lambda n, f: tuple(f(c) for c in self._key(n, "spatial_keys"))
                df = joins.crossmatch(df, a(self._key(parent)), pos(parent, a), right, b(self._key(child)), pos(child, b), int(kind.get("nmax", 1)), float(kind.get("dmax", 1.0)), outer, f"{child}.", place)
            elif kind["type"] == "equi":
                df = joins.key_join(df, a(kind["left"][1]), right, b(kind["right"][1]), outer, f"{child}.", place if kind["right"][1] == self.tables[child].schema.primary_key else None)
            else:
                df = self._linked(df, kind, s, a(self._key(parent)), right, b(self._key(child)), outer, f"{child}.", place)
            df = df.drop(*[f"{child}.{c}" for c in ("_CELL", "_T") if stored])
            if outer and compat_nulls:
                kinds = {f.name: f.dataType for f in right.schema.fields}
                df = df.select(*[F.coalesce(q(c), zero(kinds[c])).alias(c) if c in kinds else q(c) for c in df.columns])
        return df, root

    def _linked(self, df, kind, s, left_key, right, right_key, outer, prefix, place) -> DataFrame:
        if kind["m1"][0] != kind["m2"][0]:
            links = joins.side_by_side(*[(self.db.read(t), self.db.table(t).schema.primary_key, self.db.table(t).schema.resolve(c)) for t, c in (kind["m1"], kind["m2"])])
            return joins.link_join(df, left_key, links, "m1", "m2", right, right_key, outer, None, None, prefix, place)
        link = self.db.table(kind["m1"][0])
        columns = lambda n: link.schema.resolve(n)
        m1, m2 = columns(kind["m1"][1]), columns(kind["m2"][1])
        rank, dist = columns("_NR") or columns("nr"), columns("_DIST") or columns("dist")
        if s.args.get("nmax") is not None and not rank or s.args.get("dmax") and not dist:
            raise QueryError(f"the link table {kind['m1'][0]} has no rank or distance to cut on")
        if kind["m1"][0] in (s.table,):  # the child holds the foreign key: a plain key join
            return joins.key_join(df, left_key, right, f"{prefix}{m1}", outer, prefix)
        links = self.db.read(kind["m1"][0])
        parent_table = self.tables[left_key.split(".")[0]]
        if kind["m1"][0] == getattr(parent_table, "name", None) and m1 == parent_table.schema.primary_key:
            return joins.key_join(df, f"{left_key.split('.')[0]}.{m2}", right, right_key, outer, prefix, place)
        nmax = kind.get("nmax", 1 if rank else None)
        links = joins.link_cuts(links, rank, dist, nmax, float(kind.get("dmax", 0) or 0))
        return joins.link_join(df, left_key, links, m1, m2, right, right_key, outer, rank, dist, prefix, place)

    def _position(self, root: str) -> tuple[Column | None, Column | None]:
        s = self.tables[root].schema.spatial_keys
        return (q(f"{root}.{s[0]}"), q(f"{root}.{s[1]}")) if s else (None, None)

    def _cell(self, root: str) -> Column:
        """Cell of a root row: of its key where the table is stored (keys are row ids), else of its position and time."""
        schema = self.tables[root].schema
        if isinstance(self.tables[root], Table) and schema.primary_key:
            return sky.cell_of_id(q(f"{root}.{schema.primary_key}"), schema.level)
        lon, lat = self._position(root)
        if lon is None:
            return F.lit(sky.OBJECT_BITS).cast("long")
        t = q(f"{root}.{schema.temporal_key}") if schema.temporal_key else None
        return sky.cell_of_id(sky.position_id(lon, lat, t, t0=schema.t0, dt=schema.dt), schema.level)

    def dataframe(self, bounds=None, cells: list[int] | None = None, testbounds: bool = True, include_cached: bool = False, compat_nulls: bool = True, with_cell: bool = False) -> DataFrame:
        """The query's result as a DataFrame (INTO is left out).

        ``cells``: only these cells. ``testbounds=False``: cells that cannot meet the bounds are left out, but rows of the
        others are not tested. ``include_cached``: each row also appears in the neighbouring cells whose border is within
        30 arc seconds of it, with _CACHED true and that cell's _CELLID. ``with_cell``: add _CELLID.
        """
        limits = bounds if isinstance(bounds, Bounds) else make_canonical(bounds)
        df, root = self._joined(limits, compat_nulls, cells, include_cached, testbounds)
        schema = self.tables[root].schema
        lon, lat = self._position(root)
        used = {n.id if isinstance(n, ast.Name) else n.attr for e in [*[i.tree for i in self.query.items], self.query.where] if e is not None for n in ast.walk(e) if isinstance(n, (ast.Name, ast.Attribute))}
        need_cell = with_cell or cells or include_cached or bool(used & set(PSEUDO)) or (limits is not None and limits.cells) or not testbounds
        if need_cell:
            df = df.withColumn("_CELLID", self._cell(root))
        if limits is not None:
            if testbounds:
                times = [q(f"{n}.{t.schema.temporal_key}") for n, t in self.tables.items() if t.schema.temporal_key]
                df = df.where(limits.test(lon, lat, times, sky.static_cell(F.col("_CELLID")) if limits.cells else None))
            elif (found := limits.static_pixels(schema.level)) is not None:
                df = df.where(sky.static_cell(F.col("_CELLID")).isin(found[0]))
        if include_cached:
            df = self._with_halo(df, lon, lat, schema.level)
        elif "_CACHED" in used:
            df = df.withColumn("_CACHED", F.lit(False))
        if cells:
            df = df.where(F.col("_CELLID").isin([int(c) for c in cells]))
        if "_CELLPATH" in used:
            df = df.withColumn("_CELLPATH", sky.cell_path(F.col("_CELLID"), schema.level, schema.t0, schema.dt))
        if used & {"_ROWNUM", "_ROWIDX", "_ROWID"}:
            df = self._numbered(df, root)
        return self._selected(df, root, with_cell)

    def _numbered(self, df: DataFrame, root: str) -> DataFrame:
        """_ROWNUM: 0-based number of a row within its cell, in order of the root's key; _ROWIDX the same, _ROWID as an id."""
        from skyframe.operators.sequence import rank_in_groups

        key = self.tables[root].schema.primary_key
        order = [f"{root}.{key}"] if key else df.columns[:1]
        tagged = df.withColumn("__o", q(order[0])).withColumn("__u", F.monotonically_increasing_id())
        placed = rank_in_groups(tagged, ["_CELLID"], ["__o", "__u"], "_ROWNUM").drop("__o", "__u")
        return placed.withColumn("_ROWIDX", F.col("_ROWNUM")).withColumn("_ROWID", sky.id_in_cell(F.col("_CELLID"), F.col("_ROWNUM")))

    def _with_halo(self, df: DataFrame, lon: Column, lat: Column, level: int, margin: float = 30 / 3600) -> DataFrame:
        """Rows of the border zone once more per neighbouring cell.

        Sixteen points on a circle of twice the margin hit every cell within the margin (corners of cells are wider than 50
        degrees, and at this distance those show more than 22.5 degrees of the circle); the distance to its border decides.
        """
        time = F.col("_CELLID").bitwiseAND(F.lit(0xFFF << 32))
        own = sky.static_cell(F.col("_CELLID"))
        others = F.array_distinct(F.filter(sky.cells_around(lon, lat, sky.circle(2 * margin, 16), level), lambda c: c != own))
        halo = df.withColumn("__c", F.explode(others)).where(borders.within(lon, lat, F.col("__c"), level, margin))
        halo = halo.withColumn("_CELLID", F.col("__c").bitwiseOR(time)).drop("__c")
        return df.withColumn("_CACHED", F.lit(False)).unionByName(halo.withColumn("_CACHED", F.lit(True)))

    # -------------------------------------------------------------- select and where
    def _selected(self, df: DataFrame, root: str, with_cell: bool) -> DataFrame:
        aliases: dict[str, str] = {}

        def member(table: str, name: str) -> Column | None:
            t = self.tables.get(table)
            if t is None or not name:
                return None
            if name in ("_ISNULL", "_NR", "_DIST"):
                return q(f"{table}.{name}") if f"{table}.{name}" in tr.frame.columns else F.lit(0) if name == "_NR" else F.lit(0.0)
            c = t.schema.resolve(name)
            return q(f"{table}.{c}") if c and f"{table}.{c}" in tr.frame.columns else None

        def resolve(name: str) -> Column | None:
            if name in aliases:
                return q(aliases[name])
            for table in [root, *[n for n in self.tables if n != root]]:
                if (c := member(table, name)) is not None and name not in ("_ISNULL", "_NR", "_DIST"):
                    return c
            return q(name) if name in PSEUDO and name in tr.frame.columns else None

        tr = Translator(df, resolve, member, self.db.functions, self.variables, self.db.fetch_uris)
        out: list[tuple[str, str]] = []
        for item in self.query.items:
            if item.tree is None:
                named = self._wildcard(item.text, root, out)
                pairs = [(n, c) for n, c in named]
            else:
                label = item.names[0] if len(item.names) == 1 else item.text.replace(" ", "")
                pairs = tr.columns(item.tree, label)
                if len(item.names) > 1:
                    if len(item.names) != len(pairs):
                        raise QueryError(f"{item.text} has {len(pairs)} columns, not {len(item.names)}")
                    pairs = [(n, c) for n, (_, c) in zip(item.names, pairs)]
                elif len(item.names) == 1 and len(pairs) == 1:
                    pairs = [(item.names[0], pairs[0][1])]
            for name, c in pairs:
                inner = f"__s{len(out)}"
                tr.frame = tr.frame.withColumn(inner, c)
                out.append((name, inner))
                if item.tree is not None:
                    aliases[name] = inner
        if self.query.where is not None:
            for cond in tr.conditions(self.query.where):  # one by one and bare, so that scans can take them over; null is no
                tr.frame = tr.frame.where(cond)
        seen: dict[str, int] = {}
        final = []
        for name, inner in out:
            seen[name] = seen.get(name, -1) + 1
            final.append(q(inner).alias(name if not seen[name] else f"{name}_{seen[name]}"))
        if with_cell and "_CELLID" not in seen:
            final.append(q("_CELLID"))
        return tr.frame.select(*final)

    def _wildcard(self, text: str, root: str, out: list) -> list[tuple[str, Column]]:
        """* : the root's columns, then the others' (with their table's name in front where taken); tab.*: always in front."""
        if text == "*":
            taken, named = {n for n, _ in out}, []
            for t in [root, *[s.name for s in self.query.sources if s.name != root]]:
                for c in self.tables[t].schema.columns():
                    name = c if c not in taken else f"{t}.{c}"
                    taken.add(name)
                    named.append((name, q(f"{t}.{c}")))
            return named
        t = text[:-2]
        if t not in self.tables:
            raise QueryError(f"no table {t} in the query")
        return [(f"{t}.{c}", q(f"{t}.{c}")) for c in self.tables[t].schema.columns()]

    # -------------------------------------------------------------- running
    def fetch(self, **options) -> pd.DataFrame | DataFrame:
        """The result on the driver (the caller vouches for its size); with INTO: the keys written, as a DataFrame."""
        if self.query.into is not None:
            return self.write(**options)
        return self.dataframe(**_known(options)).toPandas()

    def iterate(self, return_blocks: bool = False, filter: Callable | None = None, **options) -> Iterator:  # noqa: A002
        """Rows one by one (or pandas blocks), partition by partition. ``filter``: block → block, applied in the cluster."""
        df = self.dataframe(**_known(options))
        if filter is not None:
            df = df.mapInPandas(lambda blocks: (filter(b) for b in blocks), df.schema)
        if not return_blocks:
            yield from df.toLocalIterator(prefetchPartitions=True)
            return
        block, names = [], df.columns
        for row in df.toLocalIterator():
            block.append(tuple(row))
            if len(block) == 10_000:
                yield pd.DataFrame(block, columns=names)
                block = []
        if block:
            yield pd.DataFrame(block, columns=names)

    def fetch_cell(self, cell: int, **options) -> pd.DataFrame:
        return self.dataframe(cells=[cell], **_known(options)).toPandas()

    def count(self, **options) -> int:
        return self.dataframe(**_known(options)).count()

    def write(self, **options) -> DataFrame:
        """Run SELECT ... INTO: append, update, upsert, or insert at given keys; returns the keys written."""
        from skyframe.catalog.table import Schema

        into = self.query.into
        df = self.dataframe(**_known(options))
        if into.key is not None:
            key = f"{into.column or '_key'}"
            kind = [i for i in self.query.items]
            self.query.items = [*kind, _item(into.key, "__into")]
            try:
                df = self.dataframe(**_known(options))
            finally:
                self.query.items = kind
            renamed = self.db.table(into.table).schema.resolve(into.column) if into.column and self.db.table_exists(into.table) else into.column
            if into.mode == "at":
                renamed = self.db.table(into.table).schema.primary_key if self.db.table_exists(into.table) else "id"
            key = (renamed or key).lstrip("_") or "id"
            df = df.drop(*[c for c in df.columns if c == key]).withColumnRenamed("__into", key)
        if not self.db.table_exists(into.table):
            columns = {c: k for c, k in self.db.schema_of(df).items()}
            spatial = into.args.get("spatial_keys")
            has_key = into.key is not None
            pk = key if has_key else "id"
            schema = Schema({"main": ({} if has_key else {pk: "u8"}) | columns}, pk, list(spatial) if spatial else None, into.args.get("temporal_key"))
            self.db.create_table(into.table, schema)
        else:
            table = self.db.table(into.table)
            fresh = {c: k for c, k in self.db.schema_of(df).items() if c not in table.schema.columns()}
            if fresh:
                if into.mode == "append":
                    raise QueryError(f"INTO without WHERE cannot add columns: {list(fresh)}")
                number = 1 + max([int(g[4:]) for g in table.schema.groups if g.startswith("auto") and g[4:].isdigit()], default=0)
                self.db.create_group(into.table, f"auto{number:03d}", {"columns": list(fresh.items())})
        mode = {"append": "append", "update": "update", "upsert": "upsert", "at": "upsert"}[into.mode]
        return self.db.write(into.table, df, mode, key if into.key is not None else None)

    def execute(self, kernels: list, group_by_static_cell: bool = False, **options) -> Iterator:
        """Run [mapper, reducer, ...] over the rows; yields what the last kernel yields.

        mapper(rows): pandas rows of one cell (``rows.attrs['cell_id']``), yields (key, value) pairs, or results if it is
        the only kernel. reducer(key, values): values one by one, yields likewise. A kernel may be (function, more
        arguments...). A cell may come in several blocks, unless ``group_by_static_cell``: then all rows of a pixel come at
        once, in order of time with the static cell's last. Nothing else about order or block size is promised. Values and
        keys must pickle; equal keys must pickle alike.
        """
        from skyframe.operators.mapreduce import chain

        df = self.dataframe(with_cell=True, **_known(options))
        return chain(df, kernels, group_by_static_cell)


def _item(tree: ast.expr, name: str):
    from skyframe.plans.parser import Item

    return Item(ast.unparse(tree), tree, [name])


def _known(options: dict) -> dict:
    names = ("bounds", "cells", "testbounds", "include_cached", "compat_nulls")
    unknown = set(options) - set(names) - {"nworkers", "progress_callback"}
    if unknown:
        raise TypeError(f"unknown options: {sorted(unknown)}")
    return {k: v for k, v in options.items() if k in names}

