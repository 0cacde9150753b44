"""A database: list of roots (the first is written to), tables, joins, functions, transactions and queries."""

from __future__ import annotations

import ast
import importlib.util
import json
import time
from collections.abc import Callable
from contextlib import contextmanager
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.catalog.storage import Folder
from skyframe.catalog.table import CatalogError, Frame, Schema, Table
from skyframe.functions.registry import Registry
from skyframe.types import dtype_of


class Database:
    """Roots are paths separated by colons (or a list, which URIs need); none for a database of registered frames only."""

    def __init__(self, spark: SparkSession, roots: str | list[str] = "", snapid: str | None = None, udf_modules: list[str] | None = None):
        self.spark = spark
        self.roots = [r.rstrip("/") for r in (roots.split(":") if isinstance(roots, str) else roots) if r]
        self.frames: dict[str, Frame] = {}
        self.joins: dict[str, dict] = {}
        self.functions = Registry()
        self.snapid, self.pending, self.hooks = snapid, None, {}
        for root in reversed(self.roots):
            self._load_functions(root)
        for module in udf_modules or []:
            self.functions.register_module(importlib.import_module(module))

    # -------------------------------------------------------------- tables
    def register(self, name: str, df: DataFrame, **keys) -> Frame:
        """Make a DataFrame a table: primary_key, spatial_keys, temporal_key, exposure_key, aliases."""
        self.frames[name] = Frame(name, df, **keys)
        return self.frames[name]

    def _root_of(self, name: str) -> tuple[str, str] | None:
        """(root, table) of a name; 'db.table' is a table of the sibling folder db of a root."""
        options = [(r, name) for r in self.roots]
        if "." in name:
            db, table = name.split(".", 1)
            options = [(f"{r.rsplit('/', 1)[0]}/{db}", table) for r in self.roots]
        for root, table in options:
            folder = Folder(self.spark, root)
            if folder.exists(f"{table}/schema.json"):
                return root, table
            if folder.exists(f"{table}.follow"):
                return json.loads(folder.read(f"{table}.follow"))["root"], table
        return None

    def follow(self, table: str, root: str) -> None:
        """Read ``table`` in place from another root (any path Spark can read) as if it were in the first one."""
        if not Folder(self.spark, f"{root}/{table}").exists("schema.json"):
            raise CatalogError(f"no table {table} in {root}")
        Folder(self.spark, self.roots[0]).write(f"{table}.follow", json.dumps({"root": root.rstrip("/")}))

    def unfollow(self, table: str) -> None:
        Folder(self.spark, self.roots[0]).delete(f"{table}.follow")

    def table_exists(self, name: str) -> bool:
        return name in self.frames or self._root_of(name) is not None

    def table(self, name: str) -> Frame | Table:
        if name in self.frames:
            return self.frames[name]
        found = self._root_of(name)
        if found is None:
            raise CatalogError(f"no table {name}")
        return Table(self.spark, *found, snapid=self.snapid)

    def tables(self) -> list[str]:
        stored = [n for r in self.roots for n in Folder(self.spark, r).names() if Folder(self.spark, f"{r}/{n}").exists("schema.json")]
        return sorted({*self.frames, *stored})

    def create_table(self, name: str, definition: dict | Schema, ignore_if_exists: bool = False) -> Table:
        if self.table_exists(name):
            if ignore_if_exists:
                return self.table(name)
            raise CatalogError(f"table {name} exists")
        if not self.roots:
            raise CatalogError("the database has no root to write to")
        schema = definition if isinstance(definition, Schema) else Schema.from_definition(definition)
        return Table.create(self.spark, self.roots[0], name, schema)

    def drop_table(self, name: str) -> None:
        if self.frames.pop(name, None) is None:
            self.table(name).folder.delete()

    def define_alias(self, table: str, alias: str, column: str) -> None:
        t = self.table(table)
        if alias in t.schema.columns() or column not in t.schema.columns():
            raise CatalogError(f"cannot call column {column} {alias}")
        t.schema.aliases[alias] = column
        if isinstance(t, Table):
            t.save_schema()

    def create_group(self, table: str, group: str, definition: dict) -> None:
        """Add a column group; rows stored before have zeros there."""
        t = self.table(table)
        t.schema.add_group(group, definition)
        t.save_schema()

    # -------------------------------------------------------------- joins
    def define_join(self, name: str, type: str = "indirect", overwrite: bool = False, **definition) -> None:  # noqa: A002
        """Save a join. indirect: m1=(table, column), m2=(table, column), of one link
        table, or of two whose rows belong together one by one in the order of their keys; equi: left=(t, c), right=(t, c)."""
        known = self.join_definitions()
        if name in known and not overwrite:
            raise CatalogError(f"join {name} exists")
        if type == "indirect":
            for end in ("m1", "m2"):
                if len(tuple(definition[end])) != 2:
                    raise CatalogError(f"{end} is a table and a column")
        elif type not in ("equi", "xmatch"):
            raise CatalogError(f"unknown join type {type}")
        d = {"type": type, **{k: list(v) if isinstance(v, tuple) else v for k, v in definition.items()}}
        self.joins[name] = d
        if self.roots:
            Folder(self.spark, self.roots[0]).write(name.replace(":", "~") + ".join", json.dumps(d))

    def define_default_join(self, a: str, b: str, type: str = "indirect", overwrite: bool = False, **definition) -> None:  # noqa: A002
        """The join used when a query names both tables."""
        self.define_join(f".{a}:{b}", type, overwrite, **definition)

    def join_definitions(self) -> dict[str, dict]:
        out: dict[str, dict] = {}
        for root in reversed(self.roots):
            folder = Folder(self.spark, root)
            for n in folder.names():
                if n.endswith(".join"):
                    out[n[:-5].replace("~", ":")] = json.loads(folder.read(n))
        return {**out, **self.joins}

    def default_join(self, a: str, b: str) -> dict | None:
        return self.join_definitions().get(f".{a}:{b}")

    # -------------------------------------------------------------- functions
    def register_udf(self, f: Callable, name: str | None = None) -> None:
        """A Column builder or pandas UDF that queries can call."""
        self.functions.register(f, name)

    def _load_functions(self, root: str) -> None:
        """user.py of a local root; its functions go under __sky_name__ if it has one."""
        path = Path(root) / "user.py"
        if "://" not in root and path.exists():
            spec = importlib.util.spec_from_file_location(f"skyframe_user_{abs(hash(root))}", path)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            self.functions.register_module(module, getattr(module, "__sky_name__", ""))

    # -------------------------------------------------------------- transactions
    def in_transaction(self) -> bool:
        return self.pending is not None

    def begin_transaction(self, join: bool = False) -> str:
        """One writer at a time; ``join`` enters the transaction another Database object began."""
        if self.pending:
            raise CatalogError("already in a transaction")
        folder = Folder(self.spark, self.roots[0])
        folder.make()
        snapid = datetime.fromtimestamp(time.time(), timezone.utc).strftime("%Y%m%d%H%M%S.%f")
        if not folder.create("transaction.lock", snapid):
            if not join:
                raise CatalogError("another transaction is open")
            snapid = folder.read("transaction.lock")
        self.pending, self._touched = snapid, set()
        return snapid

    def on_commit(self, table: str, hook: Callable, priority: int = 0) -> None:
        """Call hook(db, table) at the commit of a table that was written to; priorities run from -1 to 10, low first."""
        if not -1 <= priority <= 10:
            raise ValueError("priorities go from -1 to 10")
        self.hooks.setdefault(table, []).append((priority, hook))

    def _stored_hooks(self, table: str) -> list[tuple[int, Callable]]:
        """Hooks of a table's definition: [name, priority, module, function, arguments]; called as function(db, table, *arguments)."""
        out = []
        for _, priority, module, function, *more in self.table(table).schema.commit_hooks:
            call = getattr(importlib.import_module(module), function)
            out.append((priority, lambda db, t, call=call, more=more: call(db, t, *(more[0] if more else ()))))
        return out

    def break_lock(self, older_than_s: float = 0.0) -> bool:
        """Take away the lock of a writer that has died; not one younger than ``older_than_s``. Whether there was one."""
        folder = Folder(self.spark, self.roots[0])
        if self.pending or not folder.exists("transaction.lock"):
            return False
        since = datetime.strptime(folder.read("transaction.lock"), "%Y%m%d%H%M%S.%f").replace(tzinfo=timezone.utc)
        if time.time() - since.timestamp() < older_than_s:
            return False
        folder.delete("transaction.lock")
        return True

    def commit(self) -> None:
        if not self.pending:
            raise CatalogError("no transaction")
        jobs = [(p, i, t, h) for t in sorted(self._touched) for i, (p, h) in enumerate([*self._stored_hooks(t), *self.hooks.get(t, [])])]
        for _, _, t, h in sorted(jobs, key=lambda j: j[:3]):
            h(self, t)
        for t in sorted(self._touched):
            self.table(t).commit(self.pending)
        Folder(self.spark, self.roots[0]).delete("transaction.lock")
        if self.snapid is not None:
            self.snapid = max(self.snapid, self.pending)
        self.pending = None

    def rollback(self) -> None:
        if not self.pending:
            raise CatalogError("no transaction")
        for t in sorted(self._touched):
            self.table(t).rollback(self.pending)
        Folder(self.spark, self.roots[0]).delete("transaction.lock")
        self.pending = None

    @contextmanager
    def transaction(self, join: bool = False):
        """Commit at the end, roll back on an error. Inside one that is open already nothing happens at the end."""
        if self.pending:
            yield self
            return
        self.begin_transaction(join)
        try:
            yield self
        except BaseException:
            self.rollback()
            raise
        self.commit()

    def write(self, table: str, df: DataFrame, mode: str = "append", on: str | None = None) -> DataFrame:
        """append, upsert or update ``df``; returns the keys of the rows written."""
        t = self.table(table)
        if not isinstance(t, Table):
            raise CatalogError(f"{table} is a registered frame")
        with self.transaction():
            self._touched.add(table)
            if mode == "append":
                return t.append(df, self.pending)
            return t.upsert(df, on or t.schema.primary_key, self.pending, insert=mode == "upsert")

    def remove(self, table: str, keys: DataFrame) -> None:
        """Take the rows with these primary keys out of a stored table; older snapshots keep them."""
        t = self.table(table)
        if not isinstance(t, Table):
            raise CatalogError(f"{table} is a registered frame")
        with self.transaction():
            self._touched.add(table)
            t.remove(keys, self.pending)

    def read(self, table: str, bounds=None, cells: list[tuple[int, int]] | None = None, with_cell: bool = False) -> DataFrame:
        """The table's rows. Of a stored table only cells that can meet ``bounds`` are opened, and of ``cells`` (pixel, slice)
        only those; ``with_cell`` adds _CELL and _T."""
        from skyframe.plans.bounds import make_canonical

        t = self.table(table)
        if isinstance(t, Table):
            return t.read(make_canonical(bounds) if isinstance(bounds, (list, tuple)) else bounds, self.pending, cells, with_cell)
        return t.read()

    # -------------------------------------------------------------- files
    def uri_path(self, uri: str) -> str:
        """Path of 'sky:table:group:file' or any other URI as it is."""
        if not uri.startswith("sky:"):
            return uri
        _, table, group, name = uri.split(":", 3)
        t = self.table(table)
        base = t.schema.fgroups.get(group, {}).get("path", f"files/{group}")
        suffix = t.schema.filters.get(group, "")
        return f"{t.folder.at(base)}/{name}{suffix}"

    def fetch_uris(self, df: DataFrame, column: str, out: str = "content", named: int = 10_000) -> DataFrame:
        """Join the content (binary) of the files that a column names; each distinct file is read once. Missing: null.

        Folders are listed, one listing each. Up to ``named`` distinct files are opened by name, beyond that all files of
        the folders, and the join picks those wanted.
        """
        prefixes = [r[0] for r in df.select(F.regexp_extract(column, r"^(sky:[^:]*:[^:]*:)", 1).alias("p")).where("p <> ''").distinct().collect()]
        path = F.col(column)
        for p in prefixes:  # as many as there are file groups
            suffix = self.uri_path(p + "\0").split("\0")
            path = F.when(F.startswith(F.col(column), F.lit(p)), F.concat(F.lit(suffix[0]), F.substring(column, len(p) + 1, 1 << 30), F.lit(suffix[1]))).otherwise(path)
        wanted = df.select(path.alias("_path")).where("_path IS NOT NULL").distinct()
        folders = [r[0] for r in wanted.select(F.regexp_replace("_path", "/[^/]*$", "").alias("f")).distinct().collect()]
        listed = {f: set(Folder(self.spark, f).names()) for f in folders}
        paths = [r[0] for r in wanted.limit(named + 1).collect()]
        there = [p for p in paths if p.rpartition("/")[2] in listed[p.rpartition("/")[0]]] if len(paths) <= named else [f for f, n in listed.items() if n]
        if not there:
            return df.withColumn(out, F.lit(None).cast("binary"))
        files = self.spark.read.format("binaryFile").load(there).select(F.regexp_replace("path", "^file:/+", "/").alias("_file"), F.col("content").alias(out))
        return df.withColumn("_at", F.regexp_replace(path, "^file:/+", "/")).join(files, F.col("_at") == F.col("_file"), "left").drop("_at", "_file")

    # -------------------------------------------------------------- queries
    def query(self, text: str, locals: dict | None = None):  # noqa: A002
        from skyframe.plans.query import BoundQuery

        return BoundQuery(self, text, dict(locals or {}))

    def define(self, text: str) -> None:
        """'name = expression of a, b' as a function: define('sq = lambda x: x * x')."""
        name, _, body = text.partition("=")
        tree = ast.parse(body.strip(), mode="eval").body
        if not isinstance(tree, ast.Lambda):
            raise ValueError("a definition is name = lambda arguments: expression")
        from skyframe.plans.expr import Translator

        names = [a.arg for a in tree.args.args]

        def f(*args):
            values = dict(zip(names, args))
            frame = self.spark.range(0)
            return _Typeless(frame, lambda n: values.get(n), lambda t, n: None, self.functions, {}).column(tree.body)

        class _Typeless(Translator):
            def _both(self, a, b):
                from pyspark.sql import types as T

                return T.DoubleType(), T.DoubleType()

            def kind(self, c):
                from pyspark.sql import types as T

                return T.DoubleType()

        self.functions.register(f, name.strip())

    def schema_of(self, df: DataFrame) -> dict[str, str]:
        return {f.name: dtype_of(f.dataType) for f in df.schema.fields}
