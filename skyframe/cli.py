"""Command line: query, import, xmatch, footprint, admin, check. ``python -m skyframe.cli --db PATH COMMAND ...``"""

from __future__ import annotations

import argparse
import ast
import importlib
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skyframe.catalog.database import Database
from skyframe.catalog.table import Table
from skyframe.plans.bounds import T, beam, polygon, rectangle

#: What a --bounds text may call; its arguments must be plain values.
BOUNDS = {"beam": beam, "rectangle": rectangle, "polygon": polygon, "T": T}


def bounds_of(text: str):
    """'beam(10, 20, 3)', '[(rectangle(0, 0, 10, 10), T(54000, 55000)), 123]': read, never evaluated as code."""

    def value(n: ast.expr):
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in BOUNDS:
            return BOUNDS[n.func.id](*[value(a) for a in n.args], **{k.arg: value(k.value) for k in n.keywords})
        if isinstance(n, ast.List):
            return [value(e) for e in n.elts]
        if isinstance(n, ast.Tuple):
            return tuple(value(e) for e in n.elts)
        return ast.literal_eval(n)

    found = value(ast.parse(text.strip(), mode="eval").body)
    return found if isinstance(found, list) else [found]


def _importer_text(db, a):
    from skyframe.sources.text import parse_columns, read_text

    t = db.table(a.table)
    kinds = t.schema.columns()
    columns = parse_columns(a.columns) if a.columns else [(c, i + 1) for i, c in enumerate(c for c in kinds if c != t.schema.primary_key)]
    constants = dict(x.split("=", 1) for x in a.set or [])
    return read_text(db.spark, a.files, columns, kinds, a.delimiter, a.skip_header, tuple(a.dms or ()), tuple(a.hms or ()), constants, not a.force)


def _importer_fits(db, a):
    from skyframe.sources.fits import read_fits

    columns = dict(x.split("=", 1) if "=" in x else (x.lower(), x) for x in (a.columns or "").split(",") if x) or None
    return read_fits(db.spark, a.files, columns=columns, units=[int(u) for u in a.units.split(",")], constants=dict(x.split("=", 1) for x in a.set or [])).drop("notfound")


#: Importers by name: (database, arguments) → rows. Others can be added.
IMPORTERS = {"text": _importer_text, "fits": _importer_fits}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skyframe")
    p.add_argument("--db", default=".", help="database folder(s), separated by colons")
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query")
    q.add_argument("text")
    q.add_argument("--bounds")
    q.add_argument("--no-testbounds", action="store_true")
    q.add_argument("--nc", action="store_true", help="include rows of neighbouring cells' border zones")
    q.add_argument("--define", action="append", default=[], help="name=lambda arguments: expression")
    q.add_argument("--format", choices=("text", "fits", "null", "parquet"), default="text")
    q.add_argument("--output")
    i = sub.add_parser("import")
    i.add_argument("kind", help=f"{', '.join(sorted(IMPORTERS))}, exposures, sweeps, catalogs, or module:function of (database, arguments) that gives rows")
    i.add_argument("table")
    i.add_argument("files", nargs="+")
    i.add_argument("--columns")
    i.add_argument("--delimiter")
    i.add_argument("--skip-header", type=int, default=0)
    i.add_argument("--dms", nargs="*")
    i.add_argument("--hms", nargs="*")
    i.add_argument("--set", nargs="*")
    i.add_argument("--units", default="1")
    i.add_argument("--force", action="store_true")
    i.add_argument("--exposures", help="exposure table (import exposures, catalogs)")
    i.add_argument("--survey", default="")
    i.add_argument("--mjd-import", type=int, default=0, help="day of import (import catalogs)")
    g = sub.add_parser("ingest", help="import new exposure files under a folder, then associate")
    o = sub.add_parser("associate", help="make objects of detections that have none")
    for s in (g, o):
        s.add_argument("detections")
        s.add_argument("--radius", type=float, default=1.0, help="arc seconds")
    o.add_argument("objects")
    o.add_argument("links")
    g.add_argument("exposures")
    g.add_argument("folder")
    g.add_argument("--objects", nargs=2, metavar=("OBJECTS", "LINKS"))
    g.add_argument("--survey", default="")
    x = sub.add_parser("xmatch")
    x.add_argument("table_from")
    x.add_argument("table_to")
    x.add_argument("--radius", type=float, default=1.0, help="arc seconds")
    x.add_argument("--neighbors", type=int, default=1)
    f = sub.add_parser("footprint")
    f.add_argument("query", help="a query of two columns: longitude, latitude")
    f.add_argument("--dx", type=float, default=0.5)
    f.add_argument("--output")
    a = sub.add_parser("admin")
    asub = a.add_subparsers(dest="action", required=True)
    c = asub.add_parser("create")
    c.add_argument("table")
    c.add_argument("columns", nargs="*", help="NAME:TYPE, type f8 if absent")
    c.add_argument("--schema", help="YAML definition")
    c.add_argument("--primary-key")
    c.add_argument("--spatial-keys")
    c.add_argument("--temporal-key")
    for name in ("desc", "snapshots", "drop", "vacuum", "rebuild", "unfollow"):
        asub.add_parser(name).add_argument("table")
    asub.add_parser("tables")
    asub.add_parser("unlock", help="take away the lock of a writer that has died").add_argument("--older-than", type=float, default=3600.0, help="seconds")
    alias = asub.add_parser("alias", help="another name of a column")
    for word in ("table", "alias", "column"):
        alias.add_argument(word)
    group = asub.add_parser("group", help="add a column group")
    group.add_argument("table")
    group.add_argument("group")
    group.add_argument("columns", nargs="+", help="NAME:TYPE, type f8 if absent")
    join = asub.add_parser("join", help="the join queries use: by a link table's columns, or by equal columns")
    join.add_argument("left")
    join.add_argument("right")
    join.add_argument("--links", nargs=3, metavar=("TABLE", "M1", "M2"))
    join.add_argument("--on", nargs=2, metavar=("LEFT_COLUMN", "RIGHT_COLUMN"))
    follow = asub.add_parser("follow", help="use a table of another root without copying it")
    follow.add_argument("table")
    follow.add_argument("root")
    k = sub.add_parser("check")
    k.add_argument("what", choices=("nrows", "catalog", "objects"))
    k.add_argument("tables", nargs="+", help="table, or for objects: detections objects links")
    k.add_argument("--radius", type=float, default=1.0)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    db = Database(spark, a.db)
    return {"query": _query, "import": _import, "ingest": _ingest, "associate": _associate, "xmatch": _xmatch, "footprint": _footprint, "admin": _admin, "check": _check}[a.command](db, a)


def _query(db, a) -> int:
    from skyframe.sources.fits import write_fits, write_fits_parts
    from skyframe.sources.text import formatted, write_text

    for d in a.define:
        db.define(d)
    q = db.query(a.text)
    options = {"bounds": bounds_of(a.bounds) if a.bounds else None, "testbounds": not a.no_testbounds, "include_cached": a.nc}
    if q.query.into is not None:
        print(f"{q.write(**options).count()} rows written")
        return 0
    df = q.dataframe(**options)
    if a.format == "null":
        print(f"{df.count()} rows")
    elif a.format == "fits":
        if a.output and a.output.endswith("/"):  # a folder: files written by the tasks
            print(f"{write_fits_parts(df, a.output.rstrip('/')).count()} files")
        else:
            write_fits(df, a.output or "output.fits")
    elif a.format == "parquet":
        df.write.parquet(a.output or "output.parquet")
    elif a.output:
        write_text(df, a.output)
    else:
        print("# " + " ".join(df.columns))
        for row in formatted(df).toLocalIterator():
            print(row[0])
    return 0


def _import(db, a) -> int:
    from skyframe.sources import surveys

    if a.kind == "exposures":
        print(f"{surveys.import_exposures(db, a.table, a.exposures, a.files, a.survey, create=True).count()} exposures")
        return 0
    if a.kind == "catalogs":
        print(f"{surveys.import_extracted(db, a.table, a.exposures, a.files, a.mjd_import)} exposures")
        return 0
    if a.kind == "sweeps":
        rows = surveys.read_sweeps(db.spark, a.files)
        if not db.table_exists(a.table):
            db.create_table(a.table, surveys._definition(db.schema_of(rows), "sdss_id", None, "run"))
    else:
        rows = _importer(a.kind)(db, a)
    print(f"{db.write(a.table, rows).count()} rows")
    return 0


def _importer(kind: str):
    if kind in IMPORTERS:
        return IMPORTERS[kind]
    module, _, name = kind.partition(":")
    if not name:
        raise ValueError(f"no importer {kind}")
    return getattr(importlib.import_module(module), name)


def _ingest(db, a) -> int:
    from skyframe.sources.surveys import ingest

    print(f"{ingest(db, a.detections, a.exposures, a.folder, a.survey, tuple(a.objects) if a.objects else None, a.radius / 3600)} files")
    return 0


def _associate(db, a) -> int:
    from skyframe.operators.associate import make_objects

    print("{} new objects, {} links".format(*make_objects(db, a.detections, a.objects, a.links, a.radius / 3600)))
    return 0


def _xmatch(db, a) -> int:
    from skyframe.operators.associate import match_catalogues

    one, two = db.table(a.table_from), db.table(a.table_to)
    s1, s2 = one.schema, two.schema
    links = match_catalogues(db.read(a.table_from), s1.primary_key, tuple(s1.spatial_keys), db.read(a.table_to), s2.primary_key, tuple(s2.spatial_keys), a.radius / 3600, a.neighbors)
    name = f"_{a.table_from}_to_{a.table_to}"
    if not db.table_exists(name):
        columns = [("xm_id", "u8"), ("m1", "u8"), ("m2", "u8"), ("dist", "f4"), ("nr", "u1"), ("ra", "f8"), ("dec", "f8")]
        db.create_table(name, {"schema": {"main": {"columns": columns, "primary_key": "xm_id", "spatial_keys": ["ra", "dec"]}}, "aliases": {"_M1": "m1", "_M2": "m2", "_DIST": "dist", "_NR": "nr"}})
        db.define_default_join(a.table_from, a.table_to, "indirect", m1=(name, "m1"), m2=(name, "m2"))
        db.define_default_join(a.table_to, a.table_from, "indirect", m1=(name, "m2"), m2=(name, "m1"))
    print(f"{db.write(name, links.drop('xm_id')).count()} links")
    return 0


def _footprint(db, a) -> int:
    from skyframe.operators.aggregate import coverage

    df = db.query(a.query).dataframe()
    counts = coverage(df, F.col(f"`{df.columns[0]}`"), F.col(f"`{df.columns[1]}`"), a.dx)
    if a.output:
        counts.write.parquet(a.output)
    else:
        for r in counts.orderBy("i", "j").toLocalIterator():
            print(r["i"], r["j"], r["n"])
    return 0


def _admin(db, a) -> int:
    if a.action == "create":
        if a.schema:
            from skyframe.sources.par import read_definition

            with open(a.schema) as f:
                definition = read_definition(f.read())
        else:
            columns = [tuple(c.split(":", 1)) if ":" in c else (c, "f8") for c in a.columns]
            group = {"columns": columns, "primary_key": a.primary_key, "spatial_keys": a.spatial_keys.split(",") if a.spatial_keys else None, "temporal_key": a.temporal_key}
            definition = {"schema": {"main": group}}
        db.create_table(a.table, definition)
    elif a.action == "alias":
        db.define_alias(a.table, a.alias, a.column)
    elif a.action == "group":
        db.create_group(a.table, a.group, {"columns": [tuple(c.split(":", 1)) if ":" in c else (c, "f8") for c in a.columns]})
    elif a.action == "join":
        if a.links:
            db.define_default_join(a.left, a.right, "indirect", overwrite=True, m1=(a.links[0], a.links[1]), m2=(a.links[0], a.links[2]))
        else:
            db.define_default_join(a.left, a.right, "equi", overwrite=True, left=(a.left, a.on[0]), right=(a.right, a.on[1]))
    elif a.action == "unlock":
        print("unlocked" if db.break_lock(a.older_than) else "no lock of that age")
    elif a.action == "tables":
        print("\n".join(db.tables()))
    elif a.action == "drop":
        db.drop_table(a.table)
    elif a.action == "follow":
        db.follow(a.table, a.root)
    elif a.action == "unfollow":
        db.unfollow(a.table)
    else:
        t: Table = db.table(a.table)
        if a.action == "desc":
            print(t.describe())
        elif a.action == "snapshots":
            for i, ok in t.snapshots():
                print(i, "committed" if ok else "failed", t.cells_in_snapshot(i).count(), "cells")
        elif a.action == "vacuum":
            print("\n".join(t.vacuum()))
        elif a.action == "rebuild":
            t.rebuild_catalog()
    return 0


def _check(db, a) -> int:
    if a.what == "nrows":
        bad = [t for t in a.tables if db.table(t).nrows() != db.read(t).count()]
    elif a.what == "catalog":
        bad = [t for t in a.tables if db.table(t).check_catalog().count()]
    else:
        from skyframe.operators.associate import sanity

        det, obj, links = (db.read(t) for t in a.tables)
        bad = [r["check"] for r in sanity(det.withColumnRenamed("mjd_obs", "mjd") if "mjd_obs" in det.columns else det, obj, links, a.radius / 3600).where("n > 0").collect()]
    print("ok" if not bad else f"failed: {bad}")
    return int(bool(bad))


if __name__ == "__main__":
    sys.exit(main())
