"""Queries over whole tables, without the filters of q36_collect_list and q44_insert_at."""

from pyspark.sql import functions as F

from skyframe.catalog.database import Database
from skyframe.queries import reference


def test_lists_hold_every_row(spark, tmp_path):
    rows = [(1, 2, 3), (1, 1, 1), (1, 4, 2), (2, 2, 1), (3, 1, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_linenumber long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = reference.queries()["q36_collect_all"](spark, str(tmp_path)).collect()
    assert {(r["l_orderkey"], r["lines"]) for r in got} == {(1, "1,2,3"), (2, "1"), (3, "1")}


def test_insert_at_given_ids_takes_every_row(spark, tmp_path):
    made = spark.range(45, 60).select(F.col("id").alias("c_custkey"), F.lit(1.5).alias("c_acctbal"), F.lit("A").alias("c_mktsegment"))
    made.write.parquet(f"{tmp_path}/customer.parquet")
    got = reference.queries()["q44_insert_all_at"](spark, str(tmp_path)).collect()
    assert {(r["custkey"], r["id"]) for r in got} == {(k, k * 2**32 + 7) for k in range(45, 60)}


def test_insert_at_with_many_rows_a_cell(spark, tmp_path):
    db = Database(spark, [str(tmp_path / "db")])
    db.register("many", spark.range(200).select(F.col("id").alias("k"), F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat")), primary_key="k", spatial_keys=["lon", "lat"])
    db.query("lon, lat, k + 0 AS n FROM many INTO marks AT (k / 100) * 4294967296 + k").write()
    assert {(r["n"], r["id"]) for r in db.read("marks").collect()} == {(k, k // 100 * 2**32 + k) for k in range(200)}
