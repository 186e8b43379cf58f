"""Registered queries on small tables of their own."""

from datetime import datetime

import pytest

from axisweave.plans import catalog

DAY = datetime(2020, 1, 1)


@pytest.fixture()
def folder(spark, tmp_path):
    """5,000 orders, each fifth with the coordinates of another, and one line item."""
    rows = [(k - k % 5 if k % 5 == 1 else k, k * 7 % 500 if k % 5 > 1 else k // 5, "O", float(k * 31 % 97), DAY, "1") for k in range(5000)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 1, 1, 1, 5.0, "F")], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("size", ["24k", "40k"])
def test_places_of_sorted_rows(spark, folder, size):
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": size, "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "40", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, x in conf.items():
        spark.conf.set(k, x)
    try:
        got = sorted((r["okey"], r["place"]) for r in catalog.QUERIES["sort_bedframe"](spark, folder).collect())
        o = catalog.orders(spark, folder).collect()
    finally:
        for k, x in old.items():
            spark.conf.set(k, x)
    half = -(-max(r["end"] for r in o) // 2)
    arm = lambda r: min(r["end"], 2 * half) - max(r["start"], half) > min(r["end"], half) - r["start"] if r["start"] < half < r["end"] else r["start"] >= half
    keys = [((int(r["chrom"][3:]), arm(r)), r["start"], r["end"]) for r in o]
    first = {}
    for i, k in enumerate(sorted(keys)):
        first.setdefault(k, i)
    assert got == sorted((r["okey"], first[k]) for r, k in zip(o, keys))
