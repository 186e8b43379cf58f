"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisweave.llm.text import dropped, stored


def _roots(parent: DataFrame) -> DataFrame:
    """id and root of a forest given as id and root (a smaller id each): pointers are doubled until none changes."""
    parent = old = stored(parent, "parents")
    while True:
        new = parent
        for k in range(2):  # two doublings a table
            up = parent.select(F.col("id").alias("_at"), F.col("root").alias("_up"))
            new = new.join(up, F.col("root") == F.col("_at"), "left").select("id", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("_moved"))
        new = stored(new, "parents")
        dropped(old)
        parent, old = new.drop("_moved"), new
        if new.where("_moved").isEmpty():
            return parent


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns id and component (smallest id reachable) for every id that an edge names.

    In each round every id hooks to its smallest neighbour if that is smaller, the trees are flattened by pointer
    doubling, and the edges are rewritten between roots; at least half of the ids that edges still name are gone
    after each round. Tables are written to the shared folder after each step. Neighbours are never gathered:
    hooking is a grouped minimum, all else are joins. Self edges and nulls are ignored; a table without edges gives no rows.
    """
    e = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    label = None
    while not e.isEmpty():
        first = e
        root = _roots(e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root")))
        to = root.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
        if label is None:
            own = root.select(F.col("root").alias("id")).distinct().select("id", F.col("id").alias("component"))
            label = root.select("id", F.col("root").alias("component")).unionByName(own)
            seen = e.select(F.col("v").alias("id")).distinct().join(label.select("id"), "id", "left_anti")
            label = stored(label.unionByName(seen.select("id", F.col("id").alias("component"))), "components")
        else:
            label = stored(label.join(to, F.col("component") == F.col("_id"), "left").select("id", F.coalesce("_root", "component").alias("component")), "components")
        e = e.join(to, F.col("u") == F.col("_id"), "left").select(F.coalesce("_root", "u").alias("u"), "v")
        e = e.join(to, F.col("v") == F.col("_id"), "left").select("u", F.coalesce("_root", "v").alias("v")).where("u <> v")
        was, e = first, stored(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        dropped(was)
    if label is None:
        return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return label
