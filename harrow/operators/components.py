"""Connected components over an edge table, by min-label hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.staging import drop_staged, staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b) links -> (id, component): the smallest id that links reach, for each linked id.

    In a round each id takes the least label around it and hands it to the root it
    had, so that whole trees are hooked, and then jumps to its label's label. Labels
    only ever fall, and nothing but a round without change ends the loop; rounds grow
    with the logarithm of a chain's length. Each round is written to the shared
    folder, so that no lineage grows and a lost executor costs one round at most.
    Null ids and self-links take no part.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    pairs = edges.select(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")).where("u < v").distinct()
    pairs = staged(pairs, "edges")
    both = pairs.select(F.col("u").alias("id"), F.col("v").alias("other")).unionByName(pairs.select(F.col("v").alias("id"), F.col("u").alias("other")))
    labels = staged(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("other"), F.col("component").alias("_c")), "other").groupBy("id").agg(F.min("_c").alias("_c"))
        taken = labels.join(near, "id").select("id", F.col("component").alias("_was"), F.least("component", "_c").alias("component"))
        to_root = F.struct(F.col("_was").alias("id"), F.lit(None).cast("long").alias("_was"), "component")
        told = taken.select(F.inline(F.array(F.struct("id", "_was", "component"), to_root)))
        hooked = told.groupBy("id").agg(F.max("_was").alias("_was"), F.min("component").alias("component"))
        roots = labels.select(F.col("id").alias("component"), F.col("component").alias("_root"))
        jumped = hooked.join(roots, "component", "left").select("id", "_was", F.least("component", F.coalesce("_root", "component")).alias("component"))
        after = staged(jumped, "labels")
        changed = after.where("component <> _was").limit(1).count()
        drop_staged(labels)
        labels = after.select("id", "component")
        labels._harrow_path = after._harrow_path
        if not changed:
            break
    drop_staged(pairs)
    return labels
