"""Connected components of an edge table, by alternating large-star and small-star steps.

Edges are first thinned inside each partition to a spanning forest (a union-find over the partition's
own edges), so dense groups shrink before anything is shuffled. Where at most ``FEW`` edges are left, one task
joins those trees in the same way; beyond that steps go on over all partitions. Each step is an aggregation (combined
before its shuffle) and an equi-join that Spark may split where a node has very many edges. Steps are
written to the shared folder; nothing but two numbers a step reaches the driver.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietspan.llm.rows import discard, materialise


#: So many edges are joined by one task.
FEW = 1 << 17


def _forest(batches):
    """Star edges (node, least node of its tree) of a partition's edges."""
    parent: dict = {}

    def root(x):
        top = x
        while (p := parent.get(top, top)) != top:
            top = p
        while (p := parent.get(x, x)) != top:
            parent[x] = top
            x = p
        return top

    names, kind = None, None
    for batch in batches:
        names, kind = batch.schema.names, batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if parent:
        nodes = list(parent)
        for i in range(0, len(nodes), 50_000):
            some = nodes[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, kind), pa.array([root(n) for n in some], kind)], names=names)


def components(edges: DataFrame, a: str, b: str, few: int = FEW) -> DataFrame:
    """(node, component): each node of an edge with the least node it reaches. Loops are ignored; null ends too."""
    kind = edges.schema[a].dataType
    schema = f"a {kind.simpleString()}, b {kind.simpleString()}"
    pairs = edges.select(F.col(a).alias("a"), F.col(b).cast(kind).alias("b")).where("a <> b").mapInArrow(_forest, schema)
    pairs = materialise(pairs, "components")
    if pairs.count() <= few:
        last, pairs = pairs, materialise(pairs.coalesce(1).mapInArrow(_forest, schema), "components")
        discard(last)
        return _labelled(pairs)

    def state(df):
        row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    before = None
    while before != (now := state(pairs)):
        before = now
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        last, pairs = pairs, materialise(small, "components")
        discard(last)
    return _labelled(pairs)


def _labelled(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
