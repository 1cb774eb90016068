"""Connected components by alternating large-star and small-star contraction.

Every step is a map-side combined minimum and an equi-join; no neighbour list,
component or link set is ever gathered in one task or on the driver. A star
centre that many nodes link to is dealt over many tasks (``spread_join``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize_table, spread_join


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) links between long ids -> (node, root) for every node that has a link to another.

    ``root`` is the smallest id of the component. Self links, repeated links and
    links with a null end have no effect; without links the result is empty.
    Rounds go on until nothing moves; their number grows with the logarithm of
    the longest path.
    """
    pairs = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    e = materialize_table(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = state(e)
    while before[0]:
        # One round: hang larger neighbours on the smallest one, then smaller neighbours likewise.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(both.where(F.col("v") > F.col("u")), low, ["u"], ["v"], total=before[0])
        large = materialize_table(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), before[0])
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = spread_join(large, low, ["u"], ["v"], total=before[0]).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize_table(rest.unionByName(low.withColumnRenamed("m", "v")).distinct(), 2 * before[0])
        now = state(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
