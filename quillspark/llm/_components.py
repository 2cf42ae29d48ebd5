"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._stage import Stage


def connected_components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """links: ``a``, ``b`` (long; any order, repeats and a = b allowed). Returns ``node``, ``component`` for every
    linked node, the component being its smallest node. An empty table gives an empty one.

    Each round replaces the links of a node by links to its smallest neighbour, so the table never grows; a hub's
    minimum is pre-aggregated before the shuffle and joined back, so no task has to hold a hub's links together.
    Rounds are about the logarithm of the longest chain. Tables between rounds are in the shared folder.
    """
    stage = Stage(spark, "components")
    table = stage.save(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "0"
    )
    state, turn = _state(table), 0
    stage.expect(state[0] * 16)
    while state[0]:
        both = table.union(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("k")).agg(F.least(F.min("v"), F.col("k")).alias("m"))
        large = (
            both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).where("u <> v")
        large = large.distinct()
        low = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        joined = large.join(low, F.col("u") == F.col("k"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        small = small.where("u <> v").distinct()
        turn += 1
        new = stage.save(small, str(turn))
        now = _state(new)
        stage.drop(str(turn - 1))
        table = new
        if now == state:
            break
        state = now
    pairs = table.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = pairs.select(F.col("component").alias("node"), "component").distinct()
    return pairs.union(roots)


def _state(table: DataFrame) -> tuple:
    row = table.agg(
        F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return tuple(row)
