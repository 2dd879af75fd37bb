"""Connected components of a table of links, by the smallest label and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.session import stored


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the smallest id that links reach.

    In each round an id takes the smallest label among its own and its neighbours', then the label of that label. Rounds grow
    with the logarithm of the longest chain in practice; every round is written, so a lost executor costs one round.
    Minima are combined map-side. Joins are merge joins, so that no table of labels goes through the driver; Spark may split the
    partition of an id with many links.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).where("u <> v").distinct()
    both = stored(both, "links")
    labels = stored(
        both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("label")), "labels"
    )
    while True:
        near = both.join(labels.hint("merge"), F.col("v") == F.col("id")).groupBy("u").agg(F.min("label").alias("near"))
        lower = labels.join(near.hint("merge"), F.col("id") == F.col("u")).select("id", "label", F.least("label", "near").alias("low"))
        lower = stored(lower, "labels")
        of = lower.select(F.col("id").alias("of"), F.col("low").alias("beyond"))
        jumped = lower.join(of.hint("merge"), F.col("low") == F.col("of")).select(
            "id", F.least("low", "beyond").alias("label"), (F.least("low", "beyond") != F.col("label")).alias("changed")
        )
        jumped = stored(jumped, "labels")
        labels = jumped.drop("changed")
        if not jumped.where("changed").limit(1).count():
            return labels.withColumnRenamed("label", "component")
