"""Connected components of a graph held in two columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id that links reach) of every id in ``links`` (a, b).

    Each round, every id takes the least label among its neighbours and then
    the label of that label, so long chains shrink by halves.  Labels and
    links stay in tables; a hub's links are aggregated before the shuffle.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "links")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.id == near.a).select("id", "label", F.least("label", "near").alias("now"))
        over = labels.select(F.col("id").alias("now"), F.col("label").alias("then"))
        step = step.join(over, "now").select("id", F.least("now", "then").alias("next"), "label")
        step = written(step, "labels")
        changed = step.filter("next <> label").limit(1).count()
        labels = step.select("id", F.col("next").alias("label"))
        if not changed:
            return labels.select("id", F.col("label").alias("component"))
