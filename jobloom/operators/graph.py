"""Which names belong together, from links between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.sources.shared import written

MOST_ROUNDS = 40


def groups(links: DataFrame) -> DataFrame:
    """(name, root) of links (a, b) between names: the root is the least name that can be reached.

    In each round a root takes the least root that any of its members is linked to. These pointers are followed to their
    ends, twice as far each time, before members and links move there; so long chains go in one round. Links within a
    group are dropped as soon as it forms. A name with many links is met by partial aggregates only.
    """
    pairs = links.select("a", "b").filter("a is not null and b is not null")
    label = written(pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name"))).distinct().withColumn("root", F.col("name")), "graph-labels")
    edges = written(pairs.filter("a <> b").distinct(), "graph-links")
    for _ in range(MOST_ROUNDS):
        if not edges.limit(1).count():
            return label
        low = edges.select(F.greatest("a", "b").alias("root"), F.least("a", "b").alias("to")).groupBy("root").agg(F.min("to").alias("to"))
        # Each root points to a smaller one, if any: no circles.
        step = written(low, "graph-steps")
        for _ in range(MOST_ROUNDS):
            far = step.join(step.select(F.col("root").alias("to"), F.col("to").alias("next")), "to", "left")
            step = written(far.select("root", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("on")), "graph-steps")
            if not step.filter("on").limit(1).count():
                break
            step = step.drop("on")
        moved = lambda df, c, s=step: df.join(s.select(F.col("root").alias(c), F.col("to").alias(f"{c}_to")), c, "left").withColumn(c, F.coalesce(f"{c}_to", c)).drop(f"{c}_to")
        label = written(moved(label, "root"), "graph-labels")
        edges = written(moved(moved(edges, "a"), "b").filter("a <> b").select("a", "b").distinct(), "graph-links")
    raise RuntimeError("groups did not settle")
