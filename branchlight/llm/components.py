"""Connected components of a link table by contraction.

In every round each node points to its smallest neighbour if that is smaller; pointers are followed to their ends by
doubling, and links are renamed to the ends. Rounds go on until no link is left; a node's root is the end of its
chain over all rounds. Each table is written once to the shared folder, so the joins read plain tables: adaptive execution
can split a popular node's rows, and lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _ends(pointers: DataFrame) -> DataFrame:
    """``pointers`` (node, root) with every chain followed to its end. Roots point to themselves and are not listed."""
    while True:
        up = pointers.select(F.col("node").alias("root"), F.col("root").alias("above"))
        pointers = written(pointers.join(up, "root", "left").select(
            "node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "pointers")
        if not pointers.where("moved").limit(1).count():
            return pointers.select("node", "root")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b) that isn't its component's smallest; ``root`` is the smallest.

    Links of a node to itself say nothing; links may repeat, in either direction.
    """
    links = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                    "links")
    found: list[DataFrame] = []
    while links.limit(1).count():
        # b's smaller neighbours are the a of its links.
        ends = _ends(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        found.append(ends)
        for side in ("a", "b"):
            renamed = ends.select(F.col("node").alias(side), F.col("root").alias("to"))
            links = written(links.join(renamed, side, "left").withColumn(side, F.coalesce("to", side)).drop("to"), "links")
        links = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                        "links")
    if not found:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    total = found[0]
    for later in found[1:]:
        onward = later.select(F.col("node").alias("root"), F.col("root").alias("end"))
        moved = total.join(onward, "root", "left").select("node", F.coalesce("end", "root").alias("root"))
        total = written(moved.unionByName(later), "roots")
    return total
