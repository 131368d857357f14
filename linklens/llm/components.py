"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linklens.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b); comp is the least node reachable.

    Each round takes the least label among the neighbours and then the label of
    that label, so path lengths about halve. Every round is written to the
    shared folder; only a count of changes reaches the driver.
    """
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                       .filter("a <> b").distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
                         .select("node", F.least("node", "least").alias("comp")), "labels")
    while True:
        near = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("near")))
        step = (labels.join(near, labels["node"] == near["a"], "left")
                .select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("mid")))
        # labels are nodes, and a label's own label is at most itself
        jump = labels.select(F.col("node").alias("mid"), F.col("comp").alias("far"))
        new = materialise(step.join(jump, "mid", "left")
                          .select("node", F.least("mid", "far").alias("comp"),
                                  (F.least("mid", "far") != F.col("old")).alias("changed")), "labels")
        labels = new.select("node", "comp")
        if new.filter("changed").isEmpty():
            return labels


def merge_components(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after more ``links`` (a, b) between nodes that have ``labels`` (node, comp) already."""
    if labels is None:
        return components(links)
    own = labels.select("node", "comp")
    named = links
    for side in ("a", "b"):
        at = own.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}"))
        named = named.join(at, side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    of_comps = components(named.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    joined = own.join(of_comps.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left")
    old = joined.select("node", F.coalesce("top", "comp").alias("comp"))
    new = of_comps.join(own, "node", "left_anti")
    return materialise(old.unionByName(new), "labels")
