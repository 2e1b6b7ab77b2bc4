"""Connected components of an edge table, with neither edges nor labels on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node for every node of ``edges`` (a, b), as (node, comp).

    Rounds of hooking and pointer jumping: every node and its present root take
    the smallest label next to them, then labels jump to the label of their
    label, so the number of rounds grows with the logarithm of the longest
    chain. Only row counts reach the driver; each round is written to the
    shared folder. Null ends, self-links and repeated links are allowed and
    change nothing; no edges give no rows.
    """
    links = edges.select("a", "b").filter("a <> b")
    both = cut_lineage(links.union(links.select("b", "a")).toDF("a", "b").distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
    labels = cut_lineage(labels.select("node", F.least("node", "near").alias("comp")), "labels")
    while True:
        left = labels.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
        right = labels.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        open_links = cut_lineage(both.join(left, "a").join(right, "b").filter("ca <> cb").select("a", "ca", "cb"), "open")
        if open_links.isEmpty():
            return labels
        offers = open_links.select(F.explode(F.array("a", "ca")).alias("node"), "cb").groupBy("node").agg(F.min("cb").alias("offer"))
        hooked = cut_lineage(
            labels.join(offers, "node", "left").select("node", F.least("comp", "offer").alias("comp")), "hooked"
        )
        roots = hooked.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        labels = cut_lineage(hooked.join(roots, "comp").select("node", F.least("comp", "root").alias("comp")), "labels")
