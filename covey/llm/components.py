"""Connected components of a table of links, by hash-min with pointer jumping over written tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covey.llm.common import Scratch


class Forest:
    """Union-find over numbered nodes that takes links in bulk."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): component is the smallest node reachable.

    Each round a node takes the smallest label among its own and its neighbours', then the label of that label.
    Labels shrink along paths by jumps, so rounds grow with the logarithm of a component's diameter on typical graphs.
    Both sides of the joins are read from written tables: AQE can split a node with very many links, and the minimum
    over neighbours is aggregated before the shuffle.  Only the number of changed labels reaches the driver.
    """
    both = links.select("a", "b").where("a <> b")
    both = scratch.table(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    state = scratch.table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:  # labels only fall, so this ends
        near = both.join(state.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        pulled = state.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("was"), F.least("component", "m").alias("now"))
        pulled = scratch.table(pulled, "pulled")
        heads = pulled.select(F.col("node").alias("now"), F.col("now").alias("head"))
        jumped = pulled.join(heads, "now", "left").select("node", "was", F.least("now", "head").alias("component"))
        new = scratch.table(jumped, "labels")
        changed = new.where("was <> component").limit(1).count()
        old, state = state, new.select("node", "component")
        state._covey_scratch = new._covey_scratch
        scratch.drop(old, pulled)
        if not changed:
            return state
