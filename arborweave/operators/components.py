"""Connected components of an undirected graph given as links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborweave.operators.skew import join_counted
from arborweave.session import materialise

#: Links that one task may hold at once (16 bytes each).
ONE_TASK = 4_000_000


def labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the links a-b, by repeated pointer jumping."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(root, high, low)
        while (up := root[root] != root).any():
            root = np.where(up, root[root], root)
        x, y = root[x], root[y]
        keep = x != y
        x, y = x[keep], y[keep]
    return nodes, nodes[root]


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the links (a, b) of a partition by one link from each node to its smallest reachable one."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        keep = x != y
        return pa.RecordBatch.from_arrays([pa.array(x[keep]), pa.array(y[keep])], ["a", "b"])

    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy(zero_copy_only=False)])
        b = np.concatenate([b, batch.column(1).to_numpy(zero_copy_only=False)])
        if len(a) > ONE_TASK:
            a, b = labels(a, b)
            if len(a) > ONE_TASK // 2:  # little to contract: pass it on
                yield rows(a, b)
                a, b = a[:0], b[:0]
    if len(a):
        yield rows(*labels(a, b))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step of the alternating stars: every neighbour (large: the greater ones) is tied to the node's least neighbour."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "a"))
        tied = join_counted(both, least, ["a"], "n", 2 * links.count()).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        tied = join_counted(down, least, ["a"], "n", links.count())
        tied = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return materialise(tied.where("a <> b").distinct(), "star")


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component): for each node of a link (a, b), the smallest node it is connected with.

    Links are first contracted inside each partition, which leaves at most
    one link per node and partition. If no more than `one_task` are left
    (counted exactly), one task finishes them; else alternating large-star
    and small-star steps run until nothing changes, each materialised, with
    hubs joined by broadcast, so no node's links meet in one task. Null ends
    and self links give no rows; repeated links count once.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna().where("a <> b")
    now = materialise(links.mapInArrow(contract, "a long, b long"), "links")
    if now.count() <= one_task:
        done = now.coalesce(1).mapInArrow(contract, "a long, b long")
    else:
        state = None
        while True:
            now = _star(_star(now, True), False)
            seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if seen == state:
                break
            state = seen
        done = now
    done = materialise(done, "components")
    roots = done.select(F.col("b").alias("node")).distinct()
    return done.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
