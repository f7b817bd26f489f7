"""Connected components of a graph of long node numbers, as distributed joins.

Rounds of large-star and small-star: each node hands its greater neighbours, then all its lesser ones,
to the least node it sees. Every round moves each link a constant number of times, hubs are handled
by partial aggregation and by joins that adaptive execution can split, and the number of rounds grows
with the logarithm of the graph's size. Each round's links are written to the shared folder.

A graph of at most `one_task` links (16 bytes each) is solved by a union-find in one task instead;
beyond that size only the rounds are used.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

ONE_TASK = 200_000


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node of each one's component) of links a-b."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], least)
        np.minimum.at(label, label[y], least)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (label == before).all():
            return nodes, nodes[label]


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for each node in links (a, b): root is the least node of its component."""
    own = F.col("a") != F.col("b")
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    loops = links.where(~own).select(F.col("a").alias("node"))
    edges = written(links.where(own).select(high, low).distinct(), "links")
    if edges.count() <= one_task:
        found = edges.coalesce(1).mapInArrow(_in_one_task, "node long, root long")
    else:
        found = _by_rounds(edges)
    found = written(found, "components")
    lone = loops.distinct().join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"))
    return found.unionByName(lone)


def _in_one_task(frames):
    import pyarrow as pa

    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for batch in frames:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
    nodes, roots = roots_of(np.concatenate(a), np.concatenate(b))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])


def _by_rounds(edges: DataFrame) -> DataFrame:
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = None
    while (now := state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a != b").distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        edges = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
