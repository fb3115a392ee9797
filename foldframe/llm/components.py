"""Connected components of an edge table, by alternating star contractions.

Every round is two aggregate-and-join steps over the edges; nothing is brought
to the driver but a count and a checksum. The number of rounds grows with the
logarithm of the longest path. Of a round the driver keeps some ten stages, with
their tasks and code, and would build what a join broadcasts; so joins are merged,
and up to ONE_TASK edges are joined by one task, without rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldframe.llm.common import stable

#: Edges that one task holds, 16 bytes each; with the places of their ends about 100 MB.
ONE_TASK = 1 << 20


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("least"))
    return both.join(least.hint("merge"), "src").filter(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("least").alias("dst")).filter("src <> dst").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the least of these."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("least"))
    return down.join(least.hint("merge"), "src").select(F.explode(F.array("src", "dst")).alias("src"), F.col("least").alias("dst")).filter("src <> dst").distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges -> (node, root): the larger of two joined roots takes the smaller one's, until no edge leaves a tree."""
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if not parts:
        return
    nodes, places = np.unique(np.concatenate(parts, 1), return_inverse=True)
    a, b = places.reshape(2, -1)
    roots = np.arange(len(nodes))
    while len(a):
        np.minimum.at(roots, np.maximum(a, b), np.minimum(a, b))
        while (deeper := roots[roots]).tobytes() != roots.tobytes():
            roots = deeper
        a, b = roots[a], roots[b]
        a, b = a[a != b], b[a != b]
    for at in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + (1 << 16)]), pa.array(nodes[roots[at : at + (1 << 16)]])], names=["node", "root"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(src, dst) of long ids -> one row (node, root) per node that has a link; root is the least node reachable.

    Self links and repeated links do no harm; null ends are left out; no edges give no rows.
    """
    edges = stable(edges.select("src", "dst").filter("src <> dst").distinct())
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst"))).first()
        if now[0] <= ONE_TASK:
            return edges.coalesce(1).mapInArrow(_joined, "node bigint, root bigint")
        if now == before:
            break
        before = now
        edges = stable(_small_star(_large_star(edges)))
    roots = edges.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct()
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(roots)
