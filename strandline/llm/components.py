"""Connected components of a graph whose edges are rows.

Edges are contracted by union-find inside each partition, sent to the
partition of their larger node and contracted again there. Then rounds of
pointer jumping follow: each node takes the root of its root, which halves
the depth, and nodes that two partitions tied to different roots tie those.
After a contraction a node has one row at most in each partition, so no node
gathers its whole component; the join that jumps has the nodes on one side
once or a few times and was written down before, so that Spark splits the
rows of a very large component. Each round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import stored


class Forest:
    """Union-find over any hashable nodes; the root is the smallest node."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up, path = self.up, []
        while (parent := up.get(x, x)) != x:
            path.append(x)
            x = parent
        for y in path:
            up[y] = x
        return x

    def join(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _contracted(edges: DataFrame) -> DataFrame:
    kind = dict(edges.dtypes)["a"]
    node = pa.binary() if kind == "binary" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                forest.join(a, b)
        nodes = list(forest.up)
        for at in range(0, len(nodes), 50_000):
            part = nodes[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, node), pa.array([forest.root(x) for x in part], node)], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, f"a {kind}, b {kind}")


def _met(edges: DataFrame) -> DataFrame:
    """Contracted before the rows are sent out by node, and after."""
    return _contracted(_contracted(edges).repartition("a"))


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: bigint or binary) that
    is no root.

    The root is the smallest node of its component. Loops, repeated edges and
    nulls do no harm; no edges give no rows.
    """
    now = stored(_met(edges.filter("a != b")), name)
    digest = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = digest(now)
    while seen[0]:
        up = now.select(F.col("a").alias("b"), F.col("b").alias("c"))
        jumped = now.join(up, "b", "left").select("a", F.coalesce("c", "b").alias("b"))
        now, before = stored(_met(jumped), name), seen
        if (seen := digest(now)) == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
