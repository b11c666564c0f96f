"""Shards by a weighted hash tree: every document descends region, rack and shard levels by weighted hash draws.

At each node every child draws -ln(u) / weight, u in (0, 1) from a digest of child and document, and the smallest draw wins. A child
is then chosen in proportion to its weight, and a draw changes only where a weight does: if the weight of a shard grows, documents of
other regions move only into its region, those of its region only into its rack, and those of its rack only into it. Nothing but the
tree and the id decides, so no document needs to know another one. Native column functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetseal.llm.common import stage

OVERHEAD_BYTES = 16
_BITS = 52
_DIGITS = _BITS // 4
# Rows that are equal in all that a manifest shows travel as one row with a count, at most so many together.
_TOGETHER = 4096
_CHUNK_DIGITS = 3


class Shard(NamedTuple):
    """A leaf of the tree: where it stands, its number, and its share of the draws."""

    region: str
    rack: str
    number: int
    weight: float = 1.0


def uniform_tree(shards: int, shards_per_rack: int = 4, racks_per_region: int = 2) -> list[Shard]:
    """``shards`` leaves of equal weight, racks and regions filled in order of number."""
    return [Shard(f"g{i // (shards_per_rack * racks_per_region)}", f"r{i // shards_per_rack}", i) for i in range(shards)]


def grown(tree: Sequence[Shard], weight: float = 1.0) -> list[Shard]:
    """One more shard, in a region of its own: documents move into it and nowhere else."""
    number = max(s.number for s in tree) + 1
    return [*tree, Shard(f"g+{number}", f"r+{number}", number, weight)]


def _children(tree: Sequence[Shard]) -> dict[str, dict[str, float]]:
    """Children and their weights by node; the root is "". A node weighs what its shards weigh, a weight of 0 closes a shard."""
    nodes: dict[str, dict[str, float]] = {}
    if len({s.number for s in tree}) != len(tree):
        raise ValueError("shard numbers of a tree are distinct")
    for s in tree:
        if s.weight > 0:
            path = ["", s.region, f"{s.region}/{s.rack}", f"{s.region}/{s.rack}/{s.number}"]
            for parent, child in zip(path, path[1:], strict=False):
                below = nodes.setdefault(parent, {})
                below[child] = below.get(child, 0.0) + s.weight
    if not nodes:
        raise ValueError("a tree needs a shard of positive weight")
    return nodes


def _drawn(children: Column, key: Column) -> Column:
    """The child of smallest draw for ``key``."""
    def draw(child: Column) -> Column:
        digest = F.substring(F.md5(F.concat(F.lit("shard|"), child["node"], F.lit("|"), key)), 1, _DIGITS)
        u = (F.conv(digest, 16, 10).cast("long") + 0.5) / float(1 << _BITS)
        return F.struct((-F.ln(u) / child["weight"]).alias("draw"), child["node"].alias("node"))
    return F.array_min(F.transform(children, draw))["node"]


def shard_of(tree: Sequence[Shard], doc_id: Column) -> Column:
    """Number of the shard in which an id lands; a null id is an id of its own."""
    key = F.coalesce(doc_id.cast("string"), F.lit("null"))
    branch = lambda below: F.array(*[F.struct(F.lit(n).alias("node"), F.lit(float(w)).alias("weight")) for n, w in below.items()])
    levels = _children(tree)
    inner = F.create_map(*[x for node, below in levels.items() if node for x in (F.lit(node), branch(below))])
    region = _drawn(branch(levels[""]), key)
    rack = _drawn(F.element_at(inner, region), key)
    return F.element_at(F.split(_drawn(F.element_at(inner, rack), key), "/"), -1).cast("int")


def place(docs: DataFrame, tree: Sequence[Shard], larger: Sequence[Shard] | None = None) -> DataFrame:
    """Add size, text_crc32, shard and grown_shard (under the ``larger`` tree) to every row, without a shuffle.

    Needs doc_id and text. A null text counts as an empty one, a null id as an id of its own (all its rows share a shard), repeated rows
    go together, an empty table stays empty. Columns called like one of the added are replaced, others pass. A text of any length costs
    its checksum; only the id is drawn with.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({
        "size": (F.octet_length(text) + OVERHEAD_BYTES).cast("long"), "text_crc32": F.crc32(text.cast("binary")),
        "shard": shard_of(tree, F.col("doc_id")), "grown_shard": shard_of(larger or grown(tree), F.col("doc_id"))})


def manifest(placed: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard) of every row of :func:`place`; slots of a shard run from 0 without gaps.

    Rows that a manifest cannot tell apart are counted before they move, and split again into at most 4,096 each, so that no id or group
    of copies fills a task. A shard is cut into 4,096 chunks by digest; slots run inside a chunk, and each starts where the ones before it end.
    """
    own = ["doc_id", "size", "text_crc32", "shard", "grown_shard"]
    counted = placed.groupBy(*own).agg(F.count("*").alias("n"))
    parts = counted.select(*own, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(_TOGETHER).cast("long"))).alias("part"))
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "size", "text_crc32", "part"))
    rows = stage(parts.select(*own, "part", F.least(F.lit(_TOGETHER), F.col("n") - F.col("part")).alias("n"), F.substring(digest, 1, _CHUNK_DIGITS).alias("chunk")),
                 "manifest")
    past = (Window.unboundedPreceding, -1)
    sizes = rows.groupBy("shard", "chunk").agg(F.sum("n").alias("in_chunk"))
    starts = sizes.select("shard", "chunk", F.coalesce(F.sum("in_chunk").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(*past)), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "chunk").orderBy("doc_id", "size", "text_crc32", "part").rowsBetween(*past)
    local = rows.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    slot = F.explode(F.sequence(F.col("start") + F.col("before"), F.col("start") + F.col("before") + F.col("n") - 1)).alias("slot")
    return local.join(starts, ["shard", "chunk"]).select("doc_id", "size", "text_crc32", "shard", slot, "grown_shard")


def write(placed: DataFrame, path: str, files_per_shard: int = 16) -> None:
    """Write the rows of :func:`place` as Parquet with a folder per shard and about ``files_per_shard`` files in each."""
    part = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(files_per_shard))
    placed.repartition("shard", part).write.partitionBy("shard").parquet(path)
