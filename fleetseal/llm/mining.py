"""Hard negatives by a secondary sort.

Scores of pairs are packed into keys (anchor, descending score, own label before others, id), dealt by anchor and sorted within partitions
by the shuffle. An iterator then reads the rows of an anchor from the nearest on: each of the first rows of its own label opens a window
of scores, each row of another label that lies in an open window is written out, and nothing of an anchor is kept but its windows.

Pairs are scored in tiles, a block of anchors against a block of rows, and a tile hands on only what can matter: its first rows of the own
label, and for each positive the first rows of its window. The positives are mined in a round of their own, by the same keys.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetseal.llm.common import stage

_PAIR = "key binary"
# Anchor id, number of its row, score and id: big endian with the sign bit turned, so that bytes sort like numbers.
_KEY = np.dtype([("anchor", ">u8"), ("row", ">u8"), ("down", ">u8"), ("other", "u1"), ("id", ">u8")])
_ANCHOR_BYTES = 16
_SIGN = np.uint64(1 << 63)
_LONG = np.iinfo(np.int64)
_EXACT = 1 << 53


class Windows:
    """What the iterator keeps of an anchor: its positives so far, and how many negatives each has."""

    def __init__(self, positives: int, negatives: int, low: int, high: int):
        self.positives, self.negatives, self.low, self.high, self.open = positives, negatives, low, high, []

    def see(self, other: bool, score: int, vec_id: int) -> Iterator[tuple]:
        """Take the next row of the anchor; give (positive id, rank, positive score) for each window that it lies in."""
        if not other:
            if len(self.open) < self.positives:
                self.open.append([vec_id, 0, score])
            return
        for window in self.open:
            if window[1] < self.negatives and self.low * window[2] <= 100 * score <= self.high * window[2]:
                window[1] += 1
                yield tuple(window)


def usable(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """(id, label, vector as doubles, dim, row) of rows with an id, a label and a finite vector."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    named = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"),
                           F.col(vector_column).cast("array<double>").alias("vector"))
    return named.filter("id is not null and label is not null and vector is not null").filter(finite).withColumns({
        "dim": F.size("vector"), "row": F.monotonically_increasing_id()})


def _packed(anchors: np.ndarray, rows: np.ndarray, scores: np.ndarray, other: np.ndarray, ids: np.ndarray) -> pa.Table:
    keys = np.empty(len(anchors), _KEY)
    keys["anchor"], keys["row"] = anchors.astype(np.int64).view(np.uint64) ^ _SIGN, rows.astype(np.uint64)
    keys["down"] = ~(scores.astype(np.int64).view(np.uint64) ^ _SIGN)
    keys["other"], keys["id"] = other, ids.astype(np.int64).view(np.uint64) ^ _SIGN
    width = _KEY.itemsize
    offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * width).buffers()[1]
    return pa.table({"key": pa.Array.from_buffers(pa.binary(), len(keys), [None, offsets, pa.py_buffer(keys.tobytes())])})


def unpacked(key: bytes) -> tuple[int, int, bool, int]:
    """(anchor id, score, whether of another label, id) of a key."""
    anchor, _, down, other, vec_id = struct.unpack(">QQQBQ", key)
    sign = 1 << 63
    return anchor - sign, (~down & (2 * sign - 1)) - sign, bool(other), vec_id - sign


def _codes(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """floor(256 x) of every component; whole numbers as floats."""
    return np.floor(256.0 * column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)) if dim else np.zeros((len(column), 0))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where no sum can leave their exact range, else in Python integers held to a long."""
    most = lambda x: float(np.abs(x).max(initial=0.0))
    if most(a) * most(b) * max(a.shape[1], 1) < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in r] for r in x.tolist()], dtype=object).reshape(x.shape)
    return np.clip(whole(a) @ whole(b).T, _LONG.min, _LONG.max).astype(np.int64)


def _first_of(scores: np.ndarray, ids: np.ndarray, fit: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of those that fit, by descending score and then id."""
    at = np.nonzero(fit)[0]
    if len(at) > 4 * k:
        floor = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= floor]
    return at[np.lexsort((ids[at], -scores[at].astype(np.float64), -scores[at]))[:k]] if len(at) else at


def _tiles(what: str, positives: int, negatives: int, low: int, high: int):
    """Score a tile and hand on its keys: first rows of the own label, or what lies first in a window of the anchor's positives."""
    schema = pa.schema([("key", pa.binary())])

    def work(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(anchors) or not len(rows):
            return schema.empty_table()
        dim = anchors["dim"][0].as_py()
        scores = _products(_codes(anchors["vector"], dim), _codes(rows["vector"], dim))
        ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
        aims = anchors["scores"].to_pylist() if what == "negatives" else None
        found = [[], [], [], [], []]
        for i, (anchor, row, label) in enumerate(zip(anchors["id"].to_pylist(), anchors["row"].to_pylist(), anchors["label"].to_pylist(), strict=True)):
            s = scores[i]
            if aims is None:
                at = _first_of(s, ids, (labels == label) & (ids != anchor), positives)
            else:
                # Bounds in whole numbers: ceil(low p / 100) <= s <= floor(high p / 100).
                inside = [(labels != label) & (s >= -(-low * p // 100)) & (s <= high * p // 100) for p in aims[i]]
                at = np.unique(np.concatenate([_first_of(s, ids, fit, negatives) for fit in inside]))
            for into, values in zip(found, (np.full(len(at), anchor), np.full(len(at), row), s[at], np.full(len(at), aims is not None), ids[at]), strict=True):
                into.append(values)
        return _packed(*[np.concatenate(x) for x in found])
    return work


def _pairs(anchors: DataFrame, rows: DataFrame, block: int, work) -> DataFrame:
    """Keys of all tiles. Blocks hold about ``block`` rows, so that a tile's size does not depend on labels, copies or the table."""
    blocks, cells = (max(1, -(-x.count() // block)) for x in (anchors, rows))
    salt = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = anchors.withColumn("block", salt(blocks, 1)).withColumn("cell", every(cells))
    right = rows.withColumn("cell", salt(cells, 2)).withColumn("block", every(blocks))
    keys = ["dim", "block", "cell"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, _PAIR)


def _sorted_stream(pairs: DataFrame, work, schema: str) -> DataFrame:
    """Deal keys by anchor, sort them within partitions, and let ``work`` read each partition as a stream."""
    partitions = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = pairs.rdd.map(lambda r: (bytes(r[0]), None))
    dealt = keyed.repartitionAndSortWithinPartitions(partitions, lambda key: zlib.crc32(key[:_ANCHOR_BYTES]))
    return pairs.sparkSession.createDataFrame(dealt.mapPartitions(work), schema)


def _by_anchor(windows):
    """The iterator: a fresh set of windows for every anchor row, fed in the order of the keys."""
    def work(keys: Iterator[tuple]) -> Iterator[tuple]:
        own, state = None, None
        for key, _ in keys:
            if key[:_ANCHOR_BYTES] != own:
                own, state = key[:_ANCHOR_BYTES], windows()
            anchor, score, other, vec_id = unpacked(key)
            for positive, rank, aim in state.see(other, score, vec_id):
                yield anchor, positive, rank, vec_id, aim, score
    return work


def _first_keys(count: int):
    """(row number of the anchor, key, score) of the first keys of every anchor."""
    def work(keys: Iterator[tuple]) -> Iterator[tuple]:
        own, seen = None, 0
        for key, _ in keys:
            own, seen = (own, seen + 1) if key[:_ANCHOR_BYTES] == own else (key[:_ANCHOR_BYTES], 1)
            if seen <= count:
                yield struct.unpack(">Q", key[8:16])[0], key, unpacked(key)[1]
    return work


def mine(anchors: DataFrame, rows: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = 4096,
         id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), ranks from 1 within anchor and positive.

    A score is the inner product of floor(256 x). Positives of an anchor are the ``positives`` rows of its label with the highest scores,
    negatives of a positive the first ``negatives`` rows of other labels with low * p <= 100 * s <= high * p; ties go to the smaller id.
    Rows without id, label or vector, or with a null or non-finite component, take no part. A row with the anchor's id is the anchor's own
    and no partner. Repeated rows are rows of their own, a repeated anchor is answered again. Only vectors of equal length meet. An
    anchor without positives, or whose windows are empty, has no rows; empty tables give none. Scores beyond a long stay at its border.
    """
    named = (id_column, vector_column, label_column)
    asked, given = usable(anchors, *named), usable(rows, *named)
    numbers = (positives, negatives, low, high)
    own = _pairs(asked, given, block, _tiles("positives", *numbers))
    first = stage(_sorted_stream(own, _first_keys(positives), "row long, key binary, score long"), "positives")
    aims = first.groupBy("row").agg(F.collect_list("score").alias("scores"))
    other = _pairs(asked.join(aims, "row"), given, block, _tiles("negatives", *numbers))
    return _sorted_stream(first.select("key").unionAll(other), _by_anchor(lambda: Windows(*numbers)),
                          "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
