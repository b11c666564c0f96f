"""Pack token pieces into as few sequences as possible.

Only the histogram of piece lengths decides: a configuration (how many pieces of each length share a sequence) is bought so
often that the configurations together hold every piece. The linear program over configurations is solved by multiplicative
weights; each round prices a configuration by a knapsack over the capacity. Its solution is rounded down, what is left is packed
by best fit. The histogram has at most ``capacity`` entries, whatever the corpus; pieces get their places in Spark, by rank
within their length.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetseal.llm.common import in_parts, stage

CAPACITY = 1024
_PIECES = "piece int, start long, length long, ids_crc32 long"


def _encoder(vocabulary: str, ranks: str | None):
    """Function from text to ids. The faster library is used where it gives the same ids: texts without the name of a special token."""
    import base64
    import os

    from tokenizers import Tokenizer
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    whole = Tokenizer.from_file(vocabulary)
    slow = lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
    if ranks is None:
        return slow
    import public_tokenizers
    import tiktoken
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    quick = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    special = [t.content for t in whole.get_added_tokens_decoder().values()]

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return slow(text)
        return np.asarray(quick.encode_to_numpy(text), np.uint32)
    return encode


def pieces(docs: DataFrame, vocabulary: str, ranks: str | None = None, capacity: int = CAPACITY, end: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document: its ids and the end mark, cut only where longer than ``capacity``.

    Pieces after the first are full; the first takes what is left. A null text has the end mark alone. Repeated rows give
    repeated pieces.
    """
    def cut(batches):
        encode = _encoder(vocabulary, ranks)
        for batch in in_parts(batches, 1):
            ids, rows = batch.column(0), []
            for row, text in enumerate(batch.column(1)):
                tokens = np.append(encode(text.as_py() or ""), np.uint32(end)).astype("<u4")
                at, number, step = 0, 0, (len(tokens) - 1) % capacity + 1
                while at < len(tokens):
                    part = tokens[at:at + step]
                    rows.append((row, number, at, len(part), zlib.crc32(part)))
                    at, number, step = at + step, number + 1, capacity
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[2:]]],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {dict(docs.dtypes)['doc_id']}, {_PIECES}")


def _priced(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, Counter]:
    """The most valuable configuration within ``capacity``: unbounded knapsack, one step per unit of capacity."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = np.searchsorted(lengths, room, side="right")
        if fits:
            worth = values[:fits] + best[room - lengths[:fits]]
            i = int(worth.argmax())
            if worth[i] > best[room - 1]:
                best[room], choice[room] = worth[i], i
                continue
        best[room] = best[room - 1]
    held, room = Counter(), capacity
    while room > 0:
        i = int(choice[room])
        room -= 1 if i < 0 else int(lengths[i])
        if i >= 0:
            held[i] += 1
    return float(best[capacity]), held


def _fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, rate: float):
    """Multiplicative weights for covering: buy the priced configuration, lower the prices of what it covers, and repeat.

    Each purchase is as large as lets no length be covered by more than 1 / ``rounds`` of its count at once. The purchases
    divided by the smallest coverage satisfy every length.
    """
    prices, covered = np.ones(len(lengths)) * lengths / capacity, np.zeros(len(lengths))
    base, bought = prices.copy(), {}
    for _ in range(rounds):
        _, held = _priced(prices, lengths, capacity)
        if not held:
            break
        kinds, number = np.fromiter(held, int), np.fromiter(held.values(), float)
        amount = float((counts[kinds] / number).min()) / 8
        key = tuple(sorted(held.items()))
        bought[key] = bought.get(key, 0.0) + amount
        covered[kinds] += amount * number
        done = covered / counts
        prices = base * np.exp(-rate * (done - done.min()))
    return bought, covered


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 400, rate: float = 12.0) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(configuration as ((length, number), ...), how many sequences)], holding exactly the pieces of the histogram.

    Configurations of the fractional solution are taken as often as the pieces that remain allow; best fit on the remaining
    histogram packs the rest, and as many sequences alike as it allows at a time.
    """
    lengths = np.array(sorted(k for k, v in histogram.items() if v > 0), int)
    if not len(lengths):
        return []
    left = np.array([histogram[int(k)] for k in lengths], np.int64)
    bought, covered = _fractional(lengths, left.astype(float), capacity, rounds, rate)
    scale = float((left / np.maximum(covered, 1e-9)).min()) if bought else 0.0
    out = []

    def take(held: list[tuple[int, int]], times: int):
        if times > 0:
            out.append((tuple((int(lengths[i]), n) for i, n in held), times))
            for i, n in held:
                left[i] -= n * times

    for key, amount in sorted(bought.items(), key=lambda x: -x[1]):
        most = min(int(left[i] // n) for i, n in key)
        fill = sum(int(lengths[i]) * n for i, n in key)
        take(list(key), most if fill == capacity and amount * max(scale, 1.0) >= most else min(most, int(amount * max(scale, 1.0))))
    while left.any():
        held, room, have = [], capacity, left.copy()
        while room:
            i = int(np.searchsorted(lengths, room, side="right")) - 1
            while i >= 0 and not have[i]:
                i -= 1
            if i < 0:
                break
            n = int(min(have[i], room // lengths[i]))
            # Leave room for the best filling of what remains rather than repeating a length that ends in a gap.
            held.append((i, n))
            have[i] -= n
            room -= n * int(lengths[i])
        take(held, min(int(left[i] // n) for i, n in held))
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY, rounds: int = 400, buckets: int = 512) -> DataFrame:
    """Add sequence_id and offset to pieces with a ``length``; offsets are gapless from 0 within a sequence.

    ``cut`` is staged in the shared folder first. The plan of sequences is bounded by the histogram and the rounds and goes to
    every task; pieces find their slot by rank within their length, which is counted in two steps so that no length is
    ranked by one task. Pieces alike in every column are interchangeable.
    """
    cut = stage(cut, "pieces")
    order = [c for c in cut.columns if c not in ("sequence_id", "offset")]
    cut = cut.select(*order).withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    amounts = cut.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    slots = cut.sparkSession.sparkContext.broadcast(_slots(plan(histogram, capacity, rounds)))
    within = F.row_number().over(Window.partitionBy("length", "__bucket").orderBy(*order)) - 1
    ranked = cut.withColumn("__within", within).join(amounts.select("length", "__bucket", before.alias("__before")), ["length", "__bucket"]).select(
        *order, (F.col("__before") + F.col("__within")).cast("long").alias("__rank"))

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        sequences, offsets = _placed(slots.value, lengths.to_numpy(), ranks.to_numpy())
        return pa.StructArray.from_arrays([pa.array(sequences), pa.array(offsets)], ["sequence_id", "offset"])

    found = ranked.withColumn("__slot", place("length", "__rank"))
    return found.select(*order, "__slot.sequence_id", "__slot.offset")


def _slots(configurations) -> dict[int, np.ndarray]:
    """Per length the slots its pieces go to: (first rank, first sequence, pieces per sequence, offset of the first)."""
    per: dict[int, list] = {}
    given, sequence = Counter(), 0
    for held, times in configurations:
        at = 0
        for length, number in held:
            per.setdefault(length, []).append((given[length], sequence, number, at))
            given[length] += number * times
            at += length * number
        sequence += times
    return {length: np.array(rows, np.int64) for length, rows in per.items()}


def _placed(slots: dict[int, np.ndarray], lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sequences, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for length in np.unique(lengths):
        own = lengths == length
        table = slots[int(length)]
        first, sequence, number, at = table[np.searchsorted(table[:, 0], ranks[own], side="right") - 1].T
        inside = ranks[own] - first
        sequences[own] = sequence + inside // number
        offsets[own] = at + inside % number * length
    return sequences, offsets
