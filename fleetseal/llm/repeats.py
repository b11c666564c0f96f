"""Remove sentences that repeat elsewhere, wherever a run of several consecutive sentences occurs again.

A sentence ends after . ! or ? before white space, and at a line break; a sentence of more than ``LONG`` words counts as several.
It is cut before the word whose hash is the smallest of any ``CUT`` neighbouring words, the rightmost of equal ones, so that a
passage is cut alike wherever in a sentence it begins, but for its first and last words. From each sentence on, the shortest run of at least ``several`` sentences and ``words`` words is hashed;
equal runs meet in one join over the whole corpus. Every sentence covered by a run that is not the first of its kind goes.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetseal.llm.common import in_parts

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LINE_BREAK = re.compile(r"[\x0A-\x0D]")
_BREAKS = bytes.maketrans(b"\r\x0B\x0C", b"\n\n\n")
LONG, CUT = 24, 12


def cuts(words: list[bytes]) -> list[int]:
    """Where a long sentence is cut: the places of the smallest hash of every ``CUT`` words in a row, at most ``CUT`` apart."""
    hashes, out, at = [xxhash.xxh3_64_intdigest(w) for w in words], [], -1
    for last in range(CUT - 1, len(hashes)):
        if at <= last - CUT:
            first = last - CUT + 1
            at = max(range(first, last + 1), key=lambda i: (-hashes[i], i))
        elif hashes[last] <= hashes[at]:
            at = last
        else:
            continue
        out.append(at)
    return out[1:] if out and out[0] == 0 else out


def _spans(words: list[bytes]):
    """(first, behind the last) word of every part of a sentence."""
    edges = [0, *(cuts(words) if len(words) > LONG else ()), len(words)]
    return zip(edges, edges[1:])


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of every sentence; between two of them there is white space only."""
    out, begin, end, words = [], 0, 0, []

    def close():
        for at, behind in _spans([w.encode() for _, _, w in words]):
            part = words[at:behind]
            out.append((part[0][0], part[-1][1], [w for _, _, w in part]))

    for match in _WORD.finditer(text):
        word = match[0]
        if words and _LINE_BREAK.search(text, end, match.start()):
            close()
            words = []
        words.append((match.start(), match.end(), word))
        end = match.end()
        if word[-1] in ".!?":
            close()
            words = []
    if words:
        close()
    return out


def worded(text: bytes) -> list[tuple[int, bytes]]:
    """(number of words, words one space apart) of the same sentences, without their places."""
    for mark in (b".", b"!", b"?"):
        text = text.replace(mark + b" ", mark + b"\n").replace(mark + b"\t", mark + b"\n")
    out = []
    for part in text.translate(_BREAKS).split(b"\n"):
        words = part.split()
        if len(words) > LONG:
            out += [(behind - at, b" ".join(words[at:behind])) for at, behind in _spans(words)]
        elif words:
            out.append((len(words), b" ".join(words)))
    return out


def runs(text: bytes, several: int = 2, words: int = 12) -> list[tuple[int, int, int, int, bool]]:
    """(first, behind the last, two halves of a 128-bit hash, whether the text held it before) of each run of sentences."""
    parts = worded(text)
    out, seen, behind, held = [], set(), 0, 0
    for first, (own, _) in enumerate(parts):
        while behind < len(parts) and (behind - first < several or held < words):
            held += parts[behind][0]
            behind += 1
        if behind - first < several or held < words:
            break
        digest = xxhash.xxh3_128_intdigest(b"\n".join([p for _, p in parts[first:behind]]))
        high, low = (digest >> 64) - (1 << 63), (digest & (2**64 - 1)) - (1 << 63)
        out.append((first, behind, high, low, digest in seen))
        seen.add(digest)
        held -= own
    return out


def _all_runs(batches, several: int, words: int):
    names = ["doc_id", "version", "first", "behind", "high", "low", "again"]
    for batch in in_parts(batches, 2):
        rows = [(row, *run) for row, text in enumerate(batch.column(2).cast(pa.binary())) for run in runs(text.as_py() or b"", several, words)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        at = pa.array(columns[0], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *[pa.array(c, pa.int32()) for c in columns[1:3]],
                                          *[pa.array(c, pa.int64()) for c in columns[3:5]], pa.array(columns[5], pa.bool_())], names)


@F.arrow_udf(T.StructType().add("n_sentences", "long").add("n_removed", "long").add("removed", "string").add("text", "string"))
def _without(texts: pa.Array, covered: pa.Array) -> pa.Array:
    """The text without the covered sentences, runs as first << 31 | number; a removed stretch takes the white space behind it along."""
    rows = []
    for text, spans in zip(texts, covered, strict=True):
        text, spans = text.as_py(), spans.as_py() or []
        if not spans:
            rows.append({"n_sentences": len(worded(text.encode())) if text else 0, "n_removed": 0, "removed": "", "text": text})
            continue
        found, gone = sentences(text), set()
        for span in spans:
            first = span >> 31
            gone.update(range(first, first + (span & (1 << 31) - 1)))
        parts, removed, at, i = [], [], 0, 0
        while i < len(found):
            j = i
            while j < len(found) and j in gone:
                j += 1
            if j > i:
                removed.append(f"{found[i][0]}:{found[j - 1][1]}")
                parts.append(text[at:found[i][0]])
                at = found[j][0] if j < len(found) else found[j - 1][1]
            i = j + 1
        rows.append({"n_sentences": len(found), "n_removed": len(gone), "removed": ",".join(removed), "text": "".join([*parts, text[at:]])})
    return pa.array(rows, pa.struct([("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.string()), ("text", pa.string())]))


def remove(docs: DataFrame, several: int = 2, words: int = 12) -> DataFrame:
    """Documents with ``text`` shortened, and n_sentences, n_removed, removed (spans start:end of the text before, comma-joined).

    The first occurrence, kept, is that in the smallest doc_id (null last), and within a document the earliest. Rows that share a
    doc_id are versions of one document: they do not take from each other, and equal ones get equal results. Null texts
    stay null, empty ones and those with too few words lose nothing. Other columns stay; those named like the added are replaced.
    """
    version = F.xxhash64(F.coalesce("text", F.lit("")))
    # Worked out anew by each of the two that read it: that takes less than a copy of every run on disk.
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), version.alias("version"), "text").mapInArrow(
        lambda batches: _all_runs(batches, several, words),
        "doc_id long, version long, first int, behind int, high long, low long, again boolean").select(
            F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), "version", "high", "low",
            (F.shiftleft(F.col("first").cast("long"), 32) + (F.col("behind") - F.col("first")).cast("long") * 2 + F.col("again").cast("long")).alias("place"))
    often = found.groupBy("high", "low").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = found.join(often, ["high", "low"]).filter((F.col("doc_id") > F.col("owner")) | (F.col("place") % 2 == 1))
    covered = later.groupBy("doc_id", "version").agg(
        F.collect_set(F.shiftright("place", 1)).alias("__covered"))  # bounded by the sentences of one document
    others = [c for c in docs.columns if c not in ("text", "n_sentences", "n_removed", "removed")]
    left = docs.select(*others, "text").withColumns({"__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), "__version": version})
    joined = left.join(covered, (F.col("__doc") == covered["doc_id"]) & (F.col("__version") == covered["version"]), "left").select(
        *[left[c] for c in others], left["text"], "__covered")
    return joined.withColumn("__new", _without("text", "__covered")).select(
        *others, "__new.text", "__new.n_sentences", "__new.n_removed", "__new.removed")
