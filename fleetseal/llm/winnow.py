"""Fingerprints of texts by winnowing, and their likeness, in native column functions.

A text is cut into units of up to three characters, anew at every white space. Each run of ``gram`` units is hashed, and from every
``window`` neighbouring hashes the smallest is chosen, the rightmost of equal ones. What two texts have in common over at least
``gram + window - 1`` units is then found at one chosen place at least, and runs shorter than ``gram`` units never match.
A chosen hash carries its place: 35 bits of hash, then 28 bits that fall as the place grows, so that the smallest number is
the rightmost of the smallest hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetseal.operators.ordered import previous_row

UNIT = r"[^\x20\x09-\x0D]{1,3}"
GRAM, WINDOW = 4, 16
_PLACE_BITS = 28
_PLACES = (1 << _PLACE_BITS) - 1
_NO_ID = -(2**62)


def _smallest_of(values: Column, step: int) -> Column:
    """At each place the smallest of four values, ``step`` apart; places behind the end do not count."""
    return F.transform(values, lambda x, i: F.least(x, F.get(values, i + step), F.get(values, i + 2 * step), F.get(values, i + 3 * step)))


def fingerprint(docs: DataFrame, text: str, into: str) -> DataFrame:
    """Add the chosen hashes with their places, in order of place; empty for a text without words (or null).

    A text of fewer units than a gram has one hash, one of fewer grams than a window one choice.
    """
    units, hashes, grams, four, least = (f"__{x}_{into}" for x in ("u", "h", "g", "m", "w"))
    number = lambda c, n: F.greatest(F.size(c) - (n - 1), F.least(F.size(c), F.lit(1)))
    get = lambda i: F.get(F.col(hashes), i)
    gram = lambda x, i: F.shiftrightunsigned(F.xxhash64(x, *[get(i + k) for k in range(1, GRAM)]), 63 - _PLACE_BITS - 6)
    return (docs
            .withColumn(units, F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0)))
            .withColumn(hashes, F.transform(units, lambda u: F.xxhash64(u)))
            .withColumn(grams, F.slice(F.transform(F.col(hashes), lambda x, i: F.shiftleft(gram(x, i), _PLACE_BITS) + (F.lit(_PLACES) - i)),
                                       1, number(hashes, GRAM)))
            .withColumn(four, _smallest_of(F.col(grams), 1))
            .withColumn(least, F.slice(_smallest_of(F.col(four), 4), 1, number(grams, WINDOW)))
            .withColumn(into, F.array_distinct(least))
            .drop(units, hashes, grams, four, least))


def places(chosen: Column) -> Column:
    """(hash, place) of each choice; the place counts units from 0."""
    return F.transform(chosen, lambda x: F.struct(F.shiftright(x, _PLACE_BITS).alias("hash"), (F.lit(_PLACES) - x.bitwiseAND(F.lit(_PLACES))).alias("place")))


def likeness(a: Column, b: Column) -> Column:
    """Share of distinct chosen hashes that two fingerprints have in common; 1 for two empty ones."""
    hashes = lambda c: F.array_distinct(F.transform(c, lambda x: F.shiftright(x, _PLACE_BITS)))
    both = F.size(F.array_intersect(hashes(a), hashes(b)))
    every = F.size(hashes(a)) + F.size(hashes(b)) - both
    return F.when(every == 0, 1.0).otherwise(both / every)


def with_next(docs: DataFrame, width: int = 64) -> DataFrame:
    """Add ``chosen`` and, of the next document in descending doc_id (the first after the last), ``next_text`` and ``next_chosen``.

    ``docs`` is (doc_id, text). Rows of one id follow each other by digest of the text, a null id comes last. The ids are cut into
    chunks; a row finds the next one in its own chunk, the last row of a chunk by way of a table of the largest rows of
    chunks, which is cut in the same way.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    rows = docs.withColumns({"__key": key, "__tie": F.xxhash64("text"), "__chunk": F.floor(key / width).cast("long")})
    largest = rows.groupBy("__chunk").agg(F.max_by("text", F.struct("__key", "__tie")).alias("text"))
    ends = rows.agg(F.min("__chunk"), F.max("__chunk")).first()
    if ends[0] is None:
        ends = (0, 0)
    around = largest.filter(F.col("__chunk") == ends[1]).withColumn("__chunk", F.lit(ends[0] - 1).cast("long"))
    # An array keeps a null text apart from no row.
    tops = largest.union(around).select("__chunk", F.array("text").alias("top"))
    before = previous_row(tops, [], ["__chunk"], ["top"], "p", widths=(4096, 4096 * 4096)).select(
        "__chunk", F.get("p.top", F.lit(0)).alias("__text"))
    before = fingerprint(before.filter(F.col("__chunk") >= ends[0]), "__text", "__chosen")
    order = Window.partitionBy("__chunk").orderBy("__key", "__tie")
    local = fingerprint(rows, "text", "chosen").withColumns({
        "__l_text": F.lag("text").over(order), "__l_chosen": F.lag("chosen").over(order)})
    joined = local.join(before, "__chunk", "left")
    inside = F.col("__l_chosen").isNotNull()
    return joined.select(*docs.columns, "chosen", F.when(inside, F.col("__l_text")).otherwise(F.col("__text")).alias("next_text"),
                         F.when(inside, F.col("__l_chosen")).otherwise(F.col("__chosen")).alias("next_chosen"))


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by the first as many of the following text."""
    whole = F.coalesce(text, F.lit(""))
    half = F.floor(F.length(whole) / 2).cast("int")
    return F.concat(F.substring(whole, F.lit(1), F.length(whole) - half), F.substring(F.coalesce(following, F.lit("")), F.lit(1), half))
