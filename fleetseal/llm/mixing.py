"""Mix sources to target weights along a curriculum.

Every source has a weight schedule over training time 0 to 1, given by knots and linear between them. Its integral says how
many words the source owes in total; the inverse of its running integral says when each of its words is due. Documents of a
source stand in a fixed random order, whole passes over the source come first, and a document is due at the time at which
the running demand reaches the middle of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetseal.operators.ordered import running

# The first 60 bits of a digest order a source; chunks of that order keep a source with most of the rows spread out.
_CHUNK_WIDTH = 1 << 48


def integrated(schedules: DataFrame) -> DataFrame:
    """(source, at, weight) knots to one row per source: its integral and its linear pieces with what was owed before each.

    A source with one knot keeps that weight from 0 to 1. Negative or null weights count as 0, times outside 0 to 1 are moved
    to the border.
    """
    at = F.least(F.greatest(F.coalesce("at", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    knots = schedules.select("source", at.alias("t0"), F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("w0"))
    order = Window.partitionBy("source").orderBy("t0", "w0")
    last, first = F.lead("t0").over(order).isNull(), F.lag("t0").over(order).isNull()
    pieces = knots.select(
        "source", F.when(first, 0.0).otherwise(F.col("t0")).alias("t0"), "w0",
        F.when(last, 1.0).otherwise(F.lead("t0").over(order)).alias("t1"),
        F.when(last, F.col("w0")).otherwise(F.lead("w0").over(order)).alias("w1"))
    owed = pieces.withColumn("owed", (F.col("w0") + F.col("w1")) / 2 * (F.col("t1") - F.col("t0")))
    before = F.coalesce(F.sum("owed").over(Window.partitionBy("source").orderBy("t0", "t1", "w0")
                                           .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return owed.withColumn("before", before).groupBy("source").agg(
        F.sum("owed").alias("weight"), F.array_sort(F.collect_list(F.struct("before", "t0", "t1", "w0", "w1"))).alias("pieces"))


def targets(sizes: DataFrame, weights: DataFrame, ceiling: float = 3.0) -> DataFrame:
    """Share the words of all sources by weight; a source owes at most ``ceiling`` times its size, the excess is reshared.

    ``sizes`` (source, source_size) and ``weights`` (source, weight, ...) have a row per source. Filling by level: in order of
    ceiling per weight, a source is full if the level that the rest would get lies above its own.
    """
    joined = sizes.join(weights.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    limit = F.col("source_size") * ceiling
    whole = Window.partitionBy()
    order = whole.orderBy(F.when(F.col("weight") > 0, limit / F.col("weight")).otherwise(F.lit(float("inf"))), "source")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = joined.withColumns({
        "__limit": limit, "__total": F.sum("source_size").over(whole), "__weights": F.sum("weight").over(whole)}).withColumns({
            "__left": F.col("__total") - F.coalesce(F.sum("__limit").over(past), F.lit(0.0)),
            "__open": F.col("__weights") - F.coalesce(F.sum("weight").over(past), F.lit(0.0))})
    full = (F.col("weight") > 0) & (F.col("__limit") * F.col("__open") <= F.col("__left") * F.col("weight"))
    level = ((F.col("__total") - F.sum(F.when(full, F.col("__limit")).otherwise(0.0)).over(whole))
             / F.nullif(F.col("__weights") - F.sum(F.when(full, F.col("weight")).otherwise(0.0)).over(whole), F.lit(0.0)))
    return ranked.withColumn("target", F.when(full, F.col("__limit")).otherwise(F.coalesce(level * F.col("weight"), F.lit(0.0)))).drop(
        "__limit", "__total", "__weights", "__left", "__open")


def due_time(share: Column, weight: Column, pieces: Column) -> Column:
    """When a source has been asked for ``share`` of all it owes: the inverse of the running integral of its schedule."""
    wanted = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * weight
    piece = F.element_at(F.filter(pieces, lambda p: (p["before"] <= wanted) & (p["t1"] > p["t0"])), -1)
    rest = wanted - piece["before"]
    slope = (piece["w1"] - piece["w0"]) / (piece["t1"] - piece["t0"])
    divisor = piece["w0"] + F.sqrt(F.greatest(piece["w0"] * piece["w0"] + 2 * slope * rest, F.lit(0.0)))
    return F.least(piece["t0"] + F.when(divisor > 0, 2 * rest / divisor).otherwise(0.0), piece["t1"])


def mix(docs: DataFrame, schedules: DataFrame, size: Column, seed: str = "mix", ceiling: float = 3.0,
        tie: Column | None = None) -> DataFrame:
    """Say of every document how often the mix takes it, and when.

    ``docs`` needs doc_id and source; ``schedules`` is (source, at, weight). Adds size, source_size, target, passes, taken
    (size times passes) and positions (array of times, one per pass; null schedule: empty). Null sources are a source of
    their own, null sizes count 0, repeated rows are documents of their own; rows that tie in doc_id and size are ordered by
    ``tie``. A document has as many passes as the target has whole source sizes, and one more if its middle lies within the rest.
    An empty input gives an empty result; columns of ``docs`` called like one of the added are replaced.
    """
    added = ["size", "source_size", "target", "passes", "taken", "positions"]
    kept = [c for c in docs.columns if c not in added]
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 15)
    rows = docs.select(*[F.col(c).alias(f"__c_{c}") for c in kept], F.col("source").alias("__source"),
                       F.coalesce(size, F.lit(0)).cast("long").alias("size"), F.conv(digest, 16, 10).cast("long").alias("__at"),
                       F.col("doc_id").alias("__doc"), (F.lit(0) if tie is None else tie).alias("__tie"))
    sizes = rows.groupBy(F.col("__source").alias("source")).agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, integrated(schedules), ceiling).withColumnRenamed("source", "__of")
    # The window keys its chunks by source; sources are few, so their plan is joined after it.
    placed = running(rows, ["__source"], ["__at", "__doc", "size", "__tie"], {"__before": ("sum", F.col("size"))},
                     widths=(_CHUNK_WIDTH,), inclusive=False)
    joined = placed.join(plan, F.col("__source").eqNullSafe(F.col("__of")), "left")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    before = F.coalesce("__before", F.lit(0))
    extra = before + F.col("size") / 2 <= F.col("target") - F.col("__whole") * F.col("source_size")
    counted = joined.withColumn("__whole", F.coalesce(whole, F.lit(0))).withColumn(
        "passes", (F.col("__whole") + F.when(extra & (F.col("__whole") < ceiling), 1).otherwise(0)).cast("int"))
    positions = F.transform(
        F.when(F.col("passes") > 0, F.sequence(F.lit(0), F.col("passes") - 1)).otherwise(F.array().cast("array<int>")),
        lambda p: due_time(F.when(F.col("target") > 0, (p * F.col("source_size") + before + F.col("size") / 2) / F.col("target"))
                           .otherwise(0.0), F.col("weight"), F.col("pieces")))
    return counted.select(
        *[F.col(f"__c_{c}").alias(c) for c in kept], "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), "passes",
        (F.col("size") * F.col("passes")).alias("taken"), positions.alias("positions"))


def in_training_order(mixed: DataFrame, untaken: bool = False) -> DataFrame:
    """One row per pass, range-sorted by training time (ties by doc_id); ``position`` holds the time, ``pass`` counts from 0.

    With ``untaken`` documents without a pass come last, both columns null.
    """
    each = F.posexplode_outer("positions") if untaken else F.posexplode("positions")
    rest = [c for c in mixed.columns if c not in ("positions", "position", "pass")]
    return mixed.select(*rest, each.alias("pass", "position")).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def cyclic_schedules(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), tilts: tuple[float, ...] = (-0.5, 0.0, 0.5)) -> DataFrame:
    """Schedules for the sources of ``docs`` by code point, null last: weights in turn, each tilted so that its integral stays."""
    sources = docs.select("source").distinct()
    place = F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (place % len(values) + 1).cast("int"))
    ranked = sources.select("source", pick(weights).alias("weight"), pick(tilts).alias("tilt"))
    knots = F.explode(F.array(*[F.struct(F.lit(float(at)).alias("at"), (F.col("weight") * (1 + side * F.col("tilt"))).alias("weight"))
                                for at, side in ((0, -1), (1, 1))]))
    return ranked.select("source", knots.alias("k")).select("source", "k.at", "k.weight")
