"""Link documents whose word-shingle sets overlap by a given Jaccard similarity, and group what links reach.

A size-aware join: in a fixed order of all shingles (common ones last), two similar sets share some of the first elements of
each, their prefixes, and the more of them the larger they are. Equal sets collapse first. Then leaders are tried: the set that
heads most of the inverted lists of a document is compared with it, which finds almost every link without forming pairs within a list. Sets near the leader of a large star
that do not link to it are gathered around it all the same. What is left are stars
(a leader and the sets that link to it or were gathered) which still meet in a list without being connected. For these, stars with few such
lists enumerate their pairs of elements, stars with many scan the lists; the boundary between the two is the cheapest. Two stars
whose leaders are too far apart for any of their members to link are done with (Jaccard distance is a metric). Of
the others, the members of the smaller star are compared with the leader of the larger. That leader bounds what two members can
have in common within it, so most pairs can only link by elements outside of it, and those are few and make short lists.
Sets gathered around one leader are told apart in the same way. Every decision is the exact overlap of whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetseal.llm.common import drop, stage
from fleetseal.llm.components import components

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
# Stars of so many sets take in what is no farther from their leader. Both change the cost, never the result.
_LARGE, _FAR = 8, 0.75
_SLICE = 1 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _slices(texts: pa.Array):
    held, size = [], 0
    for text in texts.cast(pa.binary()):
        text = text.as_py() or b""
        if held and size + len(text) > _SLICE:
            yield held
            held, size = [], 0
        held.append(text.lower().split())
        size += len(text)
    if held:
        yield held


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sets(words: list[list[bytes]], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than ``width`` make one shingle, none an empty set."""
    numbers: dict[bytes, int] = {}
    codes = np.array([numbers.setdefault(w, len(numbers)) for own in words for w in own], np.int64)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in numbers], np.uint64)[codes] if len(codes) else np.zeros(0, np.uint64)
    n = len(hashes) - width + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        rolled = rolled * _FACTOR + hashes[k:k + n]
    rolled = _mixed(rolled).view(np.int64)
    out, at = [], 0
    for own in words:
        if len(own) >= width:
            out.append(np.unique(rolled[at:at + len(own) - width + 1]))
        elif own:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(own), seed=len(own)) - (1 << 63)], np.int64))
        else:
            out.append(np.zeros(0, np.int64))
        at += len(own)
    return out


def _needed(size: int) -> int:
    """Least overlap of a set of this size with anything it links to."""
    return -(-NUMERATOR * size // DENOMINATOR)


def _extra(size):
    """How many elements two linked sets have in common within their prefixes at least, by the size of the smaller one."""
    return 2 + size // 20


def common_shingles(docs: DataFrame, width: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles in many documents, sorted, at most 1 / ``share`` of them, and the rank of each by how many: they come last
    in the order of shingles, the commonest at the end.

    Counts only add up what is frequent within a slice of a task. Which shingles are taken for common changes the cost, never the result.
    """
    def work(batches):
        for batch in batches:
            for words in _slices(batch.column(0)):
                sets = _sets(words, width)
                keys, n = np.unique(np.concatenate(sets), return_counts=True)
                often = n >= 3
                yield pa.RecordBatch.from_arrays([pa.array(keys[often]), pa.array(n[often]), pa.array([0] * int(often.sum()), pa.int64())], ["key", "n", "all"])
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([sum(map(len, sets))], pa.int64())], ["key", "n", "all"])
    counted = stage(docs.select("text").mapInArrow(work, "key long, n long, all long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("all").alias("all")), "common")
    total = counted.agg(F.sum("all")).first()[0] or 0
    found = counted.filter(F.col("n") >= max(8, total * share)).select("key", "n").toArrow()
    keys, n = found["key"].to_numpy(), found["n"].to_numpy()
    by_key, rank = np.argsort(keys), np.empty(len(keys), np.int64)
    rank[np.lexsort((keys, n))] = np.arange(len(keys))
    return keys[by_key], rank[by_key]


def shingle_sets(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], width: int) -> DataFrame:
    """(doc_id, version, n, high, low, rare, often): size and digest of each set, and its prefix, uncommon and common elements apart."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def work(batches):
        last, rank = shared.value
        for batch in batches:
            at = 0
            for words in _slices(batch.column(2)):
                columns = [[], [], [], [], []]
                for own in _sets(words, width):
                    digest = xxhash.xxh3_128_intdigest(own.tobytes())
                    place = np.minimum(np.searchsorted(last, own), len(last) - 1)
                    is_common = last[place] == own if len(last) else np.zeros(len(own), bool)
                    length = min(len(own), len(own) - _needed(len(own)) + _extra(len(own)))
                    rare = own[~is_common][:length]
                    often = own[is_common][np.argsort(rank[place[is_common]])][:length - len(rare)] if len(rare) < length else own[:0]
                    for column, value in zip(columns, (len(own), (digest >> 64) - (1 << 63), (digest & (2**64 - 1)) - (1 << 63),
                                                       rare, often), strict=True):
                        column.append(value)
                part = slice(at, at + len(words))
                at += len(words)
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], batch.column(1)[part], *[pa.array(c, pa.int64()) for c in columns[:3]],
                                                  *[pa.array(c, pa.list_(pa.int64())) for c in columns[3:]]], ["doc_id", "version", "n", "high", "low", "rare", "often"])
    return docs.select("doc_id", "version", "text").mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, version long, n long, high long, low long, rare array<long>, often array<long>")


def _whole_sets(texts: DataFrame, width: int) -> DataFrame:
    """(row, elements) of texts with the row and digest of the kind they are expected to be; of texts side by side that agree, one."""
    def work(batches):
        last = None
        for batch in batches:
            at = 0
            for words in _slices(batch.column(3)):
                rows, kept = [], []
                expected = [c[at:at + len(words)].to_pylist() for c in batch.columns[:3]]
                at += len(words)
                for row, high, low, own in zip(*expected, _sets(words, width), strict=True):
                    digest = xxhash.xxh3_128_intdigest(own.tobytes())
                    if row != last and ((digest >> 64) - (1 << 63), (digest & (2**64 - 1)) - (1 << 63)) == (high, low):
                        rows.append(row)
                        kept.append(own)
                        last = row
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(kept, pa.list_(pa.int64()))], ["row", "elements"])
    return texts.select("row", "high", "low", "text").mapInArrow(work, "row long, elements array<long>")


def _overlap_needed(a: Column, b: Column) -> Column:
    return F.ceil((a + b) * F.lit(NUMERATOR) / F.lit(NUMERATOR + DENOMINATOR) - 1e-9)


def _may_link(a: Column, b: Column) -> Column:
    return (F.least(a, b) * DENOMINATOR >= F.greatest(a, b) * NUMERATOR)


def _shared_needed(a: Column, b: Column) -> Column:
    """Least number of common prefix elements of two linked sets: what the larger one has behind its prefix can add no more."""
    behind = lambda n: F.ceil(n * NUMERATOR / F.lit(DENOMINATOR) - 1e-9) - _more(n)
    return F.greatest(_more(F.least(a, b)), _overlap_needed(a, b) - F.greatest(behind(a), behind(b)))


def _more(n: Column) -> Column:
    return 2 + F.floor(n / 20)


def _compared(pairs: DataFrame, elements: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) with n_a, n_b and their overlap, from whole sets; each set travels once per pair."""
    # Sets are small in files and large in memory: they are not to be broadcast by the size of a file.
    side = lambda name: elements.select(F.col("row").alias(name), F.col("elements").alias(f"__{name}")).hint("merge")
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    return met.select(*pairs.columns, F.size("__a").alias("n_a"), F.size("__b").alias("n_b"), F.size(F.array_intersect("__a", "__b")).alias("overlap"))


def _linked() -> Column:
    return F.col("overlap") * DENOMINATOR >= (F.col("n_a") + F.col("n_b") - F.col("overlap")) * NUMERATOR


def _distance() -> Column:
    return 1 - F.col("overlap") / (F.col("n_a") + F.col("n_b") - F.col("overlap"))


def inverted_lists(sets: DataFrame, kinds: DataFrame) -> DataFrame:
    """(key, row, n): elements of prefixes and the kinds of sets that have them, where more than one has."""
    # Uncommon elements head short lists, so a window over each is bounded; common ones are counted before they meet.
    rare = sets.select(F.explode("rare").alias("key"), "high", "n").withColumn("__n", F.count("*").over(Window.partitionBy("key"))).filter("__n > 1").drop("__n")
    often = sets.select(F.explode("often").alias("key"), "high", "n")
    # Half a digest may stand for two kinds, which makes a list longer than it need be and no more.
    met = stage(rare.union(often).distinct().join(kinds.select("row", "high", "n"), ["high", "n"]).select("key", "row", "n"), "lists")
    several = met.groupBy("key").agg(F.count("*").alias("__n")).filter("__n > 1").select("key")
    return met.join(several, "key", "left_semi")


def _leaders(lists: DataFrame, turn: int) -> DataFrame:
    """(a, b): each set with the one that heads most of its lists, if they have enough elements in common to link.

    At first the set whose lists are longest heads a list: of edited copies the text that they were made from, as edits are in short lists.
    """
    place = F.xxhash64("row", F.lit(turn))
    if turn == 0:
        lengths = lists.groupBy("key").agg(F.count("*").alias("length"))
        lists = lists.join(lists.join(lengths, "key").groupBy("row").agg(F.sum("length").alias("weight")), "row")
        place = -F.col("weight")
    heads = lists.groupBy("key").agg(F.min(F.struct(place.alias("p"), "row", "n")).alias("h")).select("key", F.col("h.row").alias("b"), F.col("h.n").alias("m"))
    met = lists.join(heads, "key").filter((F.col("row") != F.col("b")) & _may_link(F.col("n"), F.col("m")))
    counted = met.groupBy("row", "b", "n", "m").agg(F.count("*").alias("common")).filter(F.col("common") >= _shared_needed(F.col("n"), F.col("m")))
    return counted.groupBy("row").agg(F.max_by("b", F.struct("common", -F.col("b"))).alias("b")).select(F.col("row").alias("a"), "b")


def _gathered(lists: DataFrame, stars: DataFrame, elements: DataFrame) -> DataFrame:
    """(row, star, distance, overlap, linked): members of small stars and sets without one, if their leader is near the leader of a
    large star, with that star.

    They need not link to that leader. Most sets that were made from one text and lie too far from it are told apart by it.
    """
    extent = stars.groupBy("star").agg(F.count("*").alias("size"))
    leading = (lists.join(stars.select("row", "star"), "row", "left").filter("star is null or star = row").drop("star")
               .join(extent.withColumnRenamed("star", "row"), "row", "left").withColumn("size", F.coalesce("size", F.lit(1))))
    heads = leading.filter(F.col("size") >= _LARGE).groupBy("key").agg(F.max(F.struct("size", "row")).alias("h")).select("key", F.col("h.row").alias("b"), F.col("h.size").alias("most"))
    met = leading.join(heads, "key").filter(F.col("size") < F.col("most")).groupBy("row", "b").agg(F.count("*").alias("common")).filter("common > 1")
    wanted = met.groupBy("row").agg(F.max_by("b", F.struct("common", "b")).alias("b")).select(F.col("row").alias("a"), "b")
    moves = stage(_compared(wanted, elements).filter(_distance() <= _FAR).select("a", "b"), "moves")
    moves = moves.join(moves.select(F.col("a").alias("b")), "b", "left_anti").select(F.col("a").alias("star"), "b")
    moved = stars.join(moves, "star").select(F.col("row").alias("a"), "b").union(
        moves.join(stars.select("star").distinct(), "star", "left_anti").select(F.col("star").alias("a"), "b"))
    return stage(_compared(moved, elements).select(F.col("a").alias("row"), F.col("b").alias("star"), _distance().alias("distance"), "overlap", _linked().alias("linked")), "gathered")


def _groups_of(stars: DataFrame, groups: DataFrame) -> DataFrame:
    """(star, group): the group of all members of a star, or a number of the star alone if they are of several."""
    placed = stars.join(groups.withColumnRenamed("node", "row"), "row", "left").withColumn("group", F.coalesce("component", "row"))
    return placed.groupBy("star").agg(F.when(F.min("group") == F.max("group"), F.min("group")).otherwise(-1 - F.col("star")).alias("group"))


def _open_stars(lists: DataFrame, stars: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, star, group, low, high): stars in lists which hold several groups, with the sizes of their members."""
    placed = (lists.join(stars.join(_groups_of(stars, groups), "star"), "row", "left")
              .withColumns({"star": F.coalesce("star", "row"), "group": F.coalesce("group", "row")}))
    narrow = placed.groupBy("key", "star", "group").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    several = narrow.groupBy("key").agg(F.min("group").alias("x"), F.max("group").alias("y")).filter("x <> y").select("key")
    return narrow.join(several, "key", "left_semi")


def _boundary(open_: DataFrame) -> int:
    """Up to how many lists a star enumerates pairs of elements rather than scan the lists: the cheapest, over powers of two."""
    lists = open_.groupBy("key").agg(F.count("*").alias("stars"))
    per = open_.join(lists, "key").groupBy("star").agg(F.count("*").alias("q"), F.sum(F.col("stars") - 1).alias("scan"))
    level = F.ceil(F.log2(F.col("q"))).cast("int")
    costs = per.groupBy(level.alias("level")).agg(F.sum(F.col("q") * (F.col("q") - 1) / 2).alias("pairs"), F.sum("scan").alias("scan")).collect()  # a row per power
    best = min(range(-1, 64), key=lambda b: (sum(c.pairs if c.level <= b else c.scan for c in costs), b))
    return 2**best if best >= 0 else 0


def _meeting_stars(open_: DataFrame) -> DataFrame:
    """(a, b): stars of different groups with two open lists in common and sizes that may link."""
    # The open lists of two stars that link have so many elements in common that the shortest lists of each suffice.
    open_ = stage(open_, "open")
    of_star = Window.partitionBy("star")
    least = _more(F.ceil(F.min("low").over(of_star) * NUMERATOR / F.lit(DENOMINATOR) - 1e-9))
    lengths = open_.groupBy("key").agg(F.count("*").alias("stars"))
    open_ = stage(open_.join(lengths, "key").withColumns({
        "place": F.row_number().over(of_star.orderBy("stars", "key")), "last": F.count("*").over(of_star) - least + 2})
        .filter("place <= last").drop("stars", "place", "last"), "open")
    bound = _boundary(open_)
    sized = open_.join(open_.groupBy("star").agg(F.count("*").alias("q")), "star").withColumn("small", F.col("q") <= bound)
    side = lambda s: sized.select("key", "small", *[F.col(c).alias(f"{c}_{s}") for c in ("star", "group", "low", "high")]).withColumnRenamed("small", f"small_{s}")
    fits = ((F.col("star_a") != F.col("star_b")) & (F.col("group_a") != F.col("group_b"))
            & (F.col("low_a") * NUMERATOR <= F.col("high_b") * DENOMINATOR) & (F.col("low_b") * NUMERATOR <= F.col("high_a") * DENOMINATOR))
    pair = [F.least("star_a", "star_b").alias("a"), F.greatest("star_a", "star_b").alias("b")]
    # Large stars scan every list they are in; a pair of large stars meets twice, so it is taken from one side.
    scanned = side("a").filter(~F.col("small_a")).join(side("b"), "key").filter(fits & (F.col("small_b") | (F.col("star_a") < F.col("star_b"))))
    of_large = scanned.groupBy(*pair).agg(F.count("*").alias("c")).filter("c > 1").select("a", "b")
    own = sized.filter("small").groupBy("star", "group").agg(
        F.array_sort(F.collect_list("key")).alias("keys"), F.min("low").alias("low"), F.max("high").alias("high"))  # at most ``bound`` keys
    rest = F.explode(F.slice(F.col("keys"), F.col("i") + 2, F.size("keys")))
    subsets = own.select("*", F.posexplode("keys").alias("i", "x")).withColumn("y", rest).select("x", "y", "star", "group", "low", "high")
    half = lambda s: subsets.select("x", "y", *[F.col(c).alias(f"{c}_{s}") for c in ("star", "group", "low", "high")])
    of_small = half("a").join(half("b"), ["x", "y"]).filter(fits & (F.col("star_a") < F.col("star_b"))).select(*pair)
    return of_large.union(of_small).distinct()


def _between_stars(close: DataFrame, stars: DataFrame, sizes: DataFrame, groups: DataFrame, links: DataFrame, lists: DataFrame, elements: DataFrame) -> DataFrame:
    """(a, b): links between members of close stars (a, b, apart), or of one star (a = b), that are in different groups by ``links``.

    ``groups`` are those of some of the links.

    Let x be a member of one star and c the leader of the other (or of its own). x and a member y of that star have at most
    min(|x & c|, |y & c|) elements in common within c. If that is less than a link of the two needs, they must share the rest outside
    of c: they meet in lists of such elements only, and of these in the shortest. Other pairs meet in the lists of prefixes.
    """
    reach = F.lit(1 - NUMERATOR / DENOMINATOR + 1e-9)
    extent = stars.groupBy("star").agg(F.count("*").alias("size"), F.max("distance").alias("radius"))
    ends = close.select(F.explode(F.array("a", "b")).alias("star")).distinct()
    alone = ends.join(extent, "star", "left_anti").select(F.col("star").alias("row"), "star", F.lit(0.0).alias("distance"), F.lit(None).cast("int").alias("overlap"))
    rows = stage(stars.join(ends, "star", "left_semi").select("row", "star", "distance", "overlap").union(alone).join(sizes, "row")
                 .select("row", "star", "distance", F.coalesce("overlap", "n").alias("inside"), "n"), "rows")

    of = lambda s: extent.select(F.col("star").alias(s), F.col("size").alias(f"size_{s}"), F.col("radius").alias(f"radius_{s}"))
    larger = F.coalesce("size_a", F.lit(1)) > F.coalesce("size_b", F.lit(1))
    turned = close.filter("a <> b").join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        F.when(larger, F.col("b")).otherwise(F.col("a")).alias("small"), F.when(larger, F.col("a")).otherwise(F.col("b")).alias("b"), "apart",
        F.coalesce(F.when(larger, F.col("radius_a")).otherwise(F.col("radius_b")), F.lit(0.0)).alias("radius"))
    to_try = (turned.join(rows.select(F.col("row").alias("a"), F.col("star").alias("small"), "distance"), "small")
              .filter(F.col("apart") <= F.col("distance") + F.col("radius") + reach)
              .join(groups.select(F.col("node").alias("a"), F.col("component").alias("group")), "a", "left")
              .join(_groups_of(stars, groups).select(F.col("star").alias("b"), F.col("group").alias("of_b")), "b", "left")
              .filter(F.coalesce("group", "a") != F.coalesce("of_b", "b")))
    probed = stage(_compared(to_try.select("a", "b", "radius"), elements), "probed")
    found = probed.filter(_linked()).select("a", "b")
    # What is of one group by now needs no more links.
    by_now = components(links.union(found)).withColumnRenamed("node", "row")
    rows = stage(rows.join(by_now, "row", "left").withColumn("group", F.coalesce("component", "row")).drop("component"), "rows")
    of_leader = rows.filter("row = star").select("star", F.col("group").alias("leads"))
    members = rows.filter("row <> star").join(of_leader, "star").withColumn("loose", F.col("group") != F.col("leads")).drop("leads", "distance")
    inner = close.filter("a = b").select(F.col("a").alias("star"))
    own = members.filter("loose").join(inner, "star", "left_semi")
    coming = (probed.filter(_distance() <= reach + F.col("radius")).select(F.col("b").alias("star"), F.col("a").alias("row"), F.col("overlap").alias("inside"))
              .join(rows.select("row", "n", "group"), "row").select("row", "star", "inside", "n", "group"))
    columns = ["star", "row", "n", "inside", "group"]
    seeks = coming.select(*columns, F.lit(False).alias("own")).union(own.select(*columns, F.lit(True).alias("own")))
    # A set seeks nothing in a star all of whose members are of its group.
    held = members.groupBy("star").agg(F.min("group").alias("__x"), F.max("group").alias("__y"))
    near = stage(seeks.join(held, "star").filter((F.col("__x") != F.col("group")) | (F.col("__y") != F.col("group"))).drop("__x", "__y"), "near")
    others = stage(members.join(near.select("star").distinct(), "star", "left_semi").select(*columns, "loose"), "others")

    within = F.least("inside_1", "inside_2")
    needed = _overlap_needed(F.col("n_1"), F.col("n_2"))
    outer = F.least(F.col("n_1") - F.col("inside_1"), F.col("n_2") - F.col("inside_2"))
    fits = ((F.col("group_1") != F.col("group_2")) & _may_link(F.col("n_1"), F.col("n_2")) & (within + outer >= needed)
            & (~F.col("own") | ~F.col("loose") | (F.col("row_1") < F.col("row_2"))))
    side = lambda rows, i: rows.select("star", *[c for c in rows.columns if c in ("key", "share", "own", "loose")],
                                       *[F.col(c).alias(f"{c}_{i}") for c in ("row", "n", "inside", "group")])

    # Elements outside of the leader, in order of how many have them. Of those a set shares at least ``k`` with what it links to, so it
    # meets that with ``share`` of its first ones.
    both = near.filter("not own").select("star", "row", "n", "inside").union(others.select("star", "row", "n", "inside"))
    whole = lambda row, name: elements.select(F.col("row").alias(row), F.col("elements").alias(name)).hint("merge")
    keys = stage(both.join(whole("row", "__own"), "row").join(whole("star", "__star"), "star")
                 .select("star", "row", "n", "inside", F.explode(F.array_except("__own", "__star")).alias("key")), "outside")
    k = F.greatest(F.lit(1), F.ceil(F.col("n") * NUMERATOR / F.lit(DENOMINATOR) - 1e-9) - F.col("inside"))
    of_row = Window.partitionBy("star", "row")
    counts = keys.groupBy("star", "key").agg(F.count("*").alias("rows"))
    heading = (keys.join(counts, ["star", "key"]).withColumns({"place": F.row_number().over(of_row.orderBy("rows", "key")), "share": 1 + F.floor((k - 1) / 4)})
               .filter((F.col("place") <= F.col("n") - F.col("inside") - k + F.col("share")) & (F.col("rows") > 1)).select("star", "row", "key", "share"))
    heading = stage(heading, "heading")
    with_keys = lambda rows, i: side(rows.join(heading, ["star", "row"]), i).withColumnRenamed("share", f"share_{i}")
    apart = (with_keys(near, 1).join(with_keys(others, 2).hint("merge"), ["star", "key"]).filter(fits & (within < needed))
             .groupBy("row_1", "row_2", F.least("share_1", "share_2").alias("share")).agg(F.count("*").alias("c"))
             .filter(F.col("c") >= F.col("share")).select("row_1", "row_2"))

    # For most sets no member of the other star can be within ``within``: sizes tell.
    room = lambda inside, n: F.col(inside) * F.lit((NUMERATOR + DENOMINATOR) / NUMERATOR) - F.col(n) + 1e-6
    best = others.groupBy("star").agg(F.min("n").alias("least"), F.max(room("inside", "n")).alias("most"))
    candidates = near.join(best, "star").filter((F.col("least") <= room("inside", "n")) & (F.col("n") <= F.col("most"))).drop("least", "most")
    listed = lambda rows, i: side(rows.join(lists.select("row", "key"), "row"), i)
    alike = (listed(candidates, 1).join(listed(others, 2).hint("merge"), ["star", "key"]).filter(fits & (within >= needed))
             .groupBy("row_1", "row_2", "n_1", "n_2").agg(F.count("*").alias("c")).filter(F.col("c") >= _shared_needed(F.col("n_1"), F.col("n_2")))
             .select("row_1", "row_2"))
    pairs = stage(apart.union(alike).select(F.col("row_1").alias("a"), F.col("row_2").alias("b")).distinct(), "pairs")
    return found.union(stage(_compared(pairs, elements).filter(_linked()).select("a", "b"), "last"))


def link(docs: DataFrame, width: int = SHINGLE, leader_rounds: int = 3, common_share: float = 2.0**-20) -> DataFrame:
    """(doc_id, version, n_shingles, component_id, component): one row per row of ``docs``, which needs doc_id and text.

    Two documents link if their sets of distinct ``width``-word shingles have a Jaccard similarity of 0.75 or more; component_id
    is the smallest doc_id that links reach. Fewer words make one shingle; a null or empty text has no set, links with
    nothing, keeps its own id and has no component. Repeated rows are rows with equal sets; a null doc_id counts as none.
    ``version`` is a digest of the text, ``component`` a number of the group.
    """
    docs = docs.select("doc_id", "text").withColumn("version", F.xxhash64("text"))
    sets = stage(shingle_sets(docs, common_shingles(docs, width, common_share), width), "sets")
    named = stage(sets.drop("rare", "often"), "named")
    # Kinds get their numbers once, in a written table.
    kinds = stage(sets.filter("n > 0").groupBy("n", "high", "low").agg(F.min("doc_id").alias("first"), F.min(F.struct("version", "doc_id")).alias("text"))
                  .withColumn("row", F.monotonically_increasing_id()), "kinds")
    lists = stage(inverted_lists(sets, kinds), "lists")
    drop(sets)
    # A set with fewer elements in lists than any link of it needs has no link.
    least = _more(F.ceil(F.col("n") * NUMERATOR / F.lit(DENOMINATOR) - 1e-9))
    several = lists.groupBy("row").agg(F.count("*").alias("c"), F.first("n").alias("n")).filter(F.col("c") >= least).select("row")
    lists = stage(lists.join(several, "row", "left_semi"), "lists")
    # One text of each kind is read; rows that repeat in id and text are left out once they are sets.
    read = kinds.join(several, "row", "left_semi").select("text.version", F.col("text.doc_id").alias("__id"), "row", "high", "low")
    texts = docs.join(read, (docs["version"] == read["version"]) & docs["doc_id"].eqNullSafe(read["__id"])).select("row", "high", "low", "text")
    elements = stage(_whole_sets(texts, width).groupBy("row").agg(F.first("elements").alias("elements")), "elements")

    spark, none = docs.sparkSession, "a long, b long, distance double, overlap int"
    found, free = [spark.createDataFrame([], none)], lists
    for turn in range(leader_rounds):
        tried = stage(_compared(_leaders(free, turn), elements).filter(_linked()).select("a", "b", _distance().alias("distance"), "overlap"), "tried")
        if tried.isEmpty():
            break
        found.append(tried)
        taken = tried.select(F.explode(F.array("a", "b")).alias("row")).distinct()
        free = free.join(taken, "row", "left_anti")
    leads = found[0]
    for more in found[1:]:
        leads = leads.union(more)
    leads = stage(leads, "leads")
    # A leader is the centre of its own star, even if it has a leader itself.
    centres = leads.select(F.col("b").alias("row")).distinct().withColumns({"star": F.col("row"), "distance": F.lit(0.0), "overlap": F.lit(None).cast("int")})
    members = leads.join(centres.select(F.col("row").alias("a")), "a", "left_anti").select(F.col("a").alias("row"), F.col("b").alias("star"), "distance", "overlap")
    stars = stage(centres.union(members), "stars")
    gathered = _gathered(lists, stars, elements)
    leads = leads.select("a", "b").union(gathered.filter("linked").select(F.col("row").alias("a"), F.col("star").alias("b")))
    stars = stage(stars.join(gathered.select("row"), "row", "left_anti").union(gathered.drop("linked")), "stars")
    radius = stars.groupBy("star").agg(F.max("distance").alias("radius"))

    groups = components(leads)
    meeting = stage(_compared(_meeting_stars(_open_stars(lists, stars.select("row", "star"), groups)), elements)
                    .withColumns({"linked": _linked(), "distance": _distance()}), "meeting")
    links = leads.union(meeting.filter("linked").select("a", "b"))
    of = lambda s: radius.select(F.col("star").alias(s), F.col("radius").alias(f"r_{s}"))
    reach = F.lit(1 - NUMERATOR / DENOMINATOR + 1e-9)
    close = meeting.filter("not linked").join(of("a"), "a", "left").join(of("b"), "b", "left").filter(
        (F.coalesce("r_a", F.lit(0.0)) + F.coalesce("r_b", F.lit(0.0)) > 0)
        & (F.col("distance") <= reach + F.coalesce("r_a", F.lit(0.0)) + F.coalesce("r_b", F.lit(0.0)))).select("a", "b", F.col("distance").alias("apart"))
    inner = gathered.select(F.col("star").alias("a"), F.col("star").alias("b"), F.lit(0.0).alias("apart")).distinct()
    close = stage(close.union(inner), "close")
    if not close.isEmpty():
        links = links.union(_between_stars(close, stars, kinds.select("row", "n"), groups, links, lists, elements))
    groups = components(links)

    grouped = kinds.join(groups.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    names = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    told = grouped.join(names, "component").select("n", "high", "low", "component", "component_id")
    return named.join(told, ["n", "high", "low"], "left").select(
        "doc_id", "version", F.col("n").alias("n_shingles"),
        F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "component")
