"""Score texts with a probabilistic suffix tree learned from the corpus.

Symbols are the UTF-8 bytes of the lower-cased words, each followed by a space, and one end mark. A context of up to ``depth``
symbols becomes a state if it is frequent enough and its next-symbol distribution diverges from that of its longest proper
suffix; the suffixes of a state are states. A state mixes its counts with the distribution of its parent, as heavily as it has
seen different symbols. Every symbol is scored by the longest state that is a suffix of what came before. The probability of a
word is the mean of what the tree gives to its symbols and of the smoothed frequency of the word, which remembers long words. In
that frequency all words never seen are one class, as they are in the base; a text's score is that of its words up to that class.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetseal.llm.common import drop, stage

START, END, SPACE = 0xFE, 0xFF, 0x20  # the marks are no bytes of UTF-8
_SLICE = 512 << 10
_WORDS_AT_ONCE = 200_000
_GRAM, _WORD = 0, 1
_LEN_SHIFT = 58
LN10, LOG2 = np.log(10), np.log10(2)


def _word_key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) >> 1


_END_KEY = _word_key(b"")  # no word is empty


def _slices(texts: pa.Array):
    """(first row, words of each text) a bounded number of bytes at a time; a longer text comes alone."""
    first, held, size = 0, [], 0
    for row, text in enumerate(texts.cast(pa.binary())):
        text = text.as_py() or b""
        if held and size + len(text) > _SLICE:
            yield first, held
            first, held, size = row, [], 0
        held.append(text.lower().split())
        size += len(text)
    if held:
        yield first, held


def _symbols(words: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after the other, each with ``depth`` start marks before and the end mark after it; and where each begins."""
    pad, parts = bytes([START]) * depth, []
    for own in words:
        parts.append(pad + b" ".join(own) + (b" \xff" if own else b"\xff"))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts[:-1])])


def _grams(symbols: np.ndarray, depth: int) -> np.ndarray:
    """depth symbols of context and the next one as a number, for every place from ``depth`` on; -1 where the next is a start mark."""
    n = len(symbols) - depth
    grams = np.zeros(n, np.int64)
    for k in range(depth + 1):
        grams = (grams << 8) | symbols[k:k + n]
    grams[symbols[depth:] == START] = -1
    return grams


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def counts(docs: DataFrame, depth: int, text: str = "text") -> DataFrame:
    """(kind, key, n): occurrences of every gram of symbols and of every word (with the end as a word) over all documents."""
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def rows(kind, keys, numbers):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys, pa.int64()), pa.array(numbers, pa.int64())], schema=schema)

    def work(batches):
        from collections import Counter
        grams, held, words = [], 0, Counter()
        for batch in batches:
            for _, own in _slices(batch.column(0)):
                keys, numbers = np.unique(_grams(_symbols(own, depth)[0], depth), return_counts=True)
                known = keys >= 0
                grams.append((keys[known], numbers[known]))
                held += int(known.sum())
                if held > 1_500_000:
                    grams = [_merged(grams)]
                    held = len(grams[0][0])
                    if held > 1_000_000:
                        yield rows(_GRAM, *grams[0])
                        grams, held = [], 0
                for line in own:
                    words.update(line)
                words[b""] += len(own)
                if len(words) > _WORDS_AT_ONCE:
                    yield rows(_WORD, [_word_key(w) for w in words], list(words.values()))
                    words.clear()
        if grams:
            yield rows(_GRAM, *_merged(grams))
        if words:
            yield rows(_WORD, [_word_key(w) for w in words], list(words.values()))

    return docs.select(text).mapInArrow(work, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _below(grams: DataFrame, depth: int) -> DataFrame:
    """(len, ctx, sym, n) of every context of up to ``depth`` symbols; the longest are the grams themselves."""
    masks = [F.lit((1 << 8 * k) - 1).cast("long") for k in range(depth + 1)]
    mask = F.element_at(F.array(*masks), F.col("len") + 1)
    ctx, sym = F.shiftright("key", 8), F.col("key").bitwiseAND(F.lit(255)).cast("int").alias("sym")
    shorter = (grams.withColumn("len", F.explode(F.sequence(F.lit(0), F.lit(depth - 1)))).select("len", ctx.bitwiseAND(mask).alias("ctx"), sym, "n")
               .groupBy("len", "ctx", "sym").agg(F.sum("n").alias("n")))
    return shorter.unionByName(grams.select(F.lit(depth).alias("len"), ctx.bitwiseAND(masks[depth]).alias("ctx"), sym, "n"))


def states(grams: DataFrame, depth: int, symbols: int, penalty: float = 2.0, closed_from: float | None = None) -> DataFrame:
    """(len, ctx, sym, n, total, kinds) of the states. ``grams`` is (key, n) with distinct keys, ``symbols`` how many were counted.

    A context that occurs twice is kept if its counts times the divergence from its parent exceed ``penalty`` times the logarithm of
    all symbols, or if a longer kept context needs it; all its symbols count. With ``closed_from``, the shortest contexts of at
    least that total which are no states come along, with a null symbol: no longer context of theirs is a state.
    """
    masks = [F.lit((1 << 8 * k) - 1).cast("long") for k in range(depth + 1)]
    mask, parent_mask = (F.element_at(F.array(*m), F.col("len") + 1) for m in (masks, [masks[0], *masks[:-1]]))
    nodes = _below(grams, depth)
    totals = nodes.groupBy("len", "ctx").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).filter("len = 0 or total >= 2")
    contexts = stage(nodes.join(totals, ["len", "ctx"]), "contexts")
    above = contexts.select(F.col("len").alias("p_len"), F.col("ctx").alias("p_ctx"), F.col("sym").alias("p_sym"), F.col("n").alias("p_n"), F.col("total").alias("p_total"))
    compared = contexts.filter("len > 0").withColumns({"p_len": F.col("len") - 1, "p_ctx": F.col("ctx").bitwiseAND(parent_mask), "p_sym": F.col("sym")}).join(
        above, ["p_len", "p_ctx", "p_sym"], "left")
    gain = F.sum(F.col("n") * F.log((F.col("n") / F.col("total")) / (F.coalesce("p_n", "n") / F.coalesce("p_total", F.lit(float(symbols))))))
    diverging = compared.groupBy("len", "ctx").agg(gain.alias("gain")).filter(F.col("gain") > penalty * float(np.log(max(symbols, 2))))
    suffixes = diverging.select("ctx", F.explode(F.sequence(F.lit(1), F.col("len"))).alias("len"))
    kept = stage(suffixes.select("len", F.col("ctx").bitwiseAND(mask).alias("ctx")).distinct(), "states")
    columns = ["len", "ctx", "sym", "n", "total", "kinds"]
    found = contexts.join(kept, ["len", "ctx"], "left_semi").unionByName(contexts.filter("len = 0")).select(*columns)
    if closed_from is None:
        return found
    frequent = contexts.filter(F.col("total") >= closed_from).filter("len > 0").select("len", "ctx", "total", "kinds").distinct()
    closed = frequent.join(kept, ["len", "ctx"], "left_anti").withColumns({"p_len": F.col("len") - 1, "p_ctx": F.col("ctx").bitwiseAND(parent_mask)})
    inner = closed.join(kept.select(F.col("len").alias("p_len"), F.col("ctx").alias("p_ctx")), ["p_len", "p_ctx"], "left_semi").unionByName(closed.filter("len = 1"))
    return found.unionByName(inner.select("len", "ctx", F.lit(None).cast("int").alias("sym"), F.lit(None).cast("long").alias("n"), "total", "kinds"))


@dataclass(frozen=True)
class Tree:
    """States as sorted arrays: ``states`` with the weight handed to the parent, ``entries`` with the probability of a symbol (log10)."""

    depth: int
    states: np.ndarray
    handed: np.ndarray
    entries: np.ndarray
    logs: np.ndarray
    unseen: float
    closed: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    complete: bool = True

    def begun(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the probability by the part of the tree that is held, and the length from which on the table must be asked; 0 if none."""
        entry, known = _at(self.entries, grams & 0xFF)
        if self.complete:
            return self.lookup(grams), np.zeros(len(grams), np.int8)
        result, level = np.full(len(grams), self.unseen), np.zeros(len(grams), np.int8)
        result[known] = self.logs[entry[known]]
        open_ = np.arange(len(grams))
        for length in range(1, self.depth + 1):
            own = grams[open_] & ((1 << 8 * (length + 1)) - 1) | (length << _LEN_SHIFT)
            entry, known = _at(self.entries, own)
            result[open_[known]] = self.logs[entry[known]]
            rest = open_[~known]
            level[rest[~_at(self.closed, own[~known] & ~0xFF)[1]]] = length
            open_ = open_[known]
        return result, level

    def lookup(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last symbol after its context."""
        result, open_, passed = np.zeros(len(grams)), np.arange(len(grams)), np.zeros(len(grams))
        for length in range(self.depth, -1, -1):
            own = grams[open_] & ((1 << 8 * (length + 1)) - 1) | (length << _LEN_SHIFT)
            state, is_state = _at(self.states, own & ~0xFF)
            entry, is_entry = _at(self.entries, own)
            is_entry &= is_state
            hit = open_[is_entry]
            result[hit] = passed[hit] + self.logs[entry[is_entry]]
            passed[open_[is_state]] += self.handed[state[is_state]]
            open_ = open_[~is_entry]
            if not len(open_):
                return result
        result[open_] = passed[open_] + self.unseen
        return result


def _at(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), int), np.zeros(len(keys), bool)
    place = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return place, table[place] == keys


def build(kept: pa.Table, depth: int, complete: bool = True) -> Tree:
    """Smooth the counts from the root to the longest contexts. Of a state rare symbols may be missing, if its suffixes' are not."""
    outside = kept.filter(pc.is_null(kept["sym"]))
    closed = np.sort(outside["len"].to_numpy().astype(np.int64) << _LEN_SHIFT | outside["ctx"].to_numpy().astype(np.int64) << 8)
    kept = kept.filter(pc.is_valid(kept["sym"]))
    length, ctx, sym, n = (kept[c].to_numpy().astype(np.int64) for c in ("len", "ctx", "sym", "n"))
    keys = length << _LEN_SHIFT | ctx << 8 | sym
    order = np.argsort(keys)
    keys, length, n = keys[order], length[order], n[order].astype(float)
    owner, begin = np.unique(keys & ~0xFF, return_index=True)
    if not len(keys):
        return Tree(depth, np.zeros(1, np.int64), np.zeros(1), keys, np.zeros(0), -np.log10(256))
    totals, kinds = (kept[c].to_numpy()[order][begin].astype(float) for c in ("total", "kinds"))
    root = n[length == 0].sum()
    handed, logs, unseen = np.log10(kinds / (totals + kinds)), np.zeros(len(keys)), float(np.log10(0.5 / (root + 128)))
    handed[owner >> _LEN_SHIFT == 0] = 0.0
    logs[length == 0] = np.log10((n[length == 0] + 0.5) / (root + 128))
    for level in range(1, depth + 1):
        own = np.nonzero(length == level)[0]
        if len(own):
            low = owner >> _LEN_SHIFT < level
            upper = Tree(level - 1, owner[low], handed[low], keys[length < level], logs[length < level], unseen)
            behind = 10 ** upper.lookup(keys[own] & ((1 << 8 * level) - 1))
            state = np.searchsorted(owner, keys[own] & ~0xFF)
            logs[own] = np.log10((n[own] + kinds[state] * behind) / (totals[state] + kinds[state]))
    return Tree(depth, owner, handed, keys, logs, unseen, closed, complete)


@dataclass(frozen=True)
class _Frequent:
    """Words that make up at least a given share of all tokens: their keys, sorted, and counts."""

    keys: np.ndarray
    n: np.ndarray
    divisor: float


def _score(batches, tree: Tree, frequent: _Frequent):
    for batch in batches:
        for first, words in _slices(batch.column(2)):
            symbols, begin = _symbols(words, tree.depth)
            grams = _grams(symbols, tree.depth)
            coded = pa.array(grams).dictionary_encode()
            distinct = coded.dictionary.to_numpy()
            logs, level = tree.begun(np.maximum(distinct, 0))
            asked = (level > 0) & (distinct >= 0)
            logs[asked | (distinct < 0)] = 0.0
            indices = coded.indices.to_numpy()
            logs, asked = logs[indices], asked[indices]
            numbers: dict[bytes, int] = {b"": 0}
            codes, sizes = [], []
            for own in words:
                codes += [numbers.setdefault(w, len(numbers)) for w in own]
                codes.append(0)
                sizes.append(len(own) + 1)
            codes, sizes = np.array(codes, np.int64), np.array(sizes, np.int64)
            edges = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            # A token begins after a space or after the start marks; its symbols run to its own space, those of the end are the end mark.
            before, now = symbols[tree.depth - 1:-1], symbols[tree.depth:]
            tokens = np.nonzero((before == SPACE) | (before == START) & (now != START))[0]
            by_tree, asking = np.add.reduceat(logs, tokens), np.add.reduceat(asked, tokens, dtype=np.int64)

            keys = np.array([_word_key(w) for w in numbers], np.int64)
            place, is_frequent = _at(frequent.keys, keys)
            n = np.where(is_frequent, frequent.n[place] if len(frequent.n) else 0, 0)
            alone = np.log10((n + 0.5) / frequent.divisor)[codes]
            rare = ~is_frequent[codes]
            base = np.add.reduceat(np.where(rare, 0.0, alone), edges)
            known = np.add.reduceat((n > 0)[codes].astype(np.int64), edges)
            later = rare | (asking > 0)
            score = np.add.reduceat(np.where(later, 0.0, np.logaddexp(alone * LN10, by_tree * LN10) / LN10 - LOG2), edges)
            places = np.concatenate([[0], np.cumsum(np.add.reduceat(later, edges, dtype=np.int64))]).astype(np.int32)
            grams_of = np.concatenate([[0], np.cumsum(asking[later])]).astype(np.int32)
            rest = pa.StructArray.from_arrays(
                [pa.array(keys[codes[later]]), pa.array(np.where(rare, -1, n[codes])[later], pa.int64()), pa.array(by_tree[later]),
                 pa.ListArray.from_arrays(pa.array(grams_of), pa.array(grams[asked]))], ["key", "n", "by_tree", "grams"])
            part = slice(first, first + len(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[part], batch.column(1)[part], pa.array(sizes), pa.array(known), pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(places), rest)],
                ["row", "doc_id", "n_tokens", "known", "base", "score", "rest"])


def _asked(grams: DataFrame, kept: DataFrame, depth: int, shared) -> DataFrame:
    """(gram, p) with log10 of the probability of every gram of ``grams``, by the states of the whole table."""

    @F.arrow_udf("struct<p:double,level:int>")
    def begun(keys: pa.Array) -> pa.Array:
        p, level = shared.value[0].begun(keys.to_numpy())
        return pa.StructArray.from_arrays([pa.array(10**p), pa.array(level.astype(np.int32))], ["p", "level"])

    mask = F.element_at(F.array(*[F.lit((1 << 8 * k) - 1).cast("long") for k in range(depth + 1)]), F.col("len") + 1)
    asked = grams.distinct().withColumn("b", begun("gram")).select("gram", F.col("b.p").alias("p"), F.explode(F.sequence("b.level", F.lit(depth))).alias("len")).withColumn(
        "ctx", F.shiftright("gram", 8).bitwiseAND(mask))
    seen = kept.filter("sym is not null").groupBy("len", "ctx").agg(  # at most 256 symbols
        F.first("total").alias("total"), F.first("kinds").alias("kinds"), F.map_from_entries(F.collect_list(F.struct("sym", "n"))).alias("seen"))
    n = F.coalesce(F.try_element_at("seen", F.col("gram").bitwiseAND(F.lit(255)).cast("int")), F.lit(0)).cast("double")
    step = F.when(F.col("total").isNotNull(), F.struct("len", n.alias("n"), F.col("total").cast("double").alias("total"), F.col("kinds").cast("double").alias("kinds")))
    folded = F.aggregate(F.array_sort("steps"), F.col("p"), lambda p, x: (x["n"] + x["kinds"] * p) / (x["total"] + x["kinds"]))
    return asked.join(seen, ["len", "ctx"], "left").groupBy("gram").agg(F.first("p").alias("p"), F.collect_list(step).alias("steps")).select(
        "gram", F.log10(folded).alias("p"))


def score(docs: DataFrame, train: Column, depth: int = 5, frequent_share: float = 2.0**-18, held: int = 1 << 21, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row, learning from rows where ``train`` holds.

    ``base_score`` is that of single words with half a count added to each, ``score`` the tree's; both are log10 and take in
    the end. Null texts are empty. Repeated rows are scored each (and learned from each). Without training rows every symbol is
    equally likely. Words that make up ``frequent_share`` of all tokens, so at most its inverse many, go to every task; the others
    meet their counts in a shuffle. Of the tree, the most frequent entries go
    to every task, ``held`` at most besides the root's; if there are more, the table is asked once for each gram that needs the others. Other columns of ``docs`` are ignored.
    """
    spark, id_type = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    table = stage(counts(docs.filter(F.coalesce(train, F.lit(False))), depth, text), "counts", "zstd")
    words, grams = stage(table.filter(F.col("kind") == _WORD).select("key", "n"), "word-counts", "zstd"), table.filter(F.col("kind") == _GRAM).select("key", "n")
    tokens, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    symbols = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    weight = F.floor(F.log2(F.least("total", F.coalesce(F.col("n") * 4, "total")).cast("double"))).cast("int")
    kept = stage(states(grams, depth, symbols, closed_from=2.0).withColumn("weight", weight), "tree", "zstd")
    drop(table)  # words and tree have what is needed of it
    # From which power of two on all entries may be held: at most 63 rows come to the driver.
    sizes, least, many = {r["weight"]: r["count"] for r in kept.filter("len > 0").groupBy("weight").count().collect()}, 64, 0
    while least > 0 and many + sizes.get(least - 1, 0) <= held:
        least -= 1
        many += sizes.get(least, 0)
    tree = build(kept.filter((F.col("len") == 0) | (F.col("weight") >= least)).toArrow(), depth, least == 0)
    top = words.filter((F.col("n") >= frequent_share * tokens) | (F.col("key") == _END_KEY)).orderBy("key").toArrow()
    divisor = tokens + 0.5 * (kinds + 1)
    shared = spark.sparkContext.broadcast((tree, _Frequent(top["key"].to_numpy(), top["n"].to_numpy(), divisor)))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col(text).alias("text"))
    scored = stage(rows.mapInArrow(lambda batches: _score(batches, *shared.value), f"row long, doc_id {id_type}, n_tokens long, known long, "
                                   "base double, score double, rest array<struct<key:long,n:long,by_tree:double,grams:array<long>>>"), "scores", "zstd")
    rest = scored.select("row", F.posexplode("rest").alias("place", "w")).select("row", "place", "w.*")
    asking = rest.filter(F.size("grams") > 0).select("row", "place", "key", "n", "by_tree", F.explode("grams").alias("gram"))
    asked = asking.join(_asked(asking.select("gram"), kept, depth, shared), "gram").groupBy("row", "place").agg(
        F.first("key").alias("key"), F.first("n").alias("n"), (F.first("by_tree") + F.sum("p")).alias("by_tree"))
    whole = stage(rest.filter(F.size("grams") == 0).select("row", "key", "n", "by_tree").unionByName(asked.select("row", "key", "n", "by_tree")), "words", "zstd")
    drop(kept)
    rare = whole.filter("n < 0").select("row", "key", "by_tree", F.lit(True).alias("rare")).join(words, "key", "left")
    both = rare.select("row", "n", "by_tree", "rare").unionByName(whole.filter("n >= 0").select("row", "n", "by_tree", F.lit(False).alias("rare")))
    n = F.coalesce("n", F.lit(0))
    alone, by_tree = F.log10((n + 0.5) / divisor), F.col("by_tree")
    high, low = F.greatest(alone, by_tree), F.least(alone, by_tree)
    sums = both.groupBy("row").agg(
        F.sum(F.when(F.col("rare"), alone).otherwise(0.0)).alias("more"), F.sum(F.when(F.col("rare") & (n > 0), 1).otherwise(0)).alias("more_known"),
        F.sum(high + F.log10(1 + F.pow(F.lit(10.0), low - high)) - float(LOG2)).alias("more_score"))
    return scored.drop("rest", "rest_logs").join(sums, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"))
