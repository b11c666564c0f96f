"""Spelling variants: words that one inserted, deleted or replaced character keeps apart, by a dictionary of trie-node pairs.

Every word is a path in a trie of words and, read from its end, in a trie of reversed words. The nodes of both are numbered. A word
w with the character at i skipped is the pair (node of w[:i], node of w[i+1:]); with a gap before i it is (node of w[:i], node of
w[i:]). Two words with a skip at the same pair differ by a replaced character, a skip and a gap at the same pair by a deleted one.
Equal pairs mean equal strings, so what meets is near and nothing else is. A pair is shared by at most as many words as the alphabet has
letters; each is told how many others are there and which is the commonest, so no pairs of words are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetseal.llm.common import ascii_lower, drop, stage

RUN = "[A-Za-zÀ-ÿ]+"
# Nodes of so many characters or fewer, which very many words share, are numbered by what they spell and never looked up.
_SHALLOW = 2
_CODE_POINTS = 1 << 21
# Longer strings are keyed by a digest, so that a word of n characters moves n keys of bounded size.
_KEY_CHARACTERS = 48
_TYPO_MODULUS = 199


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, run) for every maximal run of letters of whole texts, A to Z in lower case."""
    found = F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(RUN), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("run"))


def with_typos(found: DataFrame, modulus: int = _TYPO_MODULUS) -> DataFrame:
    """(word) per run of (doc_id, run): runs whose checksum with the id the modulus divides lose a character that it names.

    A run of a document without id has no checksum and stays.
    """
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    at = F.pmod(F.col("h"), F.length("run").cast("long")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return found.withColumn("h", h).select(F.when(F.col("h") % modulus == 0, cut).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, shortest: int = 6, least: int = 5) -> DataFrame:
    """(word, n) of the distinct words that are long and frequent enough."""
    return words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _met(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join without a broadcast: both sides grow with the words, and Spark sizes one by its packed files, or by what stands before an explode."""
    return left.join(right.hint("merge"), on, how)


def _key(part: Column) -> Column:
    return F.when(F.length(part) <= _KEY_CHARACTERS, part).otherwise(F.sha2(part, 256))


def _spelled(part: Column) -> Column:
    """Number of a node of at most two characters: below 0, from their code points."""
    first, second = F.ascii(F.substring(part, 1, 1)).cast("long"), F.ascii(F.substring(part, 2, 1)).cast("long")
    return -1 - F.when(part == "", F.lit(0)).otherwise((first + 1) * _CODE_POINTS + F.when(F.length(part) > 1, second + 1).otherwise(F.lit(0)))


def _nodes(words: DataFrame, part, side: str) -> DataFrame:
    """(word, at, node) for every place of every word, ``part(word, at)`` being what the node spells."""
    places = F.sequence(F.lit(0), F.length("word"))
    spelled = words.select("word", F.posexplode(F.transform(places, lambda i: part(F.col("word"), i))).alias("at", "spells"))
    paths = spelled.select("word", "at", F.when(F.length("spells") <= _SHALLOW, _spelled(F.col("spells"))).alias("shallow"),
                           F.when(F.length("spells") > _SHALLOW, _key(F.col("spells"))).alias("key"))
    numbers = stage(paths.filter("key is not null").select("key").distinct().withColumn("number", F.monotonically_increasing_id()), f"trie-{side}")
    deep = _met(paths.filter("key is not null"), numbers, "key").select("word", "at", F.col("number").alias("node"))
    return deep.unionByName(paths.filter("key is null").select("word", "at", F.col("shallow").alias("node"))).withColumn("side", F.lit(side))


def entries(words: DataFrame) -> DataFrame:
    """(prefix, suffix, gap, first, word, n): every skip and gap of every word of (word, n) as a pair of node numbers.

    ``first`` says of a skip that the character before it is another one: deleting any of several equal characters in a row gives one word,
    which is to be met once.
    """
    forward = _nodes(words.select("word"), lambda w, i: F.substring(w, F.lit(1), i), "forward")
    backward = _nodes(words.select("word"), lambda w, i: F.substring(w, i + 1, F.length(w)), "backward")
    numbers = forward.unionByName(backward).groupBy("word").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("at", "node")))).alias(side) for side in ("forward", "backward")])
    whole = _met(numbers, words, "word")
    node = lambda side, i: F.get(F.col(side), i)["node"]
    letter = lambda i: F.substring("word", i + 1, F.lit(1))

    def at(i):
        same = (i > 0) & (letter(i) == letter(i - 1))
        gap = F.struct(node("forward", i).alias("prefix"), node("backward", i).alias("suffix"), F.lit(True).alias("gap"), F.lit(False).alias("first"))
        skip = F.struct(node("forward", i).alias("prefix"), node("backward", i + 1).alias("suffix"), F.lit(False).alias("gap"), (~same).alias("first"))
        return F.when(i < F.length("word"), F.array(gap, skip)).otherwise(F.array(gap))
    every = F.flatten(F.transform(F.sequence(F.lit(0), F.length("word")), at))
    return whole.select("word", "n", F.explode(every).alias("e")).select("e.*", "word", "n")


def near(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of the words of (word, n) that have a near one: how many, and the commonest, ties to the smaller."""
    rank = lambda m: F.struct((-m["n"]).alias("down"), m["word"].alias("word"))
    groups = entries(words).groupBy("prefix", "suffix").agg(F.collect_list(F.struct("word", "n", "gap", "first")).alias("members")).filter(F.size("members") > 1)
    cut = groups.select(
        F.filter("members", lambda m: ~m["gap"]).alias("skips"),
        F.filter("members", lambda m: m["gap"]).alias("gaps"),
        F.filter("members", lambda m: ~m["gap"] & m["first"]).alias("firsts"))
    ranked = cut.select("*", *[F.slice(F.array_sort(F.transform(c, rank)), 1, 2).alias(f"top_{c}") for c in ("skips", "gaps", "firsts")])
    told = lambda m, count, best: F.struct(m["word"].alias("word"), count.alias("many"), best.alias("best"))
    top = lambda c, i: F.get(F.col(f"top_{c}"), F.lit(i))
    other = lambda m: F.when(top("skips", 0)["word"] == m["word"], top("skips", 1)).otherwise(top("skips", 0))
    told_all = F.concat(
        F.transform("skips", lambda m: told(m, F.size("skips") - 1, other(m))),
        F.transform("firsts", lambda m: told(m, F.size("gaps"), top("gaps", 0))),
        F.transform("gaps", lambda m: told(m, F.size("firsts"), top("firsts", 0))))
    rows = ranked.select(F.explode(F.filter(told_all, lambda t: t["many"] > 0)).alias("t"))
    return rows.groupBy("t.word").agg(F.sum("t.many").alias("n_near"), F.min("t.best").alias("best")).select(
        "word", "n_near", F.col("best.word").alias("best"), (-F.col("best.down")).alias("best_n"))


def forms(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, n, form, form_n, n_near, root): what a word is a variant of.

    ``words`` is (word, n), a row per word. The form is the commonest near word (ties to the smaller) if it is at least ``times`` as frequent,
    else null; the root is where forms lead from a word. Counts grow along forms, so there are no circles, and every round of looking up the
    form of the form halves what is left of the longest way. No words: no rows. Words may hold any characters and have any length.
    """
    around = near(words)
    found = F.col("best_n") >= times * F.col("n")
    judged = stage(_met(words, around, "word", "left").select(
        "word", "n", F.when(found, F.col("best")).alias("form"), F.when(found, F.col("best_n")).alias("form_n"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(found, F.col("best")).otherwise(F.col("word")).alias("root")), "forms")
    # Only words with a form move; where their way ends is found among themselves.
    ways = stage(judged.filter("form is not null").select("word", "root"), "ways")
    while True:
        step = stage(_met(ways, ways.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "ways")
        drop(ways)
        ways = step
        if step.filter("moved").isEmpty():
            break
    return _met(judged.drop("root"), ways.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def group(docs: DataFrame, shortest: int = 6, least: int = 5, times: int = 5, modulus: int = _TYPO_MODULUS) -> DataFrame:
    """Spelling variants among the words of ``docs`` (doc_id, text), see :func:`forms`.

    Null and empty texts have no words, repeated rows count again, other columns play no part, an empty table gives no rows. Texts of any
    length are read whole; a run of any length is a word if it is frequent enough.
    """
    words = stage(counted(with_typos(runs(docs.select("doc_id", "text")), modulus), shortest, least), "words")
    return forms(words, times)
