"""Hard negatives, hash tree and spelling variants against plain Python, and with odd input."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_edges import rows

from fleetseal.llm import mining, sharding, variants

VECTORS = "vec_id long, embedding array<double>, label int"


def mined(spark, table, **named):
    df = spark.createDataFrame(table, VECTORS)
    return rows(mining.mine(df.filter("vec_id % 100 = 0"), df, **named))


def plain_negatives(table, positives=5, negatives=10):
    """Every anchor against every row, in plain loops."""
    ok = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in table
          if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, c in ok:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, d) for j, w, d in ok if j != i and len(w) == len(v))
        for p, pid in [(-s, j) for s, j, d in scored if d == c][:positives]:
            fit = [(-s, j) for s, j, d in scored if d != c and 30 * p <= -100 * s <= 90 * p][:negatives]
            out += [(i, pid, k + 1, j, p, s) for k, (s, j) in enumerate(fit)]
    return sorted(out, key=repr)


def some_vectors(n, seed, dim=6, labels=3):
    rng = random.Random(seed)
    return [(i, [round(rng.uniform(-1, 1), 2) for _ in range(dim)], rng.randrange(labels)) for i in range(n)]


def test_negatives_against_all_pairs(spark):
    table = some_vectors(420, 1) + [(1000 + i, [0.5] * 6, 1) for i in range(60)] + [(2000 + i, [0.2] * 6, 2) for i in range(60)]
    expected = plain_negatives(table)
    assert len(expected) > 100
    assert mined(spark, table) == mined(spark, table, block=37) == expected


def test_negatives_of_zero_scores_and_ties(spark):
    # Positives and negatives of score 0: the window is the single score 0, and ids decide.
    table = [(0, [1.0, 0.0], 0), (5, [0.0, 1.0], 0), (1, [0.0, 2.0], 1), (9, [0.0, 2.0], 1), (4, [-1.0, 0.0], 0), (7, [-0.5, 0.0], 1)]
    got = mined(spark, table)
    assert got == plain_negatives(table) == [(0, 5, 1, 1, 0, 0), (0, 5, 2, 9, 0, 0)]


def test_negatives_of_odd_rows(spark):
    base = some_vectors(130, 2)
    odd = [(None, [0.1] * 6, 1), (300, None, 1), (400, [0.1] * 6, None), (301, [0.1, None, 0.1, 0.1, 0.1, 0.1], 1), (302, [0.1, float("nan")] + [0.1] * 4, 1),
           (303, [float("inf")] * 6, 1), (500, [], 1), (501, [], 2), (600, [0.1] * 3, 1), (700, [0.0] * 6, 2)]
    assert mined(spark, base + odd) == plain_negatives(base + odd)
    twice = base + base[:1] + base[50:51]  # a repeated anchor is answered twice, a repeated row counts twice
    assert collections.Counter(mined(spark, twice)) == collections.Counter(plain_negatives(twice))
    assert mined(spark, []) == [] and mined(spark, [(0, [1.0], 1)]) == []


def test_negatives_with_other_names_and_columns(spark):
    df = spark.createDataFrame(some_vectors(220, 3), VECTORS)
    other = df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("dim"), F.lit(1).alias("row"), F.lit(2).alias("block"), F.lit("x").alias("key"))
    got = mining.mine(other.filter("id % 100 = 0"), other, id_column="id", vector_column="vector", label_column="dim")
    assert rows(got) == plain_negatives([tuple(r) for r in df.collect()])


def test_scores_beyond_doubles_stay_exact(spark):
    big = [(0, [float(2**20), 1.0], 0), (1, [float(2**20), 1.0], 0), (2, [float(2**19), 3.0], 1), (3, [float(2**19), 2.0], 1)]
    assert mined(spark, big) == plain_negatives(big)
    huge = [(0, [1e30], 0), (1, [1e30], 0), (2, [1e29], 1)]
    assert mined(spark, huge) == []  # both at the border of a long: outside the window


def test_an_anchor_with_most_rows_keeps_only_windows():
    state, out = mining.Windows(2, 3, 30, 90), []
    out += list(state.see(False, 100, 1))
    for k in range(1000):
        out += list(state.see(True, 80, k))
    assert out == [(1, r, 100) for r in (1, 2, 3)] and len(state.open) == 1
    key = mining._packed(*[np.array([x]) for x in (-5, 3, -9, 1, -7)]).column("key")[0].as_py()
    assert mining.unpacked(key) == (-5, -9, True, -7)


# Hash tree

def drawn(tree, key):
    """The descent in plain Python."""
    path, level = "", list(tree)
    for at in (lambda s: s.region, lambda s: f"{s.region}/{s.rack}", lambda s: f"{s.region}/{s.rack}/{s.number}"):
        weights = collections.defaultdict(float)
        for s in level:
            weights[at(s)] += s.weight
        u = lambda n: (int(hashlib.md5(f"shard|{n}|{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        path = min((-math.log(u(n)) / w, n) for n, w in weights.items() if w > 0)[1]
        level = [s for s in level if at(s) == path]
    return level[0].number


TREE = [sharding.Shard("a", "1", 0, 2.0), sharding.Shard("a", "1", 1, 1.0), sharding.Shard("a", "2", 2, 0.0), sharding.Shard("a", "2", 5, 1.0),
        sharding.Shard("b", "1", 3, 3.0), sharding.Shard("c", "9", 4, 0.5)]


def test_descent_against_plain(spark):
    ids = [None, -1, 0, *range(1, 400)]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", sharding.shard_of(TREE, F.col("doc_id")).alias("s")).collect()
    assert {r.doc_id: r.s for r in got} == {i: drawn(TREE, "null" if i is None else i) for i in ids}
    assert 2 not in {r.s for r in got}


def test_shares_follow_weights(spark):
    got = collections.Counter(r.s for r in spark.range(30000).select(sharding.shard_of(TREE, F.col("id")).alias("s")).collect())
    for s in TREE:
        assert abs(got[s.number] / 30000 - s.weight / 7.5) < 0.012


def test_movement_stays_in_the_changed_subtree(spark):
    ids = spark.range(8000)
    heavier = [s._replace(weight=4.0) if s.number == 0 else s for s in TREE]
    moved = ids.select(sharding.shard_of(TREE, F.col("id")).alias("a"), sharding.shard_of(heavier, F.col("id")).alias("b")).filter("a <> b").collect()
    region, rack = {s.number: s.region for s in TREE}, {s.number: (s.region, s.rack) for s in TREE}
    assert moved and all(region[r.b] == "a" for r in moved)
    assert all(rack[r.b] == ("a", "1") for r in moved if region[r.a] == "a") and all(r.b == 0 for r in moved if rack[r.a] == ("a", "1"))
    for tree in (TREE, sharding.uniform_tree(40), sharding.uniform_tree(7)):
        larger = sharding.grown(tree)
        new = ids.select(sharding.shard_of(tree, F.col("id")).alias("a"), sharding.shard_of(larger, F.col("id")).alias("b")).filter("a <> b").collect()
        assert new and all(r.b == larger[-1].number for r in new)


def test_trees_that_cannot_be():
    with pytest.raises(ValueError):
        sharding.shard_of([sharding.Shard("a", "b", 0, 0.0)], F.lit(1))
    with pytest.raises(ValueError):
        sharding.shard_of([sharding.Shard("a", "b", 0), sharding.Shard("a", "c", 0)], F.lit(1))


def test_manifest_of_odd_rows(spark, odd_docs):
    extra = odd_docs.withColumns({"shard": F.lit("mine"), "grown_shard": F.lit(0), "text_crc32": F.lit("x"), "slot": F.lit(1)})
    placed = sharding.place(extra, sharding.uniform_tree(40))
    assert placed.count() == 11 and sorted(placed.columns) == sorted(extra.columns)
    got = sharding.manifest(placed).collect()
    texts = collections.defaultdict(list)
    for r in odd_docs.select("doc_id", "text").collect():
        texts[r.doc_id].append((r.text or "").encode())
    assert len(got) == 11
    for r in got:
        assert (r.size, r.text_crc32) in [(len(t) + 16, zlib.crc32(t)) for t in texts[r.doc_id]]
    by_shard = collections.defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert sharding.manifest(sharding.place(odd_docs.filter("false"), sharding.uniform_tree(3))).count() == 0


def test_one_id_with_most_rows_is_split(spark):
    docs = spark.range(9500).select(F.when(F.col("id") > 500, F.col("id")).alias("doc_id"), F.lit("same").alias("text")).unionAll(
        spark.range(9000).select(F.lit(7).cast("long"), F.lit("same")))
    got = sharding.manifest(sharding.place(docs, sharding.uniform_tree(4)))
    by_shard = got.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.min("slot").alias("a"), F.max("slot").alias("b")).collect()
    assert sum(r.n for r in by_shard) == 18500 and all((r.d, r.a, r.b) == (r.n, 0, r.n - 1) for r in by_shard)


def test_written_shards_hold_their_rows(spark, tmp_path, documents):
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    sharding.write(sharding.place(docs, sharding.uniform_tree(6)), str(tmp_path / "shards"), 2)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(tuple(r) for r in back.select("doc_id", "text").collect()) == sorted(documents)
    assert back.filter(F.col("shard") != sharding.shard_of(sharding.uniform_tree(6), F.col("doc_id"))).isEmpty()


# Spelling variants

def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_forms(counts, times=5):
    out, form = {}, {}
    for w, n in counts.items():
        around = [(-counts[v], v) for v in counts if is_near(w, v)]
        best = min(around, default=None)
        form[w] = best[1] if best and -best[0] >= times * n else None
        out[w] = (form[w], n, len(around), counts[form[w]] if form[w] else None)
    roots = {}
    for w in counts:
        at = w
        while form[at]:
            at = form[at]
        roots[w] = at
    return {w: (*v, roots[w]) for w, v in out.items()}


def got_forms(spark, counts):
    got = variants.forms(spark.createDataFrame(list(counts.items()), "word string, n long"))
    return {r.word: (r.form, r.n, r.n_near, r.form_n, r.root) for r in got.collect()}


def test_forms_against_all_pairs(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(0, 7))) for _ in range(260)}
    counts = {w: rng.choice([1, 2, 5, 30, 200, 1000]) for w in words}
    assert got_forms(spark, counts) == plain_forms(counts)


def test_forms_of_special_words(spark):
    long = "xy" * 400
    counts = {"aaaa": 50, "aaa": 5, "aa": 1, "a": 1, "": 3, long: 40, long + "z": 5, long[:300] + "q" + long[301:]: 4, "été": 9, "ete": 9, "日本語": 70, "日本": 7, "𝒳𝒴𝒵": 5, "𝒳𝒵": 1,
              "abcdef": 1, "abcdeg": 5, "abcdxg": 25, "abcyxg": 125, "abzyxg": 625, "b" * 60: 10, "b" * 59: 1}
    got = got_forms(spark, counts)
    assert got == plain_forms(counts)
    assert got["abcdef"][4] == "abzyxg" and got["aa"][4] == "aaaa"
    assert variants.forms(spark.createDataFrame([], "word string, n long")).count() == 0


def test_ties_go_to_the_smaller_word(spark):
    assert got_forms(spark, {"word": 1, "ward": 10, "wird": 10, "wordy": 10})["word"] == ("ward", 1, 3, 10, "ward")


def test_words_of_odd_rows(spark, odd_docs):
    got = {r.word: r.n for r in variants.counted(variants.with_typos(variants.runs(odd_docs), 10**12), 1, 1).collect()}
    assert got["alpha"] == 2 and got["one"] == 1 and got["end"] == 18000 and got["x"] == 2
    assert variants.group(odd_docs.filter("false")).count() == 0
    assert variants.group(odd_docs, shortest=1, least=1).count() > 5


def test_a_checksum_takes_a_character(spark):
    docs = [(i, "Éclair straße naïve NOËL x× ab") for i in range(300)]
    runs = rows(variants.runs(spark.createDataFrame(docs, "doc_id long, text string")))
    assert {r for i, r in runs if i == 0} == {"Éclair", "straße", "naïve", "noËl", "x×", "ab"}
    got = collections.Counter(r.word for r in variants.with_typos(spark.createDataFrame(runs, "doc_id long, run string"), 7).collect())
    expected = collections.Counter()
    for i, r in runs:
        h = zlib.crc32(f"{i}:{r}".encode())
        expected[r if h % 7 else r[:h % len(r)] + r[h % len(r) + 1:]] += 1
    assert got == expected
    # Without an id there is no checksum.
    assert [r.word for r in variants.with_typos(spark.createDataFrame([(None, "word")], "doc_id long, run string"), 1).collect()] == ["word"]
