"""Nulls in every column, empty and blank and long texts, repeated rows, ties, empty tables, clashing column names."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_against_brute_force import grouped

from fleetseal.llm import chat, components, jaccard, mixing, nearest, packing, private, repeats, suffix_tree, toxicity, winnow
from fleetseal.llm.queries import RANKS, VOCABULARY


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*(names or df.columns)).collect()), key=repr)


@pytest.fixture
def none(odd_docs):
    return odd_docs.filter("false")


def test_suffix_tree(odd_docs, none):
    got = rows(suffix_tree.score(odd_docs, F.col("doc_id") > 2), "doc_id", "n_tokens", "n_known", "train_tokens")
    assert len(got) == 11 and (2, 1, 1, got[0][3]) in got and got.count((1, 9, 1, got[0][3])) == 2
    assert suffix_tree.score(none, F.lit(True)).count() == 0
    untrained = suffix_tree.score(odd_docs, F.lit(False)).filter("doc_id = 2").first()
    assert (untrained.n_known, untrained.train_tokens, untrained.base_score) == (0, 0, 0.0)


def test_tree_is_a_distribution(spark):
    docs = spark.createDataFrame([(i, "ab abc abcd " * 20 + "x" * (i % 3)) for i in range(30)], "doc_id long, text string")
    table = suffix_tree.counts(docs, 3).filter("kind = 0").select("key", "n")
    tree = suffix_tree.build(suffix_tree.states(table, 3, table.agg(F.sum("n")).first()[0]).toArrow(), 3)
    assert len(tree.states) > 4
    for context in (b"abc", b" ab", b"\xfe\xfe\xfe", b"zzz"):
        grams = [int.from_bytes(context + bytes([s]), "big") for s in range(256)]
        import numpy as np
        assert abs((10 ** tree.lookup(np.array(grams, np.int64))).sum() - 1) < 1e-6


def test_what_is_held_does_not_change_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).cache()
    train = F.col("doc_id") % 5 > 0
    whole = {r.doc_id: r for r in suffix_tree.score(docs, train, frequent_share=0.0).collect()}
    for held, share in ((0, 2.0**-6), (3000, 2.0**-11)):
        got = suffix_tree.score(docs, train, held=held, frequent_share=share).collect()
        assert len(got) == len(whole)
        for r in got:
            assert (r.n_known, r.n_tokens) == (whole[r.doc_id].n_known, whole[r.doc_id].n_tokens)
            assert abs(r.score - whole[r.doc_id].score) < 1e-6 * abs(r.score) and abs(r.base_score - whole[r.doc_id].base_score) < 1e-6 * abs(r.base_score)


def test_rare_contexts_become_states_in_large_tables(spark):
    grams = spark.createDataFrame([(int.from_bytes(b"aaaa", "big"), 10**9), (int.from_bytes(b"aqon", "big"), 20), (int.from_bytes(b"aaob", "big"), 10**6)], "key long, n long")
    kept = suffix_tree.states(grams, 3, 10**9 + 10**6 + 20)
    assert [r.n for r in kept.filter(F.col("ctx") == int.from_bytes(b"qo", "big")).filter("len = 2").collect()] == [20]


def test_winnowing(odd_docs, none):
    docs = odd_docs.select("doc_id", "text")
    got = winnow.with_next(docs)
    assert got.count() == 11 and winnow.with_next(none.select("doc_id", "text")).count() == 0
    after = {(r.doc_id, r.text): r.next_text for r in got.filter("doc_id in (7, 8)").collect()}
    assert after == {(8, "x"): "x", (7, "x"): got.filter("doc_id = 6").first().text}
    assert got.filter("doc_id is null and text is null").first().next_text == "x"  # after the last comes the first
    one = got.filter("doc_id = 1").withColumn("same", winnow.likeness(F.col("chosen"), F.col("chosen"))).collect()
    assert [r.same for r in one] == [1.0, 1.0]
    only = docs.filter("doc_id = 7")
    assert winnow.with_next(only).first().next_text == "x"


def test_winnowing_chooses_the_rightmost_smallest(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab ") for _ in range(n)) for n in (1, 5, 40, 300, 900)]
    df = winnow.fingerprint(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "chosen")
    units = df.select("text", "chosen", F.regexp_extract_all("text", F.lit(winnow.UNIT), F.lit(0)).alias("u")).withColumn(
        "h", F.transform("u", lambda x: F.xxhash64(x))).collect()
    gram = lambda h: spark.range(1).select(F.xxhash64(*[F.lit(x) for x in h])).first()[0]
    for r in units[:4]:
        k, w = winnow.GRAM, winnow.WINDOW
        hashes = [(gram(r.h[i:i + k]) & (2**64 - 1)) >> 29 for i in range(max(len(r.h) - k + 1, min(len(r.h), 1)))]
        expected = set()
        for at in range(max(len(hashes) - w + 1, min(len(hashes), 1))):
            window = hashes[at:at + w]
            expected.add(at + max(i for i, x in enumerate(window) if x == min(window)))
        got = [(2**28 - 1) - (x & (2**28 - 1)) for x in r.chosen]
        assert got == sorted(expected)


def test_chat(spark):
    turns = spark.createDataFrame([(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, None, "<|end|>"),
                                   (None, 1, "ann", "x"), (2, 0, "system", "alone"), (1, None, "ann", "first")], "conv_id long, turn long, role string, text string")
    got = chat.rotate(turns.withColumn("speaker", F.lit(1)).withColumn("start", F.lit(2)))
    one = got.filter("conv_id = 1 and speaker = 'ann'").orderBy("start").collect()
    text = "".join(r.segment for r in one)
    assert text.startswith("<|turn|>assistant\nfirst<|end|>\n<|turn|>system\nbe kind") and "user bob" in text and text.count("< |end|>") == 1
    assert all(text[r.start:r.start + r.length] == r.segment for r in one)
    assert ["".join(text[r.body_start:r.body_start + r.body_length]) for r in one if r.trained] == ["first<|end|>", "hi<|end|>"]
    assert Counter((r.conv_id, r.speaker) for r in got.collect()) == {(1, "ann"): 6, (1, "bob"): 6, (None, "ann"): 1}
    assert chat.rotate(turns.filter("false")).count() == 0


def test_jaccard(odd_docs, none, spark):
    got = rows(jaccard.link(odd_docs), "doc_id", "n_shingles", "component_id")
    assert got.count((1, 4, 1)) == 2 and (2, 0, 2) in got and (3, 0, 3) in got and (8, 1, 7) in got and (None, 1, None) in got and len(got) == 11
    assert {c for i, n, c in got if i in (5, 6)} == {5}
    assert jaccard.link(none).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_links_of_middling_likeness(spark, seed):
    rng = random.Random(seed)
    words, docs = [f"w{i}" for i in range(400)], []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 6, 7, 8, 9, 12, 15, 30, 60, 120, 200]))]
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                k = rng.randrange(len(own))
                own[k:k + rng.choice([0, 1, 2])] = [rng.choice(words)]
            if rng.random() < 0.3:
                own += [rng.choice(words) for _ in range(rng.randrange(1 + len(own) // 4))]
            docs.append((len(docs), " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(jaccard.link(df), "doc_id", "n_shingles", "component_id") == sorted(grouped(docs), key=repr)


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    got = dict(rows(components.components(chain)))
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (90, 95, 100)} == {90}
    assert components.components(chain.filter("false")).count() == 0


def test_mixing(odd_docs, none):
    docs = odd_docs.withColumn("words", F.coalesce(F.size(F.split("text", " ")), F.lit(0)))
    got = mixing.mix(docs, mixing.cyclic_schedules(docs), F.col("words"), tie=F.xxhash64("text"))
    all_rows = got.collect()
    assert len(all_rows) == 11 and all(r.taken <= 3 * r["size"] and r.target <= 3 * r.source_size for r in all_rows)
    assert abs(sum({r.source: r.target for r in all_rows}.values()) - sum(r["size"] for r in all_rows)) < 1e-6
    assert rows(got) == rows(mixing.mix(docs, mixing.cyclic_schedules(docs), F.col("words"), tie=F.xxhash64("text")))
    at = [r.position for r in mixing.in_training_order(got).collect()]
    assert at == sorted(at) and len(at) == sum(r.passes for r in all_rows)
    assert mixing.mix(none, mixing.cyclic_schedules(none), F.col("size")).count() == 0


def test_curriculum_follows_its_schedule(spark):
    docs = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(2000)], "doc_id long, source string")
    knots = spark.createDataFrame([("a", 0.0, 0.0), ("a", 0.5, 2.0), ("a", 1.0, 0.0), ("b", 0.3, 1.0)], "source string, at double, weight double")
    placed = mixing.in_training_order(mixing.mix(docs, knots, F.lit(10))).toPandas()
    early = lambda s, t: (placed[placed.source == s].position <= t).mean()
    for t in (0.1, 0.25, 0.5, 0.8):
        assert abs(early("b", t) - t) < 0.01
        assert abs(early("a", t) - (2 * t * t if t <= 0.5 else 1 - 2 * (1 - t) ** 2)) < 0.01


def test_toxicity(odd_docs, none, spark):
    seen = spark.createDataFrame([("you fool", 1), ("good day to you", 0), (None, 0), ("", 0), ("fool and villain", 2), ("day", None)] * 20, "text string, grade int")
    model = toxicity.fit(seen, 3)
    got = toxicity.grade(odd_docs.withColumn("toxic", F.lit("clash")), model)
    assert got.count() == 11 and not any(r.toxic for r in got.collect())
    new = toxicity.grade(spark.createDataFrame([("a fool",), ("villain fool",), ("a good day",)], "text string"), model).collect()
    assert [r.toxic for r in new] == [True, True, False] and new[1].severity > new[0].severity > new[2].severity
    assert list(model.thresholds) == sorted(model.thresholds)
    assert toxicity.grade(none, toxicity.fit(seen.filter("false"), 3)).count() == 0


def test_packing(odd_docs, none, spark):
    cut = packing.pieces(odd_docs, VOCABULARY, RANKS)
    got = packing.pack(cut.withColumn("offset", F.lit("clash")))
    assert got.count() == cut.count() and got.filter("doc_id = 2").first().length == 1
    longest = got.filter("doc_id = 5").orderBy("piece").collect()
    assert [r.length for r in longest[1:]] == [1024] * (len(longest) - 1) and [r.start for r in longest[1:]] == [longest[0].length + 1024 * i for i in range(len(longest) - 1)]
    assert packing.pack(packing.pieces(none, VOCABULARY, RANKS)).count() == 0
    special = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    assert rows(packing.pieces(special, VOCABULARY, RANKS)) == rows(packing.pieces(special, VOCABULARY))


@pytest.mark.parametrize("histogram", [{1: 5}, {1024: 3, 1: 2}, {600: 7, 424: 7}, {513: 4, 511: 9, 2: 3}, {k: k % 7 + 1 for k in range(1, 1025)}])
def test_plans_hold_every_piece(histogram):
    plan, held = packing.plan(histogram, rounds=100), Counter()
    for configuration, times in plan:
        assert sum(k * n for k, n in configuration) <= 1024
        held.update({k: n * times for k, n in configuration})
    assert held == histogram
    total = sum(k * n for k, n in histogram.items())
    assert sum(t for _, t in plan) <= max(-(-total // 1024) * 1.05 + 2, sum(n for k, n in histogram.items() if k > 512))


DISGUISED = [
    ("write to jane.doe [at] mail (dot) example [dot] org now", ["email:9:51"]),
    ("jane dot doe at example dot com", ["email:9:31"]),
    ("call plus four nine one seven one two three four five six seven", ["phone:5:63"]),
    ("card four one one one 1111 1111 one one one one", ["card:5:47"]),
    ("host 192 dot 168 dot 0 dot 1 up", ["ip:5:28"]),
    ("sеnd to аnn@exаmple.com", ["email:8:23"]),
    ("ann@exam​ple.com", ["email:0:16"]),
    ("We met at noon. Look at example.com, dot com times at one two three.", []),
]


@pytest.mark.parametrize("text, spans", DISGUISED)
def test_disguises(text, spans):
    plain = private.identifiers(text)
    got = [f"{private.KINDS[k]}:{a}:{b}" for a, k, b in private.disguised(text, plain)]
    assert [s for s in got if s not in spans] == [] and set(spans) <= set(got) | {f"{private.KINDS[k]}:{a}:{b}" for a, k, b in plain}


PARTLY_PLAIN = [
    ("j\u043ehn@example.com", ["email:0:16", "email:2:16"], "[EMAIL]"),
    ("jane[dot]doe@example.com", ["email:0:24", "email:9:24"], "[EMAIL]"),
    ("john@mail.example[dot]com", ["email:0:25", "email:0:17"], "[EMAIL]"),
    ("jo\u200bhn@example.com", ["email:0:17", "email:3:17"], "[EMAIL]"),
    ("+1 415 555 26\uff17", ["phone:0:13", "phone:0:14"], "[PHONE]"),
    ("ask jane dot doe@example.com", ["email:4:28", "email:13:28"], "[EMAIL]"),
    ("jane dot doe [at] example dot com", ["email:0:33"], "[EMAIL]"),
    ("john@example.com and \u0430nn@example.com", ["email:0:16", "email:21:36", "email:22:36"], "[EMAIL] and [EMAIL]"),
]


@pytest.mark.parametrize("text, spans, masked", PARTLY_PLAIN)
def test_partly_plain_spans(spark, text, spans, masked):
    df = spark.createDataFrame([(text,)], "text string")
    found = [f"{s.kind}:{s.start}:{s.end}" for s in private.find(df).first().spans]
    assert sorted(found) == sorted(spans)
    assert masked in private.mask(df).first().text and "@" not in private.mask(df).first().text


def test_private(odd_docs, none, spark):
    assert all(r.spans == [] for r in private.find(odd_docs).collect()) and private.find(none).count() == 0
    assert rows(private.mask(odd_docs), "doc_id", "text", "size") == rows(odd_docs, "doc_id", "text", "size")
    masked = private.mask(spark.createDataFrame([("a@b.co and 10.0.0.1, 4111 1111 1111 1111",), (None,)], "text string"))
    assert rows(masked) == [("[EMAIL] and [IP], [CARD]",), (None,)]
    long = "a" * 200_000 + "@" + "1" * 200_000 + " " + "1." * 100_000 + "+" * 100_000
    assert private.find(spark.createDataFrame([(long,)], "text string")).first() is not None


def test_nearest(spark):
    nan, inf = float("nan"), float("inf")
    data = [(20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [None, 1.0]), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (10, []), (40, None)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("cell", F.lit(2))
    got = rows(nearest.search(df.filter("vec_id % 20 = 0"), df, 3, block=2))
    assert got == [(20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 2, 1.0)]
    assert len(rows(nearest.search(df.filter("vec_id = 20"), df, 20))) == 4
    assert nearest.search(df.filter("false"), df.filter("false")).count() == 0


def test_nearest_against_every_pair(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(900, 16)).astype(np.float32)
    vectors[::9] = vectors[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = rows(nearest.search(df.filter("vec_id % 20 = 0"), df, 20, block=64), "query_id", "rank", "vec_id")
    wide = vectors.astype(float)
    expected = []
    for q in range(0, 900, 20):
        score = np.zeros(900)
        for d in range(16):
            score = score + wide[q, d] * wide[:, d]
        order = [i for i in np.lexsort((np.arange(900), -score)) if i != q][:20]
        expected += [(q, k + 1, int(i)) for k, i in enumerate(order)]
    assert got == sorted(expected, key=repr)


def test_repeats(odd_docs, none):
    got = rows(repeats.remove(odd_docs), "doc_id", "n_sentences", "n_removed", "text")
    assert len(got) == 11 and repeats.remove(none).count() == 0
    assert [r for r in got if r[0] == 1] == [(1, 2, 0, "Alpha beta gamma. Delta epsilon zeta eta theta.")] * 2
    first, second = ([r for r in got if r[0] == i][0] for i in (5, 6))
    assert second[2] > 0.9 * second[1] and second[2] > first[2]
    assert (2, 0, 0, None) in got and (3, 0, 0, "") in got


def test_repeats_at_other_offsets_of_long_sentences(spark):
    rng = random.Random(11)
    new = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    passage = new(60)
    texts = [" ".join([*new(100), *passage, *new(100)])] + [" ".join([*new(40 + k), *passage, *new(80)]) for k in range(12)]
    got = repeats.remove(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        left = len(set(passage) & set(r.text.split()))
        assert set(texts[r.doc_id].split()) - set(r.text.split()) <= set(passage)
        assert left == 60 if r.doc_id == 0 else left <= 24


def test_cuts_follow_the_words():
    rng = random.Random(2)
    words = [f"v{rng.randrange(500)}".encode() for _ in range(3000)]
    cut = repeats.cuts(words)
    assert max(b - a for a, b in zip([0, *cut], [*cut, len(words)], strict=True)) <= 2 * repeats.CUT
    for skip in (1, 7, 400):
        behind = skip + repeats.CUT
        assert [c - skip for c in cut if c >= behind] == [c for c in repeats.cuts(words[skip:]) if c >= repeats.CUT]
    assert repeats.cuts([b"a", b"b"] * 40)[repeats.CUT:] == list(range(repeats.cuts([b"a", b"b"] * 40)[repeats.CUT], 80, 2))
