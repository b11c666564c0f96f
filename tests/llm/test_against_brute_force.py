"""Registered queries without SQL against plain Python over the smallest tables."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from fleetseal.llm.queries import QUERIES

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def rows(spark, sf, name):
    return [r.asDict() for r in QUERIES[name](spark, sf).collect()]


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def grouped(docs):
    sets, parent = [shingles(t) for _, t in docs], list(range(len(docs)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, j in itertools.combinations(range(len(docs)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * len(sets[i] | sets[j]):
            parent[max(top(i), top(j))] = min(top(i), top(j))
    return [(docs[i][0], len(sets[i]), docs[top(i)][0]) for i in range(len(docs))]


def test_scores(spark, sf, documents):
    got = {r["doc_id"]: r for r in rows(spark, sf, "op1_suffix_tree")}
    held_out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in documents}
    seen = Counter(w for i, t in documents if not held_out[i] for w in [*words(t), b""])
    total, kinds = sum(seen.values()), len(seen)
    for i, text in documents:
        tokens = [*words(text), b""]
        r = got[i]
        base = sum(math.log10((seen[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held_out[i], len(tokens), sum(w in seen for w in tokens), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
    assert len(got) == len(documents)


def test_tree_beats_single_words(spark):
    got = [r for r in rows(spark, "/root/testdata/sf0.01", "op1_suffix_tree") if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert sum(r["score"] > r["base_score"] for r in got) > 0.9 * len(got)


def test_edited_texts(spark, sf, documents):
    got = {r["doc_id"]: r for r in rows(spark, sf, "op2_winnowing")}
    order = sorted(documents, reverse=True)
    near, apart = [], []
    for (i, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        near.append(got[i]["near_edited"])
        apart.append(got[i]["near_next"])
    assert sum(near) / len(near) > 0.25 > 0.1 > sum(apart) / len(apart)
    by_text = defaultdict(set)
    for i, text in documents:
        by_text[text].add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_groups(spark, sf, documents):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(spark, sf, "op4_jaccard_groups"))
    assert got == sorted(grouped(documents))


def test_packing(spark, sf, documents):
    tokenizer, got = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), rows(spark, sf, "op7_configuration_packing")
    expected = set()
    for i, text in documents:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected.add((i, piece, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))))
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == expected and len(got) == len(expected)
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= math.ceil(sum(r["length"] for r in got) / 1024) * 1.02 + 2


def luhn(digits):
    double = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(d - 9 if d > 9 else d for d in double) + sum(map(int, digits[-1::-2]))) % 10 == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    found = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(x) > 255 for x in m[0].split("."))) or (kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits))) \
                    or (kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(found)]


def test_private_spans(spark, sf, documents):
    got = {r["doc_id"]: r for r in rows(spark, "/root/testdata/sf0.01", "op8_private_spans")}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    for i, text in docs:
        spans = plain(text)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert {k: got[i][f"n_{k}"] for k in PATTERNS} == {k: sum(s.startswith(k) for s in spans) for k in PATTERNS}
        assert set(spans) <= set(got[i]["spans"].split(",")) or not spans
    assert sum(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in got.values()) > 10


def test_repeated_sentences(spark, sf, documents):
    from fleetseal.llm.repeats import runs, sentences
    got = {r["doc_id"]: r for r in rows(spark, sf, "op10_sentence_spans")}
    found = {i: [(x[0], x[1], x[2:4]) for x in runs(t.encode())] for i, t in documents}
    first = {}
    for i, _ in documents:
        for a, _, h in found[i]:
            first.setdefault(h, (i, a))
    for i, text in documents:
        gone = {k for a, b, h in found[i] if first[h] != (i, a) for k in range(a, b)}
        parts = sentences(text)
        assert (got[i]["n_sentences"], got[i]["n_removed"]) == (len(parts), len(gone))
        kept = [w for k, p in enumerate(parts) if k not in gone for w in p[2]]
        assert got[i]["text"].split() == " ".join(kept).split()


def test_toxicity_on_labels(spark):
    got = {r["doc_id"]: r["toxic"] for r in rows(spark, "/root/testdata/sf0.01", "op6_ordinal_toxicity")}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    right = sum(got[r.doc_id] == bool(r.toxic) for r in labels)
    assert right / len(labels) > 0.97
