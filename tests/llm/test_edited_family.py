"""A large family of edits of one text, of which many lie too far from it to link: what is compared grows with the family, not its square."""

import itertools
import random

from fleetseal.llm import jaccard


def shingles(text):
    w = text.split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def family(size, width):
    """Copies of one text with up to a quarter of the words replaced by words seldom used twice, some cut off, a few edited further."""
    draw = random.Random(5)
    base, out = [f"w{i}" for i in range(width)], []
    for i in range(size):
        own = list(draw.choice(out)) if out and draw.random() < 0.15 else list(base)
        for at in draw.sample(range(len(own)), draw.randrange(len(own) // 8)):
            own[at] = f"n{i}x{draw.randrange(9)}" if draw.random() < 0.8 else f"m{draw.randrange(4)}"
        out.append(own[:draw.randrange(width // 2, len(own))] if draw.random() < 0.2 and len(own) > width // 2 else own)
    return [" ".join(base), *map(" ".join, out)]


def test_large_family(spark, monkeypatch):
    texts = family(260, 64)
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, j in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            parent[max(top(i), top(j))] = min(top(i), top(j))
    groups = {top(i) for i in range(len(texts))}
    assert len(groups) > 100  # each differs from each other, so that all must be told apart
    rows, plain = [], jaccard._compared

    def compared(pairs, elements):
        rows.append(pairs.count())
        return plain(pairs, elements)
    monkeypatch.setattr(jaccard, "_compared", compared)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link(docs).collect()}
    assert got == {i: (len(sets[i]), top(i)) for i in range(len(texts))}
    assert sum(rows) < 10 * len(texts)
