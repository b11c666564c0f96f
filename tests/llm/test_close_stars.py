"""Groups within families of edited copies, where leaders lie just too far apart, against every pair compared."""

import itertools
import random

from fleetseal.llm import jaccard


def shingles(text):
    w = text.split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def family(seed, size, width, spare):
    """Copies of one text with words replaced (by few words, so that copies share what is new), taken out or cut off."""
    draw = random.Random(seed)
    base = [f"w{seed}x{i}" for i in range(width)]
    for _ in range(size):
        own = list(base)
        for _ in range(draw.randrange(4)):
            own[draw.randrange(width)] = f"new{seed}x{draw.randrange(spare)}"
        if draw.random() < 0.3:
            del own[draw.randrange(width)]
        if draw.random() < 0.5:
            own = own[draw.randrange(width // 4):]
        yield " ".join(own)


def test_families(spark, monkeypatch):
    texts = [*family(1, 90, 40, 3), *family(2, 60, 80, 2), *family(3, 40, 30, 50)]
    docs = list(enumerate(texts + texts[:20], 1))
    sets, parent = [shingles(t) for _, t in docs], list(range(len(docs)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, j in itertools.combinations(range(len(docs)), 2):
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            parent[max(top(i), top(j))] = min(top(i), top(j))
    asked, plain = [], jaccard._between_stars

    def between(close, *rest):
        asked.append(close.count())
        return plain(close, *rest)
    monkeypatch.setattr(jaccard, "_between_stars", between)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {docs[i][0]: (len(sets[i]), docs[top(i)][0]) for i in range(len(docs))}
    assert asked and asked[0] > 0
