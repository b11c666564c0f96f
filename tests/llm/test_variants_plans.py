"""No join of the spelling variants is broadcast: its sides grow with the words, and their size is told too low."""

from fleetseal.llm import variants


def test_no_side_that_grows_with_the_words_is_broadcast(spark, monkeypatch):
    words = spark.createDataFrame([("abandon", 50), ("abandn", 3), ("bandon", 9), ("zebrafish", 7), ("zebrafsh", 1)], "word string, n long")
    plans, plain = [], variants.stage

    def stage(df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, *rest)
    monkeypatch.setattr(variants, "stage", stage)
    got = variants.forms(words)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert sorted((r.word, r.form, r.n_near, r.root) for r in got.collect()) == [
        ("abandn", "abandon", 1, "abandon"), ("abandon", None, 2, "abandon"), ("bandon", "abandon", 1, "abandon"),
        ("zebrafish", None, 1, "zebrafish"), ("zebrafsh", "zebrafish", 1, "zebrafish")]
    assert sum(p.count("SortMergeJoin") for p in plans) >= 5 and not [p for p in plans if "Broadcast" in p]
