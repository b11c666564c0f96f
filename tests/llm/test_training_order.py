"""The mix in training order, and that the query goes through it."""

from pyspark.sql import functions as F

from fleetseal.llm import mixing, queries


def test_documents_without_a_pass_come_last(spark):
    rows = [(1, 2, [0.5, 0.9]), (2, 1, [0.1]), (3, 0, []), (4, 1, [0.5])]
    mixed = spark.createDataFrame(rows, "doc_id long, passes int, positions array<double>")
    got = [(r.doc_id, r["pass"], r.position) for r in mixing.in_training_order(mixed, untaken=True).collect()]
    assert got == [(2, 0, 0.1), (1, 0, 0.5), (4, 0, 0.5), (1, 1, 0.9), (3, None, None)]
    assert [r.doc_id for r in mixing.in_training_order(mixed).collect()] == [2, 1, 4, 1]


def test_the_query_returns_each_document_where_its_first_pass_is(spark, tmp_path):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"),
                                   F.repeat(F.lit("w "), (F.col("id") % 17).cast("int")).alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op5_curriculum_mix(spark, str(tmp_path)).collect()
    at = [r.first_position for r in got]
    none = at.index(None) if None in at else len(at)
    assert sorted(r.doc_id for r in got) == list(range(300)) and at[:none] == sorted(at[:none]) and set(at[none:]) <= {None}
    assert {r.passes for r in got[none:]} <= {0} and all(r.passes for r in got[:none]) and none > 100
