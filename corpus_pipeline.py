"""The training-data pipeline: each stage applies one operator of fleetseal.llm to what the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs. All but
the last return the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetseal.llm import jaccard, mixing, packing, private, toxicity
from fleetseal.llm.common import shared_path, table, word_count
from fleetseal.llm.queries import RANKS, VOCABULARY

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no grade of toxicity is likelier than not. A document without text stays."""
    model = toxicity.fit(toxicity.labelled_sample(docs, table(spark, sf_dir, "labels")), 3)
    return toxicity.grade(docs.select(*COLUMNS), model).filter(~F.col("toxic")).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row with the smallest id (null last; then by digest of the text); all rows without words."""
    number = F.coalesce("doc_id", F.lit(2**63 - 1))
    grouped = jaccard.link(docs.select("doc_id", "text")).withColumn("id", number)
    first = grouped.filter("n_shingles > 0").groupBy("component").agg(F.min(F.struct("id", "version")).alias("first")).select("first.id", "first.version")
    rows = docs.select(*COLUMNS).withColumns({"id": number, "version": F.xxhash64("text"), "words": word_count(F.col("text"))})
    kept = rows.filter("words > 0").join(first, ["id", "version"], "left_semi").dropDuplicates(["id", "version"])
    return kept.union(rows.filter("words = 0").select(*kept.columns)).select(*COLUMNS)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the names of kinds in place of personal data."""
    return private.mask(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per pass that the mix takes of a document, in training order; a document that it does not take goes.

    Times are worked out without the texts, which then move once to their times and once into order. Rows equal in id and text
    are told apart by nothing: one of them stands for the passes of all.
    """
    keys = {"id": F.coalesce("doc_id", F.lit(2**63 - 1)), "version": F.xxhash64("text")}
    narrow = docs.select("doc_id", "source", word_count(F.col("text")).alias("words"), *[c.alias(k) for k, c in keys.items()])
    taken = mixing.mix(narrow, mixing.cyclic_schedules(docs), F.col("words"), tie=F.col("version")).filter("passes > 0")
    due = taken.groupBy("id", "version").agg(F.flatten(F.collect_list("positions")).alias("positions"))
    rows = docs.select(*COLUMNS, *[c.alias(k) for k, c in keys.items()]).dropDuplicates(["id", "version"])
    return mixing.in_training_order(rows.join(due, ["id", "version"])).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every row with its sequence and its place there."""
    return packing.pack(packing.pieces(docs, VOCABULARY, RANKS)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", without_toxic), ("near_duplicates", one_of_each), ("personal_data", masked), ("mixing", mixed), ("packing", packed)]

# A classifier, components of links, transducers and a packing are more than SQL can state: tests/llm holds a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        path = shared_path(spark, name)
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
