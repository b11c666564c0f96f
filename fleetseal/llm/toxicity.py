"""Grade the toxicity of texts by cumulative-link ordinal regression on the words they hold.

One weight per word serves every grade: P(grade <= k) is the logistic function of threshold k minus the summed weights of a
text's words. The weights are kept sparse by an L1 penalty (accelerated proximal gradient); thresholds are ordered.
The model is fitted on a bounded sample of labelled rows and applied to whole texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
_JVM_WORD = r"[\p{L}\p{N}]+"


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def score(self, text: str | None) -> float:
        """Summed weights of the distinct words; 0 for a null or empty text."""
        return sum(self.weights[w] for w in self.weights.keys() & set(_WORD.findall(text.lower()))) if text else 0.0


def _logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def _loss(eta: np.ndarray, grade: np.ndarray, cuts: np.ndarray, case: np.ndarray):
    """Weighted negative log likelihood and its gradients by score and by threshold; cuts runs from -inf to inf."""
    upper, lower = _logistic(cuts[grade + 1] - eta), _logistic(cuts[grade] - eta)
    share = np.maximum(upper - lower, 1e-12)
    by_cut = np.zeros(len(cuts))
    np.add.at(by_cut, grade + 1, -case * upper * (1 - upper) / share)
    np.add.at(by_cut, grade, case * lower * (1 - lower) / share)
    return -(case * np.log(share)).sum(), case * (1 - upper - lower), by_cut[1:-1]


def _cuts(free: np.ndarray) -> np.ndarray:
    """Ordered thresholds from the first one and the logarithms of the gaps."""
    return np.concatenate([[-np.inf], free[0] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(free[1:], -30, 8)))]), [np.inf]])


def fit_arrays(rows: np.ndarray, columns: np.ndarray, n_columns: int, grade: np.ndarray, grades: int, penalty: float = 0.0005,
               rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds. (rows, columns) are the cells of a binary matrix, ``grade`` runs from 0 to grades - 1.

    One pseudo-row per grade without words keeps thresholds finite where a grade has no example.
    """
    n = len(grade) + grades
    all_grades, case = np.concatenate([grade, np.arange(grades)]), np.full(n, 1.0 / n)

    def value(x):
        weights, free = x[:n_columns], x[n_columns:]
        eta, cuts = np.bincount(rows, weights[columns], minlength=n), _cuts(free)
        loss, by_eta, by_cut = _loss(eta, all_grades, cuts, case)
        gaps = np.exp(np.clip(free[1:], -30, 8))
        by_free = np.concatenate([[by_cut.sum()], [by_cut[k + 1:].sum() * gaps[k] for k in range(len(gaps))]])
        return loss, np.concatenate([np.bincount(columns, by_eta[rows], minlength=n_columns), by_free])

    x = np.zeros(n_columns + grades - 1)
    x[n_columns] = np.log((np.sum(all_grades == 0)) / max(1, np.sum(all_grades > 0)))
    momentum, t, step = x.copy(), 1.0, 1.0
    for _ in range(rounds):
        loss, slope = value(momentum)
        while True:
            new = momentum - step * slope
            new[:n_columns] = np.sign(new[:n_columns]) * np.maximum(np.abs(new[:n_columns]) - step * penalty, 0)
            move = new - momentum
            if step < 1e-9 or value(new)[0] <= loss + slope @ move + (move @ move) / (2 * step) + 1e-12:
                break
            step /= 2
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum, done = new + (t - 1) / t_next * (new - x), np.abs(new - x).max() < 1e-6
        if (momentum - new) @ (new - x) < 0 or slope @ (new - x) > 0:
            momentum, t_next = new.copy(), 1.0
        x, t, step = new, t_next, step * 1.3
        if done:
            break
    return x[:n_columns], _cuts(x[n_columns:])[1:-1]


def _telling(parents: np.ndarray, codes: np.ndarray, n_words: int, grade: np.ndarray, least: int, most: int) -> np.ndarray:
    """The ``most`` words, held by ``least`` texts or more, whose mean grade is furthest from the others', in standard errors."""
    n = max(1, len(grade))
    held = np.bincount(codes, minlength=n_words).astype(float)
    residual = grade - grade.mean() if len(grade) else grade.astype(float)
    spread = np.sqrt(np.maximum(held * (1 - held / n), 1e-9) * max(float((residual ** 2).mean()) if len(grade) else 0.0, 1e-9))
    test = np.where(held >= least, np.abs(np.bincount(codes, residual[parents], minlength=n_words)) / spread, -1.0)
    chosen = np.argsort(-test, kind="stable")[:most]
    return np.sort(chosen[test[chosen] >= 0])


def fit(labelled: DataFrame, grades: int, rows: int = 8192, least: int = 3, features: int = 2000, penalty: float = 0.0005, text: str = "text") -> Model:
    """Fit on (text, grade); the caller bounds ``labelled``, of which at most ``rows`` rows are taken by digest of the text.

    Features are the ``features`` words, each in ``least`` sampled texts or more, that tell the grades apart best one by one. Null grades are left out, null texts have no words,
    grades are moved into 0 to grades - 1. Without any row every text gets severity by the pseudo-rows alone.
    """
    sample = labelled.filter(F.col("grade").isNotNull()).select(
        F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_JVM_WORD), F.lit(0))).alias("words"),
        F.least(F.greatest(F.col("grade"), F.lit(0)), F.lit(grades - 1)).cast("int").alias("grade"),
        F.xxhash64(text).alias("at")).orderBy("at").limit(rows).select("words", "grade").toArrow()
    lists = sample["words"].combine_chunks() if sample.num_rows else pa.array([], pa.list_(pa.string()))
    grade = sample["grade"].to_numpy().astype(np.int64)
    parents, coded = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists).dictionary_encode()
    codes = coded.indices.to_numpy()
    chosen = _telling(parents, codes, len(coded.dictionary), grade, least, features)
    number = np.full(len(coded.dictionary), -1)
    number[chosen] = np.arange(len(chosen))
    kept = number[codes] >= 0
    rows_kept, columns_kept = parents[kept], number[codes[kept]]
    words = coded.dictionary.take(pa.array(chosen)).to_pylist()
    # The sample is read. Arrow would keep its memory for the rest of the driver's life.
    del sample, lists, parents, coded, codes, number, kept
    pa.default_memory_pool().release_unused()
    weights, cuts = fit_arrays(rows_kept, columns_kept, len(chosen), grade, grades, penalty)
    return Model({w: float(v) for w, v in zip(words, weights, strict=True) if v}, tuple(float(c) for c in cuts))


def grade(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``severity`` (expected grade), ``toxic_probability`` (of any grade above 0) and ``toxic`` (that is at least one half).

    Null and empty texts get the model's value for no words and are never toxic. Repeated rows and other columns stay.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was fitted on

    @F.arrow_udf("double")
    def summed(texts: pa.Array) -> pa.Array:
        return pa.array([spread.value.score(t.as_py()) for t in texts], pa.float64())

    above = lambda cut: 1 / (1 + F.exp(F.lit(cut) - F.col("__eta")))
    severity: Column = F.lit(0.0)
    for cut in model.thresholds:
        severity = severity + above(cut)
    return docs.withColumn("__eta", summed(F.col(text))).withColumns({
        "severity": severity, "toxic_probability": above(model.thresholds[0])}).withColumn(
            "toxic", (F.col("toxic_probability") >= 0.5) & (F.length(F.coalesce(text, F.lit(""))) > 0)).drop("__eta")


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = 8192) -> DataFrame:
    """(text, grade) of at most ``rows`` labelled documents, chosen by digest of the id: 0 clean, 1 toxic, 2 toxic and of low quality.

    A document labelled more than once counts with its worst label. Only the ids of the sample meet the documents.
    """
    one = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(
        F.max(F.when(F.col("toxic") > 0, F.when(F.coalesce("quality", F.lit(1)) > 0, 1).otherwise(2)).otherwise(0)).alias("grade"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "grade")
