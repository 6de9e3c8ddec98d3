"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other: toxic, then toxic_prose (toxic, in a text of good quality),
then toxic_junk (toxic, in a text of bad quality), as `labels.toxic` and `labels.quality` mark them. Each
linear model sees which of the selected words and beginnings of words a text has, and the log-odds that the earlier models give its
categories; for the training rows those come from models fitted on the other folds, so a later model never
leans on a fit to its own rows.

Words are selected in Spark: counts over the sample's whole texts, then for each category the `features` words whose
log-odds for it stand highest above zero, measured by their spread. Fitting runs in numpy on at most `sample` labelled rows.

Edge cases: null and empty texts have no words and score the models' intercepts; without usable labels,
or with labels of one kind, a category scores the share of its labels (0 without any); conflicting labels
of a doc_id count as toxic and as bad quality; of texts of equal labelled doc_id the fit takes the one of the least feature bits; a null quality counts as good. Empty in, empty out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.quality import SAMPLE, remainder
from mnemora.llm.shared import only
from mnemora.llm.textkernels import WORDS_AND_MARKS, chunks_of, joined, token_hashes, tokens

CATEGORIES = ("toxic", "toxic_prose", "toxic_junk")
FEATURES = 512
LEAST_ROWS = 3
"""A word must stand in so many of the sample's texts to be selected."""
FOLDS = 5
BEGINNINGS = (4, 5, 6, 7, 8)
"""Bytes of the beginnings of words that count as features beside the whole words."""


def _lower(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in pc.utf8_lower(column).cast(pa.binary()).to_pylist()]


def _features(texts: list[bytes]):
    """For a chunk of texts: hashes of its words and of their beginnings, and the text of each."""
    data, begins = joined(texts)
    starts, ends = tokens(data, WORDS_AND_MARKS)
    text = np.searchsorted(begins, starts, side="right") - 1
    yield token_hashes(data, starts, ends), text
    for size in BEGINNINGS:
        longer = np.flatnonzero(ends - starts > size)
        yield token_hashes(data, starts[longer], starts[longer] + size), text[longer]


def word_sets(texts: list[bytes]):
    """The distinct hashes of the words and beginnings of each text, in order."""
    for a, b in chunks_of(texts):
        parts = list(_features(texts[a:b]))
        h, text = np.concatenate([x for x, _ in parts]), np.concatenate([t for _, t in parts])
        order = np.argsort(text, kind="stable")
        at = np.searchsorted(text[order], np.arange(b - a + 1))
        for i in range(b - a):
            yield np.unique(h[order[at[i] : at[i + 1]]])


def presence(texts: list[bytes], vocabulary: np.ndarray) -> np.ndarray:
    """[texts, features of the sorted vocabulary]: 1 where a text has it."""
    out = np.zeros((len(texts), len(vocabulary)), dtype=np.uint8)
    if not len(vocabulary):
        return out
    maybe = np.zeros(1 << 16, dtype=bool)
    maybe[vocabulary >> np.uint64(48)] = True
    for a, b in chunks_of(texts):
        for h, text in _features(texts[a:b]):
            some = np.flatnonzero(maybe[h >> np.uint64(48)])
            k = np.minimum(np.searchsorted(vocabulary, h[some]), len(vocabulary) - 1)
            hit = vocabulary[k] == h[some]
            out[a + text[some[hit]], k[hit]] = 1
    return out


@dataclass
class Linear:
    weights: np.ndarray
    intercept: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ self.weights + self.intercept, -30, 30)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, epochs: int = 40, rate: float = 0.05, decay: float = 1e-4) -> Linear:
    """Logistic regression with an L2 penalty, by Adam."""
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
        return Linear(np.zeros(x.shape[1]), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(11)
    w = np.zeros(x.shape[1] + 1)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 256)):
            part = x[rows]
            g = (_sigmoid(part @ w[:-1] + w[-1]) - y[rows]) / len(rows)
            grad = np.append(part.T @ g + decay * w[:-1], g.sum())
            step += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Linear(w[:-1], float(w[-1]))


@dataclass
class Chain:
    vocabulary: np.ndarray
    models: list[Linear]

    def probabilities(self, words: np.ndarray) -> np.ndarray:
        """[texts, categories], each category from the words and the categories before it."""
        x = words.astype(np.float64)
        out = []
        for model in self.models:
            odds = model.log_odds(x)
            out.append(_sigmoid(odds))
            x = np.column_stack([x, odds / 4])
        return np.column_stack(out)


def fit_chain(words: np.ndarray, marks: np.ndarray, folds: np.ndarray, vocabulary: np.ndarray) -> Chain:
    """marks [rows, categories]. Later models are trained with out-of-fold predictions of the earlier ones."""
    x, models = words.astype(np.float64), []
    for j in range(marks.shape[1]):
        models.append(fit_linear(x, marks[:, j]))
        if j + 1 < marks.shape[1]:
            odds = np.zeros(len(x))
            for k in range(FOLDS):
                odds[folds == k] = fit_linear(x[folds != k], marks[folds != k, j]).log_odds(x[folds == k])
            x = np.column_stack([x, odds / 4])
    return Chain(vocabulary, models)


def marks_sample(labels: DataFrame, sample: int) -> DataFrame:
    """At most `sample` rows (__id and the categories) outside the held-out third, in the order of a hash of doc_id."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(remainder("doc_id") != 1)
    one = usable.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("toxic").alias("t"), F.min(F.coalesce("quality", F.lit(1))).alias("q"))
    toxic, good = F.col("t") == 1, F.col("q") == 1
    marks = [toxic, toxic & good, toxic & ~good]
    return one.select("__id", *[m.cast("double").alias(c) for m, c in zip(marks, CATEGORIES)]).orderBy(F.xxhash64("__id"), "__id").limit(sample)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Chain:
    chosen = marks_sample(labels, sample)
    source = only(docs, "doc_id", "text").withColumn("__id", F.col("doc_id").cast("long")).join(F.broadcast(chosen), "__id").drop("doc_id")

    def words_of(batches):
        for batch in batches:
            sets = list(word_sets(_lower(batch.column("text"))))
            lists = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in CATEGORIES] + [lists], [*CATEGORIES, "words"])

    sets = source.mapInArrow(words_of, ", ".join(f"{c} double" for c in CATEGORIES) + ", words array<long>")
    counts = sets.select(*CATEGORIES, F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in CATEGORIES])
    counts = counts.where(F.col("n") >= LEAST_ROWS).persist()
    rows = source.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in CATEGORIES]).first()
    picked: set[int] = set()
    for c in CATEGORIES:
        yes, no = float(rows[c] or 0), float(rows.n) - float(rows[c] or 0)
        a, b = F.col(c) + 0.5, F.col("n") - F.col(c) + 0.5
        odds = F.log(a / (F.lit(yes + 1) - a)) - F.log(b / (F.lit(no + 1) - b))
        spread = F.sqrt(1 / a + 1 / b + 1 / (F.lit(yes + 1) - a) + 1 / (F.lit(no + 1) - b))
        top = counts.select("word", (odds / spread).alias("z")).orderBy(F.desc("z"), "word").limit(features)
        picked |= {r.word for r in top.collect()}
    counts.unpersist()
    vocabulary = np.sort(np.array(sorted(picked), dtype=np.int64).view(np.uint64))

    def rows_of(batches):
        for batch in batches:
            bits = np.packbits(presence(_lower(batch.column("text")), vocabulary), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("__id"), *[batch.column(c) for c in CATEGORIES], pa.array([r.tobytes() for r in bits], pa.binary())], ["id", *CATEGORIES, "bits"])

    got = source.mapInArrow(rows_of, "id long, " + ", ".join(f"{c} double" for c in CATEGORIES) + ", bits binary").groupBy("id", *CATEGORIES).agg(F.min("bits").alias("bits")).collect()  # of rows of equal doc_id the least
    got = sorted((r.id, bytes(r.bits), *[r[c] for c in CATEGORIES]) for r in got)
    words = np.zeros((len(got), len(vocabulary)), dtype=np.uint8)
    for i, r in enumerate(got):
        words[i] = np.unpackbits(np.frombuffer(r[1], dtype=np.uint8), count=len(vocabulary)) if len(vocabulary) else 0
    marks = np.array([r[2:] for r in got], dtype=np.float64).reshape(len(got), len(CATEGORIES))
    return fit_chain(words, marks, np.arange(len(got)) % FOLDS, vocabulary)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, the probability of each category, predicted: toxic at 0.5 or more) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    names = [f"p_{c}" for c in CATEGORIES]

    def run(batches):
        chain = shared.value
        for batch in batches:
            texts = _lower(batch.column("text"))
            p = chain.probabilities(presence(texts, chain.vocabulary)) if texts else np.zeros((0, len(names)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(p[:, j]) for j in range(len(names))]], ["doc_id", *names])

    scored = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names))
    held_out = F.coalesce(remainder("doc_id") == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), *names, F.when(F.col(names[0]) >= 0.5, 1).otherwise(0).alias("predicted"))
