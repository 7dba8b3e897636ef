"""Toxicity by a classifier chain: linear models in sequence, each fed the probabilities of the categories before it.

Later models are trained on out-of-fold probabilities of earlier ones, so that they
see them as they will be on new documents.  Features: presence of words, of their first letters, and of marks.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE, WordTable, read, slices, word_hash

#: Bound of the labelled sample that the models are fitted on (the smallest by a hash of the id), and of the features of a model.
#: One task holds the sample's features, some 1,000 numbers a document.
SAMPLE, FEATURES = 12_000, 4_000
FOLDS, ROUNDS, L2 = 3, 150, 0.3
#: Categories in the chain's order, as SQL over the columns of `labels`.
CHAIN = {"junk": "quality = 0", "toxic": "toxic = 1"}
PREFIXES = (4, 5, 6)
pieces = re.compile(r"\w+|[^\w\s]+").findall


def word_features(word: str) -> tuple[int, ...]:
    """Hashes (31 bits) of a word and of its first letters."""
    low = word.lower()
    names = [low, *(f"{low[:n]}*" for n in PREFIXES if len(low) > n)]
    if len(word) > 2 and word.isupper():
        names.append("^")
    return tuple(word_hash(x) >> 32 for x in names)


def present(text: str | None, table: WordTable) -> set[int]:
    return set().union(*(table[w] for w in set(pieces(text)))) if text else set()


def flattened(docs: list[np.ndarray]):
    """(document's number, feature) as two arrays, for a few documents at a time: all of a sample's at once would take too much memory."""
    for k in range(0, len(docs), SLICE):
        part = docs[k : k + SLICE]
        yield np.repeat(np.arange(k, k + len(part), dtype=np.int32), [len(d) for d in part]), np.concatenate(part)


class Sparse:
    """Documents as rows of present features, by number of a chosen feature."""

    def __init__(self, docs: list[np.ndarray], chosen: np.ndarray):
        rows, cols = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for row, flat in flattened(docs):
            at = np.minimum(np.searchsorted(chosen, flat), max(0, len(chosen) - 1))
            ok = chosen[at] == flat if len(chosen) else np.zeros(len(flat), bool)
            rows.append(row[ok])
            cols.append(at[ok].astype(np.int32))
        self.row, self.col, self.shape = np.concatenate(rows), np.concatenate(cols), (len(docs), len(chosen))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.shape[0])

    def t_dot(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], self.shape[1])


def choose(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The features that tell most of y: greatest G statistic among those in three documents or more, sorted."""
    names = np.unique(np.concatenate([*docs, np.zeros(0, np.int32)]))
    n, k = np.zeros(len(names)), np.zeros(len(names))
    for row, flat in flattened(docs):
        at = np.searchsorted(names, flat)
        n += np.bincount(at, minlength=len(names))
        k += np.bincount(at, y[row], len(names))
    p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    q = np.clip(k / np.maximum(n, 1), 1e-9, 1 - 1e-9)
    g = np.where(n >= 3, n * (q * np.log(q / p) + (1 - q) * np.log((1 - q) / (1 - p))), 0)
    best = np.argsort(-g, kind="stable")[:FEATURES]
    return np.sort(names[best[g[best] > 2]])


def fit(docs: list[np.ndarray], earlier: np.ndarray, y: np.ndarray) -> dict:
    """Logistic regression with a quadratic penalty, by accelerated gradient steps with a step for each feature."""
    if not len(y):
        return {"features": np.zeros(0, np.int64), "weights": np.zeros(0), "earlier": np.zeros(earlier.shape[1]), "bias": 0.0}
    chosen = choose(docs, y)
    x, m = Sparse(docs, chosen), earlier.shape[1]
    w, v = np.zeros(len(chosen) + m), np.zeros(len(chosen) + m)
    bias = vb = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    width = np.bincount(x.row, minlength=len(y)) + m + 1  # bounds the curvature: sum over features of x_f * |x|_1 / 4
    scale = np.append(x.t_dot(width / 4), (earlier**2).sum(0) * width.max(initial=1) / 4) + L2
    for t in range(ROUNDS):
        p = 1 / (1 + np.exp(-(x.dot(v[: len(chosen)]) + earlier @ v[len(chosen) :] + vb)))
        g = p - y
        new = v - (np.append(x.t_dot(g), earlier.T @ g) + L2 * v) / scale
        new_b = vb - 4 * g.sum() / width.sum()
        pull = t / (t + 3)
        v, vb = new + pull * (new - w), new_b + pull * (new_b - bias)
        w, bias = new, new_b
    return {"features": chosen, "weights": w[: len(chosen)], "earlier": w[len(chosen) :], "bias": bias}


def predict(model: dict, docs: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
    z = Sparse(docs, model["features"]).dot(model["weights"]) + earlier @ model["earlier"] + model["bias"]
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_chain(docs: list[np.ndarray], labels: np.ndarray) -> list[dict]:
    """A model for each column of labels; docs: each one's features.  Folds go by place."""
    fold, models, seen = np.arange(len(docs)) % FOLDS, [], np.zeros((len(docs), 0))
    for c, y in enumerate(labels.T.astype(float)):
        models.append(fit(docs, seen, y))
        if c + 1 == labels.shape[1]:  # no later model needs its probabilities
            break
        out = np.zeros(len(docs))
        for k in range(FOLDS):
            a, b = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            out[b] = predict(fit([docs[i] for i in a], seen[a], y[a]), [docs[i] for i in b], seen[b])
        seen = np.column_stack([seen, out])
    return models


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[dict]:
    """The chain, fitted on at most `sample` labelled documents, a stated bound.

    One task of an executor fits it; only the models come to the driver.  Where one doc_id has several rows of labels, it is in
    a category if any of them says so, and where it has several texts, one of them counts, always the same.  Without labelled
    rows all weights are 0.
    """
    import pyarrow as pa

    flags = [F.max(F.coalesce(F.expr(sql), F.lit(False)).cast("int")).alias(c) for c, sql in CHAIN.items()]
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(*flags)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        table = WordTable(word_features)
        for b in slices(batches):
            found = [np.array(sorted(present(t, table)), np.int32).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", *CHAIN)), pa.array(found, pa.binary())], ["doc_id", *CHAIN, "found"])

    def learn(batches):
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["doc_id"])
        found = [np.frombuffer(r["found"], np.int32) for r in rows]
        flags = np.array([[r[c] for c in CHAIN] for r in rows]).reshape(-1, len(CHAIN))
        del rows
        # Features of fewer than three documents are never chosen, and most are such ones.
        names, n = np.unique(np.concatenate([*found, np.zeros(0, np.int32)]), return_counts=True)
        names = names[n >= 3]
        found = [d[np.isin(d, names, assume_unique=True)] for d in found]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_chain(found, flags))])], ["models"])

    schema = "doc_id long, " + ", ".join(f"{c} int" for c in CHAIN) + ", found binary"
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").mapInArrow(run, schema)
    rows = rows.groupBy("doc_id", *CHAIN).agg(F.max("found").alias("found")).repartition(1)
    done = rows.mapInArrow(learn, "models binary").collect()
    return pickle.loads(done[0][0]) if done else fit_chain([], np.zeros((0, len(CHAIN))))


def score(docs: DataFrame, models: list[dict], text: str = "text") -> DataFrame:
    """docs with the probability of each category as p_<name>.

    Whole texts, each row by itself; null and empty texts get what the models say of no feature at all.  Columns
    named like the results are replaced.  Without labelled rows every probability is 0.5.
    """
    import pyarrow as pa
    from pyspark.sql.types import DoubleType, StructField, StructType

    names = [f"p_{c}" for c in CHAIN]
    docs = docs.drop(*names)
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        models = sent.value
        used = {int(f) for m in models for f in m["features"]}
        table = WordTable(lambda w: tuple(f for f in word_features(w) if f in used))
        for b in slices(batches):
            found = [np.array(sorted(present(t, table)), np.int64) for t in b.column(text).to_pylist()]
            seen = np.zeros((b.num_rows, 0))
            for m in models:
                seen = np.column_stack([seen, predict(m, found, seen)])
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c) for c in seen.T)], [*b.schema.names, *names])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(c, DoubleType()) for c in names)]))


def classify(docs: DataFrame, all_docs: DataFrame, labels: DataFrame, cut: float = 0.5) -> DataFrame:
    """docs with p_<category> and `toxic`: whether the last category is likelier than `cut`."""
    return score(docs, train(all_docs, labels)).withColumn("toxic", F.col(f"p_{[*CHAIN][-1]}") > cut)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, docs, read(spark, sf_dir, "labels")).drop("text")
