"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training reads a bounded sample of labelled rows (`max_rows`, a parameter) in one task; its L1 term leaves a few
thousand non-zero weights, which are broadcast, and every document is scored from its whole text by its own task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import beside, held_out, kept_fields, outputs, table
from .words import NOT_WORD, U64, WordHasher, mix, sliced, texts_of


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.0
    epochs: int = 6
    #: Labelled rows of each class that training reads at most.
    max_rows: int = 4000
    threshold: float = 0.7


def featurised(texts: list[bytes | None], hasher: WordHasher, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature index and text number of every occurrence: words, pairs of neighbours, pairs with one word between."""
    h, offsets = hasher.batch(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    parts, docs = [h], [doc]
    for gap, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xD6E8FEB86659FD93)):
        if len(h) > gap:
            same = doc[:-gap] == doc[gap:]
            parts.append(mix((h[:-gap] * U64(factor) + h[gap:])[same]))
            docs.append(doc[gap:][same])
    return (np.concatenate(parts) >> U64(64 - bits)).astype(np.int64), np.concatenate(docs)


def train(rows: list[tuple[np.ndarray, int]], s: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Per-coordinate FTRL-proximal over (feature indices, label): the non-zero indices, their weights, the bias.

    With one class only, or no rows, the weights are empty and the bias is the smoothed log odds.
    """
    pos = sum(y for _, y in rows)
    if not rows or pos in (0, len(rows)):
        return np.empty(0, np.int64), np.empty(0), float(np.log((pos + 1) / (len(rows) - pos + 1)))
    z, n = np.zeros(1 << s.bits), np.zeros(1 << s.bits)
    zb = nb = 0.0
    for epoch in range(s.epochs):
        for k in np.random.Generator(np.random.PCG64(epoch)).permutation(len(rows)):
            idx, y = rows[k]
            zi, ni = z[idx], n[idx]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= s.l1, 0.0, -(zi - np.sign(zi) * s.l1) / ((s.beta + root) / s.alpha + s.l2))
            bias = -zb / ((s.beta + nb**0.5) / s.alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
            z[idx] = zi + g - (np.sqrt(ni + g * g) - root) / s.alpha * w
            n[idx] = ni + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / s.alpha * bias
            nb += g * g
    idx = np.flatnonzero(np.abs(z) > s.l1)
    zi = z[idx]
    w = -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(n[idx])) / s.alpha + s.l2)
    return idx, w, -zb / ((s.beta + nb**0.5) / s.alpha)


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> tuple[np.ndarray, np.ndarray, float]:
    """Learns from the labelled rows outside the held-out fold, at most s.max_rows of each class, picked by a hash of the id.

    Labels other than 0 and 1, null ids and labelled ids without a document are left out; an id labelled both ways counts
    both ways. Of documents that repeat an id the one with the least features counts.
    """
    known = labels.where(~held_out() & F.col("toxic").isin(0, 1)).select(
        "doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("_at")
    )
    # per class a top-k: partial per task, bounded at the end
    sample = known.where("toxic = 1").orderBy("_at", "doc_id").limit(s.max_rows).unionByName(
        known.where("toxic = 0").orderBy("_at", "doc_id").limit(s.max_rows)
    ).select("doc_id", "toxic").distinct()
    # bounded by max_rows: small enough to broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text")
    hasher = WordHasher(NOT_WORD, fold=True)

    def features(batches):
        for b in sliced(batches, "text"):
            idx, doc = featurised(texts_of(b.column("text")), hasher, s.bits)
            key = np.unique(doc.astype(np.int64) << 32 | idx)
            cuts = np.searchsorted(key >> 32, np.arange(b.num_rows + 1))
            blobs = [(key[i:j] & 0xFFFFFFFF).astype(np.uint32).tobytes() for i, j in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("toxic"), pa.array(blobs, pa.binary())], ["doc_id", "toxic", "f"])

    def learn(batches):
        got = [(d, f, y) for b in batches for d, y, f in zip(*(b.column(i).to_pylist() for i in range(3)))]
        got.sort(key=lambda x: x[:2])  # the same order whatever the tasks did
        idx, w, bias = train([(np.frombuffer(f, np.uint32).astype(np.int64), y) for _, f, y in got], s)
        yield pa.RecordBatch.from_arrays([pa.array([idx.astype(np.int64).tobytes()]), pa.array([w.astype(np.float64).tobytes()]), pa.array([float(bias)])], ["idx", "w", "bias"])

    # one task, on at most 2 * max_rows rows of features: of rows that repeat a doc_id one counts
    model = rows.mapInArrow(features, "doc_id long, toxic int, f binary").groupBy("doc_id", "toxic").agg(F.min("f").alias("f")).repartition(1)
    got = model.mapInArrow(learn, "idx binary, w binary, bias double").first()
    if got is None:
        return train([], s)
    return np.frombuffer(got.idx, np.int64), np.frombuffer(got.w, np.float64), got.bias


def score(docs: DataFrame, model, s: Settings = Settings(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` of docs with `score` (0 to 1) and `predicted` (score >= s.threshold).

    A null or empty text has no features: its score is that of the bias. Each distinct feature of a text counts once,
    however long the text. Each row is scored by itself: repeated rows and ids score alike, an empty table gives an
    empty one. A kept column called score or predicted comes out with `_input` after its name.
    """
    idx, w, bias = model
    sparse = docs.sparkSession.sparkContext.broadcast((idx, w))  # at most 2 ** s.bits weights
    hasher = WordHasher(NOT_WORD, fold=True)
    names = outputs(keep, ["score", "predicted"])
    schema = f"{kept_fields(docs, keep, names)}, score double, predicted int"

    def run(batches):
        weights = np.zeros(1 << s.bits)
        weights[sparse.value[0]] = sparse.value[1]
        for b in sliced(batches, "_text"):
            f, doc = featurised(texts_of(b.column("_text")), hasher, s.bits)
            hit = np.flatnonzero(weights[f])
            key = np.unique(doc[hit].astype(np.int64) << 32 | f[hit])
            total = np.bincount(key >> 32, weights[key & 0xFFFFFFFF], b.num_rows) + bias
            p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(b.column(f"_k{i}") for i in range(len(keep))), pa.array(p), pa.array((p >= s.threshold).astype(np.int32))], [*names, "score", "predicted"])

    return beside(docs, keep, _text="text").mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Trains on labels and scores every row of docs; see `fit` and `score` for what odd rows give."""
    return score(docs, fit(docs, labels, s), s, keep)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; held_out marks the fold nothing is learnt from."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", held_out().alias("held_out"), "score", "predicted")
