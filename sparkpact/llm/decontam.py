"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

1. The words of the benchmark are counted over all documents, which gives how often each of its n-grams would be
   expected by chance. Seeds are the n-grams with an expectation of at most `expected`, and each item's rarest half in
   any case. How often a passage leaks doesn't make its seeds common.
2. Passages that contain a seed are aligned with the seed's item, word by word, around the seed's diagonal; the local
   alignment's score as a share of the item's best possible one decides. Edited or paraphrased copies keep most of it.

A benchmark of at most `broadcast_bytes` goes to all tasks, and documents never move. Beyond it, seeds are joined by
a shuffle on their hash (hot seeds are split by the adaptive join), and texts are joined to the pairs found. Both ways
have the same seeds.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table, written
from .words import NOT_WORD, U64, WordHasher, rolled, sliced, texts_of, window_starts


@dataclass(frozen=True)
class Settings:
    n: int = 3
    expected: float = 0.01
    threshold: float = 0.5
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    slack: int = 8
    broadcast_bytes: int = 32 << 20


def smith_waterman(a: np.ndarray, b: np.ndarray, s: Settings) -> tuple[int, int]:
    """Best local alignment score of word sequences and the end of its part of b."""
    at, row, best, end = np.arange(len(b) + 1), np.zeros(len(b) + 1, np.int64), 0, 0
    slope = -s.gap * at
    for x in a:
        new = np.zeros_like(row)
        np.maximum(row[:-1] + np.where(b == x, s.match, s.mismatch), row[1:] + s.gap, out=new[1:])
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + slope) - slope  # gaps within the row
        k = int(new.argmax())
        if new[k] > best:
            best, end = int(new[k]), k
        row = new
    return best, end


def aligned(item: np.ndarray, doc: np.ndarray, diagonals: np.ndarray, s: Settings) -> tuple[float, int, int]:
    """Share of the item's best score, and the passage's first and last word + 1, over the regions around the diagonals."""
    best = (0.0, 0, 0)
    reach, d = len(item) + s.slack, np.unique(diagonals)
    for group in np.split(d, np.flatnonzero(np.diff(d) > 2 * reach) + 1):
        low, high = max(0, int(group[0]) - s.slack), min(len(doc), int(group[-1]) + reach)
        part = doc[low:high]
        score, end = smith_waterman(item, part, s)
        if score / (s.match * len(item)) > best[0]:
            back, start = smith_waterman(item[::-1], part[:end][::-1], s)
            best = (score / (s.match * len(item)), low + end - start, low + end)
    return best


HITS = "doc_id long, item_id long, score double, seeds long, start long, end long"


class Index:
    """Seeds of the items: sorted hashes with item and place, and a small bit table ahead of the search."""

    BITS = 22

    def __init__(self, ids: list[int], words: list[np.ndarray], rare: list[np.ndarray], n: int):
        self.ids, self.words = ids, words
        rows = [(rolled(w, n)[r], np.full(len(r), k), r) for k, (w, r) in enumerate(zip(words, rare)) if len(r)]
        h, item, at = (np.concatenate(c) for c in zip(*rows)) if rows else (np.empty(0, U64), np.empty(0, int), np.empty(0, int))
        order = np.argsort(h, kind="stable")
        self.h, self.item, self.at = h[order], item[order], at[order]
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[h >> U64(64 - self.BITS)] = True

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of n-grams: the number of each that is a seed, once for each item and place it seeds."""
        k = np.flatnonzero(self.maybe[grams >> U64(64 - self.BITS)])
        low, high = np.searchsorted(self.h, grams[k]), np.searchsorted(self.h, grams[k], "right")
        size = high - low
        into = np.arange(int(size.sum())) + np.repeat(low - (np.cumsum(size) - size), size)
        return np.repeat(k, size), self.item[into], self.at[into]


def hasher() -> WordHasher:
    return WordHasher(NOT_WORD, fold=True)


def rare_places(words: np.ndarray, share: dict[int, float], total: int, s: Settings) -> np.ndarray:
    """Starts of an item's seeds: expectation at most s.expected, and the rarest half in any case."""
    m = len(words) - s.n + 1
    if m <= 0:
        return np.empty(0, np.int64)
    logs = np.log([share.get(int(w), 0.5 / max(total, 1)) for w in words])
    chance = np.convolve(logs, np.ones(s.n), "valid") + np.log(max(total, 1))
    keep = chance <= np.log(s.expected)
    keep[np.argsort(chance, kind="stable")[: (m + 1) // 2]] = True
    return np.flatnonzero(keep)


def word_shares(docs: DataFrame, vocabulary: np.ndarray) -> tuple[dict[int, float], int]:
    """How often each word of a sorted, bounded vocabulary occurs among all words of all documents, and their number."""
    make = hasher

    def count(batches):
        own, seen, total = make(), np.zeros(len(vocabulary), np.int64), 0
        for b in sliced(batches, "text"):
            h, _ = own.batch(texts_of(b.column("text")))
            total += len(h)
            if len(vocabulary):
                k = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                seen += np.bincount(k[vocabulary[k] == h], minlength=len(vocabulary))
        k = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *k.tolist()], pa.int64()), pa.array([total, *seen[k].tolist()], pa.int64())], ["k", "n"])

    sums = {r.k: r.n for r in docs.select("text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}  # one row a word of the benchmark
    total = sums.pop(-1, 0)
    return {int(vocabulary[k]): n / total for k, n in sums.items()}, total


def contaminated(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, item_id, score, seeds (places that seeded), start and end (words) of every passage that scores s.threshold or more.

    One row per document row and item with the best passage: of equal ones the first; rows and ids that repeat each give
    their own. A null doc_id takes part. Null and empty texts, and items with fewer than s.n words, match nothing;
    repeated item ids count as separate items. Texts of any length are read whole: an alignment takes the regions around
    the seeds, a row of the item's length at a time. Either table may be empty. Other columns are not read.
    """
    items = _items(benchmark)
    return _by_broadcast(docs, items, s) if _small(items, s) else _by_shuffle(docs, items, s).drop("digest")


def clean(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...], s: Settings = Settings()) -> DataFrame:
    """Columns `keep`, the text among them, of the documents without any such passage. Beyond the broadcast's bound rows go by their text's SHA-256.

    What decides is a row's text alone: null ids, repeated ids and rows are treated alike both ways. Null texts stay.
    """
    items = _items(benchmark)
    if _small(items, s):
        return _by_broadcast(docs, items, s, keep)
    bad = _by_shuffle(docs, items, s).select("digest").distinct()
    texts = docs.where("text is not null")
    return texts.join(bad, F.sha2(F.col("text").cast("binary"), 256) == bad.digest, "left_anti").select(*keep).unionAll(docs.where("text is null").select(*keep))


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))


def _small(items: DataFrame, s: Settings) -> bool:
    size = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    return (size[0] or 0) + 64 * size[1] <= s.broadcast_bytes


def _by_broadcast(docs: DataFrame, items: DataFrame, s: Settings, keep: tuple[str, ...] = ()) -> DataFrame:
    rows = items.orderBy("item_id", "text").collect()  # at most s.broadcast_bytes
    words = [hasher().batch([r.text.encode()])[0] for r in rows]
    vocabulary = np.unique(np.concatenate([*words, np.empty(0, U64)]))
    share, total = word_shares(docs, vocabulary)
    index = Index([r.item_id for r in rows], words, [rare_places(w, share, total, s) for w in words], s.n)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        own, index = hasher(), shared.value
        for b in sliced(batches, "text"):
            h, offsets = own.batch(texts_of(b.column("text")))
            starts, counts = window_starts(offsets, s.n)
            grams = rolled(h, s.n)[starts] if len(starts) else np.empty(0, U64)
            k, item, at = index.hits(grams)
            doc = np.repeat(np.arange(b.num_rows), counts)[k]
            place = starts[k] - offsets[doc]
            order = np.lexsort((item, doc))
            doc, item, diagonal = doc[order], item[order], (place - at)[order]
            ids, out, bad = b.column("doc_id"), [], np.zeros(b.num_rows, bool)
            cuts = np.flatnonzero(np.diff(doc, prepend=-1) | np.diff(item, prepend=-1))
            for i, j in zip(cuts, [*cuts[1:], len(doc)]):
                d, q = int(doc[i]), int(item[i])
                score, start, end = aligned(index.words[q], h[offsets[d] : offsets[d + 1]], diagonal[i:j], s)
                if score >= s.threshold:
                    bad[d] = True
                    out.append((ids[d].as_py(), index.ids[q], score, int(j - i), start, end))
            yield b.filter(pa.array(~bad)) if keep else _rows(out)

    if keep:
        return docs.select(*keep).mapInArrow(run, docs.select(*keep).schema)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, HITS)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], [x.split()[0] for x in HITS.split(", ")])


def _by_shuffle(docs: DataFrame, items: DataFrame, s: Settings) -> DataFrame:
    """For a benchmark of any size: n-grams of both sides meet on their hash; word counts come from a join. `digest` is the text's SHA-256."""
    make = hasher

    def grams(id_name: str, n: int):
        def run(batches):
            own = make()
            for b in sliced(batches, "text"):
                h, offsets = own.batch(texts_of(b.column("text")))
                starts, counts = window_starts(offsets, n)
                doc = np.repeat(np.arange(b.num_rows), counts)
                g = (rolled(h, n) if n > 1 else h)[starts] if len(starts) else np.empty(0, U64)  # of one word: its own hash
                yield pa.RecordBatch.from_arrays([b.column(id_name).take(pa.array(doc)), pa.array(g.view(np.int64)), pa.array(starts - offsets[doc])], [id_name, "h", "at"])

        return run

    # ids are written before anything reads them: several branches, and tasks that run again, must see the same ones
    d = written(docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "rows")
    i = written(items.select(F.monotonically_increasing_id().alias("_item"), "item_id", "text"), "items")
    item_words = i.select("_item", "text").mapInArrow(grams("_item", 1), "_item long, h long, at long")
    doc_words = d.select("_row", "text").mapInArrow(grams("_row", 1), "_row long, h long, at long").groupBy("h").agg(F.count("*").alias("n"))
    total = word_shares(docs, np.empty(0, U64))[1]

    def rare(batches):
        for b in batches:
            out = []
            for item, words in zip(b.column("_item").to_pylist(), b.column("words").to_pylist()):
                words.sort(key=lambda w: w["at"])
                h = np.array([w["h"] for w in words], np.int64).view(U64)
                share = {int(x): w["n"] / total for x, w in zip(h, words) if w["n"] is not None}
                at = rare_places(h, share, total, s)
                out += zip([item] * len(at), rolled(h, s.n)[at].view(np.int64).tolist(), at.tolist()) if len(at) else []
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], ["_item", "h", "q"])

    counted = item_words.join(doc_words, "h", "left").groupBy("_item").agg(F.collect_list(F.struct("at", "h", "n")).alias("words"))
    seeds = counted.mapInArrow(rare, "_item long, h long, q long")
    doc_grams = d.select("_row", "text").mapInArrow(grams("_row", s.n), "_row long, h long, at long")
    pairs = doc_grams.join(seeds, "h").groupBy("_row", "_item").agg(F.collect_set(F.col("at") - F.col("q")).alias("diagonals"), F.count("*").alias("seeds"))
    both = pairs.join(d, "_row").join(i.withColumnRenamed("text", "item_text"), "_item").select("doc_id", "item_id", "text", "item_text", "diagonals", "seeds")

    def run(batches):
        own = make()
        for b in batches:
            out, digests, texts = [], [], texts_of(b.column("text"))
            x, y = own.batch(texts), own.batch(texts_of(b.column("item_text")))
            for k, (doc_id, item_id, diagonals, seeds) in enumerate(zip(*(b.column(c).to_pylist() for c in ("doc_id", "item_id", "diagonals", "seeds")))):
                score, start, end = aligned(y[0][y[1][k] : y[1][k + 1]], x[0][x[1][k] : x[1][k + 1]], np.array(diagonals), s)
                if score >= s.threshold:
                    out.append((doc_id, item_id, score, seeds, start, end))
                    digests.append(hashlib.sha256(texts[k]).hexdigest())
            yield _rows(out).append_column("digest", pa.array(digests, pa.string()))

    return both.mapInArrow(run, f"{HITS}, digest string")


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every passage of the documents that holds a benchmark item, edited or not: see `contaminated`."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
