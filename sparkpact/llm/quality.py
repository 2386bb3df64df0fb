"""Quality classifier: co-training of a text-content view and a page-metadata view.

Each view has a logistic regression of its own; the text's reads hashed words and surface shares. Over some rounds each
view scores all unlabelled documents outside the held-out fold and labels the `taken` it is surest of, for the other to
learn from; then both are calibrated on labelled rows that neither saw, and combined. Labelled rows are a bounded sample
(`labelled`, a parameter); features of the documents that training scores are written once, as 32-bit numbers.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Written, beside, held_out, kept_fields, outputs, table
from .words import WordHasher, sliced, texts_of


@dataclass(frozen=True)
class Settings:
    #: Labelled rows of each class that training reads at most.
    labelled: int = 3000
    rounds: int = 4
    #: Unlabelled documents that each view labels in a round.
    taken: int = 180
    sources: int = 64
    threshold: float = 0.5


_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, *range(9, 14)), "line": (10,), "stop": tuple(b".,;:!?"), "bar": tuple(b"|"), "symbol": tuple(b"#$%&*+-/<=>@\\^_`{}~()[]\"'"), "other": range(128, 256)}
#: Hash classes of words in the text's view.
WORDS = 128
TEXT_FEATURES = len(_CLASSES) + 9 + WORDS


def text_view(texts: list[bytes | None], hasher: WordHasher) -> np.ndarray:
    """Shares of character classes, lengths and repetition of words and lines, and of words by hash class, by text."""
    h, offsets = hasher.batch(texts)
    out = np.zeros((len(texts), TEXT_FEATURES))
    tables = [np.isin(np.arange(256), list(c)) for c in _CLASSES.values()]
    for k, t in enumerate(texts):
        t = t or b""
        counts = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        n = max(len(t), 1)
        out[k, : len(tables)] = [counts[x].sum() / n for x in tables]
        w = h[offsets[k] : offsets[k + 1]]
        m = max(len(w), 1)
        kinds, times = np.unique(w, return_counts=True) if len(w) else (w, np.zeros(1))
        lines = t.split(b"\n")
        p = counts[counts > 0] / n
        out[k, -WORDS:] = np.sqrt(np.bincount((w >> np.uint64(57)).astype(np.int64), minlength=WORDS) / m)
        out[k, len(tables) : -WORDS] = [
            np.log1p(len(w)),
            n / m / 10,
            len(kinds) / m,
            times.max() / m,
            float((w[1:] == w[:-1]).mean()) if len(w) > 1 else 0.0,
            float((w[2:] == w[:-2]).mean()) if len(w) > 2 else 0.0,
            len(set(lines)) / len(lines),
            np.log1p(len(lines)),
            float(-(p * np.log(p)).sum()) / 4,
        ]
    return out


def meta_view(lang: list, source: list, n_chars: list, sources: int) -> np.ndarray:
    """Language and source by hash, and the length that the page reports. Nulls are a kind of their own."""
    out = np.zeros((len(lang), 16 + sources + 9))
    for k, (a, b, n) in enumerate(zip(lang, source, n_chars)):
        out[k, zlib.crc32(repr(a).encode()) % 16] = 1
        out[k, 16 + zlib.crc32(repr(b).encode()) % sources] = 1
        size = np.log1p(max(n or 0, 0))
        out[k, -9] = size / 10
        out[k, -8 + min(7, int(size) // 2)] = 1
    return out


class Logistic:
    """L2-regularised logistic regression on standardised features, by Newton steps. Classes weigh alike."""

    def __init__(self, x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 12, balanced: bool = True):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        pos = y.mean()
        weight = np.where(y == 1, 0.5 / max(pos, 1e-9), 0.5 / max(1 - pos, 1e-9)) if balanced else np.ones(len(y))
        self.w = np.zeros(z.shape[1])
        ridge = np.r_[np.full(x.shape[1], l2), 1e-6]
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            slope = z.T @ (weight * (p - y)) + ridge * self.w
            curve = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge)
            self.w -= np.linalg.solve(curve, slope)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.w[:-1] + self.w[-1], -30, 30)


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, surest, s: Settings):
    """The two views' classifiers, each taught by the other.

    surest(models, highs, lows): for each view the feature rows (both views') of the open documents it scores highest
    and lowest; none of them comes again.
    """
    own = [(v, y.astype(float)) for v in views]
    prior = max(y.mean(), 1e-3)
    high = min(s.taken - 1, max(1, round(s.taken * prior))) if s.taken > 1 else 1
    models = [Logistic(*d) for d in own]
    for _ in range(s.rounds):
        found = surest(models, high, max(1, s.taken - high))
        if found is None:
            break
        for view in (0, 1):
            (up, down) = found[1 - view]
            rows = np.concatenate([up[view], down[view]])
            own[view] = np.r_[own[view][0], rows], np.r_[own[view][1], np.ones(len(up[view])), np.zeros(len(down[view]))]
        models = [Logistic(*d) for d in own]
    return models


@dataclass
class Model:
    views: list | None
    calibrated: list | None
    combined: object
    constant: float = 0.5

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities by text, by metadata, and by both."""
        if self.views is None:
            return tuple(np.full(len(text), self.constant) for _ in range(3))  # type: ignore[return-value]
        logits = [c.logit(v.logit(x)[:, None]) for v, c, x in zip(self.views, self.calibrated, (text, meta))]
        both = self.combined.logit(np.stack(logits, 1))
        return tuple(1 / (1 + np.exp(-x)) for x in (*logits, both))  # type: ignore[return-value]


def _features(docs: DataFrame, keep: list[str], s: Settings) -> DataFrame:
    def run(batches):
        hasher = WordHasher()
        for b in sliced(batches, "text"):
            text = text_view(texts_of(b.column("text")), hasher).astype(np.float32)
            meta = meta_view(*(b.column(c).to_pylist() for c in ("lang", "source", "n_chars")), s.sources).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([x.tobytes() for x in text], pa.binary()), pa.array([x.tobytes() for x in meta], pa.binary())], [*keep, "f_text", "f_meta"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "f_text binary, f_meta binary"])
    return docs.select(*dict.fromkeys([*keep, "text", "lang", "source", "n_chars"])).mapInArrow(run, schema)


def _matrix(rows, name: str) -> np.ndarray:
    return np.array([np.frombuffer(r[name], np.float32) for r in rows], float)


_TOPS = "place int, sure double, doc_id long, f_text binary, f_meta binary"


def _surest(pool: DataFrame, models: list, high: int, low: int, out: set) -> list | None:
    """For each view the documents of the pool that it scores highest and lowest, none twice, `out` left aside.

    Each task returns at most the best `high` and `low` of its own by each view; top-k of these are what the driver gets.
    """
    shared, done = pool.sparkSession.sparkContext.broadcast(models), np.array(sorted(out), np.int64)  # at most 4 * rounds * taken ids
    wanted = [high, low, high, low]

    def run(batches):
        held = [[] for _ in wanted]
        for b in batches:
            b = b.filter(pa.array(~np.isin(b.column("doc_id").to_numpy(), done)))
            if not b.num_rows:
                continue
            for view, name in enumerate(("f_text", "f_meta")):
                logit = shared.value[view].logit(np.frombuffer(b"".join(b.column(name).to_pylist()), np.float32).reshape(b.num_rows, -1).astype(float))
                ids = b.column("doc_id").to_numpy()
                for place, sure in ((2 * view, logit), (2 * view + 1, -logit)):
                    k = np.lexsort((ids, -sure))[: wanted[place]]
                    held[place] += [(float(sure[i]), int(ids[i]), b.column("f_text")[int(i)].as_py(), b.column("f_meta")[int(i)].as_py()) for i in k]
                    held[place] = sorted(held[place], key=lambda r: (-r[0], *r[1:]))[: wanted[place]]
        rows = [(place, *r) for place, best in enumerate(held) for r in best]
        kinds = [pa.int32(), pa.float64(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in _TOPS.split(", ")])

    tops = Written(pool.select("doc_id", "f_text", "f_meta").mapInArrow(run, _TOPS), "surest")
    lists, had = [], set()
    for place, n in enumerate(wanted):
        best = tops.df.where(F.col("place") == place).orderBy(F.desc("sure"), "doc_id", "f_text", "f_meta").limit(n).collect()  # at most s.taken
        best = [r for r in best if r.doc_id not in had]  # what one view is surest of isn't taken twice
        had |= {r.doc_id for r in best}
        lists.append(best)
    tops.drop()
    if not had:
        return None
    out |= had
    return [tuple((_matrix(rows, "f_text").reshape(len(rows), TEXT_FEATURES), _matrix(rows, "f_meta").reshape(len(rows), len(models[1].mean))) for rows in lists[2 * v : 2 * v + 2]) for v in (0, 1)]


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Learns from labelled rows outside the held-out fold; one in five of them only calibrates.

    Labels other than 0 and 1 and null ids are left out; an id labelled both ways counts both ways; of documents that
    repeat an id one counts, that with the least features. The pool is every document of the fold without a label.
    """
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    at = F.xxhash64("doc_id").alias("_at")
    known = labels.where(~held_out() & F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"), at)
    sample = known.where("y = 1").orderBy("_at", "doc_id").limit(s.labelled).unionByName(known.where("y = 0").orderBy("_at", "doc_id").limit(s.labelled)).drop("_at").distinct()
    made = Written(_features(docs.where(~held_out() & F.col("doc_id").isNotNull()), ["doc_id"], s), "features")
    # bounded by the sample, and so is what it brings to the driver: some kilobytes a row
    rows = made.df.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("f_text", "f_meta")).alias("f")).select("doc_id", "y", "f.*").collect()
    rows.sort(key=lambda r: (r.doc_id, r.y))
    y = np.array([r.y for r in rows], int)
    own = np.array([zlib.crc32(f"calibrate {r.doc_id}".encode()) % 5 for r in rows])
    learn, check = own > 0, own == 0
    for part in (learn, check):
        if len(set(y[part])) < 2:  # nothing to tell apart
            made.drop()
            return Model(None, None, None, float((y.sum() + 1) / (len(y) + 2)))
    views = [_matrix(rows, "f_text"), _matrix(rows, "f_meta")]
    pool, out = made.df.join(known.select("doc_id").distinct(), "doc_id", "left_anti"), set()
    models = co_train((views[0][learn], views[1][learn]), y[learn], lambda m, high, low: _surest(pool, m, high, low, out), s)
    made.drop()
    logits = [m.logit(v[check]) for m, v in zip(models, views)]
    calibrated = [Logistic(x[:, None], y[check].astype(float), 0.1, balanced=False) for x in logits]
    both = np.stack([c.logit(x[:, None]) for c, x in zip(calibrated, logits)], 1)
    return Model(models, calibrated, Logistic(both, y[check].astype(float), 0.1, balanced=False))


def quality(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` with p_text, p_meta, score (that a document is good) and kept (score >= s.threshold).

    Null texts are empty; texts of any length are read whole. Where labels have one class only, or none, all scores are
    the smoothed share of it. Each row is scored by itself: repeated rows and null ids come out as they are, an empty
    table gives an empty one, and a kept column that has an added column's name comes out with `_input` after it.
    """
    names = outputs(keep, ["p_text", "p_meta", "score", "kept"])
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, s))

    def run(batches):
        hasher = WordHasher()
        for b in sliced(batches, "_text"):
            meta = meta_view(*(b.column(c).to_pylist() for c in ("_lang", "_source", "_n_chars")), s.sources)
            found = model.value.score(text_view(texts_of(b.column("_text")), hasher), meta)
            yield pa.RecordBatch.from_arrays([*(b.column(f"_k{i}") for i in range(len(keep))), *(pa.array(x) for x in found), pa.array(found[2] >= s.threshold)], [*names, "p_text", "p_meta", "score", "kept"])

    schema = f"{kept_fields(docs, keep, names)}, p_text double, p_meta double, score double, kept boolean"
    return beside(docs, keep, _text="text", _lang="lang", _source="source", _n_chars="n_chars").mapInArrow(run, schema)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, each view's and the combined probability, and kept of every document: see `quality`."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", held_out().alias("held_out"), "p_text", "p_meta", "score", "kept")
