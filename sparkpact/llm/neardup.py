"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, rerank by the original vectors.

Rotations for balanced binary codes are learnt on a bounded sample. A code is cut into substrings, one a table; vectors
that share a table's key are candidates, and their cosines in double precision decide. Keys widen with the number of
vectors, and tables are added with the width until pairs exactly at the threshold meet with the wanted recall; where the
most tables don't reach it, keys are narrowed, in the end to none, which compares all with all. A pair counts in the first
table where it meets, so nothing has to be made distinct. Equal vectors are one class with a multiplicity, and a key
with many vectors is dealt out by pairs of blocks. Tasks give back counts and a spanning forest, not pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import cut, table


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.95
    #: Tables at least and at most, and the share of pairs exactly at `cosine` that have to meet in one of them.
    tables: int = 12
    most_tables: int = 64
    recall: float = 0.999
    #: Vectors of one key on average that keys are widened to keep to.
    load: int = 32
    #: Vectors that the rotations are learnt on at most.
    sample: int = 4096
    iterations: int = 30
    #: Vectors of one key that are compared in one task, and those of small keys packed together.
    block: int = 1024
    unit: int = 8192


def pairs_at(base: np.ndarray, dimension: int, count: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, those of base in turn or else random ones, and as many with exactly this cosine to them."""
    r = np.random.Generator(np.random.PCG64(12345))
    x = np.resize(base, (count, dimension)) if len(base) else r.normal(size=(count, dimension))
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    u = r.normal(size=x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
    return x, cosine * x + math.sqrt(1 - cosine * cosine) * u


class Rotation:
    """Keys of vectors of one dimension: `tables` of `width` bits, by which pairs at s.cosine meet with s.recall.

    The recall is measured on pairs made from `fresh` vectors; without a sample, signs of random projections differ with
    the angle's share of a half turn.
    """

    def __init__(self, sample: np.ndarray, fresh: np.ndarray, dimension: int, width: int, s: Settings):
        self.mean = sample.mean(0) if len(sample) else np.zeros(dimension)
        x, maps = sample - self.mean, []
        # principal axes; all are kept, as substrings need the bits
        axes = np.linalg.svd(x, full_matrices=True)[2].T if 1 < len(x) else np.eye(dimension)
        v = x @ axes
        for k in range(-(-width * s.most_tables // dimension)):
            r = np.linalg.qr(np.random.Generator(np.random.PCG64(k)).normal(size=(dimension, dimension)))[0]
            for _ in range(s.iterations if len(x) > 1 else 0):  # nearest codes, then the nearest rotation to them
                u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
                r = w.T @ u.T
            maps.append(axes @ r)
        self.map = np.concatenate(maps, 1)
        one, two = pairs_at(fresh, dimension, 2 * s.sample, s.cosine)
        for self.width in range(width, 0, -1):
            self.tables = s.most_tables
            if len(sample):
                met = np.logical_or.accumulate(self.keys(one) == self.keys(two), 1).mean(0)
            else:
                met = 1 - (1 - (1 - math.acos(s.cosine) / math.pi) ** self.width) ** np.arange(1, s.most_tables + 1)
            if met[-1] >= s.recall:
                self.tables = max(s.tables, int(np.argmax(met >= s.recall)) + 1)
                break
        else:
            self.width, self.tables = 0, 1
        self.map = self.map[:, : self.width * self.tables]

    def keys(self, x: np.ndarray) -> np.ndarray:
        bits = ((x - self.mean) @ self.map[:, : self.width * self.tables] >= 0).reshape(len(x), self.tables, self.width)
        return (bits @ (1 << np.arange(self.width, dtype=np.int64))).astype(np.int64)


def _usable(column: str = "embedding"):
    """Not null, not zero, all components finite."""
    v = F.col(column)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def _linked(x: np.ndarray, y: np.ndarray, kx: np.ndarray, ky: np.ndarray, t: int, least: float) -> np.ndarray:
    """Which of x link with which of y and meet in table t first."""
    ok = x @ y.T >= least
    a, b = np.nonzero(ok)
    if len(a) and t:
        late = (kx[a, :t] == ky[b, :t]).any(1)
        ok[a[late], b[late]] = False
    return ok


def _forest(ok: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) that connect whatever the links connect."""
    a, b = np.nonzero(ok)
    parent = list(range(ok.shape[0] + ok.shape[1]))

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    # most links fall to a few components: those that a first pass has joined are skipped at once
    label = np.arange(len(parent))
    out, n = [], ok.shape[0]
    while len(a):
        la, lb = label[a], label[b + n]
        open_ = la != lb
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        if not len(a):
            break
        _, one = np.unique(la, return_index=True)
        for k in one.tolist():
            i, j = find(int(a[k])), find(int(b[k]) + n)
            if i != j:
                parent[max(i, j)] = min(i, j)
                out.append((int(a[k]), int(b[k])))
        label = np.array([find(k) for k in range(len(parent))])
    return out


FOUND = "a long, b long, n long"


def links(classes: DataFrame, s: Settings) -> DataFrame:
    """Of classes (id, embedding, times): rows (a, null, n), of which n sums to the vectors linked with class a's from other classes, and forest edges (a, b, 0)."""
    spark = classes.sparkSession
    n = classes.count()
    width = max(8, min(24, round(math.log2(max(n / s.load, 2)))))
    dims = classes.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    main = dims[0].d if dims else 1
    taken = classes.where(F.size("embedding") == main).orderBy(F.xxhash64("id"), "id").limit(2 * s.sample).select("embedding").collect()  # bounded
    sample = np.array([r.embedding for r in taken], float).reshape(-1, main)
    sample /= np.abs(sample).max(1, keepdims=True)
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    learnt, fresh = sample[: s.sample], sample[s.sample :]
    rotation = spark.sparkContext.broadcast(Rotation(learnt, fresh if 2 * len(fresh) > len(learnt) else sample, main, width, s))

    def code(batches):
        others: dict[int, Rotation] = {}
        for b in batches:
            ids, raw, times = b.column("id").to_numpy(), b.column("embedding").to_pylist(), b.column("times").to_numpy()
            size = np.array([len(v) for v in raw])
            for d in np.unique(size):
                k = np.flatnonzero(size == d)
                x = np.array([raw[i] for i in k], float)
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                if d != main and d not in others:
                    others[d] = Rotation(np.empty((0, d)), np.empty((0, d)), int(d), width, s)
                keys = (rotation.value if d == main else others[d]).keys(x)
                blob, codes = [v.tobytes() for v in x], [v.tobytes() for v in keys.astype(np.int32)]
                for t in range(keys.shape[1]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(k), t, np.int32)), pa.array(np.full(len(k), d, np.int32)), pa.array(keys[:, t]), pa.array(ids[k]), pa.array(times[k]), pa.array(codes), pa.array(blob)],
                        ["t", "d", "k", "id", "times", "codes", "x"],
                    )

    rows = classes.select("id", "embedding", "times").mapInArrow(code, "t int, d int, k long, id long, times long, codes binary, x binary")
    many = cut(rows.groupBy("t", "d", "k").count().where(F.col("count") > s.block).select("t", "d", "k", F.ceil(F.col("count") / s.block).cast("int").alias("blocks")))
    units = max(1, n // s.unit)
    dealt = rows.join(many, ["t", "d", "k"], "left")
    own = F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int")
    small = dealt.where("blocks is null").withColumn("at", F.concat_ws("/", "t", "d", F.pmod(F.xxhash64("k"), F.lit(units)))).withColumn("side", F.lit(0))
    large = (
        dealt.where("blocks is not null")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("at", F.concat_ws("/", "t", "d", "k", F.least("own", "other"), F.greatest("own", "other")))
        .withColumn("side", F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2))
    )
    names = ["at", "side", "t", "k", "id", "times", "codes", "x"]

    def meet(key, p):
        t = p.column("t")[0].as_py()
        ids, times, k, side = (p.column(c).to_numpy() for c in ("id", "times", "k", "side"))
        x = np.stack([np.frombuffer(v, float) for v in p.column("x").to_pylist()])
        codes = np.stack([np.frombuffer(v, np.int32) for v in p.column("codes").to_pylist()])
        total, edges = np.zeros(len(ids), np.int64), []
        if side.any():  # two blocks of one key
            pairs = [(np.flatnonzero(side == 1), np.flatnonzero(side == 2), False)]
        else:
            order = np.argsort(k, kind="stable")
            begin = np.append(np.flatnonzero(np.diff(k[order], prepend=k[order][0] - 1)), len(order))
            pairs = [(order[i:j], order[i:j], True) for i, j in zip(begin[:-1], begin[1:]) if j - i > 1]
        for i, j, same in pairs:
            ok = _linked(x[i], x[j], codes[i], codes[j], t, s.cosine)
            if same:
                np.fill_diagonal(ok, False)
            if not ok.any():
                continue
            total[i] += ok @ times[j]
            if not same:
                total[j] += times[i] @ ok
            edges += [(ids[i[a]], ids[j[b]]) for a, b in _forest(ok)]
        some = np.flatnonzero(total)
        none = len(some)
        return pa.Table.from_arrays(
            [
                pa.array([*ids[some].tolist(), *(int(a) for a, _ in edges)], pa.int64()),
                pa.array([*[None] * none, *(int(b) for _, b in edges)], pa.int64()),
                pa.array([*total[some].tolist(), *[0] * len(edges)], pa.int64()),
            ],
            ["a", "b", "n"],
        )

    return small.select(names).unionAll(large.select(names)).groupBy("at").applyInArrow(meet, FOUND)


def near_duplicates(vectors: DataFrame, s: Settings = Settings()) -> DataFrame:
    """vec_id, n_links, component_id, kept.

    Vectors that are null, zero or hold null or non-finite components link with nothing, nor do those of different
    dimensions with each other. Repeated rows are vectors of their own, linked with each other. component_id is the
    smallest vec_id reachable by links; a null vec_id never names a component unless it is all there is.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = v.where(_usable())
    grouped = fine.groupBy("embedding").agg(F.count("*").alias("times"), F.min("vec_id").alias("first"))
    classes = cut(grouped.withColumn("id", F.monotonically_increasing_id()))
    found = cut(links(classes, s))
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    named = cut(components(found.where("b is not null").select("a", "b")))
    known = classes.join(named, classes.id == named.node, "left").select("id", "embedding", "times", "first", F.coalesce("component", "id").alias("component"))
    least = cut(known.groupBy("component").agg(F.min("first").alias("component_id")))
    known = cut(cut(known).join(least, "component").join(counts, F.col("id") == F.col("a"), "left").select("embedding", "component_id", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links")))
    linked = fine.join(known, "embedding").select("vec_id", "n_links", "component_id")
    alone = v.where(~F.coalesce(_usable(), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_embedding_neardup(spark, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector: see `near_duplicates`."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b
      ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
     AND list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings
      UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.a AS vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, c.a = c.component_id AS kept
FROM c LEFT JOIN n ON c.a = n.a
"""
