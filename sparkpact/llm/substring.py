"""Substring dedup: a log-structured fingerprint index over windows of words.

Documents come in batches of rising doc_id. Each batch's window hashes are dealt out by hash range and merge-joined with
the index: sorted immutable runs of all windows of earlier batches, one file for each hash range. A hit counts only if
a second, independent hash agrees (48 and 16 bits). The batch's new windows then become a run of their own, and runs of
like size are compacted into one. Only the batch is shuffled: a range's task opens its own files of the runs.

Windows travel packed: one row holds what one task's chunk has for one hash range, as arrays. A chunk sends each window
once, however often it occurs there, so a passage in a third of all documents costs one entry a chunk.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import expanded, release, remove, shared_path, squeezed, table, written
from .words import U64, WordHasher, rolled, texts_of, window_starts

FIRST = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Settings:
    window: int = 20
    batches: int = 3
    #: Bytes of text of a chunk, of a hash range and of a group that is rewritten together: what a task holds at a time.
    chunk_bytes: int = 4 << 20
    range_bytes: int = 12 << 20
    group_bytes: int = 4 << 20


PACKED = "kind int, bucket int, docs binary, sizes binary, starts binary, h binary, c binary"
WINDOWS, RUN, REMOVED = 0, 1, 2


def _packed(kind: int, bucket: int, doc: np.ndarray, start: np.ndarray, h=None, c=None) -> tuple:
    """Entries in order of (doc, start), as one row."""
    edge = np.flatnonzero(np.diff(doc, prepend=doc[:1] - 1)) if len(doc) else np.empty(0, np.int64)
    sizes = np.diff(np.append(edge, len(doc))).astype(np.int32)
    return (kind, bucket, doc[edge].tobytes(), sizes.tobytes(), _steps(start), None if h is None else h.view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), None if c is None else c.tobytes())


def _steps(start: np.ndarray) -> bytes:
    """Starts as differences that wrap, in as few bytes as the starts need."""
    kind = np.uint16 if not len(start) or start.max() < 1 << 16 else np.uint32
    return np.diff(start.astype(kind), prepend=kind(0)).tobytes()


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in PACKED.split(", ")])


def _unpacked(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """doc and start of all entries of packed rows."""
    docs = np.frombuffer(b"".join(t.column("docs").to_pylist()), np.int64)
    sizes = np.frombuffer(b"".join(t.column("sizes").to_pylist()), np.int32)
    starts = []
    for raw, own in zip(t.column("starts").to_pylist(), t.column("sizes").to_pylist()):
        n = int(np.frombuffer(own, np.int32).sum())
        kind = np.uint16 if len(raw) == 2 * n else np.uint32
        starts.append(np.cumsum(np.frombuffer(raw, kind), dtype=kind).astype(np.int64))
    return np.repeat(docs, sizes), np.concatenate(starts) if starts else np.empty(0, np.int64)


def _hashes(t: pa.Table) -> np.ndarray:
    raw = np.frombuffer(b"".join(t.column("h").to_pylist()), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view(U64).ravel()


def _coded(h: np.ndarray, c: np.ndarray) -> bytes:
    """A run's file: sorted hashes as byte planes of their differences, then the second hashes, compressed."""
    planes = np.diff(h, prepend=U64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes + c.tobytes())


def _decoded(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    n = len(data) // 10
    return np.cumsum(data[: 8 * n].reshape(8, -1).T.copy().view(U64).ravel(), dtype=U64), data[8 * n :].view(np.uint16)


def _ordered(doc: np.ndarray, start: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (h, c, doc, start) and, along it, the place of each entry's first of equal windows."""
    order = np.lexsort((start, doc, h))
    hs, cs = h[order], c[order]
    same = hs[1:] == hs[:-1]
    if (same & (cs[1:] != cs[:-1])).any():  # a collision of the first hash
        order = np.lexsort((start, doc, c, h))
        hs, cs = h[order], c[order]
        same = hs[1:] == hs[:-1]
    lead = np.arange(len(order))
    lead[1:][same & (cs[1:] == cs[:-1])] = 0
    return order, np.maximum.accumulate(lead)


def _group(doc: np.ndarray, groups: int) -> np.ndarray:
    return np.where(doc == FIRST, 0, np.mod(doc, groups))


def _removed(doc: np.ndarray, start: np.ndarray, groups: int) -> list[tuple]:
    """Starts of repeated windows as one row for each group of documents."""
    if not len(doc):
        return []
    g = _group(doc, groups)
    order = np.lexsort((start, doc, g))
    doc, start, g = doc[order], start[order], g[order]
    cuts = np.append(np.flatnonzero(np.diff(g, prepend=-1)), len(g))
    return [_packed(REMOVED, int(g[i]), doc[i:j], start[i:j]) for i, j in zip(cuts[:-1], cuts[1:])]


def fingerprints(docs: DataFrame, buckets: int, groups: int, s: Settings) -> DataFrame:
    """Packed windows by hash range, each once a chunk, and the chunk's own repeats as removals."""

    def run(batches):
        hasher = WordHasher()
        ids, texts, size = [], [], 0

        def flush():
            order = np.argsort(np.array(ids, np.int64), kind="stable")
            doc_ids = np.array(ids, np.int64)[order]
            h, offsets = hasher.batch([texts[k] for k in order])
            at, counts = window_starts(offsets, s.window)
            if not len(at):
                return []
            place = np.repeat(np.arange(len(doc_ids)), counts)
            doc, start = doc_ids[place], at - offsets[place]
            wh, wc = rolled(h, s.window)[at] >> U64(16), (rolled(h, s.window, 0xD6E8FEB86659FD93)[at] >> U64(48)).astype(np.uint16)
            del h
            order, lead = _ordered(doc, start, wh, wc)
            first = order[lead]
            repeat = (doc[order] != doc[first]) | (start[order] != start[first])
            rows = _removed(doc[order[repeat]], start[order[repeat]], groups)
            own = np.sort(order[lead == np.arange(len(lead))])
            bucket = ((wh[own] >> U64(16)) * U64(buckets) >> U64(32)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            own, bucket = own[by], bucket[by]
            cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
            return rows + [_packed(WINDOWS, int(bucket[i]), doc[k], start[k], wh[k], wc[k]) for i, j in zip(cuts[:-1], cuts[1:]) for k in [own[i:j]]]

        def out(rows):
            for i in range(0, len(rows), 32):
                yield _batch_of(rows[i : i + 32])

        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), texts_of(b.column("text"))):
                ids.append(FIRST if d is None else d)
                texts.append(t)
                size += len(t or b"")
                if size > s.chunk_bytes:
                    yield from out(flush())
                    ids, texts, size = [], [], 0
        if ids:
            yield from out(flush())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PACKED)


class FingerprintIndex:
    """Sorted immutable runs of windows' hashes in folders, newest last, each with a file for each hash range.

    Tasks name the files they write after themselves, and only those in a run's manifest count, so that tasks can run
    again. The manifests stay tables; nothing of them comes to the driver but their sums.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        #: Folder, manifest, entries.
        self.runs: list[tuple[str, DataFrame, int]] = []
        #: Folders that the next saved state no longer names; how many states there have been.
        self.stale: list[str] = []
        self.states = 0

    def _new(self) -> str:
        return f"{self.folder}/run-{uuid.uuid4().hex}"

    @classmethod
    def opened(cls, spark: SparkSession, folder: str) -> tuple[FingerprintIndex, int | None]:
        """The index that was last saved in a folder, and into how many hash ranges it deals; an empty one where there is none."""
        index = cls(spark, folder.rstrip("/"))
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(index.folder)
        system = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in system.listStatus(jpath)] if system.exists(jpath) else []
        done = sorted(n for n in names if n.startswith("state-") and system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{index.folder}/{n}/_SUCCESS")))
        if not done:
            return index, None
        index.states = int(done[-1].removeprefix("state-"))
        state = spark.read.schema("place int, run string, buckets int, bucket int, path string, n long").parquet(f"{index.folder}/{done[-1]}")
        runs = state.groupBy("place", "run", "buckets").agg(F.sum("n").alias("n")).orderBy("place").collect()  # a row a run: few
        index.runs = [(r.run, state.where(F.col("place") == r.place).select("bucket", "path", "n"), r.n) for r in runs if r.run]
        return index, runs[0].buckets

    def save(self, buckets: int) -> None:
        """Writes which runs there are as one table, whose success file makes it count; then drops what no state names any more."""
        self.states += 1
        state = self.spark.createDataFrame([(-1, "", buckets, None, None, 0)], "place int, run string, buckets int, bucket int, path string, n long")
        for place, (run, files, _) in enumerate(self.runs):
            state = state.unionByName(files.select(F.lit(place).alias("place"), F.lit(run).alias("run"), F.lit(buckets).alias("buckets"), "bucket", "path", "n"))
        state.write.mode("overwrite").parquet(f"{self.folder}/state-{self.states:08d}")
        self.forget()

    def forget(self) -> None:
        """Drops the runs that compaction has replaced."""
        for old in self.stale:
            remove(self.spark, old)
        self.stale = []

    def manifest(self, runs=None) -> DataFrame:
        out = self.spark.createDataFrame([], "bucket int, path string, n long")
        for _, m, _ in self.runs if runs is None else runs:
            out = out.unionByName(m)
        return out

    def _added(self, folder: str, done: DataFrame) -> None:
        files = done.where(f"kind = {RUN}").select("bucket", F.col("starts").cast("string").alias("path"), F.conv(F.hex("sizes"), 16, 10).cast("long").alias("n"))
        n = files.agg(F.sum("n")).first()[0] or 0
        self.runs.append((folder, files, n))

    def absorb(self, windows: DataFrame, groups: int, keep: bool = True) -> DataFrame:
        """Merge-joins a batch with the runs; returns its removals. keep: the batch's new windows become a run."""
        folder = self._new()

        def merge(key, new, old):
            passed = new.filter(pa.compute.equal(new.column("kind"), REMOVED))
            new = new.filter(pa.compute.equal(new.column("kind"), WINDOWS))
            rows = []
            if new.num_rows:
                doc, start = _unpacked(new)
                h, c = _hashes(new), np.frombuffer(b"".join(new.column("c").to_pylist()), np.uint16)
                order, lead = _ordered(doc, start, h, c)
                leaders = np.flatnonzero(lead == np.arange(len(lead)))
                known = np.zeros(len(leaders), bool)
                lh, lc = h[order[leaders]], c[order[leaders]]
                for oh, oc in _opened(old.column("path").to_pylist()):
                    k, end = np.searchsorted(oh, lh), np.searchsorted(oh, lh, "right")
                    while (go := k < end).any():
                        known[go] |= oc[k[go]] == lc[go]
                        k = k + go
                first = order[lead]
                repeat = (doc[order] != doc[first]) | (start[order] != start[first])
                slot = np.zeros(len(order), np.int64)
                slot[leaders] = 1
                repeat |= known[np.cumsum(slot) - 1]
                rows += _removed(doc[order[repeat]], start[order[repeat]], groups)
                if keep and not known.all():
                    rows.append(_file(folder, key[0].as_py(), lh[~known], lc[~known]))
            return pa.concat_tables([passed, pa.Table.from_batches([_batch_of(rows)])]) if rows else passed

        done = written(windows.groupBy("bucket").cogroup(self.manifest().groupBy("bucket")).applyInArrow(merge, PACKED), "substring-batch")
        release(self.spark)
        if keep:
            self._added(folder, done)
            self.compact()
        return done.where(f"kind = {REMOVED}")

    def compact(self) -> None:
        """Merges the two newest runs while they are of like size: there are few runs, and an entry is rewritten seldom."""
        while len(self.runs) > 1 and self.runs[-1][2] * 4 >= self.runs[-2][2] * 3:
            folder, two = self._new(), self.runs[-2:]

            done = written(self.manifest(two).groupBy("bucket").applyInArrow(_merged_into(folder), PACKED), "substring-compaction")
            self.runs = self.runs[:-2]
            self._added(folder, done)
            self.stale += [old for old, _, _ in two]

    def drop(self) -> None:
        for folder in [*(f for f, _, _ in self.runs), *self.stale]:
            remove(self.spark, folder)
        self.runs, self.stale = [], []


def _merged_into(folder: str):
    def merge(key, t):
        parts = list(_opened(t.column("path").to_pylist()))
        h, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(h, kind="stable")
        return pa.Table.from_batches([_batch_of([_file(folder, key[0].as_py(), h[order], c[order])])])

    return merge


def _opened(paths: list[str]):
    from pyarrow import fs

    for path in paths:
        system, place = fs.FileSystem.from_uri(path)
        with system.open_input_stream(place, compression=None) as f:
            yield _decoded(f.read())


def _file(folder: str, bucket: int, h: np.ndarray, c: np.ndarray) -> tuple:
    """Writes a range's file and returns its manifest row: the path among `starts`, the number of entries in `sizes`."""
    from pyarrow import fs

    path = f"{folder}/range-{bucket:08d}-{uuid.uuid4().hex}.zst"
    system, place = fs.FileSystem.from_uri(path)
    system.create_dir(os.path.dirname(place), recursive=True)
    with system.open_output_stream(place, compression=None) as f:
        f.write(_coded(h, c))
    return (RUN, bucket, None, len(h).to_bytes(8, "big"), path.encode(), None, None)


def _odd_prime(n: int) -> int:
    n |= 1
    while any(n % k == 0 for k in range(3, int(n**0.5) + 1, 2)):
        n += 2
    return n


def deduplicated(docs: DataFrame, s: Settings = Settings(), text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept words as `kept`, if text).

    A word goes if a window of s.window words covers it whose words also start at a smaller (doc_id, start). Texts
    shorter than a window, empty and null ones lose nothing. A null doc_id counts as the smallest; rows that repeat a
    doc_id are one document, and what is removed at a start in one of them is removed there in all.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, groups = max(48, size // s.range_bytes), _odd_prime(max(47, size // s.group_bytes))
    cuts = docs.select(F.percentile_approx("doc_id", [k / s.batches for k in range(1, s.batches)], 10000)).first()[0] or []
    cuts = sorted(set(cuts))
    folder = shared_path(spark, "fingerprints")
    index, removed = FingerprintIndex(spark, folder), []
    for k in range(len(cuts) + 1):
        batch = docs
        if k:
            batch = batch.where(F.col("doc_id") > cuts[k - 1])
        if k < len(cuts):
            batch = batch.where((F.col("doc_id") <= cuts[k]) | (F.col("doc_id").isNull() if k == 0 else F.lit(False)))
        removed.append(index.absorb(fingerprints(batch, buckets, groups, s), groups, keep=k < len(cuts)))
        index.forget()
    index.drop()
    gone = removed[0]
    for r in removed[1:]:
        gone = gone.unionByName(r)
    return _rewritten(docs, gone.select("bucket", "docs", "sizes", "starts"), groups, s, text)


def extended(docs: DataFrame, folder: str, s: Settings = Settings(), buckets: int = 4096, text: bool = False) -> DataFrame:
    """`deduplicated` of one new batch against all batches that the index in a shared folder has taken, which it then joins.

    A word goes if a window that covers it also starts in an earlier batch, or earlier in this one. buckets: hash ranges
    of a new index; an index keeps its own. A batch that fails before its state is saved has changed nothing. An empty
    batch, null ids and texts are as in `deduplicated`.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index, known = FingerprintIndex.opened(spark, folder)
    buckets = known or buckets
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = _odd_prime(max(47, size // s.group_bytes))
    gone = index.absorb(fingerprints(docs, buckets, groups, s), groups)
    index.save(buckets)
    return _rewritten(docs, gone.select("bucket", "docs", "sizes", "starts"), groups, s, text)


def _rewritten(docs: DataFrame, gone: DataFrame, groups: int, s: Settings, text: bool) -> DataFrame:
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * text

    def rewrite(key, texts, cut):
        doc, start = _unpacked(cut)
        order = np.argsort(doc, kind="stable")
        doc, start = doc[order], start[order]
        rows = []
        for batch in texts.to_batches():
            for d, t in zip(batch.column("doc_id").to_pylist(), expanded(batch.column("z"))):
                words = t.split()
                n, own = len(words), FIRST if d is None else d
                i, j = np.searchsorted(doc, own), np.searchsorted(doc, own, "right")
                if i < j:
                    at = np.unique(start[i:j])
                    at = at[at + s.window <= n]
                    cover = np.zeros(n + 1, np.int64)
                    cover[at] += 1
                    np.add.at(cover, at + s.window, -1)
                    words = list(compress(words, np.cumsum(cover[:-1]) == 0))
                kept = b" ".join(words)
                rows.append((d, n, n - len(words), hashlib.sha256(kept).hexdigest(), *([kept.decode()] if text else [])))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(4 + text)], [x.split()[0] for x in schema.split(", ")])

    at = F.coalesce(F.pmod(F.col("doc_id"), F.lit(groups)), F.lit(0)).cast("int")
    return squeezed(docs).withColumn("bucket", at).groupBy("bucket").cogroup(gone.groupBy("bucket")).applyInArrow(rewrite, schema)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document: see `deduplicated`."""
    return deduplicated(table(spark, sf_dir, "documents"))


_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(w[s + 1 : s + 20], ' ')) AS k
        FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 19, 0))) AS s FROM d)),
f AS (SELECT k, min(doc_id * 10000000 + s) AS first FROM win GROUP BY k),
cov AS (SELECT DISTINCT doc_id, p FROM (
        SELECT win.doc_id, unnest(range(win.s, win.s + 20)) AS p FROM win JOIN f USING (k) WHERE win.doc_id * 10000000 + win.s <> f.first)),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) AS t, count(*) AS n
         FROM each e LEFT JOIN cov c ON e.doc_id = c.doc_id AND e.p = c.p WHERE c.p IS NULL GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""
