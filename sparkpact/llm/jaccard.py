"""N-gram Jaccard join: token-combination prefixes.

A document's tokens are its distinct word shingles, in one global order: first all that aren't frequent, then the
frequent class (a bounded list of the most frequent), each by hash. Two sets with Jaccard similarity >= t share all but
e = n - ceil(t * n) tokens of either, so prefixes of each must meet. A prefix extends until removing any e tokens still
leaves a match: each rare token counts one and is indexed alone; frequent tokens fall into small hash classes, of which
each counts one less than its tokens and is indexed by pairs within the class. Tokens that many documents share are
thus indexed only in combination, and only by documents that have little else.

Frequent are tokens that many nodes of one chunk have, and those that the index itself finds with many nodes: their
documents' prefixes are extended and indexed anew.

Documents with equal sets are one node. The groups of signatures that have the same least node form a family. Within it,
sketches (bit vectors that differ in no more bits than the sets in tokens) rule pairs out before any text is moved. Of the
pairs left, first only those are verified by their texts that would join the family, nearest first; then all that still
lie across components. Every pair that shares a signature is thereby ruled out, verified or known to be connected, and the
pairs that leave a task are about as many as its nodes, also where thousands of near copies meet.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .shared import Written, expanded, release, squeezed, table, tasks, written
from .words import _MASK, U64, WordHasher, mix, rolled, texts_of, window_starts


@dataclass(frozen=True)
class Settings:
    words: int = 5
    #: Similarity of at least percent / 100.
    percent: int = 80
    #: Most tokens of the frequent class.
    frequent: int = 1 << 17
    chunk_bytes: int = 4 << 20
    range_bytes: int = 16 << 20
    #: Nodes that a single token may have before it counts as frequent.
    crowd: int = 512
    #: Members of a group that are compared in one piece.
    block: int = 2048


def spare(n, percent: int):
    """How many of n tokens a partner may lack."""
    return n - (percent * n + 99) // 100


def level(n: int, percent: int) -> int:
    """log2 of the number of classes that frequent tokens of a set of n fall into: about four to a class in a prefix."""
    need = (percent * n + 99) // 100
    return max(1, min((spare(n, percent) + 1) // 2, need - 1)).bit_length() - 1


def token_sets(texts: list[bytes | None], hasher: WordHasher, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The distinct tokens of each text, by text and hash, and where each text's begin. A text of fewer words is one token."""
    h, offsets = hasher.batch(texts)
    at, counts = window_starts(offsets, s.words)
    token = rolled(h, s.words)[at] if len(at) else np.empty(0, U64)
    doc = np.repeat(np.arange(len(texts)), counts)
    n = np.diff(offsets)
    short = np.flatnonzero((n > 0) & (n < s.words))
    if len(short):
        alone = np.array([rolled(h[offsets[k] : offsets[k + 1]], int(n[k]))[0] for k in short], U64) ^ mix(n[short].astype(U64))
        token, doc = np.concatenate([token, alone]), np.concatenate([doc, short])
    order = np.lexsort((token, doc))
    token, doc = token[order], doc[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
    token, doc = token[new], doc[new]
    return token, np.searchsorted(doc, np.arange(len(texts) + 1))


def node_ids(token: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each token set; that of an empty set is 0."""
    sums = np.concatenate([[U64(0)], np.cumsum(mix(token ^ U64(0x5851F42D4C957F2D)), dtype=U64)])
    out = sums[offsets[1:]] - sums[offsets[:-1]]
    n = np.diff(offsets)
    return np.where(n > 0, mix(out + n.astype(U64)), U64(0)).view(np.int64)


def signatures(token: np.ndarray, is_frequent: np.ndarray, s: Settings) -> np.ndarray:
    """Of one set, in hash order: its prefix's rare tokens (odd), and pairs of frequent ones within their classes (even)."""
    n = len(token)
    e = int(spare(n, s.percent))
    rare = token[~is_frequent][: e + 1]
    alone = rare | U64(1)
    if len(rare) > e or n == 1:
        return np.unique(alone)
    common = token[is_frequent]
    need, out = e + 1 - len(rare), [alone]
    low, high = -(-s.percent * n // 100), n * 100 // s.percent
    for bits in sorted({level(m, s.percent) for m in range(low, high + 1)} if high - low < 64 else {level(m, s.percent) for m in (*range(low, high + 1, max(1, (high - low) // 64)), high)}):
        kind = (mix(common) >> U64(32)).astype(np.int64) & ((1 << bits) - 1)
        order = np.argsort(kind, kind="stable")
        first = np.ones(n, bool)[: len(common)]
        first[order[1:]] = kind[order[1:]] != kind[order[:-1]]
        gain = np.cumsum(~first)  # each token after the first of its class counts one
        size = int(np.searchsorted(gain, need)) + 1
        own, of = common[:size], kind[:size]
        order = np.argsort(of, kind="stable")
        own, of = own[order], of[order]
        for gap in range(1, len(own)):
            same = of[gap:] == of[:-gap]
            if not same.any():
                break
            a, b = own[:-gap][same], own[gap:][same]
            out.append(mix(np.minimum(a, b) * U64(0x9E3779B97F4A7C15) + np.maximum(a, b) + U64(bits)) & U64(_MASK - 1))
    return np.unique(np.concatenate(out))


def _chunks(batches, s: Settings):
    """(doc ids, texts) of about s.chunk_bytes."""
    ids, texts, size = [], [], 0
    for b in batches:
        for d, t in zip(b.column("doc_id").to_pylist(), texts_of(b.column("text"))):
            ids.append(d)
            texts.append(t)
            size += len(t or b"")
            if size >= s.chunk_bytes:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


DOCUMENT, OFTEN = 0, 1


def facts(docs: DataFrame, s: Settings) -> DataFrame:
    """kind, a, b, c: each document's (doc_id, n_shingles, node), and (token, count) of tokens that many of a chunk's nodes have."""

    def run(batches):
        hasher = WordHasher(fold=True)
        for ids, texts in _chunks(batches, s):
            token, offsets = token_sets(texts, hasher, s)
            node, n = node_ids(token, offsets), np.diff(offsets)
            _, one = np.unique(node, return_index=True)
            chosen = np.zeros(len(ids), bool)
            chosen[one] = True
            often, times = np.unique(token[np.repeat(chosen, n)], return_counts=True)
            many = times >= max(3, len(one) // 500)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([DOCUMENT, OFTEN], [len(ids), int(many.sum())]).astype(np.int32)),
                    pa.concat_arrays([pa.array(ids, pa.int64()), pa.array(often[many].view(np.int64))]),
                    pa.array(np.concatenate([n, times[many]]).astype(np.int64)),
                    pa.array(np.concatenate([node, np.zeros(int(many.sum()), np.int64)])),
                ],
                ["kind", "a", "b", "c"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "kind int, a long, b long, c long")


PACKED = "bucket int, nodes binary, sizes binary, at binary, h binary"
#: Signatures that one task keeps before it deals them out (32 a range at least), and most hash ranges.
_HELD, _RANGES = 1 << 19, 1 << 16


def indexed(docs: DataFrame, frequent: np.ndarray, buckets: int, s: Settings) -> DataFrame:
    """The signatures of every chunk's nodes, packed by hash range. Those of single tokens are odd, of combinations even."""
    known = docs.sparkSession.sparkContext.broadcast(np.sort(frequent >> U64(1)))  # at most s.frequent hashes

    def rows(held):
        h, node, n = (np.concatenate(c) for c in zip(*held))
        bucket = ((h >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        h, node, n, bucket = h[order], node[order], n[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets))
        out = []
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own, first, at = np.unique(node[i:j], return_index=True, return_inverse=True)
            out.append((int(bucket[i]), own.tobytes(), n[i:j][first].tobytes(), at.astype(np.uint16 if len(own) < 1 << 16 else np.uint32).tobytes(), h[i:j].tobytes()))
        kinds = [pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], [x.split()[0] for x in PACKED.split(", ")])

    def run(batches):
        hasher, often, held, size = WordHasher(fold=True), known.value, [], 0
        table_ = np.zeros(1 << 22, bool)
        table_[often >> U64(41)] = True
        for ids, texts in _chunks(batches, s):
            token, offsets = token_sets(texts, hasher, s)
            node, n = node_ids(token, offsets), np.diff(offsets)
            common = table_[token >> U64(42)]
            maybe = np.flatnonzero(common)
            if len(maybe):
                k = np.minimum(np.searchsorted(often, token[maybe] >> U64(1)), len(often) - 1)
                common[maybe] = often[k] == token[maybe] >> U64(1)
            _, one = np.unique(node, return_index=True)
            one = one[n[one] > 0]
            found = [signatures(token[offsets[k] : offsets[k + 1]], common[offsets[k] : offsets[k + 1]], s) for k in one]
            if found:
                counts = [len(x) for x in found]
                held.append((np.concatenate(found), np.repeat(node[one], counts), np.repeat(n[one].astype(np.int64), counts)))
                size += sum(counts)
            if size >= max(_HELD, 32 * buckets):
                yield rows(held)
                held, size = [], 0
        if size:
            yield rows(held)

    return docs.select("doc_id", "text").mapInArrow(run, PACKED)


FOUND = "kind int, g long, node long, n long"
MEMBER, CROWD = 0, 1


def shared_signatures(packed: DataFrame, s: Settings) -> DataFrame:
    """Of signatures that two nodes or more of similar size have: the members (node and its size n), by the group's least node g.

    Groups that begin with the same node are one family: what many signatures hold together is compared once. Rows of
    kind CROWD are single tokens g that n > s.crowd nodes have.
    """

    def meet(key, t):
        h, node, size = [], [], []
        for nodes, sizes, at, hs in zip(*(t.column(c).to_pylist() for c in ("nodes", "sizes", "at", "h"))):
            nodes, sizes, hs = np.frombuffer(nodes, np.int64), np.frombuffer(sizes, np.int64), np.frombuffer(hs, U64)
            at = np.frombuffer(at, np.uint16 if len(at) == 2 * len(hs) else np.uint32)
            h.append(hs)
            node.append(nodes[at])
            size.append(sizes[at])
        h, node, size = np.concatenate(h), np.concatenate(node), np.concatenate(size)
        order = np.lexsort((node, size, h))
        h, node, size = h[order], node[order], size[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
        h, node, size = h[new], node[new], size[new]
        near = np.zeros(len(h), bool)  # of similar size as the next one of the group
        near[:-1] = (h[1:] == h[:-1]) & (100 * size[:-1] >= s.percent * size[1:])
        near[1:] |= near[:-1].copy()
        h, node, size = h[near], node[near], size[near]
        begin = np.flatnonzero(np.diff(h, prepend=h[:1] ^ U64(1)) != 0)
        counts = np.diff(np.append(begin, len(h)))
        crowds = (counts > s.crowd) & (h[begin] & U64(1) == 1)
        family = np.repeat(np.minimum.reduceat(node, begin), counts) if len(begin) else node
        order = np.lexsort((node, family))
        family, node, size = family[order], node[order], size[order]
        new = np.ones(len(node), bool)
        new[1:] = (family[1:] != family[:-1]) | (node[1:] != node[:-1])
        columns = [
            np.repeat([MEMBER, CROWD], [int(new.sum()), int(crowds.sum())]).astype(np.int32),
            np.concatenate([family[new], h[begin][crowds].view(np.int64)]),
            np.concatenate([node[new], np.zeros(int(crowds.sum()), np.int64)]),
            np.concatenate([size[new], counts[crowds]]),
        ]
        return pa.Table.from_arrays([pa.array(x) for x in columns], [x.split()[0] for x in FOUND.split(", ")])

    return packed.groupBy("bucket").applyInArrow(meet, FOUND)


def sketch_bits(n):
    """Bits of the sketch of a set of n: a power of two of at least three a token."""
    return 1 << max(6, int(3 * n - 1).bit_length())


def sketches(token: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Of each token set a bit vector in which each token flips one bit. Sketches differ in no more bits than sets in tokens."""
    out, place = [], mix(token ^ U64(0x2545F4914F6CDD1D))
    for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
        bits = sketch_bits(j - i)
        flips = np.bincount((place[i:j] & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(flips.astype(np.uint8), bitorder="little").tobytes())
    return out


def described(docs: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """node, sketch and z (one squeezed text) of the wanted nodes, whatever the doc_ids of their rows are."""

    def run(batches):
        import zstandard

        hasher, z = WordHasher(fold=True), zstandard.ZstdCompressor(level=1)
        for _, texts in _chunks(batches, s):
            token, at = token_sets(texts, hasher, s)
            node, some = node_ids(token, at), np.flatnonzero(np.diff(at))
            k = some[np.unique(node[some], return_index=True)[1]]
            yield pa.RecordBatch.from_arrays([pa.array(node[k]), pa.array([z.compress(texts[i]) for i in k.tolist()], pa.binary())], ["node", "z"])

    def sketch(batches):
        hasher = WordHasher(fold=True)
        for b in batches:
            for i in range(0, b.num_rows, _SLICE):
                part = b.slice(i, _SLICE)
                token, at = token_sets(expanded(part.column("z")), hasher, s)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sketches(token, at), pa.binary()), part.column("z")], ["node", "sketch", "z"])

    by_node = docs.select("doc_id", "text").mapInArrow(run, "node long, z binary").groupBy("node").agg(F.min("z").alias("z"))
    return by_node.join(wanted, "node").select("node", "z").mapInArrow(sketch, "node long, sketch binary, z binary")


_SLICE = 200
#: Words of sketches compared at a time.
_SLAB = 1 << 20


class Sketches:
    """The sketches of some nodes as word matrices by width, each also folded once for pairs of unequal width."""

    def __init__(self, raw: list[bytes]):
        self.width = np.array([len(x) for x in raw], np.int64)
        self.row, self.plain, self.folded = np.zeros(len(raw), np.int64), {}, {}
        for w in np.unique(self.width).tolist():
            k = np.flatnonzero(self.width == w)
            self.row[k] = np.arange(len(k))
            self.plain[w] = np.frombuffer(b"".join(raw[i] for i in k.tolist()), U64).reshape(len(k), w // 8)
            if w > 8:
                half = w // 16
                self.folded[w] = self.plain[w][:, :half] ^ self.plain[w][:, half:]

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """In how many bits the sketches of x and y differ; those more than one width apart: in none."""
        out, u, v = np.zeros(len(x), np.int64), self.width[x], self.width[y]
        kinds, which = np.unique(np.stack([u, v], 1), axis=0, return_inverse=True)
        for i, (p, q) in enumerate(kinds.tolist()):
            if max(p, q) > 2 * min(p, q):
                continue
            k, low = np.flatnonzero(which.ravel() == i), min(p, q)
            a, b = (self.plain[w] if w == low else self.folded[w] for w in (p, q))
            step = max(1, _SLAB // (low // 8))
            for j in range(0, len(k), step):
                own = k[j : j + step]
                out[own] = np.bitwise_count(a[self.row[x[own]]] ^ b[self.row[y[own]]]).sum(1, dtype=np.int64)
        return out


def _pairs(g: np.ndarray, sizes: np.ndarray, percent: int):
    """Index pairs of similar size within groups, of rows ordered by group and size, some hundred thousand at a time."""
    group = np.cumsum(np.diff(g, prepend=g[:1]) != 0) << 40
    last = np.searchsorted(group + sizes, group + sizes * 100 // percent, side="right")
    begin, count = np.arange(len(sizes)) + 1, np.maximum(last - np.arange(len(sizes)) - 1, 0)
    ends, i, done = np.cumsum(count), 0, 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, done + (1 << 18), side="right")))
        x = np.repeat(np.arange(i, j), count[i:j])
        if len(x):
            yield x, np.arange(len(x)) + np.repeat(begin[i:j] - (ends[i:j] - count[i:j] - done), count[i:j])
        i, done = j, int(ends[j - 1])


def _spanning(x: np.ndarray, y: np.ndarray, far: np.ndarray, n: int) -> np.ndarray:
    """Of candidate links of n nodes, those of a spanning forest, nearest first: each part's nearest link, until none is left."""
    order = np.argsort(far, kind="stable")
    x, y, left, label, out = x[order], y[order], order, np.arange(n), []
    while True:
        u, v = label[x], label[y]
        apart = u != v
        if not apart.any():
            return np.concatenate(out) if out else left[:0]
        x, y, left, u, v = x[apart], y[apart], left[apart], u[apart], v[apart]
        nearest = np.full(n, len(u))
        for end in (u, v):
            mine = np.full(n, len(u))
            mine[end[::-1]] = np.arange(len(u))[::-1]
            nearest = np.minimum(nearest, mine)
        chosen = np.unique(nearest[nearest < len(u)])
        out.append(left[chosen])
        parent = list(range(n))
        for a, b in zip(u[chosen].tolist(), v[chosen].tolist()):
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            while parent[b] != b:
                parent[b] = b = parent[parent[b]]
            parent[max(a, b)] = min(a, b)
        root = np.array(parent)
        while (root[root] != root).any():
            root = root[root]
        label = root[label]


def _groups(batches, least: int = 4096):
    """Whole groups of an ordered partition, some thousand rows at a time."""
    held, rows = [], 0
    for b in batches:
        g = b.column("g").to_numpy()
        ends = np.flatnonzero(g[1:] != g[:-1]) + 1
        if held and b.num_rows and held[-1].column("g")[-1].as_py() != int(g[0]):
            ends = np.concatenate([[0], ends])
        i = 0
        for j in ends.tolist():
            if rows + j - i >= least:
                yield pa.Table.from_batches([*held, b.slice(i, j - i)])
                held, rows, i = [], 0, j
        if i < b.num_rows:
            held.append(b.slice(i))
            rows += b.num_rows - i
    if held:
        yield pa.Table.from_batches(held)


def candidates(members: DataFrame, s: Settings, spanning: bool) -> DataFrame:
    """Pairs (a, b) of nodes that share a family, lie in different components and may be similar by size and sketch.

    members: g, node, n, c (how many the family has), component and sketch. The sketches' distance is at most the sets'
    symmetric difference, so no similar pair is lost. spanning: only as many, nearest first, as would join all that the
    pairs can join. A family of more than s.block members goes by pairs of blocks, each of them a group.
    """
    p = s.percent
    blocks = F.ceil(F.col("c") / s.block).cast("int")
    side = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = members.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    name = F.when(F.col("c") > s.block, F.xxhash64("g", F.least("side", "other"), F.greatest("side", "other"))).otherwise(F.col("g"))
    dealt = dealt.select(name.alias("g"), "side", (F.col("side") != F.col("other")).alias("cross"), "node", "n", "component", "sketch")
    # by range: families of any size spread evenly, and a task holds one at a time
    dealt = dealt.repartitionByRange(tasks(members), "g").sortWithinPartitions("g", "n", "node")

    def run(batches):
        for t in _groups(batches):
            g, side, node, n, part = (t.column(c).to_numpy() for c in ("g", "side", "node", "n", "component"))
            cross = t.column("cross").to_numpy()
            _, one, own = np.unique(node, return_index=True, return_inverse=True)
            sketch = Sketches(t.column("sketch").take(pa.array(one)).to_pylist())
            label, at = np.unique(part, return_inverse=True)
            found = []
            for x, y in _pairs(g, n, p):
                ok = (at[x] != at[y]) & (~cross[x] | (side[x] != side[y]))  # each of two blocks alone is a group of its own
                x, y = x[ok], y[ok]
                far, most = sketch.apart(own[x], own[y]), (100 - p) * (n[x] + n[y])
                near = (100 + p) * far <= most
                x, y, far = x[near], y[near], far[near] / most[near]
                if spanning and len(x):
                    k = _spanning(at[x], at[y], far, len(label))
                    x, y, far = x[k], y[k], far[k]
                found.append((x, y, far))
            if not found:
                continue
            x, y, far = (np.concatenate(c) for c in zip(*found))
            if spanning:
                k = _spanning(at[x], at[y], far, len(label))
                x, y = x[k], y[k]
            pairs = np.unique(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])], 1), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough, by their whole texts."""
    x, y = nodes.select(F.col("node").alias("a"), F.col("z").alias("x")), nodes.select(F.col("node").alias("b"), F.col("z").alias("y"))

    def run(batches):
        hasher = WordHasher(fold=True)
        for whole in batches:
            for i in range(0, whole.num_rows, _SLICE):
                b = whole.slice(i, _SLICE)
                (u, p), (v, q) = (token_sets(expanded(b.column(c)), hasher, s) for c in ("x", "y"))
                keep = []
                for k in range(b.num_rows):
                    c, d = u[p[k] : p[k + 1]], v[q[k] : q[k + 1]]
                    both = len(np.intersect1d(c, d, assume_unique=True))
                    keep.append(100 * both >= s.percent * (len(c) + len(d) - both) and both > 0)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b").join(x, "a").join(y, "b").mapInArrow(run, "a long, b long")


def signed(docs: DataFrame, often: DataFrame, s: Settings) -> DataFrame:
    """Families of nodes that share signatures: g, node, n, written. often: (a, n), tokens known to be frequent and in how many nodes.

    Where single tokens turn out to have more than s.crowd nodes, they join the frequent class, prefixes are extended
    and all is indexed anew, until no such token is left or the class is full; what is then left of large groups is
    compared in blocks.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(_RANGES, max(24, size // s.range_bytes))
    counts = {r.a: r.n for r in often.orderBy(F.desc("n"), "a").limit(s.frequent).collect()}  # at most s.frequent
    while True:
        found = Written(shared_signatures(indexed(docs, np.array(list(counts), np.int64).view(U64), buckets, s), s), "signatures")
        new = found.df.where(f"kind = {CROWD}").orderBy(F.desc("n"), "g").limit(max(0, s.frequent - len(counts))).collect()  # at most s.frequent
        if not new:
            members = written(found.df.where(f"kind = {MEMBER}").select("g", "node", "n").distinct(), "members")
            found.drop()
            return members
        counts |= {r.g: r.n for r in new}
        found.drop()


def grouped(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles and component_id, one row per row of docs.

    A null or empty text has no shingles and links with nothing: its component is its own doc_id. A null doc_id takes
    part, but is never a component's name unless it is all there is. Rows that repeat a doc_id are links of their own.
    An empty table gives an empty table; other columns of docs are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = Written(facts(docs, s), "shingle-facts")
    rows = known.df.where(f"kind = {DOCUMENT}").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), F.col("c").alias("node"))
    members = signed(docs, known.df.where(f"kind = {OFTEN}").groupBy("a").agg(F.sum("b").alias("n")), s)
    release(spark)
    nodes = Written(described(docs, members.select("node").distinct(), s), "nodes")
    release(spark)
    members = members.join(members.groupBy("g").agg(F.count("*").alias("c")), "g")
    sketched = members.join(nodes.df.select("node", "sketch"), "node")
    first = Written(candidates(sketched.withColumn("component", F.col("node")), s, spanning=True), "candidates")
    release(spark)
    links = Written(verified(first.df, nodes.df, s), "links")
    known_components = components(links.df)
    labels = F.coalesce("component", "node").alias("component")
    placed = Written(members.join(known_components, "node", "left").select("g", "node", "n", "c", labels), "placed")
    mixed = placed.df.groupBy("g").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("g")
    open_ = placed.df.join(mixed, "g").join(nodes.df.select("node", "sketch"), "node")
    rest = Written(candidates(open_, s, spanning=False).join(first.df, ["a", "b"], "left_anti"), "candidates")
    release(spark)
    more = Written(verified(rest.df, nodes.df, s), "links")
    final = known_components if more.df.isEmpty() else components(links.df.unionAll(more.df))
    for t in (placed, first, rest, nodes):
        t.drop()
    release(spark)
    named = rows.join(final, "node", "left").select("doc_id", "n_shingles", "node", F.coalesce("component", "node").alias("component"))
    named = written(named, "named")
    known.drop()
    names = written(named.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("component_id")), "names")
    alone = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return named.join(names, "component", "left").select("doc_id", "n_shingles", alone.alias("component_id"))


def representatives(docs: DataFrame, keep: tuple[str, ...], s: Settings = Settings()) -> DataFrame:
    """Columns `keep`, doc_id and text among them, of one document of each component: that with its smallest doc_id.

    Documents without shingles or text all stay, and so do rows without doc_id, which nothing could name.
    """
    docs = docs.select(*keep)
    found = grouped(docs, s).where("doc_id = component_id").select("doc_id", (F.col("n_shingles") > 0).alias("_linked")).distinct()
    moved = squeezed(docs.where("doc_id is not null and text is not null")).join(found, "doc_id")
    rest = [c for c in keep if c not in ("doc_id", "text")]
    # a doc_id that rows repeat: of those with shingles one stays, within the join's own partitions
    order = Window.partitionBy("doc_id").orderBy(*rest, "z")
    one = moved.withColumn("_n", F.row_number().over(order)).where("_n = 1 or not _linked").select(*rest, "doc_id", "z")

    def run(batches):
        for b in batches:
            text = pa.array(expanded(b.column("z")), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([text if c == "text" else b.column(c) for c in keep], list(keep))

    return one.mapInArrow(run, docs.schema).unionByName(docs.where("doc_id is null or text is null"))


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every document: see `grouped`."""
    return grouped(table(spark, sf_dir, "documents"))


_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
OP6_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(w[s + 1 : s + 5], ' ')) AS k
       FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
often AS (SELECT k FROM sh GROUP BY k HAVING count(*) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN often USING (k) JOIN sh b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * p.c >= 80 * (x.n + y.n - p.c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT r.a AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON r.a = n.doc_id GROUP BY r.a
"""
