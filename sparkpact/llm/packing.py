"""Packing: documents as token ids into sequences of at most `size` tokens, without padding.

1. Each document is tokenised once, into a table in the shared folder.
2. Whole windows are cut off the front of long documents. The lengths that remain, 1 to size - 1, give a histogram
   over all documents (at most size - 1 counts).
3. Length combinations of depth two and three that fill a window exactly are enumerated, and non-negative least
   squares solves how often to use each, against the histogram. This plan is small and goes to all tasks.
4. Each task packs its own documents in blocks: by the plan's rounded counts, then the residue greedily, where
   documents may be cut. A block's last tokens form sequences of power-of-two lengths, which need no padding.

There is no shuffle but that of the histogram's counts.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable
from itertools import compress, filterfalse
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table, written
from .words import SPACES, texts_of

TOKENIZER = "word_bpe_49k.json"
SIZE = 2048
END = 1
#: Tokens that a task packs at a time.
BLOCK = 1 << 22
_PEEL = b".,;:!?$%*#&|)"
_PART = 6 << 20


class WordIds(dict):
    """The ids of words, as little-endian uint32 bytes, by a tokenizer that never joins across white space.

    A final run of common punctuation after a letter is a token sequence of its own and letters are lower-cased by
    the tokenizer, so words share work beyond case and punctuation. Unknown words of letters alone are encoded many at
    a time: each is one piece of text to the tokenizer, and only its last token is a word's end. Beyond about `most`
    bytes, words not met again lately are forgotten; long ones are, whenever others are learnt.
    """

    def __init__(self, path: str, most: int = 24 << 20, suffix: str = "</w>"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer, self.most, self.older, self.held, self.long = Tokenizer.from_file(path), most, {}, 0, []
        self.bare = Tokenizer.from_file(path)  # for letters alone, in lower case: nothing to normalise, nor to match
        self.bare.normalizer = None
        self.bare.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for w, k in vocabulary.items() if w.endswith(suffix)]] = True

    def encode(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def encode_letters(self, words: list[str], at_once: int = 250) -> list[bytes]:
        """Ids of words that consist of letters, as `_letters` gives them."""
        out, parts = [], [words[i : i + at_once] for i in range(0, len(words), at_once)]
        for part, e in zip(parts, self.bare.encode_batch_fast(list(map("\n".join, parts)), add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cuts, raw = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist(), ids.tobytes()
            out += [raw[i:j] for i, j in zip([0, *cuts], cuts)] if len(cuts) == len(part) else self.encode(part)
        return out

    def learn(self, words: Iterable[bytes]) -> None:
        """Makes the ids of all words, each given once, known. What can be done for all words at once isn't done word by word."""
        for w in self.long:
            del self[w]
        self.long = []
        if self.held > self.most:
            self.older, self.held = dict(self), 0
            self.clear()
        missing = list(filterfalse(self.__contains__, words))
        lately = {w: self.older[w] for w in missing if w in self.older}
        self.update(lately)
        new = [w for w in missing if w not in lately] if lately else missing
        self.held += _ENTRY * len(missing)
        if not new:
            return
        if len(max(new, key=len)) > _LONG:
            self.long = [w for w in new if len(w) > _LONG]
        plain = list(map(bytes.isalpha, new))  # ASCII letters alone
        some = list(compress(new, plain))
        if some:
            self.update(zip(some, self.encode_letters(b"\n".join(some).lower().decode().split("\n"))))
        if len(some) < len(new):
            self.learn_others([w for w, a in zip(new, plain) if not a])

    def learn_others(self, new: list[bytes]) -> None:
        """Of words that aren't ASCII letters alone: those that end in punctuation share the ids of what is before it."""
        bare = [w.rstrip(_PEEL) for w in new]
        texts = list(map(_letters, b"\n".join(bare).decode().split("\n")))
        plain = list(dict.fromkeys(filter(None, texts)))
        found = dict(zip(plain, self.encode_letters(plain), strict=True))
        ends = list({w[len(x) :] for w, x, t in zip(new, bare, texts) if t and len(w) > len(x)})
        after = {b"": b""} | dict(zip(ends, self.encode([e.decode() for e in ends])))
        self.update({w: found[t] + after[w[len(x) :]] for w, x, t in zip(new, bare, texts) if t})
        rest = [w for w, t in zip(new, texts) if not t]
        self.update(zip(rest, self.encode([w.decode() for w in rest])))


#: About what a short word and its ids take in a dictionary, in bytes, and from which length on a word isn't kept.
_ENTRY, _LONG = 200, 64


def _letters(t: str) -> str:
    """A word as the tokenizer's normaliser leaves it, if that is letters alone; else nothing (U+0130 becomes two characters)."""
    if not t.isascii():
        t = normalize("NFC", t)
        if "\u03a3" in t:  # lower case would look at what is around it
            return ""
    t = t.lower()
    return t if t.isalpha() else ""


#: One of the marks that most often end a word, straight after an ASCII letter or digit or a Latin-1 letter: a piece of its own.
_MARK = re.compile(rb"([.,;:!?])(?:(?<=[a-z0-9].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))(?=[ \t\n])")


_SPACE = np.isin(np.arange(256), list(SPACES))


def prepared(text: bytes | None) -> bytes:
    """A text in lower case as far as ASCII goes, and with a space before many a final mark: its ids are the same.

    The tokenizer composes before it lowers, and some letters compose with a mark (U+0300 to U+036F) in lower case only.
    """
    text = text or b""
    if b"\xcc" not in text and b"\xcd" not in text:
        text = text.lower()
    return _MARK.sub(rb" \1", text)


def ids_of(texts: list[bytes | None], words: WordIds, last: bytes) -> list[bytes]:
    """The ids of each text and then `last`. Only distinct words become Python objects; the rest is done by Arrow."""
    texts = list(map(prepared, texts))
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    gap = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).view(np.int8)))
    starts, sizes = edge[::2], edge[1::2] - edge[::2]
    if not len(starts):
        return [last] * len(texts)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    split = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~gap])]).dictionary_encode()
    distinct = split.dictionary.to_pylist()
    words.learn(distinct)
    found = pa.array(map(words.__getitem__, distinct), pa.large_binary()).take(split.indices)
    ends, raw = np.frombuffer(found.buffers()[1], np.int64), found.buffers()[2] or b""
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    at = ends[np.searchsorted(starts, begins)].tolist()
    return [bytes(raw[i:j]) + last for i, j in zip(at[:-1], at[1:])]


_loaded: dict[str, WordIds] = {}


def tokenised(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """doc_id, n and ids (little-endian uint32) of each document's text, with `end` after it. A null text is empty."""

    def run(batches):
        words = _loaded.get(path)
        if words is None:
            words = _loaded[path] = WordIds(path)
        last = np.array([end], "<u4").tobytes()
        for b in batches:
            texts, ids, i = texts_of(b.column("text")), [], 0
            while i < len(texts):  # a few MB at a time
                j, size = i, 0
                while j < len(texts) and size < _PART:
                    size += len(texts[j] or b"")
                    j += 1
                ids += ids_of(texts[i:j], words, last)
                i = j
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, ids binary")


def combinations(counts: np.ndarray, size: int, common: int = 48) -> list[tuple[int, ...]]:
    """Pairs and triples of lengths with a positive count that sum to `size`; triples have two of the `common` most frequent lengths."""
    have = counts > 0
    found = {(a, size - a) for a in range(1, size // 2 + 1) if have[a] and have[size - a]}
    top = sorted(np.argsort(-counts, kind="stable")[:common].tolist())
    for i, a in enumerate(top):
        for b in top[i:]:
            c = size - a - b
            if a > 0 and 0 < c < size and have[a] and have[b] and have[c]:
                found.add(tuple(sorted((a, b, c))))
    return sorted(found)


def solve(counts: np.ndarray, combos: list[tuple[int, ...]], sweeps: int = 60) -> np.ndarray:
    """Non-negative least squares by coordinate descent: repeat counts whose lengths' total is nearest the histogram."""
    left, x = counts.astype(float).copy(), np.zeros(len(combos))
    columns = [(np.unique(c, return_counts=True)) for c in combos]
    columns = [(idx, m, float((m * m).sum())) for idx, m in columns]
    for _ in range(sweeps):
        moved = 0.0
        for k, (idx, m, norm) in enumerate(columns):
            new = max(0.0, x[k] + float(left[idx] @ m) / norm)
            if step := new - x[k]:
                left[idx] -= step * m
                x[k] = new
                moved = max(moved, abs(step))
        if moved < 0.01:
            break
    return x


def plan(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], float]]:
    """The combinations to use with their repeat counts, as shares of the histogram's rarest length in each."""
    combos = combinations(counts, size)
    x = solve(counts, combos)
    return [(c, float(v)) for c, v in sorted(zip(combos, x), key=lambda p: (-p[1], p[0])) if v >= 0.5]


def pack(lengths: list[int], size: int, planned: list[tuple[tuple[int, ...], float]], share: float = 1.0) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document number, start, length) for one block.

    share: the block's part of the whole histogram, by which repeat counts are scaled and rounded.
    """
    out: list[list[tuple[int, int, int]]] = []
    rest: dict[int, list[int]] = defaultdict(list)
    begin = []
    for k, n in enumerate(lengths):
        full = n // size
        out += [[(k, i * size, size)] for i in range(full)]
        begin.append(full * size)
        if n % size:
            rest[n % size].append(k)
    for combo, times in planned:
        for _ in range(max(1, round(times * share))):
            need = {x: combo.count(x) for x in combo}
            if any(len(rest.get(x, ())) < m for x, m in need.items()):
                break
            out.append([(k, begin[k], x) for x in combo for k in [rest[x].pop()]])
    # the residue: the largest length that fits, else the next document is cut where the window ends
    order = sorted((x for x, ks in rest.items() if ks), reverse=True)
    row: list[tuple[int, int, int]] = []
    room = size
    waiting = [(x, k) for x in order for k in rest[x]]
    low, high = 0, len(waiting)
    while low < high:
        x, k = waiting[low]
        if x <= room:
            low += 1
        elif waiting[high - 1][0] <= room:
            high -= 1
            x, k = waiting[high]
        else:
            low += 1
        piece = min(x, room)
        row.append((k, begin[k], piece))
        room -= piece
        if not room:
            out.append(row)
            row, room = [], size
        if piece < x:
            row.append((k, begin[k] + piece, x - piece))
            room -= x - piece
    total = sum(p[2] for p in row)
    while total:  # powers of two need no padding
        part, want = [], 1 << (total.bit_length() - 1)
        total -= want
        while want:
            k, s, n = row[0]
            m = min(n, want)
            part.append((k, s, m))
            want -= m
            row = row[1:] if m == n else [(k, s + m, n - m), *row[1:]]
        out.append(part)
    return out


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, path: str, size: int = SIZE, end: int = END, block: int = BLOCK) -> DataFrame:
    """One row per piece. A null text gives the end token alone; each row of docs is a document of its own, also where ids repeat."""
    tokens = written(tokenised(docs, path, end), "tokens")
    counts = np.zeros(size, np.int64)
    for r in tokens.groupBy((F.col("n") % size).alias("r")).count().where("r > 0").collect():  # at most size - 1 rows
        counts[r.r] = r["count"]
    planned, whole = plan(counts, size), max(1, int(counts.sum()))

    def run(batches):
        first = TaskContext.get().partitionId() << 36
        ids, docs_, held = [], [], 0

        def flush():
            nonlocal first, ids, docs_, held
            lengths = [len(x) // 4 for x in ids]
            rows = []
            for seq in pack(lengths, size, planned, len(ids) / whole):
                at = 0
                for k, s, n in seq:
                    rows.append((docs_[k], s, n, zlib.crc32(ids[k][4 * s : 4 * (s + n)]), lengths[k], first, at))
                    at += n
                first += 1
            ids, docs_, held = [], [], 0
            names = PACKED.replace(" long", "").split(", ")
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

        for b in batches:
            for d, x in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
                ids.append(x)
                docs_.append(d)
                held += len(x) // 4
                if held >= block:
                    yield flush()
        if ids:
            yield flush()

    return tokens.select("doc_id", "ids").mapInArrow(run, PACKED)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document, by sequence: see `packed`."""
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), str(public_tokenizers.path(TOKENIZER)))
