"""Token counts: a linear longest-match automaton over a vocabulary trie.

Each trie node holds a failure link and the number of pieces that are popped on the way along it, so a word's greedy
(longest match first) piece count comes from one pass over its bytes, without going back and without building pieces.
"""

from __future__ import annotations

import base64
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import beside, kept_fields, outputs, table
from .words import texts_of

#: The vocabulary file, by its name in the folder of public tokenizers.
VOCABULARY = "byte_bpe_50k.tiktoken"


class Automaton:
    """Greedy piece counts of byte strings. Where no piece fits, a whole word counts as one unknown piece."""

    def __init__(self, vocabulary):
        children: list[dict[int, int]] = [{}]
        final = [False]
        for piece in vocabulary:
            node = 0
            for c in piece:
                nxt = children[node].get(c)
                if nxt is None:
                    nxt = children[node][c] = len(children)
                    children.append({})
                    final.append(False)
                node = nxt
            final[node] = bool(node)
        link, pops = [-1] * len(children), [0] * len(children)
        queue = deque([0])
        while queue:  # parents before children: a link leads to a shorter string
            u = queue.popleft()
            for c, v in children[u].items():
                queue.append(v)
                if final[v]:
                    link[v], pops[v] = 0, 1
                    continue
                z, n = link[u], pops[u]
                while z >= 0 and c not in children[z]:
                    n += pops[z]
                    z = link[z]
                if z >= 0:
                    link[v], pops[v] = children[z][c], n
        self.children, self.link, self.pops = children, link, pops

    def count(self, word: bytes) -> int:
        children, link, pops = self.children, self.link, self.pops
        node = total = 0
        for c in word:
            nxt = children[node].get(c)
            while nxt is None:
                total += pops[node]
                node = link[node]
                if node < 0:
                    return 1
                nxt = children[node].get(c)
            node = nxt
        while node:
            total += pops[node]
            node = link[node]
            if node < 0:
                return 1
        return total


class Counts(dict):
    """Piece counts of words, each preceded by `prefix`; forgets all beyond `most` words and keeps none of more than LONG bytes."""

    LONG = 64

    def __init__(self, automaton: Automaton, prefix: bytes, most: int = 400_000):
        self.automaton, self.prefix, self.most = automaton, prefix, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        n = self.automaton.count(self.prefix + word)
        if len(word) <= self.LONG:
            self[word] = n
        return n


def read_vocabulary(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


_loaded: dict[tuple[str, bytes], Counts] = {}


def token_counts(docs: DataFrame, path: str, prefix: bytes = b" ", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` with `n_words` and `n_tokens` of each whole text.

    Words are runs without space and \\x09-\\x0D; each is matched with `prefix` before it, as the vocabulary's pieces
    that begin words carry it. Null and empty texts have no words and no tokens; texts and words of any length are
    matched whole. Each row stands for itself: repeated rows and null ids come out as they are, an empty table gives an
    empty one, and a kept column called n_words or n_tokens comes out with `_input` after its name. `path` must be
    readable on every executor, like any installed package's file.
    """
    names = outputs(keep, ["n_words", "n_tokens"])

    def run(batches):
        counts = _loaded.get((path, prefix))  # a reused worker builds the automaton once
        if counts is None:
            counts = _loaded[path, prefix] = Counts(Automaton(read_vocabulary(path)), prefix)
        of = counts.__getitem__
        for b in batches:
            words = [(t or b"").split() for t in texts_of(b.column("_text"))]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(f"_k{i}") for i in range(len(keep))), pa.array([len(w) for w in words], pa.int64()), pa.array([sum(map(of, w)) for w in words], pa.int64())], [*names, "n_words", "n_tokens"]
            )

    return beside(docs, keep, _text="text").mapInArrow(run, f"{kept_fields(docs, keep, names)}, n_words long, n_tokens long")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words and n_tokens of every document: see `token_counts`."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), str(public_tokenizers.path(VOCABULARY)))
