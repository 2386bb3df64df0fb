"""Results that must not depend on the size of a table, nor on ids being there and distinct."""

import random
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from sparkpact.functions.lineage import shared_path
from sparkpact.llm import decontam, jaccard, neardup, packing, substring


def test_embeddings_at_the_threshold(spark):
    x, y = neardup_pairs(3000, 64, 0.9501)
    v = np.concatenate([x, y])
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(v)), "embedding": pa.array(list(v))}))
    got = {r.vec_id: r for r in neardup.near_duplicates(df).collect()}
    found = [got[k].n_links == got[3000 + k].n_links == 1 and got[3000 + k].component_id == k for k in range(3000)]
    assert len(got) == 6000 and np.mean(found) >= 0.995


def neardup_pairs(n, d, cosine, seed=4):
    r = np.random.default_rng(seed)
    x, u = r.normal(size=(2, n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u -= (u * x).sum(1, keepdims=True) * x
    return x, cosine * x + np.sqrt(1 - cosine**2) * u / np.linalg.norm(u, axis=1, keepdims=True)


@pytest.mark.parametrize("width", [8, 12, 20, 24])
def test_embeddings_recall_of_any_width(width):
    r = np.random.default_rng(3)
    learnt, fresh, none = r.normal(size=(2000, 64)), r.normal(size=(2000, 64)), np.empty((0, 64))
    learnt /= np.linalg.norm(learnt, axis=1, keepdims=True)
    x, y = neardup_pairs(4000, 64, 0.95)
    for base, other in ((learnt, fresh), (none, none)):
        m = neardup.Rotation(base, other, 64, width, neardup.Settings())
        assert m.map.shape == (64, m.width * m.tables) and (m.keys(x) == m.keys(y)).any(1).mean() >= 0.995


def test_decontamination_by_either_way(spark):
    r = np.random.default_rng(6)
    medium, rare = [f"m{k}" for k in range(21)], [f"r{k}" for k in range(19)]
    fill = [" ".join(f"w{k}" for k in r.integers(0, 900, 60)) for _ in range(80)]
    edited = " ".join([*medium, *(f"e{k}" for k in range(19))])  # the rarest half of the n-grams is gone
    rows = [*enumerate(fill), (100, f"{fill[0]} {edited}"), (None, f"{edited} {fill[1]}"), (5, edited), (None, "clean"), (101, None), (None, None)]
    items = [(1, " ".join(medium + rare)), (2, " ".join(f"q{k}" for k in range(12))), (2, "a b"), (3, None)]
    rows += [(102, items[1][1]), (102, "clean too")]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found, kept = [], []
    for s in (decontam.Settings(), decontam.Settings(broadcast_bytes=0)):
        found.append(sorted(map(tuple, decontam.contaminated(d, b, s).collect()), key=repr))
        kept.append(sorted(map(tuple, decontam.clean(d, b, ("doc_id", "text"), s).collect()), key=repr))
    assert found[0] == found[1] and kept[0] == kept[1]
    assert sorted((x[0], x[1]) for x in found[1] if x[0] is not None) == [(5, 1), (100, 1), (102, 2)] and len(found[1]) == 4
    assert kept[1] == sorted([*enumerate(fill), (None, "clean"), (101, None), (None, None), (102, "clean too")], key=repr)


def test_jaccard_with_null_and_repeated_ids(spark):
    r = np.random.default_rng(8)
    words = [f"w{k}" for k in r.integers(0, 9000, 100)]
    middle, far, other = [*words[:92], *"abcdefgh"], [*"ijklmnop", *words[8:92], *"abcdefgh"], [f"v{k}" for k in range(100)]
    rows = [(1, words), (None, middle), (2, far), (7, other), (7, [*words[:99], "z"]), (8, [*other[:99], "z"]), (9, [f"u{k}" for k in range(60)])]
    lone = [f"t{k}" for k in range(80)]
    rows += [(None, lone), (None, [*lone[:79], "z"])]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for _, w in rows]
    assert 100 * len(sets[0] & sets[2]) < 80 * len(sets[0] | sets[2])  # only the row without doc_id connects them
    got = jaccard.grouped(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    want = [(1, 1), (None, 1), (2, 1), (7, 7), (7, 1), (8, 7), (9, 9), (None, None), (None, None)]
    assert sorted(((x.doc_id, x.component_id) for x in got), key=repr) == sorted(want, key=repr)


def cloud(copies: int, words: int = 60, seed: int = 3):
    """Edited copies of one text: some close to it, some too far from it and from each other, and two outliers that pair up."""
    rng = random.Random(seed)
    text = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    rows = []
    for i in range(copies):
        own = list(text)
        for _ in range(rng.choice((0, 1, 1, 2, 2, 3, 5, 8))):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        rows.append((i + 1, " ".join(own)))
    far = [f"y{i}" if i % 4 == 0 else w for i, w in enumerate(text)]
    return [*rows, (copies + 1, " ".join(far)), (copies + 2, " ".join([*far, "end"]))]


def test_jaccard_of_many_near_copies(spark):
    rows = cloud(500)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    least = list(range(len(rows)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                links += 1
                x, y = root(i), root(j)
                least[max(x, y)] = min(x, y)
    want = [(rows[i][0], len(a), rows[root(i)][0]) for i, a in enumerate(sets)]
    assert 30 < len({w[2] for w in want}) < 400 and links > 5000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for s in (jaccard.Settings(), jaccard.Settings(chunk_bytes=8000, crowd=16, block=50, frequent=100), jaccard.Settings(chunk_bytes=8000, crowd=4, block=128, frequent=1 << 17)):
        assert sorted(map(tuple, jaccard.grouped(docs, s).collect())) == want


def test_jaccard_sketches_bound_the_distance():
    rng = np.random.default_rng(5)
    token = rng.integers(0, 1 << 64, 4000, dtype=np.uint64)
    for n in (1, 5, 64, 90, 700, 3000):
        for size in {max(1, n * 4 // 5), n}:
            a, b = np.sort(token[:n]), np.sort(token[n // 6 : n // 6 + size])
            both = len(np.intersect1d(a, b))
            pair = jaccard.Sketches([jaccard.sketches(x, np.array([0, len(x)]))[0] for x in (a, b)])
            assert pair.apart(np.array([0]), np.array([1]))[0] <= len(a) + len(b) - 2 * both


def direct(tokenizer, text: str) -> list[int]:
    return [*tokenizer.encode(text, add_special_tokens=False).ids, packing.END]


def packed_ids(spark, texts: list[str], path: str) -> list[list[int]]:
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(packing.tokenised(df, path).collect(), key=lambda r: r.doc_id)
    return [np.frombuffer(r.ids, "<u4").tolist() for r in rows]


def test_packing_of_every_letter(spark):
    path = str(public_tokenizers.path(packing.TOKENIZER))
    tokenizer = Tokenizer.from_file(path)
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    some = [c for c in letters if ord(c) < 0x3400 or c.lower() != c or len(normalize("NFC", c)) > 1] + letters[::97]
    texts = [" ".join(f"{c} a{c}b {c}, {c.upper()}{c}" for c in some[i : i + 50]) for i in range(0, len(some), 50)]
    texts += [f"x {c}y." for c in some if len(c.lower()) > 1 or not c.lower().isalpha()] + ["I love İstanbul", "İİ, İ.", "ŉ ǰ ΐ"]
    assert packed_ids(spark, texts, path) == [direct(tokenizer, t) for t in texts]


def test_packing_of_random_mixes(spark):
    path = str(public_tokenizers.path(packing.TOKENIZER))
    tokenizer, rng = Tokenizer.from_file(path), random.Random(11)
    pieces = ["word", "Word", "É", "é", "été", "»", "«", "?!", ".", ",", "...", "'s", "don't", "'", "42", "a1", "×", "÷", "é.", "İ", "ß", "ſ", "ﬁ", "٣", "中文", "é", "́", "<|endoftext|>", "-", "–", "$5,000.00", " ", " "]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", "", " ", " ", "\n", "\t", ". ", ", ", "! "]) for _ in range(40)) for _ in range(400)]
    assert packed_ids(spark, texts, path) == [direct(tokenizer, t) for t in texts]


def test_word_cache_is_bounded():
    words = packing.WordIds(str(public_tokenizers.path(packing.TOKENIZER)), most=50_000)
    for k in range(40):
        batch = {f"w{chr(97 + k % 26)}{i}".encode() for i in range(k * 100, k * 100 + 100)} | {b"long" * 50 + str(k).encode()}
        words.learn(batch)
        assert all(w in words for w in batch)
    assert len(words) + len(words.older) < 800 and sum(len(w) > 64 for w in words) == 1


def test_substring_index_of_batches_over_calls(spark):
    r = random.Random(9)
    passage = [f"p{k}" for k in range(40)]
    rows = []
    for i in range(90):
        own = [f"w{r.randrange(3000)}" for _ in range(r.randrange(10, 80))]
        if i % 4 == 0:
            own[5:5] = passage[r.randrange(8) :]
        rows.append((i, " ".join(own)))
    rows[60] = (60, rows[3][1])
    s = substring.Settings(chunk_bytes=3000)
    whole = {x.doc_id: tuple(x) for x in substring.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), s).collect()}
    folder, got = shared_path(spark, "index"), {}
    for low in range(0, 90, 15):  # ids rise from batch to batch, so the result is that of one call
        batch = spark.createDataFrame(rows[low : low + 15], "doc_id long, text string")
        got |= {x.doc_id: tuple(x) for x in substring.extended(batch, folder, s, buckets=20).collect()}
    assert got == whole and any(x[2] for x in whole.values())
    index, buckets = substring.FingerprintIndex.opened(spark, folder)
    assert buckets == 20 and 1 <= len(index.runs) <= 4
    again = substring.extended(spark.createDataFrame(rows[:5] + [(None, None)], "doc_id long, text string"), folder, s).collect()
    assert all(x.n_removed == (x.n_words if x.n_words >= 20 else 0) for x in again)
    assert substring.extended(spark.createDataFrame([], "doc_id long, text string"), folder, s).count() == 0
