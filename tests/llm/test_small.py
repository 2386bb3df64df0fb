"""The operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

import hashlib
import random
import re
import zlib
from itertools import compress

import numpy as np
import pytest

from sparkpact.llm import decontam, graph, jaccard, neardup, packing, pii, quality, substring, toxicity, warc, wordpiece
from sparkpact.llm.words import WordHasher, mix, rolled

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, bucket int, z string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or ""), 1.0, 7, 3, "z") for k, (i, t) in enumerate(rows)], DOCS)


def prose(r, n, words=400):
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    passage = prose(r, 60, 9000)
    rows = [(k, prose(r, r.randrange(0, 200), 5000)) for k in range(120)]
    rows += [(200 + k, prose(r, 30, 5000) + " " + passage + "\n" + prose(r, 20, 5000)) for k in range(12)]
    base = prose(r, 150, 5000)
    for k in range(25):  # near copies of one text
        w = base.split()
        w[r.randrange(150)] = "edited"
        rows.append((300 + k, " ".join(w)))
    rows += [(400 + k, base) for k in range(20)] + [(500, None), (501, ""), (502, " \n "), (503, "a b"), (504, "A B"), (505, "é ü"), (506, "x" * 30000), (507, prose(r, 30000, 20000)), (None, base), (None, None)]
    rows += [(3, rows[3][1])]
    r.shuffle(rows)
    return rows


def test_word_hashes():
    h = WordHasher()
    a, o = h.batch([b"a b", None, b"", b"b\ta", ("q" * 3_000_000).encode() * 2])
    assert o.tolist() == [0, 2, 2, 2, 4, 5] and a[0] == a[3] and a[1] == a[2] and a[0] != a[1]
    x = np.arange(40, dtype=np.uint64)
    for k in (1, 2, 3, 7, 20):
        want = [sum(int(x[i + j]) * pow(0xC2B2AE3D27D4EB4F, k - 1 - j, 2**64) for j in range(k)) % 2**64 for i in range(41 - k)]
        assert (rolled(x, k) == mix(np.array(want, np.uint64))).all()


def test_toxicity(spark):
    r = random.Random(1)
    rows = [(k, prose(r, 30, 60) + (" vile scum" if k % 4 == 0 else "")) for k in range(400)]
    d = docs(spark, [*rows, (900, None), (901, ""), (None, "vile scum")])
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(900, None), (None, 1)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(d, labels).collect()}
    fold = [k for k in range(400) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum((got[k].predicted == 1) == (k % 4 == 0) for k in fold) >= 0.97 * len(fold)
    assert got[900].score == got[901].score and 0 <= got[900].score <= 1 and len(got) == 403
    empty = toxicity.toxicity(d, labels.where("false")).collect()
    assert len(empty) == 403 and len({x.score for x in empty}) == 1
    assert toxicity.toxicity(d.where("false"), labels).count() == 0


def brute_substring(rows, window=20):
    words = [((-(2**63) if i is None else i), (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, (i, s)), (i, s))
    removed = {}
    for i, w in words:
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (i, s):
                removed.setdefault(i, set()).add(s)
    out = []
    for (i, w), (d, _) in zip(words, rows):
        keep = np.ones(len(w), bool)
        for s in removed.get(i, ()):
            if s + window <= len(w):
                keep[s : s + window] = False
        out.append((d, len(w), int((~keep).sum()), hashlib.sha256(b" ".join(compress(w, keep))).hexdigest()))
    return sorted(out, key=repr)


def test_substring(spark, corpus):
    s = substring.Settings(chunk_bytes=4000)
    assert sorted(map(tuple, substring.deduplicated(docs(spark, corpus), s).collect()), key=repr) == brute_substring(corpus)
    assert substring.deduplicated(docs(spark, corpus).where("false")).count() == 0


def brute_jaccard(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    return sorted(((d, len(s), least.get(find(k)) if s else d) for k, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def test_jaccard(spark, corpus):
    for s in (jaccard.Settings(), jaccard.Settings(chunk_bytes=6000, frequent=64), jaccard.Settings(frequent=0)):
        assert sorted(map(tuple, jaccard.grouped(docs(spark, corpus), s).collect()), key=repr) == brute_jaccard(corpus)
    assert jaccard.grouped(docs(spark, corpus).where("false")).count() == 0


def test_jaccard_representatives(spark, corpus):
    kept = jaccard.representatives(docs(spark, corpus), ("doc_id", "text", "lang", "source", "n_chars")).collect()
    want = {c for d, n, c in brute_jaccard(corpus) if n} | {d for d, n, _ in brute_jaccard(corpus) if not n}
    assert {k.doc_id for k in kept} == want
    assert len([k for k in kept if k.doc_id == 3]) == 1


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5), (2000, 2001), (2001, 2000)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination(spark):
    r = random.Random(3)
    items = [(k, prose(r, 30, 3000)) for k in range(8)] + [(8, None), (9, ""), (10, "a")]
    rows = [(k, prose(r, 80, 3000)) for k in range(60)]
    leaks = {}
    for k in range(8):
        w = items[k][1].split()
        if k % 2:  # edited: every seventh word
            w = [x if j % 7 else "zz" for j, x in enumerate(w)]
        rows.append((100 + k, prose(r, 40, 3000) + "\n" + " ".join(w) + " " + prose(r, 10, 3000)))
        leaks[100 + k] = k
    rows += [(200, None), (201, ""), (202, "a")]
    d, b = docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    for s in (decontam.Settings(), decontam.Settings(broadcast_bytes=0)):
        assert {(x.doc_id, x.item_id) for x in decontam.contaminated(d, b, s).collect()} == set(leaks.items())
        assert {x.doc_id for x in decontam.clean(d, b, ("doc_id", "text"), s).collect()} == {k for k, _ in rows} - set(leaks)
    assert decontam.contaminated(d, b.where("false")).count() == 0 and decontam.contaminated(d.where("false"), b).count() == 0
    x, y = np.array([1, 2, 3, 4, 5], np.uint64), np.array([9, 1, 2, 7, 3, 4, 5, 9], np.uint64)
    assert decontam.smith_waterman(x, y, decontam.Settings()) == (9, 7)


def test_embeddings(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(60, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    rows += [(100 + k, (base[0] + 0.05 * r.normal(size=16)).tolist()) for k in range(40)]
    rows += [(200 + k, base[1].tolist()) for k in range(10)] + [(300, (base[1] * 7).tolist())]
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [None] * 16), (404, [1.0, 2.0]), (405, []), (406, [2.0, 4.0]), (1, base[1].tolist())]
    fine = [(k, i, np.array(v)) for k, (i, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    link = {k: set() for k, *_ in fine}
    for k, _, a in fine:
        for m, _, b in fine:
            if k != m and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95:
                link[k].add(m)
    df = spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, id int, component int, times int")
    got = neardup.near_duplicates(df, neardup.Settings(block=16)).collect()
    assert len(got) == len(rows)
    found, true = sum(x.n_links for x in got), sum(map(len, link.values()))
    assert 0.9 * true <= found <= true
    by = {x.vec_id: x for x in got}
    assert by[1].n_links >= 11 and by[300].component_id == 1 and by[404].component_id == by[406].component_id == 404
    assert all(by[k].n_links == 0 and by[k].kept for k in (400, 401, 402, 403, 405))
    assert neardup.near_duplicates(df.where("false")).count() == 0


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/\n", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 70000), (5, "u", "é" * 70000), (None, "u", "solo")], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    manifest = warc.write(warc.deduplicated(pages), folder, roll=200)
    back = warc.read(manifest, folder).collect()
    got = {(x.page_id, x.record_type, x.refers_to, x.payload_bytes) for x in back}
    assert got == {(1, "revisit", 2, 8), (2, "response", None, 8), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 140000), (None, "response", None, 4)} and len(back) == 7
    assert all(warc.digest(x.payload) == x.payload_digest for x in back if x.payload is not None)
    import io

    one = warc.member([("WARC-Type", "response"), ("WARC-Payload-Digest", "sha1:" + warc.digest(b"ok"))], b"H\r\n\r\nok")
    assert [r.payload for r in warc.records(io.BytesIO(one * 3), chunk=7)] == [b"ok"] * 3
    for bad in (one[:-3], one[:20] + b"x" + one[21:], warc.member([("WARC-Type", "response"), ("WARC-Payload-Digest", "sha1:no")], b"H\r\n\r\nok")):
        with pytest.raises(warc.Damaged):
            list(warc.records(io.BytesIO(bad)))
    assert warc.read(warc.write(warc.deduplicated(pages.where("false")), folder), folder).count() == 0


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_base(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            if (k == 0) or (k == 1 and all(int(x) <= 255 for x in m.group().split("."))) or (k == 2 and 12 <= len(digits) <= 19 and pii.luhn(digits)) or (k == 3 and 9 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("ab.@-1 234+()5é\n") for _ in range(r.randrange(60))) for _ in range(3000)]
    texts += ["4111 1111 1111 1111, +1 (415) 555-2671; 10.0.0.255 256.1.1.1 a.b@c.d.", "1" * 50000, "a" * 50000 + "@", None, ""]
    d = docs(spark, list(enumerate(texts)))
    for x in pii.personal_data(d).collect():
        t = texts[x.doc_id] or ""
        base = brute_base(t)
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert x.base_sha256 == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        assert set(pii.listed(base).split(",")) <= set(x.spans.split(","))
    model = pii.trained()
    added = lambda t: [(pii.KINDS[k], t[s:e]) for s, k, e in pii.added_spans(t, pii.base_spans(t), model)]
    assert added("call (415) 555-2671 now") == [("phone", "(415) 555-2671")]
    assert added("reach bob [at] host [dot] org") == [("email", "bob [at] host [dot] org")]
    assert added('token = "8f40a6af40009d6a464f8895924c39cf8cf69077" in 2024, version 2.0') == []
    assert pii.redacted("x a@b.c y", [(2, 0, 7)]) == "x [EMAIL] y" and pii.redacted(None, []) is None


def test_wordpiece(spark):
    vocabulary = [b" a", b" ab", b" abcd", b"b", b"bc", b"c", b"d", b"cd", b"xyz", b"x", b" ", b"y"]
    known, auto = set(vocabulary), wordpiece.Automaton(vocabulary)

    def greedy(w):
        n, i = 0, 0
        while i < len(w):
            j = next((j for j in range(len(w), i, -1) if w[i:j] in known), None)
            if j is None:
                return 1
            n, i = n + 1, j
        return n

    r = random.Random(6)
    for _ in range(5000):
        w = b" " + bytes(r.choice(b"abcdxyzq") for _ in range(r.randrange(1, 9)))
        assert auto.count(w) == greedy(w), w
    import public_tokenizers

    path = str(public_tokenizers.path(wordpiece.VOCABULARY))
    known, texts = set(wordpiece.read_vocabulary(path)), ["Hello worlds, naïve é", None, "", "a\tb\n" * 50]
    for x in wordpiece.token_counts(docs(spark, list(enumerate(texts))), path).collect():
        words = (texts[x.doc_id] or "").encode().split()
        assert (x.n_words, x.n_tokens) == (len(words), sum(greedy(b" " + w) for w in words))


def test_packing(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path(packing.TOKENIZER))
    t = Tokenizer.from_file(path)
    extra = [(600, "<|endoftext|>Mixed.CASE it's, ÀB́ 12.5..."), (601, "x\x1cy z")]
    rows = [*corpus, *extra]
    got = packing.packed(docs(spark, rows), path, block=20000).collect()
    want = sorted(((i, n + 1) for i, n in ((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows)), key=repr)
    assert sorted(((p.doc_id, p.doc_tokens) for p in got if p.start == 0), key=repr) == want
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in rows if i is not None}
    for p in got:
        if p.doc_id is not None:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
    rows_by = {}
    for p in got:
        rows_by.setdefault(p.sequence_id, []).append(p)
    for s in rows_by.values():
        s.sort(key=lambda p: p.offset)
        n = sum(p.length for p in s)
        assert [p.offset for p in s] == list(np.cumsum([0, *(p.length for p in s)])[:-1]) and n <= 2048 and (n == 2048 or n & (n - 1) == 0)
    combos = packing.combinations(np.bincount([3, 5, 5, 2, 2, 4], minlength=8), 8)
    assert (3, 5) in combos and (2, 2, 4) in combos and all(sum(c) == 8 for c in combos)
    assert packing.packed(docs(spark, []), path).count() == 0


def test_quality(spark):
    r = random.Random(8)
    rows = [(k, prose(r, 60, 500) if k % 3 else "spam " * 60) for k in range(300)] + [(900, None), (901, "")]
    d = docs(spark, rows)
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(300)], "doc_id long, quality int")
    got = {x.doc_id: x for x in quality.quality(d, labels).collect()}
    assert sum(got[k].kept == (k % 3 > 0) for k in range(300)) >= 290 and len(got) == 302
    assert len(quality.quality(d, labels.where("quality = 1")).collect()) == 302
    assert quality.quality(d.where("false"), labels).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    item = prose(r, 40, 4000)
    base = prose(r, 60, 4000)
    rows = [(k, prose(r, 60, 4000) + (" vile scum" if k % 5 == 0 else "")) for k in range(300)]
    rows += [(400, base), (401, base), (402, base + " end"), (403, prose(r, 30, 4000) + " " + item), (404, "mail me: a@b.org now"), (405, None), (406, "")]
    d = docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(300)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        d = spark.createDataFrame(stage(spark, d, str(tmp_path)).collect(), d.schema)
        kept[name] = {x.doc_id: x for x in d.collect()}
    assert {400, 403, 404, 405, 406} <= set(kept["toxicity"]) and sum(k in kept["toxicity"] for k in range(0, 300, 5)) <= 6 and sum(k in kept["toxicity"] for k in range(300) if k % 5) == 240
    assert 400 in kept["near_duplicates"] and not {401, 402} & set(kept["near_duplicates"])
    assert set(kept["near_duplicates"]) - set(kept["decontamination"]) == {403}
    assert kept["personal_data"][404].text == "mail me: [EMAIL] now" and kept["personal_data"][404].n_chars == 20 and kept["personal_data"][405].text is None
    ids = {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert ids == set(kept["personal_data"])
