"""Odd inputs, and models against brute force."""

import itertools
import math
import random

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from sparkpact.functions.lineage import shared_path
from sparkpact.llm import decontam, pii, quality, toxicity, wordpiece

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, spans string, n_tokens string, p_text string, _text string"
LABELS = "doc_id long, quality int, toxic int"


def rows(n=60):
    r = random.Random(5)
    word = lambda: r.choice("the of and garden river music stone paper cloud winter letter window".split())
    out = []
    for i in range(n):
        bad = i % 3 == 0
        text = " ".join(("awful idiot hate" if bad and k % 4 == 0 else word()) for k in range(30)) + (" !!! $$$" if i % 2 else ".")
        out.append((i, text, "en", "web", len(text), "s", "p", "n", "t", "x"))
    return [*out, out[0], out[0], (None, out[1][1], None, None, None, None, None, None, None, None), (900, None, None, None, None, None, None, None, None, None), (901, "", "en", "web", 0, "", "", "", "", ""), (902, "idiot " * 60_000, "en", "web", 1, "", "", "", "", "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(60)] + [(0, 1, 0), (None, 1, 1), (3, None, None), (5, 7, 7), (4000, 1, 1)], LABELS)


OPERATORS = {
    "toxicity": lambda d, lab, keep: toxicity.toxicity(d, lab, toxicity.Settings(l1=0.1), keep),
    "quality": lambda d, lab, keep: quality.quality(d, lab, quality.Settings(taken=4), keep),
    "pii": lambda d, lab, keep: pii.personal_data(d, keep, redact=True),
    "tokens": lambda d, lab, keep: wordpiece.token_counts(d, str(public_tokenizers.path(wordpiece.VOCABULARY)), keep=keep),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_that_repeat_nulls_long_texts_and_clashes(docs, labels, name):
    keep = ("doc_id", "score", "spans", "n_tokens", "p_text", "_text")
    out = OPERATORS[name](docs, labels, keep)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == docs.count()
    same = [r for r in got if r[0] == 0]
    assert len(same) == 3 and len(set(same)) == 1 and sum(r[0] is None for r in got) == 1
    kept = [dict(zip(out.columns, r)) for r in got if r[0] == 7][0]
    assert kept.get("score_input", kept["score"]) == "s" and kept["_text"] == "x"
    empty = OPERATORS[name](docs.where("false"), labels, ("doc_id",))
    assert empty.count() == 0 and "doc_id" in empty.columns
    assert OPERATORS[name](docs, labels.where("false"), ("doc_id",)).count() == len(got)


def test_toxicity_reads_each_labelled_id_once(spark, docs, labels):
    s = toxicity.Settings(l1=0.1)
    one = toxicity.fit(docs, labels, s)
    many = toxicity.fit(docs.unionAll(docs).unionAll(docs), labels.unionAll(labels), s)
    assert all(np.array_equal(a, b) for a, b in zip(one, many))


def test_ftrl_against_one_coordinate_at_a_time():
    r, s = random.Random(2), toxicity.Settings(bits=6, l1=0.3, l2=0.1, epochs=2)
    data = [(np.unique([r.randrange(64) for _ in range(9)]), r.randrange(2)) for _ in range(40)]
    z, n, zb, nb = [0.0] * 64, [0.0] * 64, 0.0, 0.0
    weight = lambda i: 0.0 if abs(z[i]) <= s.l1 else -(z[i] - math.copysign(s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)
    for epoch in range(s.epochs):
        for k in np.random.Generator(np.random.PCG64(epoch)).permutation(len(data)):
            x, y = data[k]
            bias = -zb / ((s.beta + math.sqrt(nb)) / s.alpha)
            g = 1 / (1 + math.exp(-(sum(weight(i) for i in x) + bias))) - y
            for i in x:
                step = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha
                z[i], n[i] = z[i] + g - step * weight(i), n[i] + g * g
            zb, nb = zb + g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / s.alpha * bias, nb + g * g
    idx, w, b = toxicity.train(data, s)
    assert idx.tolist() == [i for i in range(64) if abs(z[i]) > s.l1]
    assert np.allclose(w, [weight(i) for i in idx]) and math.isclose(b, -zb / ((s.beta + math.sqrt(nb)) / s.alpha))


def segmentations(n):
    if not n:
        yield []
    for size in range(1, min(n, pii.LONGEST) + 1):
        for rest in segmentations(n - size):
            yield [*rest, (n - size, n)]


def test_field_against_all_segmentations():
    model = pii.SemiMarkov()
    r = random.Random(8)
    base = pii.trained()
    model.w = {k: v + r.uniform(-0.2, 0.2) for k, v in base.w.items()}
    for text in ("call 555-123-4567 now", "bob at host dot com please", "card 4111 1111 1111 1111", "ip 10[.]0[.]0[.]5 up", "a 12 b 345 c"):
        tokens = [m.span() for m in pii._TOKEN.finditer(text)]
        best, total = (-math.inf, None), []
        for parts in segmentations(len(tokens)):
            for kinds in itertools.product(range(len(pii.KINDS) + 1), repeat=len(parts)):
                v = sum(model.segment(text, tokens, i, j)[y] for (i, j), y in zip(parts, kinds))
                if v > -math.inf:
                    total.append(v)
                    best = max(best, (v, [(i, j, y) for (i, j), y in zip(parts, kinds) if y]))
        want = [(tokens[i][0], y - 1) for i, j, y in best[1]]
        got = [(s, k) for s, k, _ in model.decode(text, tokens, -math.inf)]
        assert [k for _, k in got] == [k for _, k in want] and all(a[0] >= b[0] for a, b in zip(got, want))
        # one step's expected features follow from the forward and backward sums: it must raise the gold path's share
        gold = set(best[1]) | {(k, k + 1, 0) for k in range(len(tokens)) if not any(i <= k < j for i, j, _ in best[1])}
        share = best[0] - np.logaddexp.reduce(total)
        moved = pii.SemiMarkov()
        moved.w = dict(model.w)
        moved.learn(text, tokens, gold, 0.01)
        after = [sum(moved.segment(text, tokens, i, j)[y] for (i, j), y in zip(parts, kinds)) for parts in segmentations(len(tokens)) for kinds in itertools.product(range(len(pii.KINDS) + 1), repeat=len(parts))]
        on = sum(moved.segment(text, tokens, i, j)[y] for i, j, y in gold)
        assert on - np.logaddexp.reduce([x for x in after if x > -math.inf]) >= share - 1e-9


def test_field_finds_what_base_patterns_miss():
    model, r = pii.trained(), random.Random(77)
    right = wrong = missed = 0
    for _ in range(800):
        text, gold = pii._sentence(r)
        at = [m.span() for m in pii._TOKEN.finditer(text)]
        base = pii.base_spans(text)
        known = {(k, text[s:e]) for s, k, e in base}
        want = {(y - 1, text[at[i][0] : at[j - 1][1]].strip(".,")) for i, j, y in gold} - known
        got = {(k, text[s:e].strip(".,")) for s, k, e in pii.added_spans(text, base, model)}
        right, wrong, missed = right + len(want & got), wrong + len(got - want), missed + len(want - got)
    assert right / (right + wrong) > 0.98 and right / (right + missed) > 0.98
    for text in ("call 123 now", "fax 200", "phone 2024 model", "he was at home dot", "x" * 300 + " 555-123 " + "y" * 300 + " 4567"):
        assert not pii.added_spans(text, pii.base_spans(text), model)
    for text, found in (("10[.]0[.]0[.]5 is up", "10[.]0[.]0[.]5"), ("write bob(at)host(dot)org today", "bob(at)host(dot)org"), (f"{'z' * 250} (212) 555-1234", "(212) 555-1234")):
        assert [text[s:e] for s, _, e in pii.added_spans(text, [], model)] == [found]


def test_decontamination_of_odd_rows_against_all_pairs(spark):
    r = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(r.choice(words) for _ in range(12))) for k in range(8)] + [(3, "another item of the same id with words"), (None, " ".join(words[:9]))]
    texts = [" ".join(r.choice(words) for _ in range(40)) for _ in range(30)]
    edited = items[2][1].split()
    edited[5] = "changed"
    texts += [f"{texts[0]} {' '.join(edited)} tail", f"{items[1][1]} {items[4][1]}", items[8][1], items[9][1], f"{items[6][1]} {items[6][1]}"]
    table = [*enumerate(texts), (30, texts[30]), (None, texts[31]), (70, None), (71, ""), (72, " ".join(texts) * 40)]
    d = spark.createDataFrame(table, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    s, own = decontam.Settings(), decontam.hasher()
    want = []
    for i, t in table:
        h = own.batch([(t or "").encode()])[0]
        for j, x in items:
            q = own.batch([x.encode()])[0]
            score = decontam.smith_waterman(q, h, s)[0] / (s.match * len(q)) if len(h) else 0
            if score >= s.threshold:
                want.append((i, j, round(score, 9)))
    for settings in (s, decontam.Settings(broadcast_bytes=0)):
        got = sorted(((x.doc_id, x.item_id, round(x.score, 9)) for x in decontam.contaminated(d, b, settings).collect()), key=repr)
        assert got == sorted(want, key=repr)
        assert decontam.contaminated(d.where("false"), b, settings).count() == 0 == decontam.contaminated(d, b.where("false"), settings).count()
        kept = decontam.clean(d, b, ("doc_id", "text"), settings).collect()
        assert sorted((x.doc_id for x in kept), key=repr) == sorted((i for i, _ in table if i not in {w[0] for w in want}), key=repr)


def test_pipeline_of_empty_and_repeated_rows(spark, docs, labels):
    folder = shared_path(spark, "tables")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "a benchmark item of some words that nobody repeats")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    plain.write.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert out.columns[:4] == ["doc_id", "start", "length", "ids_crc32"] and out.where("doc_id = 902").count() <= 200
    ids = [r.doc_id for r in out.select("doc_id", "doc_tokens").distinct().collect()]
    assert len(ids) == len(set(ids)) and {900, 901} <= set(ids)
    plain.where("false").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
