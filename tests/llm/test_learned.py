"""Fitted operators: contracts, held-out accuracy, and what enters a score."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideglass.llm.language import identify_language, words_of
from tideglass.llm.quality import BITS, fit, indicators, keep_quality, score_quality
from tideglass.llm.sample import bounded_sample

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_on_held_out_rows(spark, tables):
    docs, labels = tables
    got = score_quality(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    m = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert (m.predicted == m.quality).mean() > 0.95


def test_held_out_labels_and_other_columns_do_not_matter(tables):
    docs, labels = tables
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = score_quality(docs, labels).orderBy("doc_id").toPandas().score
    b = score_quality(docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit(None).cast("string")), other).orderBy("doc_id").toPandas().score
    assert np.allclose(a, b)


def test_rejected_rows_go_and_columns_stay(tables):
    docs, labels = tables
    bad = {r.doc_id for r in score_quality(docs, labels).filter("predicted = 0").collect()}
    kept = keep_quality(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - bad


def test_odd_texts_are_scored(spark, corpus, empty, tables):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = score_quality(corpus, labels).collect()
    assert len(got) == corpus.count() and all(0 <= r.score <= 1 for r in got) and any(r.doc_id is None and r.held_out is None for r in got)
    assert score_quality(empty, labels).count() == 0 and {r.score for r in score_quality(corpus, labels.limit(0)).collect()} == {0.5}
    assert keep_quality(corpus, labels.limit(0)).count() == corpus.count()


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["a", "b", "c", "good" if k % 2 else "bad"], 30)) for k in range(80)]
    f, first = indicators(pa.array(texts))
    rows = [f[i:j] for i, j in zip(first[:-1], first[1:], strict=True)]
    label = np.arange(80) % 2
    s = fit(rows, label).scores(f, first)
    assert ((s >= 0.5) == label).all()
    assert (fit(rows, np.ones(80, int)).scores(f, first) > 0.5).all() and (fit([], np.zeros(0, int)).scores(f, first) == 0.5).all()


def test_language_on_held_out_rows(tables):
    docs, _ = tables
    got = identify_language(docs).toPandas().merge(docs.toPandas(), on="doc_id")
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all() and got.score.between(0, 1).all()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98


def test_unseen_words_back_off_and_letterless_texts_are_und(spark, empty):
    rows = [(k, "the thing there then " * 3, "en") for k in range(1, 40)] + [(k, "und nicht auch zwischen " * 3, "de") for k in range(100, 140)]
    rows += [(1000, "thinger theing", None), (1001, "nichtig zwischendurch", None), (1002, None, "en"), (1003, "12 !? 3", "de"), (None, "the", None), (1004, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify_language(docs).collect()}
    assert [got[k].lang_pred for k in (1000, 1001, 1002, 1003, 1004, None)] == ["en", "de", "und", "und", "und", "en"]
    assert got[1002].score == 0 and got[None].held_out is None
    assert identify_language(empty).count() == 0 and {r.lang_pred for r in identify_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_the_sample_keeps_its_bounds(spark):
    docs = spark.createDataFrame([(i, "x" * (10 + i % 50)) for i in range(500)] + [(7, "y" * 5000)] * 3 + [(None, "z")], "doc_id long, text string").filter("doc_id IS NOT NULL")
    got = bounded_sample(docs, 100, 2500).collect()
    assert len(got) <= 100 and sum(len(r.text) for r in got) <= 2500 and 7 not in {r.doc_id for r in got} and len(got) > 30
    assert {r.doc_id for r in got} == {r.doc_id for r in bounded_sample(docs.repartition(7), 100, 2500).collect()}
    assert bounded_sample(docs, 1000, 1 << 20).count() == docs.count()


def test_features_are_words_pairs_and_shapes():
    """As many distinct features as by hand, where no two share a hash."""
    texts = ["Ab ab ab Cd 12, x", "", None, "one", "é 1"]
    f, first = indicators(pa.array(texts))

    def shape(w):
        out = ""
        for c in w.encode():
            k = "A" if 65 <= c <= 90 else "a" if 97 <= c <= 122 or c >= 128 else "0" if 48 <= c <= 57 else chr(c)
            out += k if not out.endswith(k) else ""
        return out

    for i, t in enumerate(texts):
        w = (t or "").split()
        shapes = [shape(x) for x in w]
        want = {("w", x) for x in w} | {("p", "same") if a == b else ("p", a, b) for a, b in zip(w, w[1:])} | {("s", *shapes[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)}
        assert first[i + 1] - first[i] == len(want) == len(set(f[first[i] : first[i + 1]].tolist()))


def test_fit_against_plain_formulas():
    """Log-count ratios by hand, and a hinge loss that projected gradient steps on the dual do not better."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 40, 12) + 25 * (k % 3 == 0)).astype(np.int32) for k in range(60)]
    label = np.array([int(k % 3 == 0) ^ int(k % 17 == 0) for k in range(60)])
    model = fit(rows, label, rounds=500)
    counts = [Counter(x for r, y in zip(rows, label, strict=True) if y == c for x in r.tolist()) for c in (1, 0)]
    size = [sum(c.values()) + (1 << BITS) for c in counts]
    for x in range(70):
        assert math.isclose(model.ratio[x], math.log((counts[0][x] + 1) / size[0]) - math.log((counts[1][x] + 1) / size[1]), abs_tol=1e-5)
    ratio = model.ratio.astype(float)
    dense = np.zeros((60, 71))
    for i, r in enumerate(rows):
        v = ratio[r]
        dense[i, r] = v / np.sqrt((v * v).sum())
    dense[:, 70] = 1  # the bias
    y, cap = np.where(label == 1, 1.0, -1.0), 60 / 2 / np.where(label == 1, label.sum(), 60 - label.sum())

    def loss(w):
        return (w * w).sum() / 2 + (cap * np.maximum(0, 1 - y * (dense @ w))).sum()

    dual, gram = np.zeros(60), (dense * y[:, None]) @ (dense * y[:, None]).T
    for _ in range(60_000):
        dual = np.clip(dual - (gram @ dual - 1) / np.linalg.norm(gram, 2), 0, cap)
    best = loss((dual * y) @ dense)
    assert loss(np.append(model.weight[:70].astype(float), model.bias)) <= best * 1.01
    f, first = np.concatenate(rows), np.append(0, np.cumsum([len(r) for r in rows]))
    margin = dense @ np.append(model.weight[:70], model.bias)
    assert np.allclose(model.margins(f, first), margin, atol=1e-3)
    assert np.allclose(model.scores(f, first), 1 / (1 + np.exp(-(model.slope * margin + model.offset))), atol=1e-3)


def test_language_against_plain_formulas(spark):
    """Word-first backoff by hand over the same rows: predictions and scores."""
    rnd = random.Random(8)
    words = {"en": ["the", "then", "there", "cat", "night"], "de": ["der", "dann", "nacht", "katze", "und"], "fr": ["le", "nuit", "chat", "alors", "été"]}
    rows = [(i, " ".join(rnd.choices(words[x], k=rnd.randint(1, 9))), x) for i, x in enumerate(rnd.choices(list(words), k=200))]
    rows += [(900, "theren katzen 12", None), (901, "qqq zzz", None), (902, "Été!", None), (903, "½ ² ①", None), (904, "a½b", None), (905, "x² der", None), (906, "\U0001d7ce 7", None)]
    learned = [(t, x) for i, t, x in rows if x and zlib.crc32(str(i).encode()) % 5]
    counts = [defaultdict(Counter) for _ in range(5)]
    for t, x in learned:
        for w in t.split():
            counts[0][w][x] += 1
            for n in range(1, 5):
                p = f"<{w}>"
                for k in range(len(p) - n + 1):
                    counts[n][p[k : k + n]][x] += 1
    langs = sorted(words)

    def vector(n, unit):
        total = {x: sum(c[x] for c in counts[n].values()) for x in langs}
        v = [math.log((counts[n][unit][x] + 0.5) / (total[x] + 0.5 * len(counts[n]))) for x in langs]
        return np.array(v) - np.mean(v)

    def vote(w):
        if w in counts[0]:
            return vector(0, w)
        p = f"<{w}>"
        for n in (4, 3, 2, 1):
            known = [p[k : k + n] for k in range(len(p) - n + 1) if p[k : k + n] in counts[n]]
            if known:
                return np.mean([vector(n, g) for g in known], axis=0)
        return np.zeros(len(langs))

    got = {r.doc_id: r for r in identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, t, _ in rows:
        own = words_of(t)
        assert own == "".join(c if c.isalpha() else " " for c in t.lower()).split()
        if not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        v = sum(vote(w) for w in own)
        assert got[i].lang_pred == langs[int(np.argmax(v))] and math.isclose(got[i].score, 1 / np.exp(v - v.max()).sum(), rel_tol=1e-9)
    assert {i for i in (903, 906) if got[i].lang_pred == "und"} == {903, 906} and got[904].lang_pred != "und"
