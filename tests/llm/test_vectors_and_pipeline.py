"""Vectors, components and the pipeline against brute force."""

import numpy as np
import pytest

import corpus_pipeline
from tideglass.llm import embedding_dedup
from tideglass.llm.embedding_dedup import embedding_duplicates
from tideglass.llm.graph import components


def brute(rows):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    ok = [(i, x / np.abs(x).max()) for i, x in ok]
    n, comp = dict.fromkeys((i for i, _ in rows), 0), {i: i for i, _ in rows}
    links = []
    for k, (i, x) in enumerate(ok):
        for j, y in ok[:k]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                n[i], n[j] = n[i] + 1, n[j] + 1
                links.append((i, j))
    for _ in rows:
        for i, j in links:
            comp[i] = comp[j] = min(comp[i], comp[j])
    return n, comp


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    out = [x.tolist() for x in base]
    out += [(base[k % 6] + rng.normal(size=16) * 0.12 * (k % 4)).tolist() for k in range(150)]
    out += [out[3]] * 30 + [(np.array(out[3]) * 5).tolist(), (-np.array(out[3])).tolist()]
    out += [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1e-300] * 16, [1e300] * 16]
    return list(enumerate(out))


@pytest.mark.parametrize("block", [1024, 16])
def test_vectors(spark, rows, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    n, comp = brute(rows)
    got = embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (n[i], comp[i], comp[i] == i) for i in n}


def planted_pairs(kind):
    """Vectors and, for each, another at a cosine of just 0.9: isotropic, or in a narrow cone."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 48))
    if kind == "cone":
        x = x / np.sqrt(48) + 2.48 * np.eye(48)[0]
    x = embedding_dedup.unit(x)
    a, b = embedding_dedup.planted(x, 0.9 + 1e-9)
    return np.concatenate([x, b])


@pytest.mark.parametrize("kind", ["isotropic", "cone"])
def test_recall_against_all_pairs(spark, kind):
    x = planted_pairs(kind)
    near = x @ x.T >= 0.9
    want = near.sum() - len(x)
    assert want >= 1400 and (kind == "isotropic" or 0.02 < want / len(x) ** 2 < 0.5)
    got = embedding_duplicates(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")).collect()
    assert 0.9 * want <= sum(r.n_links for r in got) <= want + 8
    assert all(r.n_links <= near[r.vec_id].sum() - 1 + 1e-9 for r in got) or kind == "cone"


def test_shared_pivots_are_counted_before_any_cosine():
    prefix = np.array([[3, 1, 9], [3, 9, 2], [1, 3, 5], [3, 7, 8], [9, 3, 7]], np.int32)
    assert {a: b.tolist() for a, b in embedding_dedup.counted(prefix, 3, 2)} == {0: [1, 4], 1: [4], 2: [], 3: [4], 4: []}  # rows 0 and 2 meet in list 1
    assert {a: b.tolist() for a, b in embedding_dedup.counted(prefix, 3, 1)}[2] == [3, 4]


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01])], "vec_id long, embedding array<float>")
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_duplicates(df).collect()} == {(None, 0, None, True), (1, 1, 1, True), (2, 1, 1, False)}
    assert embedding_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    parent = {}
    for a, b in links:
        for v in (a, b):
            parent.setdefault(v, v)
    for _ in range(100):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    want = {v: c for v, c in parent.items() if any(v in link for link in links if link[0] != link[1])}
    assert {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == want


def test_stages(spark, corpus):
    from tests.llm.test_text_operators import near_want, shingles

    sf = "/root/testdata/sf0.001"
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "shard"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages, columns = dict(corpus_pipeline.STAGES), docs.columns
    good = stages["quality"](spark, docs, sf)
    assert good.columns == columns and 0.6 < good.count() / docs.count() < 1
    one = stages["near_dedup"](spark, docs, sf)
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {i for i, c in near_want(docs).items() if i == c}
    items = [shingles(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in docs.collect() if not any(q and len(shingles(r.text) & q) >= 0.75 * len(q) for q in items)}
    assert {r.doc_id for r in stages["decontaminate"](spark, docs, sf).collect()} == clean
    mixed = stages["mix"](spark, docs, sf)
    assert mixed.columns == columns and 0.7 < mixed.count() / docs.count() < 1.3
    out = stages["shard"](spark, docs, sf)
    assert out.count() == docs.count() and out.columns[: len(columns)] == columns


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert 50 < out.count() < 250 and "slot" in out.columns
