"""Registered queries against their DuckDB texts; odd tables and column names through every operator and stage."""

import datetime as dt

import duckdb
import pytest

import corpus_pipeline
from tideglass.llm import queries
from tideglass.llm.common import numbered
from tideglass.llm.decontaminate import contained_items, drop_contaminated
from tideglass.llm.embedding_dedup import embedding_duplicates
from tideglass.llm.language import identify_language
from tideglass.llm.lm_score import lm_score
from tideglass.llm.mixing import mix_sources
from tideglass.llm.near_dup import drop_near_duplicates, near_duplicates
from tideglass.llm.pii import find_pii
from tideglass.llm.quality import keep_quality, score_quality
from tideglass.llm.sharding import shard
from tideglass.llm.substring_dedup import substring_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return round(v, 5) if isinstance(v, float) else v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_duckdb(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    res = duck.execute(queries.SQL[name])
    names = [d[0] for d in res.description]
    want = sorted(repr([plain(row[names.index(c)]) for c in columns]) for row in res.fetchall())
    assert sorted(names) == columns and sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want


#: Names that an operator might use for itself, and ones that differ from its own in case alone.
CLASHING = (
    "__id", "__source", "__cdf", "__b", "__key", "__block", "key", "block", "row", "offset", "id", "to", "n", "of", "rate", "draws", "cdf", "salt", "pick", "tkey", "ikey", "grp", "Text", "DOC_ID", "Source", "c0",
    "c1", "rep", "family", "label", "Lang",
)


@pytest.fixture(scope="module")
def odd(spark):
    base = "a few words that make a text of more than five words " * 3
    rows = [(i, base + str(i % 3), "s", "en") for i in range(6)] + [(None, None, None, None), (None, base, None, "de"), (7, "", "t", None), (7, "", "t", None), (8, "x y", "t", "de")]
    schema = "doc_id long, text string, source string, lang string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, *("?" * len(CLASHING))) for r in rows], schema)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, "?") for i in range(6)] + [(None, 1, "?"), (2, None, "?")], "doc_id long, quality int, label string")


def test_names_that_clash(spark, odd, labels):
    n = odd.count()
    whole = {
        "near": drop_near_duplicates(odd), "quality": keep_quality(odd, labels.limit(0)), "clean": drop_contaminated(odd, spark.createDataFrame([(1, "not there at all in any")], "item_id long, text string")),
        "mix": mix_sources(odd, epochs=3.0), "shard": shard(odd, 3),
    }
    for name, out in whole.items():
        assert out.columns[: len(odd.columns)] == odd.columns, name
        rows = out.collect()
        assert all(r[4 + k] == "?" for r in rows for k in range(len(CLASHING))), name
    assert whole["quality"].count() == whole["clean"].count() == whole["shard"].count() == n
    for op in (substring_dedup, lm_score, near_duplicates, find_pii, identify_language):
        assert op(odd).count() == n, op
    assert score_quality(odd, labels).count() == n
    for limit in (1 << 20, 1):
        assert contained_items(odd, odd, item_id="doc_id", item_bytes=limit).count() > n
    vectors = spark.createDataFrame([(1, [1.0, 0.0], "?", "?"), (2, [1.0, 0.1], "?", "?")], "vec_id long, embedding array<double>, VEC_ID string, rep string")
    assert {r.component_id for r in embedding_duplicates(vectors).collect()} == {1}


def test_a_missing_column_is_named(odd):
    with pytest.raises(ValueError, match="no column body"):
        near_duplicates(odd, text="body")


def write(spark, to, docs, labels, items):
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
        df.write.parquet(f"{to}/{name}.parquet")
    return spark.read.parquet(f"{to}/documents.parquet")


def test_stages_on_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int")
    sf = str(tmp_path)
    docs = write(spark, sf, docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_stages_on_nulls_repeats_and_further_columns(spark, odd, labels, tmp_path):
    sf = str(tmp_path)
    docs = numbered(odd).selectExpr("c0 doc_id", "c1 text", "c3 lang", "c2 source", "c4 __id", "c5 row", "c6 offset", "c7 family")  # no names that differ in case alone in a file
    docs = write(spark, sf, docs, labels.select("doc_id", "quality"), spark.createDataFrame([(1, None), (None, "")], "item_id long, text string"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).columns[: len(docs.columns)] == docs.columns, name
    assert corpus_pipeline.run(spark, sf).count() >= 0


def test_a_megabyte_of_text(spark):
    """One text of some three megabytes, with an address at its end, beside short ones."""
    long = "".join(f"word{i % 5003} " for i in range(300_000)) + "mail joe at example dot com"
    docs = spark.createDataFrame([(1, long), (2, long), (3, "word1 word2 word3 word4 word5 word6"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert (got[1].component_id, got[2].component_id, got[3].component_id) == (1, 1, 3)
    out = {r.doc_id: r for r in substring_dedup(docs, 20).collect()}
    assert out[2].n_removed == out[2].n_words == 300_006 and out[1].n_removed >= 300_000 - 5003 - 20
    assert len({r.doc_id: r for r in find_pii(docs).collect()}[1].spans) == 1
    assert contained_items(docs, docs.filter("doc_id = 3"), item_id="doc_id").count() == 3
