"""Stupid-backoff language model over the whole corpus."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.blocks import U64, Grouped, Words, answers, distinct, mix, to_cells
from tideglass.llm.common import pick

OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64()), ("mean_log_score", pa.float64())])
OUT_DDL = "doc_id long, n_words long, log_score double, mean_log_score double"
COUNTS = pa.schema([("n", pa.int32()), ("ngram", pa.int64()), ("count", pa.int64())])
#: Occurrences that an unseen word counts for.
UNSEEN = 0.5


def lm_score(docs: DataFrame, order: int = 3, backoff: float = 0.4, leave_out: bool = True, doc_id: str = "doc_id", text: str = "text", **sizes) -> DataFrame:
    """Natural-log stupid-backoff score of every text under the counts of all other texts.

    S(w|c) = count(cw)/count(c) if the n-gram occurs, else backoff * S(w|shorter c); for one word
    count(w)/words, where an unseen word counts as UNSEEN. The first words of a text back off for want of
    context. With ``leave_out`` a text's own n-grams do not count for itself, so text that occurs nowhere else
    backs off; without it every n-gram occurs at least once. Returns doc_id, n_words, log_score (sum) and
    mean_log_score (null without words).

    Count tables are partitioned by hash range and joined to the n-grams exploded per document group. From
    trigrams on only those are counted over the corpus whose two shorter n-grams both repeat: any other
    occurs once, here, and needs no look-up. ``ngram_counts`` gives the tables themselves, ``score_with`` scores
    further texts by them.

    Null and empty texts have no words and score 0. Rows with one doc_id are texts of their own, as are equal
    ones. An empty table gives an empty result; further columns, whatever their names, are ignored.
    """
    if order < 2:
        raise ValueError("order must be 2 at least")
    grouped = Grouped(docs, doc_id, text, **sizes)
    heard, total = None, corpus_words(docs, text)

    def ask(n):
        def fn(grp, t, heard):
            w = Words(t.column("text"))
            known = {} if n <= 2 else counts(w, n - 1, heard)
            rows = []
            for k in (1, 2) if n <= 2 else (n,):
                h, _, _, c = distinct(w.grams(k)[wanted(w, k, known)])
                rows += grouped.ask(grp, k, h, c.astype(np.uint32))
            return to_cells(rows)

        return fn

    for n in [2, *range(3, order + 1)]:
        got = grouped.own(grouped.emit(ask(n), heard), corpus_counts, np.uint32)
        heard = got if heard is None else heard.unionByName(got)

    def finish(grp, t, heard):
        w = Words(t.column("text"))
        return scored(t, w, counts(w, order, heard), total, order, backoff, leave_out)

    return grouped.emit(finish, heard, OUT_DDL)


def ngram_counts(docs: DataFrame, order: int = 3, doc_id: str = "doc_id", text: str = "text", **sizes) -> DataFrame:
    """The count table of a corpus: n, ngram (64 bits of hash) and count, one row for every n-gram up to ``order``.

    Rows come partitioned by ranges of the hash; write them as Parquet to score further texts by them. Null and
    empty texts have no n-grams; an empty table gives an empty result."""
    grouped = Grouped(docs, doc_id, text, **sizes)

    def ask(grp, t, _):
        w = Words(t.column("text"))
        rows = []
        for n in range(1, order + 1):
            h, _, _, c = distinct(w.grams(n)[w.left >= n])
            rows += grouped.ask(grp, n, h, c.astype(np.uint32))
        return to_cells(rows)

    def total(level, h, c):
        at, _, where, _ = distinct(h)
        return pa.Table.from_arrays([pa.array(np.full(len(at), level, np.int32)), pa.array(at.view(np.int64)), pa.array(np.bincount(where, weights=c).astype(np.int64))], schema=COUNTS)

    return grouped.reduce(grouped.emit(ask), total, "n int, ngram long, count long", np.uint32)


def score_with(docs: DataFrame, table: DataFrame, order: int = 3, backoff: float = 0.4, doc_id: str = "doc_id", text: str = "text", **sizes) -> DataFrame:
    """The scores of ``lm_score`` for texts that ``table`` (see ngram_counts) was not counted on.

    The distinct n-grams of each document group are joined to the table by hash. An empty table of counts leaves
    every word unseen; nulls, empty texts and repeated rows are treated as in ``lm_score``."""
    grouped = Grouped(docs, doc_id, text, **sizes)
    total = table.filter("n = 1").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]

    def explode(grp, t, _):
        w = Words(t.column("text"))
        found = [distinct(w.grams(n)[w.left >= n])[0] for n in range(1, order + 1)]
        level = np.repeat(np.arange(1, order + 1, dtype=np.int32), [len(h) for h in found])
        h = np.concatenate(found).view(np.int64)
        return pa.table({"grp": pa.array(np.full(len(h), grp)), "n": pa.array(level), "ngram": pa.array(h)})

    known = grouped.emit(explode, schema="grp long, n int, ngram long").join(table, ["n", "ngram"]).select("grp", "n", "ngram", "count")

    def finish(grp, t, known):
        w = Words(t.column("text"))
        n, h, c = (known.column(x).to_numpy() for x in ("n", "ngram", "count"))
        got = {}
        for k in range(1, order + 1):
            got[k] = np.zeros(len(w.hash), np.int64)
            at = np.flatnonzero(w.left >= k)
            keys = h[n == k].view(U64)
            if len(at) and len(keys):
                sort = np.argsort(keys)
                keys, own = keys[sort], w.grams(k)[at]
                place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                got[k][at] = np.where(keys[place] == own, c[n == k][sort][place], 0)
        return scored(t, w, got, total, order, backoff, False)

    return grouped.emit(finish, known, OUT_DDL)


def scored(t: pa.Table, w: Words, got: dict[int, np.ndarray], total: int, order: int, backoff: float, leave_out: bool) -> pa.Table:
    """Sums by text, from the counts of the n-grams that start at each word."""
    if not t.num_rows:
        return OUT.empty_table()
    score = np.zeros(len(w.hash))
    if len(score):
        if leave_out:
            got = {n: c - own_counts(w, n) for n, c in got.items()}
        words = np.maximum(total - (w.count[w.doc] if leave_out else 0), 1)
        score = np.log(np.maximum(got[1], UNSEEN) / words) + math.log(backoff) * (order - 1)
        longest = np.minimum(np.arange(len(score)) - w.first[w.doc] + 1, order)  # words of the n-gram that ends here
        for n in range(2, order + 1):
            end = np.flatnonzero(longest >= n)
            end = end[got[n][end - n + 1] > 0]
            at = end - n + 1
            score[end] = np.log(got[n][at] / got[n - 1][at]) + math.log(backoff) * (order - n)
    sums = np.bincount(w.doc, weights=score, minlength=t.num_rows)
    mean = [s / n if n else None for s, n in zip(sums.tolist(), w.count.tolist(), strict=True)]
    return pa.Table.from_arrays([t.column("doc_id"), pa.array(w.count, pa.int64()), pa.array(sums, pa.float64()), pa.array(mean, pa.float64())], schema=OUT)


def own_counts(w: Words, n: int) -> np.ndarray:
    """How often the n-gram from each position on occurs in its own text; 1 where there is no full one."""
    at = np.flatnonzero(w.left >= n)
    out = np.ones(len(w.hash), np.int64)
    _, _, where, count = distinct(mix(w.grams(n)[at] ^ mix(w.doc[at].astype(U64) + U64(1))))
    out[at] = count[where]
    return out


def corpus_words(docs: DataFrame, text: str) -> int:
    """Words in all texts; one number comes to the driver."""

    def count(batches):
        for batch in batches:
            yield pa.record_batch({"n": pa.array([sum(len((x or "").encode().split()) for x in batch.column("text").to_pylist())], pa.int64())})

    return pick(docs, text=(text, "string")).mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0


def wanted(w: Words, n: int, known: dict) -> np.ndarray:
    """Positions whose n-gram must be counted over the corpus."""
    ok = w.left >= n
    if n > 2:
        c = known[n - 1]
        ok[:-1] &= (c[:-1] > 1) & (c[1:] > 1)
    return np.flatnonzero(ok)


def counts(w: Words, upto: int, heard: pa.Table) -> dict[int, np.ndarray]:
    """Corpus counts of the n-gram from each position on, for n up to ``upto``; 1 where there is no full one."""
    out: dict[int, np.ndarray] = {}
    for n in range(1, upto + 1):
        at = wanted(w, n, out)
        out[n] = np.ones(len(w.hash), np.int64)
        if len(at):
            _, _, where, _ = distinct(w.grams(n)[at])
            out[n][at] = answers(heard, n)[where]
    return out


def corpus_counts(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Corpus counts for each n-gram of each cell."""
    _, _, where, _ = distinct(h)
    return np.bincount(where, weights=c).astype(np.int64)[where]
