"""Removal of repeated word windows by level-wise doubling."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideglass.llm.blocks import CELL_DDL, CHECK_STEP, U64, Grouped, Words, answers, distinct, repeated, to_cells
from tideglass.llm.common import materialise

LAST = np.int64(2**63 - 1)
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def substring_dedup(docs: DataFrame, window: int = 20, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True, **sizes) -> DataFrame:
    """Remove each word covered by a ``window``-word sequence that also starts earlier.

    Earlier means a smaller doc_id, or the same document and an earlier start; windows are judged on the
    input. Words are runs of characters other than space and \\t..\\r. Returns doc_id, n_words, n_removed,
    kept_sha256 (of the kept words joined by one space) and, if asked, kept_text.

    Levels (see ``lengths``) double up to ``window``. At each shorter length a window is stood for by its
    *anchor*, the least-hashed sequence of that length inside it: equal windows have equal anchors, so a window
    that repeats has a repeated anchor at every level. Only windows whose anchors repeat at one length are looked
    at with twice that length; those that survive to the last level are compared in full, by 96 bits of hash,
    over the corpus. Where none survives a level the further ones have nothing to ask.

    A null text has no words. A null doc_id is later than all others. Of two rows with one doc_id neither is
    earlier at the same start, so repeated rows stay alike. An empty table gives an empty result; further
    columns, whatever their names, are ignored.
    """
    if window < 2:
        raise ValueError("window must be 2 at least")
    grouped = Grouped(docs, doc_id, text, **sizes)
    levels = lengths(window)

    def ask_anchors(length, before):
        def fn(grp, t, heard):
            w = Words(t.column("text"))
            h, where, many = anchors(w, alive(w, window, before, heard), window, length)
            return to_cells(grouped.ask(grp, length, h | many.astype(U64)))

        return fn

    def ask_windows(grp, t, heard):
        w = Words(t.column("text"))
        at = alive(w, window, levels[:-1], heard)
        h, first, _, _ = distinct(w.grams(window)[at])
        doc, start = place(t, w, at[first])
        return to_cells(grouped.ask(grp, window, h, w.grams(window, CHECK_STEP)[at[first]].astype(np.uint32), doc, start))

    def finish(grp, t, heard):
        w = Words(t.column("text"))
        covered = np.zeros(len(w.hash) + 1, np.int64)
        at = alive(w, window, levels[:-1], heard)
        if len(at):
            _, first, which, _ = distinct(w.grams(window)[at])
            later = answers(heard, window, bool)
            doc, start = place(t, w, at)
            same = (doc == doc[first][which]) & (start == start[first][which])
            gone = at[np.where(same, later[which], True)]
            np.add.at(covered, gone, 1)
            np.add.at(covered, gone + window, -1)
        covered = np.cumsum(covered[:-1]) > 0
        removed = np.diff(np.append(0, np.cumsum(covered))[w.first])
        shas, texts = [], []
        for i, s in enumerate(t.column("text").to_pylist()):
            words = (s or "").encode().split()
            kept = b" ".join(compress(words, ~covered[w.first[i] : w.first[i + 1]]) if removed[i] else words)
            shas.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode() if keep_text else None)
        out = [t.column("doc_id"), pa.array(w.count, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())]
        return pa.Table.from_arrays(out, schema=OUT) if t.num_rows else OUT.empty_table()

    heard = None
    for k, length in enumerate(levels[:-1]):
        got = grouped.own(grouped.emit(ask_anchors(length, levels[:k]), heard), repeated)
        heard = got if heard is None else heard.unionByName(got)
    later = grouped.own(grouped.emit(ask_windows, heard), starts_earlier, np.uint32, np.int64, np.uint32)
    out = grouped.emit(finish, later if heard is None else heard.unionByName(later), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out if keep_text else out.drop("kept_text")


def longest_repeats(docs: DataFrame, window: int = 20, doc_id: str = "doc_id", text: str = "text", **sizes) -> DataFrame:
    """How long the repeated passages of each text are: doc_id, n_words and longest, the largest of ``window``,
    twice that, four times that ... at which a sequence of so many words stands at two places of the corpus; 0 if
    none of ``window`` words does.

    A sequence of twice a length is looked at only where both its halves repeat; the loop ends at the first length
    that leaves no candidate anywhere. Null and empty texts have no words; equal rows repeat each other; an empty
    table gives an empty result; further columns, whatever their names, are ignored.
    """
    grouped = Grouped(docs, doc_id, text, **sizes)
    levels: list[int] = []
    heard = docs.sparkSession.createDataFrame([], CELL_DDL)

    def ask(length, before):
        def fn(grp, t, heard):
            w = Words(t.column("text"))
            at = extended(w, length, repeating(w, before, heard))
            h, _, _, count = distinct(w.grams(length)[at] & ~U64(1))
            return to_cells(grouped.ask(grp, length, h | (count > 1).astype(U64)))

        return fn

    while True:
        length = levels[-1] * 2 if levels else window
        asked = materialise(grouped.emit(ask(length, list(levels)), heard), "repeat-cells")
        if not asked.limit(1).count():
            break
        heard = heard.unionByName(materialise(grouped.own(asked, repeated), "repeat-answers"))
        levels.append(length)

    def finish(grp, t, heard):
        w = Words(t.column("text"))
        longest = np.zeros(t.num_rows, np.int64)
        for k in range(len(levels)):
            at = repeating(w, levels[: k + 1], heard)
            longest[w.doc[at]] = levels[k]
        return pa.table({"doc_id": t.column("doc_id"), "n_words": pa.array(w.count, pa.int64()), "longest": pa.array(longest)})

    return grouped.emit(finish, heard, "doc_id long, n_words long, longest long")


def extended(w: Words, length: int, at: np.ndarray | None) -> np.ndarray:
    """Starts of the sequences of ``length`` words both whose halves are among the repeated ones at ``at``."""
    if at is None:
        return np.flatnonzero(w.left >= length)
    have = np.zeros(len(w.hash), bool)
    have[at] = True
    at = at[w.left[at] >= length]
    return at[have[at + length // 2]]


def repeating(w: Words, levels: list[int], heard: pa.Table) -> np.ndarray | None:
    """Starts of the sequences that repeat at the last of the levels; None before the first one."""
    at = None
    for length in levels:
        at = extended(w, length, at)
        if len(at):
            _, _, where, _ = distinct(w.grams(length)[at] & ~U64(1))
            at = at[answers(heard, length, bool)[where]]
    return at


def lengths(window: int, least: int = 8) -> list[int]:
    """``window`` and its halves (rounded up) down to ``least``, shortest first: each is twice the one before it,
    or up to one word less. A length below ``least`` repeats by chance too often to be worth a pass."""
    out = [window]
    while (half := -(-out[0] // 2)) >= least:
        out.insert(0, half)
    return out


def alive(w: Words, window: int, levels: list[int], heard: pa.Table | None) -> np.ndarray:
    """Starts of the windows whose anchors repeat at all the levels answered so far."""
    at = np.flatnonzero(w.left >= window)
    for length in levels:
        if len(at):
            _, where, _ = anchors(w, at, window, length)
            at = at[answers(heard, length, bool)[where]]
    return at


def anchors(w: Words, at: np.ndarray, window: int, length: int):
    """Of the windows that start at ``at``: the distinct anchor hashes (lowest bit cleared), each window's place
    among them, and whether an anchor occurs at two positions."""
    low = w.grams(length) & ~U64(1)
    pos, have, want = np.arange(len(low)), 1, window - length + 1
    while have < want:  # the leftmost least of the next ones, doubling
        step = min(have, want - have)
        nxt, npos = np.append(low[step:], np.full(step, ~U64(0)))[: len(low)], np.append(pos[step:], np.zeros(step, np.int64))[: len(pos)]
        smaller = nxt < low
        low, pos, have = np.where(smaller, nxt, low), np.where(smaller, npos, pos), have + step
    low, pos = low[at], pos[at]
    new = np.ones(len(pos), bool)  # positions do not decrease
    new[1:] = pos[1:] != pos[:-1]
    h, _, where, count = distinct(low[new])
    return h, where[np.cumsum(new) - 1] if len(pos) else np.zeros(0, np.int64), count > 1


def place(t: pa.Table, w: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    doc = t.column("doc_id").fill_null(int(LAST)).to_numpy().astype(np.int64)
    return doc[w.doc[at]], (at - w.first[w.doc[at]]).astype(np.uint32)


def starts_earlier(h: np.ndarray, check: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether each window also starts earlier."""
    order = np.lexsort((check, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (check[order][1:] != check[order][:-1])
    at, group = np.flatnonzero(new), np.cumsum(new) - 1
    doc, start = doc[order], start[order].astype(np.int64)
    least = np.minimum.reduceat(doc, at)[group]
    begin = np.minimum.reduceat(np.where(doc == least, start, LAST), at)[group]
    late = np.empty(len(h), bool)
    late[order] = (doc > least) | (start > begin)
    return late
