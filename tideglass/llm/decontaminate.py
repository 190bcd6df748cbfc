"""Search for short benchmark items inside long documents: size-partitioned MinHash containment."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.blocks import U64, Words, shingle_sets, shingles, slices
from tideglass.llm.common import Shared, filter_rows, index_of, materialise, numbered, pick, text_bytes

#: Least hashes kept of an item, and the probability with which a containment at the threshold may be missed by them.
HASHES, MISS = 16, 1e-7
#: Items of more bytes of text than this are joined by shuffle instead of being broadcast.
ITEM_BYTES = 32 << 20
#: Bits of the filter that drops, before that join, shingles that no item has. Its size is fixed; it only saves work.
FILTER_BITS = 26
DDL = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"
OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shingles", pa.int64()), ("n_shared", pa.int64()), ("containment", pa.float64())])


def least_hits(kept: int, threshold: float) -> int:
    """How many of an item's ``kept`` hashes a document must have: fewer are found with a probability below MISS
    if it has ``threshold`` of the item's shingles, of which the least hashes are a random sample."""
    below = 0.0
    for c in range(kept):
        below += math.comb(kept, c) * threshold**c * (1 - threshold) ** (kept - c)
        if below > MISS:
            return max(1, c)
    return max(1, kept)


def enough(shared, size, threshold: float):
    return shared >= threshold * size - 1e-9


class Sketches:
    """Items by size class: in each class the least hashes of its items, and which items have them."""

    def __init__(self, h: np.ndarray, first: np.ndarray, threshold: float):
        """``h``: the items' shingle sets one after the other, sorted within each; ``first``: where each begins."""
        self.h, self.first, self.size = h, first, np.diff(first)
        kept = np.minimum(self.size, HASHES)
        self.least = np.array([least_hits(k, threshold) for k in range(HASHES + 1)])[kept]
        self.classes = []
        of_class = np.frexp(self.size.astype(float))[1]
        for c in np.unique(of_class[self.size > 0]).tolist():
            items = np.flatnonzero(of_class == c)
            at = np.repeat(first[items] - np.cumsum(kept[items]) + kept[items], kept[items]) + np.arange(int(kept[items].sum()))
            hashes, item = h[at], np.repeat(items, kept[items])
            order = np.argsort(hashes, kind="stable")
            known, start = np.unique(hashes[order], return_index=True)
            maybe = np.zeros(1 << 16, bool)
            maybe[(known & U64(0xFFFF)).astype(np.int64)] = True
            self.classes.append((known[-1], maybe, known, np.append(start, len(order)), item[order]))

    def candidates(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, item) pairs with enough hashes in common, ``h`` being shingles of documents ``doc``."""
        docs, items = [], []
        for limit, maybe, known, start, item in self.classes:
            at = np.flatnonzero(h <= limit)  # the document's sketch for this class
            at = at[maybe[(h[at] & U64(0xFFFF)).astype(np.int64)]]
            place = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
            hit = known[place] == h[at]
            key = np.unique(doc[at[hit]].astype(np.int64) * len(known) + place[hit])  # a shingle counts once
            d, place = key // len(known), key % len(known)
            many = start[place + 1] - start[place]
            own = item[np.repeat(start[place] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))]
            pair, count = np.unique(np.repeat(d, many) * len(self.size) + own, return_counts=True)
            pair = pair[count >= self.least[pair % len(self.size)]]
            docs.append(pair // len(self.size))
            items.append(pair % len(self.size))
        empty = np.zeros(0, np.int64)
        return np.concatenate([empty, *docs]), np.concatenate([empty, *items])


class Index:
    """All items, for a broadcast: arrays alone, some 20 bytes for each of their shingles."""

    def __init__(self, ids: list, texts: list, width: int, threshold: float):
        self.width, self.threshold, self.ids = width, threshold, pa.array(ids, pa.int64())
        self.sketches = Sketches(*shingle_sets(Words(pa.array(texts, pa.string()), lower=True), width), threshold)

    def contained(self, texts: pa.Array):
        """(text, item, shared shingles) for every text that holds an item."""
        h, doc = shingles(Words(texts, lower=True), self.width)
        docs, items = self.sketches.candidates(h, doc)
        order = np.argsort(docs, kind="stable")
        docs, items = docs[order], items[order]
        of_doc = np.argsort(doc, kind="stable")
        h, doc = h[of_doc], doc[of_doc]
        edges = np.append(np.flatnonzero(np.diff(docs, prepend=-1)), len(docs))
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            own = np.unique(h[np.searchsorted(doc, docs[i]) : np.searchsorted(doc, docs[i], "right")])
            for k in items[i:j].tolist():
                shared, size = overlap(self.sketches.h[self.sketches.first[k] : self.sketches.first[k + 1]], own), int(self.sketches.size[k])
                if enough(shared, size, self.threshold):
                    yield int(docs[i]), k, shared


def overlap(few: np.ndarray, many: np.ndarray) -> int:
    """How many of the distinct ``few`` are among the sorted ``many``."""
    return int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum()) if len(many) else 0


def broadcast_index(items: DataFrame, width: int, threshold: float) -> Shared:
    rows = items.select("item_id", "text").orderBy("item_id", "text").collect()
    return Shared(items.sparkSession, Index([r.item_id for r in rows], [r.text for r in rows], width, threshold))


def contained_items(
    docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.75, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """Pairs of document and item where the document holds ``threshold`` of the item's distinct shingles.

    Words are runs of characters other than space and \\t..\\r, with A-Z in lower case.
    Returns doc_id, item_id, n_shingles (of the item), n_shared and containment; one row a pair of rows.
    Items are partitioned by size. Of each its HASHES least hashes are kept; the document's sketch for a class is
    all its hashes up to the largest one kept there, so long documents and short items compare as containment
    wants it. Pairs with too few common hashes are dropped (a containment at the threshold is, with probability
    1e-7); the others are verified on exact shingle sets.

    Documents are scanned once. Items of up to ``item_bytes`` of text are broadcast, more are joined by hash.
    Fewer than ``width`` words are one shingle, none no shingle: such an item is in no document. Null and empty
    texts hold nothing. Null ids stay null; repeated rows give a row each; a containment of just ``threshold``
    counts. Empty tables give an empty result; further columns, whatever their names, are ignored.
    """
    rows = pick(docs, doc_id=(doc_id, "long"), text=(text, "string"))
    asked = pick(items, item_id=(item_id, "long"), text=(item_text, "string"))
    if text_bytes(asked) <= item_bytes:
        index = broadcast_index(asked, width, threshold)
        return rows.mapInArrow(lambda batches: search_batches(batches, index.value), DDL)
    found = joined_matches(rows, asked, width, threshold)
    pairs = rows.select("doc_id", F.md5("text").alias("tkey")).join(found, "tkey")
    pairs = pairs.join(asked.select("item_id", F.md5("text").alias("ikey")), "ikey")
    return pairs.select("doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def drop_contaminated(
    docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.75, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """The rows, with all their columns, that hold no item (see contained_items).

    Null and empty texts stay, as do all rows if there are no items; repeated rows are judged alike. Columns and
    their names are the input's, whatever they are. Nothing is shuffled where the items are broadcast.
    """
    asked = pick(items, item_id=(item_id, "long"), text=(item_text, "string"))
    column = f"c{index_of(docs, text)}"
    if text_bytes(asked) > item_bytes:
        found = joined_matches(pick(docs, text=(text, "string")), asked, width, threshold).select("tkey").distinct()
        return numbered(docs).join(found, F.md5(F.col(column).cast("string")) == F.col("tkey"), "left_anti").toDF(*docs.columns)
    index = broadcast_index(asked, width, threshold)

    def clean(batch):
        keep = np.ones(batch.num_rows, bool)
        start = 0
        for part in slices(batch, text=column):
            keep[[start + row for row, _, _ in index.value.contained(part.column(column).cast(pa.string()))]] = False
            start += part.num_rows
        return keep

    return filter_rows(docs, clean)


def search_batches(batches, index: Index):
    for batch in batches:
        for part in slices(batch):
            found = list(index.contained(part.column("text")))
            if found:
                row, item, shared = (pa.array(x, pa.int64()) for x in zip(*found, strict=True))
                size = pa.array(index.sketches.size[item.to_numpy()], pa.int64())
                share = pa.array(shared.to_numpy() / size.to_numpy())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(row), index.ids.take(item), size, shared, share], schema=OUT)


def joined_matches(rows: DataFrame, items: DataFrame, width: int, threshold: float) -> DataFrame:
    """(tkey, ikey, n_shingles, n_shared) by MD5 of text: candidates by a join of sketches, verified on full sets."""
    low = (1 << FILTER_BITS) - 1

    def sketch(batches):
        for batch in batches:
            for part in slices(batch):
                h, first = shingle_sets(Words(part.column("text"), lower=True), width)
                sets = [h[i:j] for i, j in zip(first[:-1], first[1:], strict=True)]
                cols = [part.column("ikey"), pa.array(np.diff(first), pa.int64()), pa.array([s[:HASHES].view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["ikey", "n", "sketch", "items"])

    keyed = items.filter("text IS NOT NULL").select(F.md5("text").alias("ikey"), "text").dropDuplicates(["ikey"])
    sets = materialise(keyed.mapInArrow(sketch, "ikey string, n long, sketch array<long>, items binary").filter("n > 0"), "item-sets")

    def mark(batches):
        seen = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            for x in batch.column("items").to_pylist():
                seen[(np.frombuffer(x, U64) & U64(low)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()], pa.binary())], names=["seen"])

    seen = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in sets.select("items").coalesce(8).mapInArrow(mark, "seen binary").toLocalIterator():  # of fixed size
        seen |= np.frombuffer(r.seen, np.uint8)
    known = Shared(rows.sparkSession, seen)

    def reduce(batches):
        bits = np.unpackbits(known.value).astype(bool)
        for batch in batches:
            for part in slices(batch):
                h, first = shingle_sets(Words(part.column("text"), lower=True), width)
                ok = bits[(h & U64(low)).astype(np.int64)]
                raw = [h[i:j][ok[i:j]].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("tkey"), pa.array(raw, pa.binary())], names=["tkey", "found"])

    texts = rows.filter("text IS NOT NULL").select(F.md5("text").alias("tkey"), "text").mapInArrow(reduce, "tkey string, found binary")
    texts = materialise(texts.filter("octet_length(found) > 0").dropDuplicates(["tkey"]), "item-texts")

    def hashes(batches):
        for batch in batches:
            raw = batch.column("found").to_pylist()
            size = [len(x) // 8 for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column("tkey").take(pa.array(np.repeat(np.arange(len(raw)), size))), pa.array(np.frombuffer(b"".join(raw), np.int64))], names=["tkey", "h"])

    # rows of one size class only meet hashes up to the largest kept there: the join on the hash sees to that
    posting = sets.select("ikey", F.size("sketch").alias("kept"), F.explode("sketch").alias("h"))
    need = F.element_at(F.array(*(F.lit(least_hits(k, threshold)) for k in range(1, HASHES + 1))), F.col("kept"))
    pairs = texts.mapInArrow(hashes, "tkey string, h long").join(posting, "h").groupBy("tkey", "ikey", "kept").count().filter(F.col("count") >= need)

    def verify(batches):
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("items", "found"))
            shared = np.array([overlap(np.frombuffer(x, U64), np.frombuffer(y, U64)) for x, y in zip(a, b, strict=True)], np.int64)
            out = pa.RecordBatch.from_arrays([batch.column("tkey"), batch.column("ikey"), batch.column("n"), pa.array(shared)], names=["tkey", "ikey", "n_shingles", "n_shared"])
            yield out.filter(pa.array(enough(shared, batch.column("n").to_numpy(), threshold)))

    full = pairs.select("tkey", "ikey").join(texts, "tkey").join(sets.select("ikey", "n", "items"), "ikey")
    return materialise(full.select("tkey", "ikey", "n", "items", "found").mapInArrow(verify, "tkey string, ikey string, n_shingles long, n_shared long"), "item-matches")
