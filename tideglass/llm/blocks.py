"""Vectorised word hashing and the block exchange.

Rows of single n-grams are too many to shuffle: a corpus has about one per word and order. The block
exchange packs the documents of each partition into *groups* of bounded size, lets each group reduce its
n-grams to distinct hashes (so a hot n-gram crosses the network once per group, however often it
occurs), cuts those sorted hashes into *cells* by hash range and ships a cell as one packed row. Whoever
owns a hash range answers with one small array per cell, in the order of the cell's own hashes, so the
answer needs no keys. Group and range counts follow the input's size; none of them holds more than a
bounded share. Beyond FAN ranges cells travel in two hops, through bundles of groups that merge them, so
their number grows as groups times FAN and not as the square of the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import materialise, parts, pick, text_bytes

U64 = np.uint64
WORD_STEP, GRAM_STEP, CHECK_STEP = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)
GROUP_BYTES, RANGE_BYTES = 6 << 20, 8 << 20
#: Cells that a group ships at most, and groups whose cells are merged in a bundle, where there are more ranges.
FAN = 1024


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * WORD_STEP)
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def powers(step: U64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), step, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of many texts: runs of bytes other than space and \\t..\\r.

    ``hash`` has one 64-bit value a word, ``doc`` the text it belongs to, ``left`` how many words of that
    text start at or after it, ``first`` the index of each text's first word (and the total, at the end).
    """

    def __init__(self, texts: pa.Array, lower: bool = False, most: int = 1 << 20):
        data, offs = text_buffer(texts)
        hashes, counts, at = [], [], 0
        while at < len(texts):  # texts of about ``most`` bytes at a time: the arrays by byte stay small
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            got = hashed(data[offs[at] : offs[to]], offs[at : to + 1] - offs[at], lower)
            hashes.append(got[0])
            counts.append(got[1])
            at = to
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        self.count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.first = np.append(0, np.cumsum(self.count))
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        self.left = np.repeat(self.first[1:], self.count) - np.arange(len(self.hash))

    def grams(self, n: int, step: U64 = GRAM_STEP) -> np.ndarray:
        """A hash of the n words from each position on; meaningful where ``left >= n``."""
        return mix(gram_sums(self.hash, n, step) + U64(n))


def hashed(data: np.ndarray, offs: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and the number of words of each text."""
    if lower:
        data = LOWER[data]
    inside = ~SPACE[data]
    edges = offs[(offs > 0) & (offs < len(data))]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[edges - 1] = False
    lens = np.flatnonzero(inside & ~after) + 1 - starts
    del before, after
    counts = np.diff(np.searchsorted(starts, offs))
    if not len(lens):
        return np.zeros(0, U64), counts
    at = np.cumsum(lens) - lens
    where = np.arange(int(lens.sum())) - np.repeat(at, lens)
    value = BYTE_VALUE[data[inside]] * powers(WORD_STEP, int(lens.max()))[where]
    return mix(np.add.reduceat(value, at) + lens.astype(U64)), counts


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def gram_sums(w: np.ndarray, n: int, step: U64) -> np.ndarray:
    """sum of w[i+j] * step^j for j < n, by doubling; positions past the end count as 0."""
    if n == 1:
        return w
    half, power = n // 2, powers(step, n)
    out = gram_sums(w, half, step)
    out = out + shifted(out, half) * power[half]
    return out + shifted(w, n - 1) * power[n - 1] if n % 2 else out


def shifted(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[: max(0, len(x) - by)] = x[by:]
    return out


def slices(batch: pa.RecordBatch, most: int = 2 << 20, text: str = "text"):
    """Slices of a batch with about ``most`` bytes of text each."""
    _, offs = text_buffer(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def planes(x: np.ndarray) -> bytes:
    """Bytes by significance: the shuffle's compression then drops the empty high ones."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def unplanes(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return planes(np.diff(x, prepend=U64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw, U64), dtype=U64)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, the first index of each, each input's place among them, and counts."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    at = np.flatnonzero(new)
    place = np.empty(len(s), np.int64)
    place[order] = np.cumsum(new) - 1
    return s[at], order[at], place, np.diff(np.append(at, len(s)))


def cuts(sorted_hashes: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of the hash ranges that a sorted array has; ``ranges`` is a power of two."""
    if not len(sorted_hashes):
        return []
    shift = U64(65 - ranges.bit_length())
    owner = (sorted_hashes >> shift).astype(np.int64) if ranges > 1 else np.zeros(len(sorted_hashes), np.int64)
    at = np.flatnonzero(np.diff(owner, prepend=-1))
    return list(zip(owner[at].tolist(), at.tolist(), [*at[1:].tolist(), len(owner)], strict=True))


def squeeze(raw: bytes) -> bytes:
    """Entropy-coded: the planes of deltas and counts have few bits a byte, which LZ codes alone leave."""
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def expand(raw: bytes) -> bytes:
    return pa.decompress(raw[4:], decompressed_size=int.from_bytes(raw[:4], "little"), codec="zstd", asbytes=True) if raw else raw


CELL = pa.schema([("grp", pa.int64()), ("rng", pa.int64()), ("level", pa.int32()), ("data", pa.binary())])
CELL_DDL = "grp long, rng long, level int, data binary"


def cells(grp: int, level: int, hashes: np.ndarray, ranges: int, *extra: np.ndarray) -> list[tuple]:
    """(grp, rng, level, data) for each hash range: the sorted hashes, then ``extra`` arrays, by bytes."""
    return [(grp, b, level, pack_sorted(hashes[i:j]) + b"".join(planes(x[i:j]) for x in extra)) for b, i, j in cuts(hashes, ranges)]


def to_cells(rows: list[tuple]) -> pa.Table:
    cols = [[r[i] for r in rows] for i in range(3)] + [[squeeze(r[3]) for r in rows]]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, CELL, strict=True)], schema=CELL)


def uncell(raw: bytes, *dtypes) -> list[np.ndarray]:
    """Sorted hashes and the further arrays of one cell."""
    width = [8, *(np.dtype(d).itemsize for d in dtypes)]
    n, at = len(raw) // sum(width), np.cumsum([0, *width])
    out = [unpack_sorted(raw[: 8 * n])]
    return out + [unplanes(raw[at[i + 1] * n : at[i + 2] * n], d) for i, d in enumerate(dtypes)]


def answer(x: np.ndarray) -> bytes:
    """An answer, with its kind up front: flags as bits (packbits pads, so their number goes along), else integers."""
    if x.dtype == bool:
        return squeeze(b"b" + np.uint32(len(x)).tobytes() + np.packbits(x).tobytes())
    return squeeze(b"q" + planes(x.astype(np.int64)))


def unanswer(raw: bytes) -> np.ndarray:
    raw = expand(raw)
    if raw[:1] == b"b":
        return np.unpackbits(np.frombuffer(raw, np.uint8, offset=5), count=int(np.frombuffer(raw, np.uint32, 1, 1)[0])).astype(bool)
    return unplanes(raw[1:], np.int64)


def answers(table: pa.Table, level: int, dtype=np.int64) -> np.ndarray:
    """A group's answers for one level, in the order of its own sorted hashes."""
    got = sorted((r, d) for r, v, d in zip(*(table.column(c).to_pylist() for c in ("rng", "level", "data")), strict=True) if v == level)
    return np.concatenate([unanswer(d) for _, d in got]).astype(dtype) if got else np.zeros(0, dtype)


def repeated(h: np.ndarray) -> np.ndarray:
    """Whether each hash occurs twice at least; its lowest bit tells that it does so in its own group."""
    _, _, where, _ = distinct(h >> U64(1))
    total = np.bincount(where, weights=1 + (h & U64(1)))
    return total[where] >= 2


class Dealt:
    """Rows dealt to groups by ``grp``; ``order`` names the columns that sort a group's rows, so that every
    pass sees one order. The exchange below ``rows`` is the same for every use within one query, so Spark
    shuffles the rows once."""

    def __init__(self, rows: DataFrame, groups: int, ranges: int, order: list[str], size: int):
        self.groups, self.ranges, self.order = groups, ranges, order
        self.coarse, self.tasks = min(ranges, FAN), parts(rows.sparkSession, size)
        self.rows = rows.repartition(self.tasks, "grp")

    def __getstate__(self):  # functions that run in tasks take numbers along, no tables
        return {k: v for k, v in self.__dict__.items() if not isinstance(v, DataFrame)}

    def opened(self, t: pa.Table) -> pa.Table:
        return t.sort_by([(c, "ascending") for c in self.order]).combine_chunks() if t.num_rows else t

    def emit(self, fn, heard: DataFrame | None = None, schema: str = "") -> DataFrame:
        """``fn(grp, rows, answers)`` for each group; ``heard`` has the answers."""
        opened, schema = self.opened, schema or CELL_DDL
        if heard is None:
            return self.rows.groupBy("grp").applyInArrow(lambda t: fn(grp_of(t), opened(t), None), schema)
        return self.rows.groupBy("grp").cogroup(self.by(heard, "grp")).applyInArrow(lambda t, a: fn(grp_of(t), opened(t), a), schema)

    def by(self, df: DataFrame, *keys: str):
        """Rows grouped by keys, over as many tasks as the input's bytes ask for."""
        return df.repartition(self.tasks, *keys).groupBy(*keys)

    def ask(self, grp: int, level: int, hashes: np.ndarray, *extra: np.ndarray) -> list[tuple]:
        return cells(grp, level, hashes, self.coarse, *extra)

    def own(self, asked: DataFrame, fn, *dtypes) -> DataFrame:
        """Answers to cells: ``fn(hashes, *extra) -> one answer a hash`` sees all cells of a hash range (and level).

        ``dtypes`` are those of the extra arrays. Equal hashes may come several times, from several groups."""

        def reply(t: pa.Table) -> pa.Table:
            every, ends = joined(t, dtypes)
            return replies(t, fn(*every), ends)

        if self.coarse == self.ranges:
            return self.by(asked, "rng", "level").applyInArrow(reply, CELL_DDL)

        def unmerge(t: pa.Table, got: pa.Table) -> pa.Table:
            t = t.sort_by("grp")
            every, ends = joined(t, dtypes)
            heard = np.concatenate([unanswer(d) for _, d in sorted(zip(got.column("rng").to_pylist(), got.column("data").to_pylist(), strict=True))])
            out = np.empty_like(heard)
            out[np.argsort(every[0], kind="stable")] = heard
            return replies(t, out, ends)

        asked, merged = self.bundled(asked, dtypes)
        got = self.by(merged, "rng", "level").applyInArrow(reply, CELL_DDL).withColumn("wide", F.floor(F.col("rng") / F.lit(self.ranges // self.coarse)))
        return self.by(asked, "bundle", "rng", "level").cogroup(self.by(got, "grp", "wide", "level")).applyInArrow(unmerge, CELL_DDL)

    def reduce(self, asked: DataFrame, fn, schema: str, *dtypes) -> DataFrame:
        """``fn(level, hashes, *extra) -> table`` for each hash range and level; nothing goes back to the groups."""
        rows = asked if self.coarse == self.ranges else self.bundled(asked, dtypes)[1]
        return self.by(rows, "rng", "level").applyInArrow(lambda t: fn(t.column("level")[0].as_py(), *joined(t, dtypes)[0]), schema)

    def bundled(self, asked: DataFrame, dtypes) -> tuple[DataFrame, DataFrame]:
        """The cells with their bundle; the cells of each bundle and coarse range merged and cut by fine range."""
        ranges = self.ranges

        def merge(t: pa.Table) -> pa.Table:
            every, _ = joined(t.sort_by("grp"), dtypes)
            order = np.argsort(every[0], kind="stable")
            return to_cells(cells(t.column("bundle")[0].as_py(), t.column("level")[0].as_py(), every[0][order], ranges, *(x[order] for x in every[1:])))

        asked = asked.withColumn("bundle", F.pmod(F.xxhash64("grp"), F.lit(max(1, -(-self.groups // FAN)))))
        return asked, self.by(asked, "bundle", "rng", "level").applyInArrow(merge, CELL_DDL)


def joined(t: pa.Table, dtypes) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes and extra arrays of all cells, one cell after the other, and where each cell ends."""
    cut = [uncell(expand(x), *dtypes) for x in t.column("data").to_pylist()]
    return [np.concatenate([c[i] for c in cut]) for i in range(1 + len(dtypes))], np.cumsum([len(c[0]) for c in cut])


def replies(t: pa.Table, got: np.ndarray, ends: np.ndarray) -> pa.Table:
    data = pa.array([answer(x) for x in np.split(got, ends[:-1])], pa.binary())
    return pa.Table.from_arrays([*(t.column(c).cast(CELL.field(c).type) for c in ("grp", "rng", "level")), data], schema=CELL)


class Grouped(Dealt):
    """Documents packed into groups of about ``group_bytes`` of text, each compressed. A group is cut from one
    partition: rows that repeat, however often, fill groups like any others, and only a single longer text exceeds
    one.

    All passes must see the same groups, whatever executor is lost. A plain scan gives its rows in one order every
    time, so groups of a lost task come out as they were; those of any other input are written to the shared folder."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", group_bytes: int = 0, range_bytes: int = 0):
        group_bytes, range_bytes = group_bytes or GROUP_BYTES, range_bytes or RANGE_BYTES
        rows = pick(docs, doc_id=(doc_id, "long"), text=(text, "string"))
        packed = rows.mapInArrow(lambda batches: pack(batches, group_bytes), "grp long, data binary")
        n = text_bytes(rows)
        groups, ranges = -(-n // group_bytes), 1 << max(0, n // range_bytes).bit_length()
        self.kept = None if replayable(rows) else materialise(packed, "groups")
        super().__init__(self.kept or packed, groups, ranges, [], n // 2)

    def opened(self, t: pa.Table) -> pa.Table:
        """A group's documents; it has one row, but for a group that only answers name."""
        return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in t.column("data").to_pylist()]).combine_chunks() if t.num_rows else GROUP.empty_table()

    def emit(self, fn, heard: DataFrame | None = None, schema: str = "") -> DataFrame:
        if heard is not None:
            return super().emit(fn, heard, schema)
        opened, rows = self.opened, self.kept or self.rows

        def each(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    t = pa.Table.from_batches([batch.slice(k, 1)])
                    yield from fn(grp_of(t), opened(t), None).to_batches()

        return rows.mapInArrow(each, schema or CELL_DDL)


#: Logical operators that give the same rows in the same order and partitions every time they run.
SCANNING_NODES = frozenset({"LogicalRelation", "DataSourceV2ScanRelation", "LocalRelation", "Range", "Project", "Filter", "SubqueryAlias"})


def replayable(df: DataFrame) -> bool:
    """Whether a frame is a scan of files with nothing but projections and filters above it."""
    plan = df._jdf.queryExecution().optimizedPlan()
    todo, ok = [plan], plan.deterministic()
    while todo and ok:
        p = todo.pop()
        ok = p.getClass().getSimpleName() in SCANNING_NODES
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return ok


GROUP = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def pack(batches, most: int):
    """Rows (grp, data) of documents, by id within a group (null last); groups are numbered by partition."""
    number = TaskContext.get().partitionId() << 32
    kept: list[pa.RecordBatch] = []
    size = 0

    def packed():
        nonlocal number, kept, size
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, GROUP, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(pa.Table.from_batches(kept).cast(GROUP).sort_by("doc_id").combine_chunks())
        row = pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["grp", "data"])
        number, kept, size = number + 1, [], 0
        return row

    for batch in batches:
        for part in slices(batch, min(most, 1 << 20)):
            own = int(text_buffer(part.column("text"))[1][-1]) + 16 * part.num_rows
            if kept and size + own > most:
                yield packed()
            kept.append(part)
            size += own
    if kept:
        yield packed()


def grp_of(t: pa.Table) -> int:
    return t.column("grp")[0].as_py() if t.num_rows else -1


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of every n-word shingle; a text of fewer words is one shingle, none without words."""
    at = np.flatnonzero(w.left >= n)
    hashes, docs = [w.grams(n)[at]], [w.doc[at]]
    for k in range(1, n):
        short = np.flatnonzero(w.count == k)
        if len(short):
            hashes.append(w.grams(k)[w.first[short]])
            docs.append(short)
    return np.concatenate(hashes), np.concatenate(docs)


def shingle_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, by text then hash, and where each text's begin (and the total)."""
    h, doc = shingles(w, n)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.searchsorted(doc[keep], np.arange(len(w.count) + 1))


def whole_groups(batches, fn, keys, least: int = 4096, most: int = 16 << 20):
    """Apply ``fn`` to runs of sorted batches that end where the keys change, of about ``least`` rows or ``most`` bytes."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        if sum(b.num_rows for b in kept) < least and sum(b.nbytes for b in kept) < most:
            continue
        t = pa.Table.from_batches(kept).combine_chunks()
        last = [t.column(k)[t.num_rows - 1].as_py() for k in keys]
        same = np.logical_and.reduce([t.column(k).to_numpy() == x for k, x in zip(keys, last, strict=True)])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield from fn(t.slice(0, cut)).to_batches()
            kept = t.slice(cut).to_batches()
    if kept:
        yield from fn(pa.Table.from_batches(kept).combine_chunks()).to_batches()


def forest(nodes: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Edges of a maximum spanning forest, by Boruvka rounds."""
    comp, rank, taken = np.arange(nodes), np.empty(len(a), np.int64), []
    rank[np.lexsort((a, b, weight))] = np.arange(len(a))
    edge_of = np.argsort(rank)
    while True:
        live = np.flatnonzero(comp[a] != comp[b])
        if not len(live):
            return np.unique(np.concatenate(taken)) if taken else np.zeros(0, np.int64)
        best = np.full(nodes, -1)
        np.maximum.at(best, comp[a[live]], rank[live])
        np.maximum.at(best, comp[b[live]], rank[live])
        edges = edge_of[np.unique(best[best >= 0])]
        taken.append(edges)
        while True:
            low = np.minimum(comp[a[edges]], comp[b[edges]])
            new = comp.copy()
            np.minimum.at(new, comp[a[edges]], low)
            np.minimum.at(new, comp[b[edges]], low)
            new = new[new[comp]]
            if (new == comp).all():
                break
            comp = new
