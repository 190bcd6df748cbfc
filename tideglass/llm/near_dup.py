"""Near-duplicate documents: HyperMinHash registers, banded, estimated, then verified on full sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.blocks import (
    CHECK_STEP, U64, Dealt, Words, answers, distinct, mix, repeated, shingle_sets, slices, to_cells, whole_groups,
)
from tideglass.llm.common import index_of, materialise, numbered, parts, pick
from tideglass.llm.graph import components

#: 256 registers of 6 + 10 bits; 51 bands of 5: two sets with Jaccard 0.75 share no band with a probability of 1e-6.
BUCKET_BITS, ZERO_BITS, MANTISSA_BITS, BAND, BANDS = 8, 6, 10, 5, 51
REGISTERS = 1 << BUCKET_BITS
#: Registers travel to first estimates with fewer bits of both kinds, a byte each.
SHORT_ZERO_BITS, SHORT_MANTISSA_BITS = 4, 4
#: A pair whose estimate lies so many deviations below the threshold is not verified (3e-7 of pairs just at it).
DEVIATIONS = 5.0
#: Sets dealt to one group and to one hash range; bytes of sets dealt to one group; bytes of a family's block.
GROUP_ROWS, RANGE_ROWS, GROUP_BYTES, BLOCK_BYTES = 4096, 8192, 8 << 20, 4 << 20
#: Band mates that are estimated together; more of them are a family as they stand, and go to full sets.
MATES = 1024
#: Beyond this many ids rows are found by a shuffled join instead of a broadcast.
BROADCAST_IDS = 200_000
SIG_DDL = "doc_id long, n_shingles long, f1 long, f2 long, regs binary"
PAIR_DDL = "a long, b long"
SET = pa.schema([("rep", pa.int64()), ("family", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("regs", pa.binary()), ("items", pa.binary())])
SET_DDL = "rep long, family long, n long, f1 long, f2 long, regs binary, items binary"


def registers(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per set and bucket, for the least hash: its leading zeros plus 1 and the bits after them; 0: none.
    ``h`` is sorted within each set, so a bucket's least hash comes first."""
    sets = np.repeat(np.arange(len(first) - 1), np.diff(first))
    cell = sets * REGISTERS + (h >> U64(64 - BUCKET_BITS)).astype(np.int64)
    at = np.flatnonzero(np.diff(cell, prepend=-1))
    rest = (h[at] << U64(BUCKET_BITS)) | U64(1)
    zeros = np.minimum(64 - np.frexp(rest.astype(np.float64))[1], (1 << ZERO_BITS) - 2)
    mantissa = (rest << (zeros + 1).astype(U64)) >> U64(64 - MANTISSA_BITS)
    out = np.zeros((len(first) - 1) * REGISTERS, np.uint16)
    out[cell[at]] = ((zeros + 1) << MANTISSA_BITS) + mantissa.astype(np.int64)
    return out.reshape(-1, REGISTERS)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """Keys by set and band; 0 for a band without any register."""
    cut = regs[:, : BAND * BANDS].reshape(len(regs), BANDS, BAND)
    keys = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=U64) * CHECK_STEP), cut.shape[:2])
    for k in range(BAND):
        keys = mix(keys ^ cut[:, :, k].astype(U64) * U64(0x9E3779B97F4A7C15))
    return np.where(cut.any(axis=2), keys | U64(1), U64(0))


def shortened(regs: np.ndarray) -> np.ndarray:
    """The same registers in a byte each."""
    zeros = np.minimum(regs >> MANTISSA_BITS, (1 << SHORT_ZERO_BITS) - 1)
    mantissa = (regs & ((1 << MANTISSA_BITS) - 1)) >> (MANTISSA_BITS - SHORT_MANTISSA_BITS)
    return ((zeros << SHORT_MANTISSA_BITS) + mantissa).astype(np.uint8)


def chance_table(zero_bits: int, mantissa_bits: int, steps: int = 8, most: int = 64) -> np.ndarray:
    """(n + m) times the sum over register values of w^2 exp(-(n+m) x), over a grid of log2(n + m).

    A register of i - 1 leading zeros has cells of width w = 2^-(b+r+i) over its stretch of [0, 1); the least
    hashes of disjoint sets of n and m fall into one cell at x with a probability of n m w^2 exp(-(n+m) x).
    """
    both, out = 2.0 ** (np.arange(most * steps + 1) / steps), 0.0
    for i in range(1, 1 << zero_bits):
        low = 0.0 if i == (1 << zero_bits) - 1 else 2.0 ** -(BUCKET_BITS + i)
        out = out + 2.0 ** -(BUCKET_BITS + mantissa_bits + i) * (np.exp(-both * low) - np.exp(-both * 2.0 ** -(BUCKET_BITS + i - 1)))
    return out * both


#: By the type that holds a register.
CHANCE = {np.dtype(np.uint16): chance_table(ZERO_BITS, MANTISSA_BITS), np.dtype(np.uint8): chance_table(SHORT_ZERO_BITS, SHORT_MANTISSA_BITS)}


def by_chance(n: np.ndarray, m: np.ndarray, kind=np.uint16) -> np.ndarray:
    """How many registers of two disjoint sets of n and m are expected to agree."""
    n, m = np.asarray(n, float), np.asarray(m, float)
    both, table = np.maximum(n + m, 1), CHANCE[np.dtype(kind)]
    return REGISTERS * n * m / both**2 * np.interp(np.log2(both) * 8, np.arange(len(table)), table)


def estimates(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates and how many registers they rest on. Registers that differ in what they stand for agree
    by chance as often as those of disjoint sets; that is taken out."""
    used = ((x != 0) | (y != 0)).sum(axis=1)
    same = ((x == y) & (x != 0)).sum(axis=1)
    chance = by_chance(n, m, y.dtype)
    return (same - chance) / np.maximum(used - chance, 1), used


def likely(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """Pairs whose estimate is not below the similarity by over DEVIATIONS deviations."""
    est, used = estimates(x, y, n, m)
    union = np.maximum((n + m) / (1 + least), used)  # registers are drawn from it without return
    return est >= least - 0.01 - DEVIATIONS * np.sqrt(least * (1 - least) / np.maximum(used, 1) * (1 - used / union))


def fingerprints(h: np.ndarray, first: np.ndarray) -> list[pa.Array]:
    """128 bits of each set, as two columns."""
    out = []
    for salt in mix(np.arange(1, 3, dtype=U64)):
        sums = np.append(U64(0), np.cumsum(mix(h ^ salt), dtype=U64))
        out.append(pa.array((sums[first[1:]] - sums[first[:-1]]).view(np.int64)))
    return out


def packed(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def unpack(t: pa.Table, column: str, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(column).to_pylist()), dtype).reshape(-1, width)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the shingle set, and its registers."""

    def sign(batches):
        for batch in batches:
            for part in slices(batch):
                h, first = shingle_sets(Words(part.column("text"), lower=True), width)
                cols = [part.column("doc_id"), pa.array(np.diff(first), pa.int64()), *fingerprints(h, first), packed(registers(h, first))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "f1", "f2", "regs"])

    return docs.mapInArrow(sign, SIG_DDL)


def band_mates(classes: DataFrame, n: int, least: float) -> DataFrame:
    """(a, b): each class and the least one of a bucket, once for every such least one.

    A bucket has the classes that share a band, cut where their sizes leave a gap that no similar pair can span.
    Its classes hang together by these edges, and there is one a class and band at most."""
    groups = max(1, -(-n // GROUP_ROWS))
    dealt = Dealt(classes.withColumn("grp", F.pmod(F.xxhash64("rep"), F.lit(groups))), groups, 1 << max(0, n // RANGE_ROWS).bit_length(), ["rep"], n * REGISTERS * 2)

    def keyed(t: pa.Table):
        keys = band_keys(unpack(t, "regs", np.uint16, REGISTERS))
        row, key = np.nonzero(keys)[0], keys[keys != 0]
        order = np.argsort(key, kind="stable")
        return key[order], t.column("rep").to_numpy()[row[order]], t.column("n").to_numpy()[row[order]]

    def ask(grp, t, _):
        key, rep, size = keyed(t)
        return to_cells(dealt.ask(grp, 0, key, rep, size.astype(np.uint32)))

    def finish(grp, t, heard):
        if not t.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in "ab"})
        _, rep, _ = keyed(t)
        first = rep - answers(heard, 0)
        pair = np.unique(np.stack([rep, first])[:, first < rep], axis=1)
        return pa.table({"a": pair[0], "b": pair[1]})

    return dealt.emit(finish, dealt.own(dealt.emit(ask), lambda h, rep, size: below(h, rep, size, least), np.int64, np.uint32), PAIR_DDL)


def below(h: np.ndarray, rep: np.ndarray, size: np.ndarray, least: float) -> np.ndarray:
    """How far the least class of each one's bucket is below it (0, which packs well, for most)."""
    order = np.lexsort((size, h))
    key, n, new = h[order], size[order].astype(float), np.ones(len(h), bool)
    new[1:] = (key[1:] != key[:-1]) | (n[:-1] < least * n[1:] - 1e-9)
    out = np.empty(len(h), np.int64)
    out[order] = np.minimum.reduceat(rep[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    return rep - out


def close_mates(mates: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Those of the edges that estimates leave: a spanning forest of the likely pairs among the mates of each class
    (which hold all pairs that share a band with it). Classes with over MATES mates keep their edges unjudged."""
    size = mates.groupBy("b").count().filter(F.col("count") > MATES).select("b")
    size = materialise(size, "near-hot")
    many = mates.join(size, "b", "left_semi").select("a", "b")
    few = mates.join(size, "b", "left_anti")
    asked = few.select(F.col("a").alias("rep"), "b").unionByName(few.select(F.col("b").alias("rep"), "b").distinct())

    def short(batches):
        for batch in batches:
            sig = shortened(np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n"), packed(sig)], names=["rep", "n", "sig"])

    rows = asked.join(classes.select("rep", "n", "regs").mapInArrow(short, "rep long, n long, sig binary"), "rep")

    def judge(t: pa.Table) -> pa.Table:
        key, rep, n = (t.column(c).to_numpy() for c in ("b", "rep", "n"))
        cut = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), t.num_rows)
        sig = unpack(t, "sig", np.uint8, REGISTERS)
        found = [(s + x, s + y) for s, e in zip(cut[:-1], cut[1:], strict=True) if e - s > 1 for x, y in hanging(n[s:e], sig[s:e], least)]
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": rep[a], "b": rep[b]})

    rows = rows.repartition(parts(mates.sparkSession), "b").sortWithinPartitions("b", "rep")
    return rows.mapInArrow(lambda batches: whole_groups(batches, judge, ("b",)), PAIR_DDL).unionByName(many).distinct()


def hanging(n: np.ndarray, sig: np.ndarray, least: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose sizes and estimates allow the similarity."""
    left, edges = np.ones(len(n), bool), []
    for seed in range(len(n)):
        todo = [seed] if left[seed] else []
        left[seed] = False
        while todo:
            x = todo.pop()
            y = np.flatnonzero(left)
            y = y[np.minimum(n[x], n[y]) >= least * np.maximum(n[x], n[y]) - 1e-9]
            if len(y):
                y = y[likely(sig[x][None, :], sig[y], n[x], n[y], least)]
                left[y] = False
                edges += [(x, k) for k in y.tolist()]
                todo += y.tolist()
    return edges


def family_sets(docs: DataFrame, families: DataFrame, width: int) -> DataFrame:
    """The full shingle sets and registers of the classes that have band mates; equal rows once."""
    ids = families.select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    few = families.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = docs.join(F.broadcast(ids) if few else ids, "doc_id")

    def sets(batches):
        for batch in batches:
            for part in slices(batch):
                h, first = shingle_sets(Words(part.column("text"), lower=True), width)
                raw = pa.array([h[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary())
                cols = [part.column("doc_id"), part.column("family"), pa.array(np.diff(first), pa.int64()), *fingerprints(h, first), packed(registers(h, first)), raw]
                yield pa.RecordBatch.from_arrays(cols, schema=SET)

    return rows.mapInArrow(sets, SET_DDL).filter("n > 0").dropDuplicates(["rep", "f1", "f2"])


def shared_items(sets: DataFrame, least: float) -> DataFrame:
    """Each set cut down to the shingles that another set has, too, without the sets that keep too few.

    A shingle of one set alone is in no intersection. Of two similar sets each has a share of ``least`` in the
    intersection, so a set with fewer shared shingles links with nothing. Both steps are exact."""
    size = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n * 8
    groups = max(1, -(-size // GROUP_BYTES))
    dealt = Dealt(sets.withColumn("grp", F.pmod(F.xxhash64("rep", "f1"), F.lit(groups))), groups, 1 << max(0, size // (4 * GROUP_BYTES)).bit_length(), ["rep", "f1", "f2"], size)

    def keyed(t: pa.Table):
        return distinct(np.frombuffer(b"".join(t.column("items").to_pylist()), U64) & ~U64(1))

    def ask(grp, t, _):
        h, _, _, count = keyed(t)
        return to_cells(dealt.ask(grp, 0, h | (count > 1).astype(U64)))

    def finish(grp, t, heard):
        if not t.num_rows:
            return SET.empty_table()
        _, _, where, _ = keyed(t)
        n = t.column("n").to_numpy()
        keep = answers(heard, 0, bool)[where]
        items, at = np.frombuffer(b"".join(t.column("items").to_pylist()), U64), np.append(0, np.cumsum(n))
        enough = np.diff(np.append(0, np.cumsum(keep))[at]) >= least * n - 1e-9
        raw = [items[i:j][keep[i:j]].tobytes() if ok else b"" for i, j, ok in zip(at[:-1], at[1:], enough, strict=True)]
        return t.select(SET.names).set_column(SET.names.index("items"), SET.field("items"), pa.array(raw, pa.binary())).filter(pa.array(enough))

    return dealt.emit(finish, dealt.own(dealt.emit(ask), repeated), SET_DDL)


def similar(a: np.ndarray, b: np.ndarray, n: int, m: int, percent: int) -> bool:
    same = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
    return 100 * same >= percent * (n + m - same)


def spanning(n: np.ndarray, regs: np.ndarray, items: list[np.ndarray], block: np.ndarray, hub: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among some sets; with two blocks, of the links between them. ``hub`` sets
    are one component from the start.

    Sets already reached are not compared again: each one found is compared, in turn, with those not reached.
    Sizes and shared shingles must allow the similarity, then the estimate, then full sets decide."""
    least, size = percent / 100, np.array([len(x) for x in items])
    apart, at = block.min() != block.max(), np.append(0, np.cumsum(size))
    token = np.unique(np.concatenate(items), return_inverse=True)[1]
    mark, left = np.zeros(int(token.max(initial=0)) + 1, bool), ~hub
    todo, edges = np.flatnonzero(hub).tolist(), []
    for seed in range(len(n) + 1):
        while todo:
            x = todo.pop()
            y = np.flatnonzero(left & (block != block[x]) if apart else left)
            y = y[np.minimum(size[x], size[y]) * (1 + least) >= least * (n[x] + n[y]) - 1e-6]
            if len(y):
                y = y[likely(regs[x][None, :], regs[y], n[x], n[y], least)]
            if len(y):
                mark[token[at[x] : at[x + 1]]] = True
                found = mark[np.concatenate([token[at[k] : at[k + 1]] for k in y])]
                mark[token[at[x] : at[x + 1]]] = False
                same = np.add.reduceat(found, np.cumsum(size[y]) - size[y], dtype=np.int64)
                y = y[100 * same >= percent * (n[x] + n[y] - same)]
                left[y] = False
                edges += [(x, k) for k in y.tolist()]
                todo += y.tolist()
        if seed < len(n) and left[seed]:
            left[seed] = False
            todo.append(seed)
    return edges


def links(shared: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the links of every family, from blocks of about BLOCK_BYTES.

    A family of one block is one group. In a larger one every set is first compared with a hub, the set with the
    largest share of shared shingles; sets that link with it need no comparison among each other, so only the
    others are compared, block by block, with each other and with those."""
    bytes_ = F.octet_length("items") + F.octet_length("regs") + 64
    large = materialise(shared.groupBy("family").agg(F.sum(bytes_).alias("size")).filter(F.col("size") > BLOCK_BYTES), "near-large")
    spark = shared.sparkSession
    if not large.limit(1).count():
        rows, hubs = shared.withColumns({"hub": F.lit(False), "block": F.lit(0), "i": F.lit(0), "j": F.lit(0)}), None
    else:
        inside = shared.join(large.select("family"), "family", "left_semi")
        hub = inside.groupBy("family").agg(F.max(F.struct((F.octet_length("items") / F.col("n")).alias("share"), "rep", "items", "n")).alias("h"))
        hub = materialise(hub.select("family", F.col("h.rep").alias("hub_rep"), F.col("h.items").alias("hub_items"), F.col("h.n").alias("hub_n")), "near-hubs")

        def near_hub(batches):
            for batch in batches:
                x, y, n, m = (batch.column(c).to_pylist() for c in ("items", "hub_items", "n", "hub_n"))
                near = [similar(np.frombuffer(p, U64), np.frombuffer(q, U64), a, b, percent) for p, q, a, b in zip(x, y, n, m, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in SET.names), batch.column("hub_rep"), pa.array(near, pa.bool_())], names=[*SET.names, "hub_rep", "hub"])

        tried = inside.join(hub, "family").select(*SET.names, "hub_rep", "hub_items", "hub_n").mapInArrow(near_hub, f"{SET_DDL}, hub_rep long, hub boolean")
        tried = materialise(tried, "near-hub-links")
        hubs = tried.filter("hub AND rep <> hub_rep").select(F.col("hub_rep").alias("a"), F.col("rep").alias("b"))
        per = tried.groupBy("family").agg(*(F.ceil(F.coalesce(F.sum(F.when(F.col("hub") == h, bytes_)), F.lit(0)) / BLOCK_BYTES).cast("int").alias(c) for c, h in (("others", False), ("near", True))))
        own = F.xxhash64("rep", "f1")
        split = tried.join(per, "family").withColumn("block", F.when(F.col("hub"), F.col("others") + F.pmod(own, F.greatest("near", F.lit(1)))).otherwise(F.pmod(own, F.greatest("others", F.lit(1)))).cast("int"))
        to = F.when(F.col("hub"), F.col("others")).otherwise(F.col("others") + F.col("near"))
        split = split.filter("others > 0").withColumn("other", F.explode(F.sequence(F.lit(0), to - 1)))
        split = split.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        rows = shared.join(large.select("family"), "family", "left_anti").withColumns({"hub": F.lit(False), "block": F.lit(0), "i": F.lit(0), "j": F.lit(0)})
        rows = rows.unionByName(split.select(*rows.columns))

    def link(t: pa.Table) -> pa.Table:
        key = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("family", "i", "j")])
        cut = np.append(np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))), t.num_rows)
        rep, n, block = (t.column(c).to_numpy() for c in ("rep", "n", "block"))
        hub, regs = t.column("hub").to_numpy(), unpack(t, "regs", np.uint16, REGISTERS)
        items = [np.frombuffer(x, U64) for x in t.column("items").to_pylist()]
        found = [(s + x, s + y) for s, e in zip(cut[:-1], cut[1:], strict=True) if e - s > 1 for x, y in spanning(n[s:e], regs[s:e], items[s:e], block[s:e], hub[s:e], percent)]
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": rep[a], "b": rep[b]})

    wanted = rows.select("family", "i", "j", "block", "hub", "rep", "n", "regs", "items")
    wanted = wanted.repartition(parts(spark), "family", "i", "j").sortWithinPartitions("family", "i", "j", "rep")
    found = wanted.mapInArrow(lambda batches: whole_groups(batches, link, ("family", "i", "j")), PAIR_DDL)
    return found if hubs is None else found.unionByName(hubs)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Classes of documents linked by the Jaccard similarity of their sets of ``width``-word shingles.

    Returns doc_id, n_shingles, component_id (least doc_id reachable by links, itself included), kept
    (doc_id = component_id), one row an input row. Two documents are linked if 100 * intersection >=
    percent * union. Words are runs of characters other than space and \\t..\\r, A-Z in lower case.

    Equal sets are one class, whatever their number. Classes are described by HyperMinHash registers; those
    that share a band of registers, and whose collision-corrected estimates allow a link, hang together in a
    family. Each family's sets are cut down to shared shingles, and links are looked for inside it: estimates
    by all bits of the registers first, full sets then. No task
    emits more than one link a set, so nothing that is shuffled grows with the square of a family, whose
    blocks alone are compared pairwise. No pair below the threshold links. One just at it is missed only if it
    shares no band (1e-6) or its estimate is off by over five deviations (3e-7), and its ends are not joined
    by other links.

    Texts of fewer words are one shingle; null, empty and blank texts have none and link with nothing, as do
    rows with a null doc_id (their component is null, kept is true). Rows that share a doc_id are one
    document. Similarity just at the threshold links. An empty table gives an empty result; further columns,
    whatever their names, are ignored.
    """
    least = percent / 100
    rows = pick(docs, doc_id=(doc_id, "long"), text=(text, "string"))
    signed = materialise(signatures(rows, width), "near-signatures")
    real = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = real.groupBy("f1", "f2", F.col("n_shingles").alias("n")).agg(F.min(F.struct("doc_id", "regs")).alias("m"))
    classes = materialise(classes.select("f1", "f2", "n", F.col("m.doc_id").alias("rep"), "m.regs"), "near-classes")
    mates = materialise(band_mates(classes.select("rep", "n", "regs"), classes.count(), least), "near-mates")
    families = components(close_mates(mates, classes, least))
    shared = materialise(shared_items(materialise(family_sets(rows, families, width), "near-sets"), least), "near-shared")
    found = components(links(shared, percent))
    at = classes.select("f1", "f2", F.col("n").alias("n_shingles"), "rep").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    at = materialise(at.select("f1", "f2", "n_shingles", F.coalesce("component", "rep").alias("component_id")), "near-components")
    linked = real.select("doc_id", "n_shingles", "f1", "f2").join(at, ["f1", "f2", "n_shingles"])
    alone = signed.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = linked.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all their columns, that near_duplicates keeps, and one of those that repeat an id.

    Rows with a null id stay, as do null and empty texts. An empty table gives an empty result; columns and their
    names are the input's, whatever they are. Ids to drop are broadcast up to BROADCAST_IDS, else joined by shuffle.
    """
    plain, key = numbered(docs), f"c{index_of(docs, doc_id)}"
    classes = materialise(near_duplicates(docs, width, percent, doc_id, text), "near-classes")
    out = without(plain, classes.filter("NOT kept").select("doc_id").distinct(), key)
    again = classes.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    again = materialise(again, "near-repeated")
    if again.limit(1).count():
        repeated = out.join(again, F.col(key).cast("long") == F.col("doc_id"), "left_semi")
        out = without(out, again, key).unionByName(repeated.dropDuplicates([key]))
    return out.toDF(*docs.columns)


def without(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, F.col(key).cast("long") == F.col("doc_id"), "left_anti")
