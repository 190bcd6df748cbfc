"""Near-duplicate vectors through a pivot-permutation index."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.blocks import U64, mix, whole_groups
from tideglass.llm.common import Shared, index_of, materialise, numbered, parts
from tideglass.llm.graph import components

#: Pivots: this many times the root of the number of vectors, sampled; lists then grow as the root, too.
PIVOTS_PER_ROOT, FEWEST_PIVOTS = 2.0, 32
#: Sampled vectors on which the length of a prefix and the least shared count are chosen, and the recall asked for there.
TUNE_ROWS, RECALL = 1500, 0.98
PREFIXES, COUNTS = (8, 12, 16, 24, 32, 48, 64), (4, 3, 2, 1)
BLOCK = 4096
SIGNED = "vec_id long, f1 long, f2 long, dim int, raw binary"
NAMES = ["pivot", "i", "j", "block", "rep", "copies", "dim", "prefix", "raw"]
TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
POSTED = "pivot long, i int, j int, block int, rep long, copies long, dim int, prefix binary, raw binary"


def vectors_of(column: pa.Array) -> list[np.ndarray | None]:
    """Each row as a vector, None if it is null, empty, zero or has a null or non-finite component."""
    out = []
    for x in column:
        v = None
        if x.is_valid and len(x) and x.values.null_count == 0:
            v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(v).all() or not v.any():
                v = None
        out.append(v)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares then neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def pack(v: np.ndarray) -> bytes:
    """Single precision where that loses nothing, so most of the shuffle is half as large."""
    v = v + 0.0  # no negative zero
    with np.errstate(over="ignore"):
        short = v.astype(np.float32)
    return (short if (short == v).all() else v).tobytes()


def unpack(raw: list[bytes], dims: np.ndarray) -> np.ndarray:
    """Vectors of one dimension as double-precision rows."""
    d = int(dims[0])
    if all(len(r) == 4 * d for r in raw):
        return np.frombuffer(b"".join(raw), np.float32).reshape(-1, d).astype(np.float64)
    return np.stack([np.frombuffer(r, np.float32 if len(r) == 4 * d else np.float64).astype(np.float64) for r in raw])


def signed(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    def sign(batches):
        for batch in batches:
            raw = [pack(v) if v is not None else None for v in vectors_of(batch.column("embedding"))]
            dims = [0 if r is None else n for r, n in zip(raw, batch.column("embedding").value_lengths().fill_null(0).to_pylist(), strict=True)]
            prints = [(0, 0) if r is None else fingerprint(r) for r in raw]
            cols = [batch.column("vec_id"), *(pa.array([p[i] for p in prints], pa.int64()) for i in range(2)), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "f1", "f2", "dim", "raw"])

    plain = numbered(vectors)
    column = {c: F.col(f"c{index_of(vectors, c)}") for c in (vec_id, embedding)}
    return plain.select(column[vec_id].cast("long").alias("vec_id"), column[embedding].cast("array<double>").alias("embedding")).mapInArrow(sign, SIGNED)


def fingerprint(raw: bytes) -> tuple[int, int]:
    x = np.frombuffer(raw, np.uint32).astype(U64) + (np.arange(1, len(raw) // 4 + 1, dtype=U64) << U64(32))
    return tuple(int(mix(x * s).sum(dtype=U64).view(np.int64)) for s in mix(np.arange(1, 3, dtype=U64)) | U64(1))


@dataclass
class Index:
    """How vectors of one dimension are described: by their ``prefix`` nearest pivots, in order, as seen from the
    mean, so that vectors in a narrow cone still differ. Candidates share ``shared`` of them. Without pivots
    there is one list of all vectors."""

    mean: np.ndarray
    pivots: np.ndarray
    prefix: int
    shared: int

    def describe(self, x: np.ndarray, k: int | None = None) -> np.ndarray:
        """The numbers of the nearest pivots of unit vectors, nearest first; -1 where there is no pivot."""
        k = self.prefix if k is None else k
        if not k:
            return np.full((len(x), 1), -1, np.int32)
        near = (x - self.mean) @ self.pivots.T
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1).astype(np.int32)


def shared_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] == b[:, None, :]).any(axis=2).sum(axis=1)


def planted(x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs at just ``least``: from each vector some way towards the next one."""
    other = np.roll(x, 1, axis=0)
    r = other - (other * x).sum(axis=1, keepdims=True) * x
    size = np.sqrt((r * r).sum(axis=1, keepdims=True))
    ok = size[:, 0] > 1e-6
    return x[ok], least * x[ok] + math.sqrt(max(0.0, 1 - least * least)) * r[ok] / size[ok]


def fit(x: np.ndarray, want: int, least: float) -> Index:
    """Pivots from the first ``want`` sampled unit vectors, and the shortest prefix and largest shared count that
    find RECALL of the pairs planted at the threshold and of the sample's own links. If none does, the index has
    no pivots and every pair is compared."""
    mean = x.mean(axis=0)
    from_mean = x[:want] - mean
    from_mean = from_mean[np.abs(from_mean).max(axis=1) > 1e-9]
    index = Index(mean, np.zeros((0, x.shape[1])), 0, 0)
    if not len(from_mean):
        return index
    pivots, keep = unit(from_mean), np.ones(len(from_mean), bool)
    alike = (1 + least) / 2  # a pivot that close to an earlier one tells nothing new, as in a family of near copies
    for at in range(0, len(pivots), 256):
        rows = slice(at, at + 256)
        near = pivots[rows] @ pivots[: at + 256][keep[: at + 256]].T
        order = np.flatnonzero(keep[: at + 256])
        for i in range(len(near)):
            keep[at + i] = not ((near[i] >= alike) & (order < at + i) & keep[order]).any()
    index = Index(mean, pivots[keep], 0, 0)
    tune = x[:TUNE_ROWS]
    near = np.triu(tune @ tune.T, 1) >= least
    own = np.argwhere(near)
    own = own[np.random.default_rng(0).permutation(len(own))[:4000]]
    pairs = [planted(tune[:400], least), (tune[own[:, 0]], tune[own[:, 1]])]
    for k in PREFIXES:
        if k <= len(index.pivots):
            counts = [shared_counts(index.describe(a, k), index.describe(b, k)) for a, b in pairs if len(a)]
            for least_shared in COUNTS:
                if all((c >= least_shared).mean() >= RECALL for c in counts):
                    return Index(mean, index.pivots, k, least_shared)
    return Index(mean, index.pivots[:0], 0, 0)


def fit_indexes(classes: DataFrame, n: int, least: float) -> dict[int, Index]:
    """An index for each dimension, from a hash sample of PIVOTS_PER_ROOT * sqrt(n) vectors, or TUNE_ROWS if that is
    more; the driver holds no more than that many, and that many pivots are broadcast."""
    want = max(FEWEST_PIVOTS, math.ceil(PIVOTS_PER_ROOT * math.sqrt(n)))
    share = min(1.0, max(want, TUNE_ROWS) / max(1, n))
    rows = classes.filter(F.pmod(F.xxhash64("f1", "f2"), F.lit(1 << 30)) < int(share * (1 << 30))).select("f1", "f2", "dim", "raw").collect()
    out = {}
    for d in sorted({r.dim for r in rows}):
        of_dim = sorted((r.f1, r.f2, bytes(r.raw)) for r in rows if r.dim == d)
        out[d] = fit(unit(unpack([r[2] for r in of_dim], np.array([d]))), want, least)
    return out


def lists_of(prefix: np.ndarray, dim: int) -> np.ndarray:
    """List numbers by dimension and pivot; pivot -1 is the list of all vectors of the dimension."""
    return (dim << 40) + prefix.astype(np.int64) + 1


def described(batches, indexes: dict[int, Index]):
    """(rows of one dimension, their units' prefixes and lists)."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for d in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == d))
            index = indexes.get(d) or Index(np.zeros(d), np.zeros((0, d)), 0, 0)
            prefix = index.describe(unit(unpack(part.column("raw").to_pylist(), np.array([d]))))
            yield part, prefix, lists_of(prefix, d)


def counted(prefix: np.ndarray, own: int, shared: int):
    """For each row of a list: the later rows that share enough pivots with it, and no list before this one.

    ``own`` is the list's pivot. Only pivot numbers are read, through the postings of this list's other pivots."""
    rows, k = prefix.shape
    if own < 0:
        for a in range(rows):
            yield a, np.arange(a + 1, rows)
        return
    order = np.argsort(prefix.ravel(), kind="stable")
    pivots, first = np.unique(prefix.ravel()[order], return_index=True)
    posting = np.split(order // k, first[1:])
    at = np.searchsorted(pivots, prefix)
    lower, higher = (prefix < own), (prefix > own)
    for a in range(rows):
        count = np.ones(rows, np.int64)
        if shared > 1 and higher[a].any():
            count += np.bincount(np.concatenate([posting[p] for p in at[a][higher[a]]]), minlength=rows)
        ok = count >= shared
        if lower[a].any():
            ok[np.concatenate([posting[p] for p in at[a][lower[a]]])] = False
        yield a, a + 1 + np.flatnonzero(ok[a + 1 :])


def linked_in(t: pa.Table, least: float, indexes: dict[int, Index]) -> pa.Table:
    """Degrees (a, null, n) and a spanning forest (a, b, 0) of the links that belong to each list's block pair.

    A pair belongs to the least list that holds both of its vectors, so it counts once. Shared pivots are counted
    first; cosines are taken of pairs with enough of them."""
    key = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("pivot", "i", "j")])
    cut = np.append(np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))), t.num_rows)
    rep, copies, block, dims = (t.column(c).to_numpy() for c in ("rep", "copies", "block", "dim"))
    raw, prefixes = t.column("raw").to_pylist(), t.column("prefix").to_pylist()
    degree, label, edges = np.zeros(t.num_rows, np.int64), np.arange(t.num_rows), []
    for s, e in zip(cut[:-1], cut[1:], strict=True):
        if e - s < 2:
            continue
        d = int(dims[s])
        x = unit(unpack(raw[s:e], dims[s:e]))
        prefix = np.frombuffer(b"".join(prefixes[s:e]), np.int32).reshape(e - s, -1)
        apart, own, weight, name, deg = key[1, s] != key[2, s], block[s:e], copies[s:e], label[s:e], degree[s:e]
        for a, b in counted(prefix, int(key[0, s] - (d << 40) - 1), indexes[d].shared if d in indexes else 0):
            if apart:
                b = b[own[b] != own[a]]
            b = b[x[b] @ x[a] >= least] if len(b) else b
            if len(b):
                deg[a] += weight[b].sum()
                deg[b] += weight[a]
                new, at = np.unique(name[b], return_index=True)
                for k in at[new != name[a]].tolist():
                    edges.append((s + a, s + b[k]))
                name[np.isin(name, new)] = name[a]
    a, b = np.array(edges, np.int64).reshape(-1, 2).T
    some = np.flatnonzero(degree)
    return pa.table({
        "a": pa.array(np.concatenate([rep[some], rep[a]]), pa.int64()),
        "b": pa.array(np.concatenate([rep[some], rep[b]]), pa.int64(), mask=np.arange(len(some) + len(a)) < len(some)),
        "n": pa.array(np.concatenate([degree[some], np.zeros(len(a), np.int64)]), pa.int64()),
    })


def embedding_duplicates(vectors: DataFrame, least: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Classes of vectors linked by a cosine of ``least`` or more, in double precision.

    Returns vec_id, n_links (other rows linked directly), component_id (least vec_id reachable, itself
    included) and kept (vec_id = component_id), one row an input row.

    Equal vectors are one class with a count. Every class is posted in the lists of its nearest pivots; a list
    is cut into blocks of BLOCK vectors and each pair of blocks is searched on its own: pivots that two vectors
    share are counted, then cosines are taken of the pairs with enough. Links leave a task as counts and a
    spanning forest, never as all pairs. How long a prefix is and how many pivots must be shared is chosen on a
    sample (see ``fit``), so that RECALL of the links just at the threshold are found; no pair below it links.
    Data that no prefix serves are compared in full.

    Vectors that are null, empty or zero or hold null or non-finite components, and rows with a null id,
    link with nothing; vectors of different dimensions do not link with each other. Rows that share an id
    are one node, though each counts as a link. A cosine of just ``least`` links. An empty table gives an empty
    result; further columns, whatever their names, are ignored.
    """
    spark = vectors.sparkSession
    rows = materialise(signed(vectors, vec_id, embedding), "vectors")
    real = rows.filter("dim > 0 AND vec_id IS NOT NULL")
    classes = real.groupBy("f1", "f2", "dim").agg(F.min(F.struct("vec_id", "raw")).alias("m"), F.count(F.lit(1)).alias("copies"))
    classes = materialise(classes.select("f1", "f2", "dim", F.col("m.vec_id").alias("rep"), F.col("m.raw").alias("raw"), "copies"), "vector-classes")
    total = classes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)).alias("size")).first()
    fitted = fit_indexes(classes, total.n, least)
    indexes = Shared(spark, fitted)

    def count(batches):
        for _, _, lists in described(batches, indexes.value):
            at, n = np.unique(lists, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], names=["pivot", "n"])

    sizes = classes.select("rep", "dim", "raw").mapInArrow(count, "pivot long, n long").groupBy("pivot").agg(F.sum("n").alias("n"))
    blocks = Shared(spark, {r.pivot: -(-r.n // BLOCK) for r in sizes.filter(F.col("n") > BLOCK).collect()})  # a number a pivot at most

    def post(batches):
        for part, prefix, lists in described(batches, indexes.value):
            row, pivot = np.repeat(np.arange(len(lists)), lists.shape[1]), lists.ravel()
            n = np.array([blocks.value.get(p, 1) for p in pivot.tolist()], np.int64)
            rep = part.column("rep").to_numpy()
            own = (mix(rep[row].view(U64)) % n.astype(U64)).astype(np.int64)
            again = np.repeat(np.arange(len(row)), n)
            other = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
            row, pivot, own = row[again], pivot[again], own[again]
            raw, shape = part.column("raw"), pa.array([p.tobytes() for p in prefix], pa.binary())
            for k in range(0, len(row), 20_000):
                c, at = slice(k, k + 20_000), pa.array(row[k : k + 20_000])
                cols = [pivot[c], np.minimum(own[c], other[c]), np.maximum(own[c], other[c]), own[c], rep[row[c]], part.column("copies").to_numpy()[row[c]], part.column("dim").to_numpy()[row[c]]]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, y) for x, y in zip(cols, TYPES, strict=False)), shape.take(at), raw.take(at)], names=NAMES)

    posted = classes.select("rep", "copies", "dim", "raw").mapInArrow(post, POSTED)
    size = total.size * max((x.prefix for x in fitted.values()), default=1)
    posted = posted.repartition(parts(spark, size), "pivot", "i", "j").sortWithinPartitions("pivot", "i", "j")
    found = posted.mapInArrow(lambda batches: whole_groups(batches, lambda t: linked_in(t, least, indexes.value), ("pivot", "i", "j")), "a long, b long, n long")
    found = materialise(found, "vector-links")
    degrees = found.filter("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    comps = components(found.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "rep")
    at = classes.select("f1", "f2", "dim", "rep", "copies").join(degrees, "rep", "left").join(comps, "rep", "left")
    at = at.select("f1", "f2", "dim", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    at = materialise(at, "vector-components")
    linked = rows.filter("dim > 0 AND vec_id IS NOT NULL").select("vec_id", "f1", "f2", "dim").join(at, ["f1", "f2", "dim"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("dim = 0 OR vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
