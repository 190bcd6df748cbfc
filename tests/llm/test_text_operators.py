"""Operators on texts against brute force over the same rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideglass.llm import blocks, mixing, near_dup
from tideglass.llm.blocks import Words
from tideglass.llm.decontaminate import contained_items, drop_contaminated
from tideglass.llm.lm_score import lm_score, ngram_counts, score_with
from tideglass.llm.mixing import mix_sources
from tideglass.llm.near_dup import drop_near_duplicates, near_duplicates
from tideglass.llm.pii import digest, disguised, find_pii, luhn, plain, spans_of
from tideglass.llm.sharding import shard
from tideglass.llm.substring_dedup import longest_repeats, substring_dedup

SMALL = {"group_bytes": 2000, "range_bytes": 4000}


def words(text, lower=False):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def shingles(text):
    w = words(text, True)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_words_split_at_ascii_space_alone():
    texts = ["a\x85b c\x0b\x0cd", "", None, "  é  ", "x" * 5000, "ab", "ba"]
    w = Words(pa.array(texts))
    assert w.count.tolist() == [3, 0, 0, 1, 1, 1, 1] and len(set(w.hash.tolist())) == 7
    assert w.grams(2)[0] == Words(pa.array(["zz a\x85b c"])).grams(2)[1]


@pytest.mark.parametrize(("window", "fan"), [(2, 1024), (7, 1024), (20, 2), (33, 1024)])
def test_substring_dedup(corpus, window, fan, monkeypatch):
    monkeypatch.setattr(blocks, "FAN", fan)
    rows = [r for r in corpus.collect()]
    order = sorted(((math.inf if r.doc_id is None else r.doc_id), words(r.text)) for r in rows)
    first = {}
    for i, w in order:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, (math.inf, math.inf)), (i, k))
    want = Counter()
    for i, w in order:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (i, k):
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[(None if i == math.inf else i, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode())] += 1
    assert Counter(map(tuple, substring_dedup(corpus, window, **SMALL).collect())) == want


def test_longest_repeats_until_no_candidate_is_left(corpus, empty):
    texts = [(r.doc_id, words(r.text)) for r in corpus.collect()]
    want = Counter()
    seen = {n: Counter(tuple(w[k : k + n]) for _, w in texts for k in range(len(w) - n + 1)) for n in (5 << k for k in range(11))}
    for i, w in texts:
        longest = max((n for n, c in seen.items() if any(c[tuple(w[k : k + n])] > 1 for k in range(len(w) - n + 1))), default=0)
        want[i, len(w), longest] += 1
    assert len({k[2] for k in want}) > 3
    assert Counter(map(tuple, longest_repeats(corpus, 5, **SMALL).collect())) == want
    assert longest_repeats(empty).count() == 0


def backoff_want(texts, corpus, order, leave_out):
    """By brute force: words and score of each text under the counts of ``corpus``."""
    grams = [Counter(tuple(w[k : k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1)) for w in corpus]
    every = sum(grams, Counter())
    total, want = sum(map(len, corpus)), []
    for i, w in enumerate(texts):
        score = 0.0
        c = Counter({g: n - (grams[i][g] if leave_out else 0) for g, n in every.items()})
        words_ = max(1, total - len(w) * leave_out)
        for k in range(len(w)):
            for n in range(min(order, k + 1), 0, -1):
                g = tuple(w[k - n + 1 : k + 1])
                if n == 1 or c[g] > 0:
                    score += math.log((c[g] / c[g[:-1]] if n > 1 else max(c[g], 0.5) / words_) * 0.4 ** (order - n))
                    break
        want.append((len(w), round(score, 6)))
    return sorted(want)


@pytest.mark.parametrize(("order", "leave_out", "fan"), [(2, True, 1024), (3, True, 2), (4, False, 1024)])
def test_lm_score(corpus, monkeypatch, order, leave_out, fan):
    monkeypatch.setattr(blocks, "FAN", fan)
    texts = [words(r.text) for r in corpus.collect()]
    got = lm_score(corpus, order, leave_out=leave_out, **SMALL).collect()
    assert sorted((r.n_words, round(r.log_score, 6)) for r in got) == backoff_want(texts, texts, order, leave_out)


@pytest.mark.parametrize("fan", [1024, 2])
def test_unseen_texts_back_off_under_a_kept_table(spark, corpus, empty, monkeypatch, tmp_path, fan):
    monkeypatch.setattr(blocks, "FAN", fan)
    ngram_counts(corpus, 3, **SMALL).write.parquet(str(tmp_path / "counts"))
    table = spark.read.parquet(str(tmp_path / "counts"))
    texts = [words(r.text) for r in corpus.collect()]
    every = Counter(tuple(w[k : k + n]) for w in texts for n in (1, 2, 3) for k in range(len(w) - n + 1))
    assert Counter({n: sum(1 for g in every if len(g) == n) for n in (1, 2, 3)}) == Counter({r.n: r["count"] for r in table.groupBy("n").count().collect()})
    assert table.agg(F.sum("count")).first()[0] == sum(every.values())
    new = ["w1 w2 never seen w3", (" ".join(map(bytes.decode, texts[4])) + " w5 w6"), "", None, "nothing"]
    got = score_with(spark.createDataFrame(list(enumerate(new)), "doc_id long, text string"), table, 3, **SMALL).collect()
    assert sorted((r.n_words, round(r.log_score, 6)) for r in got) == backoff_want([words(x) for x in new], texts, 3, False)
    assert score_with(empty, table).count() == 0 and ngram_counts(empty).count() == 0


def test_groups_of_a_scan_are_not_written(spark, corpus, tmp_path):
    """A scan is packed again if a task is lost; anything else is kept in the shared folder. Both give the same."""
    corpus.select("doc_id", "text").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    assert blocks.replayable(docs.select("text")) and blocks.replayable(docs.filter("doc_id > 3"))
    assert not blocks.replayable(corpus) and not blocks.replayable(docs.repartition(3)) and not blocks.replayable(docs.withColumn("r", F.rand()))
    assert blocks.Grouped(docs).kept is None and blocks.Grouped(corpus).kept is not None
    one, two = (Counter((r.doc_id, r.n_words, round(r.log_score, 6)) for r in lm_score(x, **SMALL).collect()) for x in (docs, corpus))
    assert one == two
    again = docs.unionByName(docs)  # groups of one hot row fill up like others
    assert lm_score(again.filter("doc_id = 7").unionByName(docs), **SMALL).count() == docs.count() + again.filter("doc_id = 7").count()


def components(sets):
    """By brute force: least id reachable over pairs of 75 % similarity."""
    parent = {i: i for i in sets}

    def find(i):
        return i if parent[i] == i else find(parent[i])

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in ids}


def near_want(docs):
    return components({r.doc_id: shingles(r.text) for r in docs.collect() if r.doc_id is not None})


def test_near_duplicates(corpus):
    want = near_want(corpus)
    got = near_duplicates(corpus).collect()
    assert len(got) == corpus.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_duplicates_in_blocks_and_without_broadcast(corpus, monkeypatch):
    for name, value in (("BLOCK_BYTES", 5000), ("GROUP_BYTES", 8000), ("GROUP_ROWS", 16), ("RANGE_ROWS", 16), ("MATES", 5), ("BROADCAST_IDS", 0)):
        monkeypatch.setattr(near_dup, name, value)
    want = near_want(corpus)
    assert {(r.doc_id, r.component_id) for r in near_duplicates(corpus).collect() if r.doc_id is not None} == set(want.items())


def test_one_of_each_class_stays(corpus):
    want = near_want(corpus)
    got = drop_near_duplicates(corpus)
    assert got.columns == corpus.columns
    ids = [r.doc_id for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, c in want.items() if i == c) and ids.count(None) == 2


@pytest.fixture
def items(spark, corpus):
    texts = [r.text for r in corpus.filter("doc_id < 40").orderBy("doc_id").collect()]
    rows = [(k, " ".join((t or "").upper().split()[:20])) for k, t in enumerate(texts)] + [(90, None), (91, ""), (92, "one"), (93, "not there at all in any"), (0, texts[0])]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("item_bytes", [1 << 20, 1500])
def test_contained_items(corpus, items, item_bytes):
    want = Counter()
    for d in corpus.collect():
        for i in items.collect():
            a, b = shingles(d.text), shingles(i.text)
            if b and len(a & b) >= 0.75 * len(b):
                want[d.doc_id, i.item_id, len(b), len(a & b), len(a & b) / len(b)] += 1
    assert want and Counter(map(tuple, contained_items(corpus, items, item_bytes=item_bytes).collect())) == want
    bad = {k[0] for k in want}
    kept = drop_contaminated(corpus, items, item_bytes=item_bytes)
    assert kept.columns == corpus.columns
    assert {r.doc_id for r in kept.collect()} - {None} == {r.doc_id for r in corpus.collect()} - bad - {None}


def test_a_short_item_in_a_document_made_of_many(spark):
    """Sizes too unlike for signatures go through the postings."""
    rnd = random.Random(1)
    texts = [" ".join("v%d" % rnd.randrange(10**6) for _ in range(10)) for _ in range(800)]
    docs = spark.createDataFrame([(1, " ".join(texts)), (2, texts[7])], "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contained_items(docs, items).collect()}
    assert got == {(1, k) for k in range(800)} | {(2, 7)}


@pytest.mark.parametrize("most", [2000, 1])  # beyond it sources are joined by salted keys
def test_mixing(corpus, monkeypatch, most):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
    rows = corpus.collect()
    out = mix_sources(corpus, epochs=3.0)
    assert [c.lower() for c in out.columns] == ["doc_id", "text", "lang", "source", "shard", "copies", "copy", "shuffle_key"]
    n, per = len(rows), Counter(r.source for r in rows)
    weight = {s: math.sqrt(c) for s, c in per.items()}
    want = Counter()
    for r in rows:
        rate = 3.0 * n * weight[r.source] / sum(weight.values()) / per[r.source]
        key = str(r.doc_id) if r.doc_id is not None else hashlib.md5((r.text or "").encode()).hexdigest()
        u = (int(hashlib.md5(f"mix:{key}:1".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, p = 0, math.exp(-rate)
        total = p
        while total <= u:
            k += 1
            p *= rate / k
            total += p
        want[r.doc_id, r.text] += k
    assert Counter((r.doc_id, r.text) for r in out.collect()) == +want
    for part in out.select("shuffle_key", F.spark_partition_id().alias("p")).toPandas().groupby("p").shuffle_key:
        assert part[1].is_monotonic_increasing


def test_mixing_to_weights_over_a_large_mean(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "'t' AS text", "if(id < 4, 'rare', 'big') AS source")
    got = {r.source: r.n for r in mix_sources(docs, {"rare": 9.0, "big": 1.0}, epochs=20.0).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(got["rare"] - 7200) < 4 * math.sqrt(7200) and abs(got["big"] - 800) < 4 * math.sqrt(800)
    assert mix_sources(docs, {"rare": 0.0}).count() == 0


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark, corpus):
    far = spark.createDataFrame([(-1, "x"), (2**63 - 1, "y"), (-(2**63), None)], "doc_id long, text string")
    for docs, n in ((corpus.drop("Shard", "COPIES"), 24), (corpus, 3), (far, 7)):
        rows = shard(docs, n, blocks=4).collect()
        slots = {}
        for r in rows:
            raw = (r.text or "").encode()
            key = r.doc_id if r.doc_id is not None else zlib.crc32(raw)
            assert (r["size"], r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
            assert (r["shard"], r.grown_shard) == (jump(key, n), jump(key, n + 1)) and r.grown_shard in (r["shard"], n)
            slots.setdefault(r["shard"], []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == docs.count()


def test_sharding_is_balanced_and_runs_no_python(spark):
    out = shard(spark.range(24_000).selectExpr("id AS doc_id", "'t' AS text"), 24)
    n = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert len(n) == 24 and 850 < min(n) and max(n) < 1150
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_want(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[ -]", "", m[0])
        out += [(m.start(), 2, m.end())] if 12 <= len(d) <= 19 and luhn(d) else []
    return sorted(out + [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15])


def test_plain_personal_data():
    rnd = random.Random(2)
    for _ in range(20_000):
        t = "".join(rnd.choices("ab@@..--++%1 2(0)9é4", k=rnd.randint(1, 60)))
        assert sorted(plain(t)) == plain_want(t)
    assert spans_of(None) == spans_of("") == [] and len(plain("9" * 200_000)) == 0


@pytest.mark.parametrize(("text", "kind", "found"), [
    ("mail jоhn.doe (at) example [dot] com now", "email", "jоhn.doe (at) example [dot] com"), ("to john at example dot co dot uk.", "email", "john at example dot co dot uk"),
    ("plus one two three four five five five one two three four ok", "phone", "plus one two three four five five five one two three four"),
    ("x four one one one 1 1 1 1 1 1 1 1 1 1 1 1 y", "card", "four one one one 1 1 1 1 1 1 1 1 1 1 1 1"),
    ("ip one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"), ("ｊｏｅ＠ｅｘ．ｃｏｍ", "email", "ｊｏｅ＠ｅｘ．ｃｏｍ"),
    ("a­b@ex.com", "email", "a­b@ex.com"), ("é un nueve dos punto x 192.168.1.٧", "ip", "192.168.1.٧"),
])
def test_disguised_personal_data_maps_back(text, kind, found):
    assert (kind, found, False) in [(s["kind"], text[s["start"] : s["end"]], s["base"]) for s in spans_of(text)]


def test_plain_texts_have_no_further_spans(corpus):
    assert not any(disguised(t) for t in ("the dot on the map", "un deux", "look at example.com", "one two three"))
    assert find_pii(corpus).count() == corpus.count()


def test_digest_of_personal_data(spark, corpus):
    """Counts, checksum and spans of the registered query, by hand from the plain patterns."""
    rnd = random.Random(5)
    texts = ["".join(rnd.choices("ab@@..--++%1 2(0)9é4", k=rnd.randint(1, 90))) for _ in range(300)]
    texts += ["mail a.b@c.de, 192.168.0.1 and +49 (30) 1234567 or 4111 1111 1111 1111", "é😀 x@y.z joe at example dot com", "", None, "1.1.1.1" * 3]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "x@y.z"), (0, texts[0])], "doc_id long, text string").unionByName(corpus.select("doc_id", "text"))
    kinds = ("email", "ip", "card", "phone")
    want = Counter()
    for r in docs.collect():
        base = sorted((a, k, b) for a, k, b in plain_want(r.text or ""))
        every = sorted(set(base) | set(disguised(r.text or "")))
        line = [",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in found) for found in (base, every)]
        want[(r.doc_id, *(sum(k == n for _, k, _ in base) for n in range(4)), hashlib.sha256(line[0].encode()).hexdigest(), line[1])] += 1
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in digest(find_pii(docs)).collect())
    assert got == want and sum(k[1] > 0 for k in got) > 5


def test_empty_tables(spark, empty, items):
    assert not substring_dedup(empty).count() + lm_score(empty).count() + near_duplicates(empty).count() + drop_near_duplicates(empty).count()
    assert not contained_items(empty, items).count() + mix_sources(empty).count() + shard(empty).count() + find_pii(empty).count()
    assert drop_contaminated(items, items.limit(0)).count() == items.count() and contained_items(items, items.limit(0), doc_id="item_id").count() == 0


def test_estimates_are_close():
    from tideglass.llm.blocks import shingle_sets

    rnd = np.random.default_rng(0)
    base = [f"x{k}" for k in rnd.integers(0, 10**9, 3000)]
    other = [w if k % 40 else f"y{k}" for k, w in enumerate(base)]
    h, first = shingle_sets(Words(pa.array([" ".join(base), " ".join(other)])), 5)
    regs, n = near_dup.registers(h, first), np.diff(first)
    assert regs.dtype == np.uint16
    a, b = set(h[: first[1]].tolist()), set(h[first[1] :].tolist())
    est, used = near_dup.estimates(regs[:1], regs[1:], n[:1], n[1:])
    assert abs(est[0] - len(a & b) / len(a | b)) < 0.11 and used[0] == 256


@pytest.mark.parametrize("size", [40, 600, 20_000])
def test_chance_agreement_of_registers(size):
    """Short registers of disjoint sets agree as often as expected, and so do long ones (hardly ever)."""
    rnd = np.random.default_rng(size)
    short, long = [], 0
    for _ in range(60):
        h = np.sort(rnd.integers(0, 2**64, (2, size), np.uint64), axis=1)
        regs = near_dup.registers(h.ravel(), np.array([0, size, 2 * size]))
        x, y = near_dup.shortened(regs)
        assert ((x == 0) == (regs[0] == 0)).all()
        short.append(int(((x == y) & (x != 0)).sum()))
        long += int(((regs[0] == regs[1]) & (regs[0] != 0)).sum())
    want = float(near_dup.by_chance(size, size, np.uint8))
    assert abs(np.mean(short) - want) < 0.2 * want + 0.4 and long < 20


def test_buckets_are_cut_at_size_gaps():
    h = np.array([5, 5, 5, 9, 5, 9], np.uint64)
    rep, size = np.array([7, 3, 4, 1, 2, 6]), np.array([100, 76, 200, 10, 60, 10])
    assert (rep - near_dup.below(h, rep, size, 0.75)).tolist() == [2, 2, 4, 1, 2, 1]  # 60, 76 and 100 hang together, 200 does not
    assert not len(near_dup.below(h[:0], rep[:0], size[:0], 0.75))


@pytest.mark.parametrize("hubs", [False, True])
def test_spanning_forest_is_that_of_all_links(hubs):
    rnd = np.random.default_rng(4)
    base = np.sort(rnd.integers(0, 2**63, 120).astype(np.uint64))
    items = []
    for _ in range(90):
        x = base.copy()
        x[rnd.integers(0, 120, rnd.integers(0, 26))] = rnd.integers(0, 2**63, 1).astype(np.uint64)
        items.append(np.unique(x))
    first = np.append(0, np.cumsum([len(x) for x in items]))
    regs, n = near_dup.registers(np.concatenate(items), first), np.diff(first)
    block = rnd.integers(0, 2, 90)
    hub = (np.arange(90) % 30 == 0) & hubs
    for side in (block, block * 0):
        def linked(i, j, side=side):
            same = len(np.intersect1d(items[i], items[j]))
            return (side.min() == side.max() or side[i] != side[j]) and 100 * same >= 75 * (n[i] + n[j] - same)

        want = [(i, j) for i in range(90) for j in range(i) if linked(i, j) or hub[i] and hub[j]]
        got = near_dup.spanning(n, regs, items, side, hub, 75)
        assert all(linked(i, j) for i, j in got) and len(got) < 90

        def labels(edges):
            parent = np.arange(90)
            for _ in range(90):
                for i, j in edges:
                    parent[i] = parent[j] = min(parent[i], parent[j])
            return parent.tolist()

        assert labels(got + [(i, j) for i in range(90) for j in range(i) if hub[i] and hub[j]]) == labels(want)
