"""Mixing, WARC, near-duplicates, sharding, SpotSigs and components against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from glossweave.llm import common, mixing, near_dup, sharding, spotsigs, warc
from glossweave.llm.common import fresh_path, table
from glossweave.llm.components import components

from .conftest import words
from .test_text_operators import pairs_of


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        free = [s for s in names if s not in capped]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def nearest_sum(sizes, target):
    """The sum nearest to target that takes every element up to three times, whole passes first."""
    total = sum(sizes)
    full = min(3, int(target / total + 1e-9)) if total else 0
    rest, sums = target - full * total, 1  # bit x: x can be reached
    for s in sizes:
        sums |= sums << s
    return full * total + min((x for x, b in enumerate(bin(sums)[:1:-1]) if b == "1"), key=lambda x: abs(x - rest))


def near_target(sizes, taken, target):
    """Within a hundredth of the target, or as near as any choice of documents comes."""
    return abs(taken - target) <= 0.01 * target or abs(taken - target) <= abs(nearest_sum(sizes, target) - target) + 1e-6


@pytest.mark.parametrize("name", ["odd_docs", "no_docs", "documents", "skewed"])
def test_mixing(request, spark, sf, name):
    if name == "documents":
        docs = table(spark, "/root/testdata/sf0.01", "documents")
    elif name == "skewed":  # a small source of a large weight meets its cap
        docs = spark.createDataFrame([(i, words(i, 5 + i % 40), "a" if i < 5 else "b" if i < 700 else f"s{i % 7}") for i in range(1000)], "doc_id long, text string, source string")
    else:
        docs = request.getfixturevalue(name)
    rows = mixing.plan(docs).collect()
    assert len(rows) == docs.count()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, size(t)) for i, t in pairs_of(docs))
    sizes, taken, each = defaultdict(int), defaultdict(int), defaultdict(list)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.size * len(r.draws)
        each[r.source].append(r.size)
        assert len(r.draws) <= 3 and len({d["pass"] for d in r.draws}) == len(r.draws) and all(0 <= d["shard"] < 64 for d in r.draws)
    want = brute_targets(sizes) if sizes else {}
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6)
    for s in sizes:
        assert near_target(each[s], taken[s], want[s]), (s, taken[s], want[s])
    again = mixing.plan(docs.repartition(3)).collect()
    assert Counter((r.doc_id, r.size, tuple(r.draws)) for r in again) == Counter((r.doc_id, r.size, tuple(r.draws)) for r in rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == +Counter({i: sum(len(r.draws) for r in rows if r.doc_id == i) for i in {r.doc_id for r in rows}})


def test_mixing_many_sources_and_shards(spark, monkeypatch):
    """More sources than a tree deals out, more blocks than a segment holds and more levels than a step; the
    shards follow the size of the mix, are disjoint passes over blocks, and each is one partition."""
    monkeypatch.setattr(mixing, "TREE_SOURCES", 16)
    monkeypatch.setattr(mixing, "SEGMENT", 8)
    monkeypatch.setattr(mixing, "TREE_STEP", 2)
    monkeypatch.setattr(mixing, "SHARD_WORDS", 1000)
    r = random.Random(3)
    source = lambda i: None if i % 97 == 0 else "big" if i % 3 == 0 else f"s{i % 40:02d}"
    rows = [(i, words(i, r.randint(0, 40)), source(i), "x", 2) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __m_source string, __m_draw int")
    got = mixing.plan(docs).collect()
    sizes, taken, in_shard = Counter(), Counter(), Counter()
    for x in got:
        sizes[x.source] += x.size
        taken[x.source] += x.size * len(x.draws)
        in_shard.update({d.shard: x.size for d in x.draws})
    want = brute_targets(sizes)
    each = {s: [x.size for x in got if x.source == s] for s in sizes}
    assert all(near_target(each[s], taken[s], want[s]) for s in sizes) and all(math.isclose(x.target, want[x.source], rel_tol=1e-9) for x in got)
    levels = math.ceil(math.log2(sum(want.values()) / 1000))
    in_shard = Counter()
    for x in got:
        for d in x.draws:
            in_shard[d.shard] += x.size
    assert levels == 5 and set(in_shard) == set(range(32)) and max(in_shard.values()) < 2.5 * sum(in_shard.values()) / 32
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    placed = mixed.select("doc_id", F.spark_partition_id().alias("p")).collect()
    by_shard = Counter((x.doc_id, d.shard) for x in got for d in x.draws)
    assert Counter((x.doc_id, x.p) for x in placed) == by_shard


def test_mixing_chooses_the_nearest_documents(spark):
    """A document too long for the rest keeps no other out; subsets of few are all tried, of many the best of the
    longest first from any place."""
    r = random.Random(5)
    cases = [[5184, 900, 800, 700, 61, 40, 12], [7], [100, 100, 100], [3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41]]
    cases += [sorted((r.randint(1, 5000) for _ in range(n)), reverse=True) for n in (13, 40)] + [sorted((r.randint(1, 300) for _ in range(256)), reverse=True)]
    rows = [(i, [(s, h) for h, s in enumerate(c)], share * sum(c)) for i, c in enumerate(cases) for share in (0.0, 0.03, 0.3, 0.71, 0.99)]
    df = spark.createDataFrame(rows, "i int, pool array<struct<s:long,h:long>>, gap double")
    for x in df.select("*", mixing.nearest(F.col("pool"), F.col("gap")).alias("ids")).collect():
        assert len(set(x.ids)) == len(x.ids)
        got, best = sum(cases[x.i][h] for h in x.ids), nearest_sum(cases[x.i], x.gap)
        assert abs(got - x.gap) <= abs(best - x.gap) + (0 if len(cases[x.i]) <= 12 else 0.01 * x.gap) + 1e-6


def test_mixing_with_more_shards_than_partitions(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUPS", 4)
    docs = spark.createDataFrame([(i, words(i, 10), f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    want = Counter((r.doc_id, d.shard // 2) for r in mixing.plan(docs, 3).collect() for d in r.draws)
    mixed = mixing.mix(docs, 3)
    assert mixed.rdd.getNumPartitions() == 4 and Counter((r.doc_id, r.p) for r in mixed.select("doc_id", F.spark_partition_id().alias("p")).collect()) == want


def test_splitting_tree_keeps_quotas(spark):
    quotas = {r: q for r, q in enumerate([1000, 10, 555, 0, 100_000, 1], 1)}
    df = spark.createDataFrame(list(quotas.items()), "rank long, quota long")
    rows = mixing.shard_quotas(df, 4, 9).collect()
    by_rank, by_shard = Counter(), Counter()
    for r in rows:
        by_rank[r["rank"]] += r.n
        by_shard[r.shard] += r.n
        assert r.n >= 0
    assert all(by_rank[r] == q for r, q in quotas.items())
    assert len(by_shard) == 16 and max(by_shard.values()) - min(by_shard.values()) <= 1


def test_hypergeometric_law(spark):
    """Chi-square of 20,000 inversions at evenly spaced uniforms, and exact support at the ends."""
    total, good, draws, n = 60, 25, 20, 20_000
    u = (F.col("id") + 0.5) / n
    df = spark.range(n).select(mixing.hypergeometric(F.lit(total), F.lit(good), F.lit(draws), u).alias("x"))
    got = {r.x: r["count"] for r in df.groupBy("x").count().collect()}
    for x in range(21):
        p = math.comb(good, x) * math.comb(total - good, draws - x) / math.comb(total, draws)
        assert abs(got.get(x, 0) - n * p) <= 2
    edge = spark.range(1).select(
        *(mixing.hypergeometric(F.lit(a), F.lit(b), F.lit(c), F.lit(0.7)).alias(k) for k, a, b, c in (("all", 9, 9, 4), ("none", 9, 0, 4), ("zero", 0, 0, 0), ("full", 9, 4, 9)))
    ).first()
    assert (edge.all, edge.none, edge.zero, edge.full) == (4, 0, 0, 4)


def brute_pages(rows):
    first = {}
    for i, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, h in rows:
        b = (h or "").encode()
        ref = first.get(h or "") if len(b) >= 100 and first.get(h or "", i) != i else None
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if ref is None else "revisit", ref))
    return Counter(out)


def test_warc(spark):
    big, same = "<p>" + words(1, 40_000) + "</p>", "<html>é " + words(2, 60)
    rows = [(3, "http://a/1", same), (1, "http://a/2", same), (2, None, same), (9, "http://b\r\nX: 1", "short"), (8, "http://b", "short"), (5, "u", None), (None, "u", same), (6, "u", ""), (7, "u", big), (7, "u", big), (4, "u", big + "\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, digest string, offset int")
    got = warc.round_trip(pages)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()) == brute_pages([(i, h) for i, _, h in rows])
    assert warc.round_trip(pages.limit(0)).count() == 0
    index = warc.write(pages)
    back = {(r.page_id, r.payload_digest): bytes(r.payload).decode() for r in warc.read(index.where("page_id = 7 or page_id = 9")).collect()}
    assert sorted(back.values(), key=len) == ["short", big]


def test_warc_archives_are_kept(spark, tmp_path):
    """Archives and index below a path can be read in another session; ids are unique and revisits name them."""
    import gzip

    same = "<html>" + words(2, 60)
    rows = [(i % 40, f"http://h/{i % 40}", same if i % 3 else words(i, 30)) for i in range(120)] + [(None, "u", same)]
    out = f"file://{tmp_path}/warc"
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), out=out)
    index = warc.read_index(spark.newSession(), out)
    want = brute_pages([(i, h) for i, _, h in rows])
    found = warc.read(index).collect()
    assert Counter((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in found) == Counter((i, d, t, ref) for (i, _, d, t, ref), n in want.items() for _ in range(n))
    raw = b"".join(gzip.open(p).read() for p in (tmp_path / "warc").glob("*.warc.gz"))
    ids, heads = re.findall(rb"WARC-Record-ID: (\S+)", raw), raw.split(b"WARC/1.1\r\n")[1:]
    assert len(ids) == len(set(ids)) == len(rows)
    kind = {re.search(rb"WARC-Record-ID: (\S+)", h)[1]: (re.search(rb"WARC-Type: (\w+)", h)[1], re.search(rb"X-Page-Id: (\d+)", h), re.search(rb"Target-URI: (\S+)", h)[1]) for h in heads}
    revisits = [h for h in heads if b"WARC-Type: revisit" in h]
    assert len(revisits) == sum(n for r, n in want.items() if r[3] == "revisit")
    for h in revisits:
        of, page, uri = kind[re.search(rb"WARC-Refers-To: (\S+)", h)[1]]
        assert of == b"response" and page[1] == re.search(rb"X-Refers-To-Page-Id: (\d+)", h)[1] and uri == re.search(rb"WARC-Refers-To-Target-URI: (\S+)", h)[1]


def test_warc_all_pages(spark, sf):
    pages = table(spark, sf, "pages")
    doubled = pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 1000))
    rows = [(r.page_id, r.html) for r in doubled.collect()]
    got = warc.round_trip(doubled).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute_pages(rows)


@pytest.mark.parametrize("heavy", [2, 1 << 16])
def test_warc_of_a_hot_payload(spark, monkeypatch, heavy):
    """One payload on half of the pages, dealt over many parts; another that stays whole; with few heavy keys and many."""
    monkeypatch.setattr(common, "HEAVY", heavy)
    monkeypatch.setattr(warc, "HOT", 5)
    monkeypatch.setattr(warc, "HOT_BYTES", 4000)
    hot, warm = "<html>" + words(2, 80), "<p>" + words(3, 50)
    rows = [(200 - i, hot if i % 2 else warm if i % 20 == 0 else words(i, 30)) for i in range(200)] + [(1, hot), (1, hot), (None, hot), (None, warm)]
    pages = spark.createDataFrame([(i, f"http://h/{i}", h, j) for j, (i, h) in enumerate(rows)], "page_id long, url string, html string, parts int").repartition(6)
    got = warc.round_trip(pages).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute_pages(rows)


@pytest.mark.parametrize("key_type", ["long", "binary"])
def test_dealt_join(spark, monkeypatch, key_type):
    """Keys that weigh much, null and unmatched keys among them, give the rows of a plain join."""
    keys = [*[1] * 50, *[2] * 9, 3, 4, None]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long").withColumn("k", F.col("k").cast("string").cast(key_type))
    one = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (9, "z")], "k long, parts string").withColumn("k", F.col("k").cast("string").cast(key_type))
    weights = rows.groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    hot = common.heavy(weights, "c", 5)
    assert sorted(r.c for r in hot.collect()) == [9, 50]
    monkeypatch.setattr(common, "HEAVY", 2)
    assert [r.c for r in common.heavy(weights, "c", 5).collect()] == [50]
    for how in ("inner", "left"):
        got = common.dealt_join(rows, one, "k", hot.withColumn("parts", F.ceil(F.col("c") / 4)), "i", how)
        assert sorted(map(str, got.select("i", "parts").collect())) == sorted(map(str, rows.join(one, "k", how).select("i", "parts").collect()))
    assert common.heavy(weights.limit(0), "c", 5).count() == 0


def test_ranges(monkeypatch):
    monkeypatch.setattr(warc, "GAP", 10)
    monkeypatch.setattr(warc, "READ_BYTES", 100)
    assert warc.ranges([(0, 30), (35, 30), (90, 20), (111, 500)]) == [(0, 65, [0, 1]), (90, 110, [2]), (111, 611, [3])]


def brute_near(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        w = tuple(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
        own = {w[j : j + k] for j in range(len(w) - k + 1)} if len(w) >= k else ({w} if w else set())
        sets.setdefault(i, own)
    ids, parent = list(sets), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(ids[a]), root(ids[b])))
                parent[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def family(n, seed=3):
    """A base, copies with few and with many changes, a chain of small changes, exact copies."""
    r, base = random.Random(seed), words(seed, 200).split()
    out = [(0, " ".join(base))]
    for i in range(1, n):
        w = list(base)
        for _ in range(r.choice((0, 2, 5, 9, 12, 30))):
            w[r.randrange(len(w))] = words(r.random(), 1)
        out.append((i, " ".join(w)))
    link = list(base)
    for i in range(n, n + 12):
        for _ in range(4):
            link[r.randrange(len(link))] = words(r.random(), 1)
        out.append((i, " ".join(link)))
    return out


@pytest.mark.parametrize("rounds", [0, 2])
@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, monkeypatch, rounds, k):
    """Small blocks, salts and chunks of pairs, so that a family needs several of each."""
    monkeypatch.setattr(near_dup, "ROUNDS", rounds)
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    monkeypatch.setattr(near_dup, "HOT", 8)
    monkeypatch.setattr(near_dup, "PAIRS", 50)
    rows = family(80)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.link(docs, k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(rows, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("shingles", [1, 300])
def test_near_duplicates_in_blocks_cut_by_length(spark, monkeypatch, shingles):
    """Blocks of some shingles: a text longer than that meets each other member by itself."""
    monkeypatch.setattr(near_dup, "ROUNDS", 0)
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", shingles)
    rows = family(12)
    rows += [(1000 + i, words(7, 3000) + " " + words(70 + i, 9)) for i in range(4)]
    got = near_dup.link(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(rows, 2)


def test_near_duplicates_of_documents(spark, sf):
    docs = table(spark, sf, "documents")
    got = near_dup.link(docs, 2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(pairs_of(docs), 2)


def test_near_duplicates_edges(spark, odd_docs, no_docs):
    got = {}
    for r in near_dup.link(odd_docs, 2).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert got[7] == [(0, 7, True)] and got[8] == [(0, 8, True)] and got[14] == [(0, 14, True)]
    assert got[12][0][1:] == (11, False) and got[13][0][1:] == (11, False) and len(got[11]) == 2
    assert (0, None, True) in got[None]
    assert near_dup.link(no_docs, 2).count() == 0 and near_dup.keep_one(no_docs).count() == 0
    kept = near_dup.keep_one(odd_docs, 2)
    assert kept.columns == odd_docs.columns and not {12, 13} & {r.doc_id for r in kept.collect()}
    only_null = spark.createDataFrame([(None, words(1, 30)), (None, words(1, 30)), (None, words(1, 29) + " x")], "doc_id long, text string")
    assert {(r.component_id, r.kept) for r in near_dup.link(only_null, 2).collect()} == {(None, True)}


def brute_rows(rows, k):
    """Component of each row (id, text), rows being linked by their sets: the smallest id that is not null."""
    sets = dict(enumerate(t for _, t in rows))
    root = {i: c for i, (_, c) in brute_near(sets.items(), k).items()}
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root[i]] = min(doc_id, least.get(root[i], doc_id))
    return [least.get(root[i]) for i in range(len(rows))]


@pytest.mark.parametrize(("rounds", "k"), [(0, 2), (2, 5)])
def test_near_duplicates_of_repeated_and_missing_ids(spark, monkeypatch, rounds, k):
    """Ids that occur with different texts lose no link, and rows without id are linked and go like others."""
    monkeypatch.setattr(near_dup, "ROUNDS", rounds)
    a, b, c, d = (words(i, 120) for i in (41, 42, 43, 44))
    near = lambda t, n=1: t + " " + words(90 + n, n)
    rows = [(5, a), (5, b), (9, near(a)), (9, near(a)), (None, near(a, 2)), (None, near(b)), (3, near(b, 2)), (7, c), (7, c), (None, c), (None, d), (None, d), (None, near(d)), (None, None), (None, " "), (8, None), (8, ""), (6, "lone text")]
    docs = spark.createDataFrame([(*r, j) for j, r in enumerate(rows)], "doc_id long, text string, doc_key int")
    want = brute_rows(rows, k)
    assert want[:7] == [5, 3, 5, 5, 5, 3, 3]
    got = Counter((r.doc_id, r.n_shingles > 0, r.component_id, r.kept) for r in near_dup.link(docs, k).collect())
    assert got == Counter((i, bool((t or "").split()), w, w is None or i == w) for (i, t), w in zip(rows, want, strict=True))
    kept = sorted(r.doc_key for r in near_dup.keep_one(docs, k).collect())
    lone = [j for j, (i, t) in enumerate(rows) if not (t or "").split()]
    of_d = [j for j in (10, 11, 12) if j in kept]
    assert sorted(j for j in kept if j not in (10, 11, 12)) == sorted({0, 6, 7, 8, 17, *lone})
    assert of_d in ([10, 11], [12])  # one text of those without any id


def test_hot_bucket_pairs(spark):
    """survivors() against all pairs: members of one bucket that are apart, in one block and in many."""
    import pandas as pd

    base = np.random.default_rng(5).integers(0, 1 << 62, 900, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[i * 7 :], base[: i * 3] + np.uint64(i + 1)])) for i in range(40)]
    regs = near_dup.sketch(sets)
    rows = pd.DataFrame({"node": range(40), "n": [len(x) for x in sets], "label": [i // 2 for i in range(40)], "regs": [r.astype(">u2").tobytes() for r in regs]})
    bands = regs.reshape(40, near_dup.BANDS, near_dup.ROWS)
    blocks = []
    for band in range(near_dup.BANDS):
        for value in {tuple(b) for b in bands[:, band]}:
            mine = rows[(bands[:, band] == value).all(1)]
            main = mine["label"].value_counts().idxmax()
            is_main = mine["label"] == main
            blocks.append(mine.assign(bucket=len(blocks), band=band, ub=0, vb=0, is_main=is_main, as_u=~is_main, as_v=True))
    got = near_dup.survivors(pd.concat(blocks), 80)
    pairs = [tuple(sorted((u, v))) for u, vs in zip(got["node"], got["partners"], strict=True) if vs is not None for v in vs]
    held = got.groupby("bucket")["node"].agg(set)
    assert all(v in held[b] for b, vs in zip(got["bucket"], got["partners"], strict=True) if vs is not None for v in vs)  # their texts are in the block
    assert len(pairs) == len(set(pairs))
    true = {(i, j) for j in range(40) for i in range(j) if near_dup.similar(sets[i], sets[j], 80) and i // 2 != j // 2 and (bands[i] == bands[j]).all(1).any()}
    assert true and true <= set(pairs)


def test_sketch():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 1 << 62, 4000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:3600], r.integers(0, 1 << 62, 400, dtype=np.uint64)]))
    one = near_dup.sketch([a, b, np.union1d(a, b), a[:1], a[:0]])
    assert (near_dup.mergeable(one[0], one[1]) == one[2]).all() and not one[4].any()
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    best, out = near_dup.estimate(one[0], one[1], len(a), len(b), 0.8)
    assert abs(best - j) < 0.1 and not out
    far = near_dup.sketch([np.unique(r.integers(0, 1 << 62, 3000, dtype=np.uint64))])[0]
    assert near_dup.estimate(one[0], far, len(a), 3000, 0.8)[1]


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, 2000 + i) for i in range(300)]
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    assert got == {x: root(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shard_store(spark, odd_docs):
    docs = spark.createDataFrame([(i, words(i, 200), "s") for i in range(400)], "doc_id long, text string, __group string").repartition(8)
    store = sharding.ShardStore(spark, fresh_path(spark, "store"), 60_000)
    assert store.versions() == [] and store.manifest() is None
    for part in range(3):
        assert store.append(docs.where(f"doc_id % 3 = {part}")) == part + 1
    before = store.manifest().collect()
    last = store.compact_all()
    after = store.manifest().collect()
    assert len(after) < len(before) and sum(r.docs for r in after) == sum(r.docs for r in before) == 400
    assert all(r.bytes < 2.5 * 60_000 for r in after)
    assert sorted(r.doc_id for r in store.read().collect()) == list(range(400))
    assert store.read().columns == ["doc_id", "text", "__group", "__sh_shard"]
    assert store.read(2).count() == sum(1 for i in range(400) if i % 3 < 2)  # older versions can be read
    with pytest.raises(Exception, match="exist"):
        store._commit(store.manifest(), last)  # another writer was first
    assert store.vacuum() > 0 and store.versions() == [last] and store.read().count() == 400


def test_shards_are_bounded_by_bytes(spark):
    """Long documents among short ones: arrivals stay under the target unless a document alone is longer,
    tiers merge up to it, and shards of a larger target are cut."""
    target = 60_000
    rows = [(i, words(i, 12_000 if i % 50 == 7 else 3000 if i % 10 == 3 else 30), {"k": [i]}) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, meta map<string,array<long>>").repartition(3)
    size = {r[0]: len(r[1]) for r in rows}
    store = sharding.ShardStore(spark, fresh_path(spark, "store"), target)
    store.append(docs)
    held = defaultdict(list)
    for r in store.read().select("doc_id", "__sh_shard").collect():
        held[r["__sh_shard"]].append(size[r.doc_id])
    assert len(held) > 20 and all(len(v) == 1 or sum(v) <= 1.2 * target for v in held.values())
    tiers = Counter(r.group.split("-")[0] for r in store.plan().collect())
    assert tiers
    store.compact_all()
    live = store.manifest().where("docs > 0").collect()
    assert sum(r.docs for r in live) == 600 and all(r.docs == 1 or r.bytes <= 2 * target for r in live)
    assert not store.plan().collect() and sorted(r.doc_id for r in store.read().collect()) == list(range(600))
    large = sharding.ShardStore(spark, store.path + "-2", 100 * target)
    large.append(docs.coalesce(1))
    large.compact_all()
    assert max(r.bytes for r in large.manifest().collect()) > 4 * target
    again = sharding.ShardStore(spark, large.path, target)
    assert {r.parts > 1 for r in again.plan().collect() if r.group.startswith("cut")} == {True}
    again.compact_all()
    live = again.manifest().where("docs > 0").collect()
    assert all(r.docs == 1 or r.bytes <= 2 * target for r in live) and sorted(r.doc_id for r in again.read().collect()) == list(range(600))
    assert again.read().where("doc_id = 5").first().meta == {"k": [5]}
    assert again.vacuum() > 0 and again.read().count() == 600


def test_waves(spark, monkeypatch):
    """A plan of more shards than a wave takes several calls and keeps every document."""
    monkeypatch.setattr(sharding, "WAVE_SHARDS", 7)
    monkeypatch.setattr(sharding, "SLOT_SHARDS", 10)
    store = sharding.ShardStore(spark, fresh_path(spark, "store"), 40_000)
    store.append(spark.createDataFrame([(i, words(i, 100)) for i in range(300)], "doc_id long, text string").repartition(30))
    first = store.compact()
    assert first == 2 and store.plan().count() > 0
    last = store.compact_all()
    assert last > 3 and sorted(r.doc_id for r in store.read().collect()) == list(range(300)) and len(store.manifest().collect()) < 30


def test_shard_documents(spark, odd_docs, no_docs, sf):
    for docs in (odd_docs, no_docs, table(spark, sf, "documents")):
        got = sharding.shard_documents(docs, target_bytes=50_000).collect()
        want = Counter((i, None if t is None else len(t.encode()), None if t is None else hashlib.sha256(t.encode()).hexdigest()) for i, t in pairs_of(docs))
        assert Counter((r.doc_id, r.n_bytes, r.text_sha256) for r in got) == want
        by_shard = Counter(r.shard for r in got)
        assert all(by_shard[r.shard] == r.shard_docs for r in got)


def brute_spots(text):
    anchors, w = set(spotsigs.ANCHORS), re.findall(r"[^\W_]+", (text or "").lower())
    spots = set()
    for i, x in enumerate(w):
        after = [y for y in w[i + 1 : i + 1 + spotsigs.REACH] if y not in anchors][: spotsigs.CHAIN]
        if x in anchors and len(after) == spotsigs.CHAIN:
            spots.add((x, *after))
    return spots or (set(zip(w, w[1:], strict=False)) if len(w) > 1 else set(w))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("name", ["odd_docs", "no_docs", "documents"])
def test_spotsigs(request, spark, sf, monkeypatch, name):
    monkeypatch.setattr(spotsigs, "RANGE_DOCS", 3)
    monkeypatch.setattr(spotsigs, "COARSE", 4)
    monkeypatch.setattr(spotsigs, "BROADCAST_RANGES", 8)
    docs = table(spark, sf, "documents") if name == "documents" else request.getfixturevalue(name)
    rows = sorted(((i, t or "") for i, t in pairs_of(docs)), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    want = []
    for at, (i, t) in enumerate(rows):
        after = rows[(at + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        if name == "odd_docs" and re.search(r"[\x1c\x85 ̈Å]", t + edited + after):
            continue  # word classes of the two regex engines differ there; covered by the digests below
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(jaccard(brute_spots(t), brute_spots(edited)), 9), round(jaccard(brute_spots(t), brute_spots(after)), 9)))
    got = spotsigs.edited_likeness(docs).collect()
    assert len(got) == len(rows)
    have = Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got)
    assert not Counter(want) - have
    assert all(r.edited_is_near == (r.near_edited >= 0.8) and r.next_is_near == (r.near_next >= 0.8) for r in got)
    same = defaultdict(set)
    texts = defaultdict(set)
    for r in got:
        texts[r.doc_id].add(r.fingerprint)
    for i, t in rows:
        same[t] |= texts[i] if len(texts[i]) == 1 else set()
    assert all(len(v) <= 1 for v in same.values())


@pytest.mark.parametrize("hot", [3, 1024])
def test_spotsigs_pairs(spark, sf, monkeypatch, hot):
    monkeypatch.setattr(spotsigs, "HOT", hot)
    docs = table(spark, "/root/testdata/sf0.01", "documents").limit(400)
    prints = spotsigs.fingerprints(docs)
    members, pairs = spotsigs.near_pairs(prints)
    first = {}
    for r in sorted(prints.collect(), key=lambda r: r.doc_id):
        first.setdefault(tuple(r.signatures), r.doc_id)
    assert {r.doc_id: r.class_id for r in members.collect()} == {r.doc_id: first[tuple(r.signatures)] for r in prints.collect()}
    sets = [(v, set(k)) for k, v in first.items() if k]
    want = {(min(a, b), max(a, b)) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if jaccard(x, y) >= 0.8}
    assert {(r.a, r.b) for r in pairs.collect()} == want


def test_spotsigs_pairs_of_repeated_ids(spark):
    """Sets that share an id, or have none, keep their pairs apart."""
    base = "the " + " the ".join(words(i, 3) for i in range(60))
    near = base + " the last words"
    other = "the " + " the ".join(words(i, 3) for i in range(500, 560))
    rows = [(5, base), (5, other), (9, near), (None, other + " the last words"), (None, base)]
    members, pairs = spotsigs.near_pairs(spotsigs.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(5, 5), (5, 9)]  # least and greatest skip the null id
    assert Counter((r.doc_id, r.class_id) for r in members.collect()) == Counter([(5, 5), (5, 5), (9, 9), (None, None), (None, 5)])


def test_empty_store_is_refused(spark):
    store = sharding.ShardStore(spark, fresh_path(spark, "store"))
    store._commit(spark.createDataFrame([], "file string, bytes long, docs long, sealed boolean"), 1)
    with pytest.raises(PySparkException):
        store.read()


def test_columns_named_like_ours_keep_their_values(spark, tmp_path):
    """Twenty distinct values in every column whose name the store and the near-duplicate stage use on the way."""
    names = ["__sh_part", "__sh_kind", "__sh_file", "__sh_first", "__sh_parts", "__sh_name", "__sh_row", "__sh_shard", "row", "name", "at", "file", "first", "parts", "__near_drop"]
    rows = [(i, words(i, 30), *(f"{c}{i}" for c in names)) for i in range(20)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {', '.join(f'{c} string' for c in names)}")
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", 4096)
    store.append(docs.repartition(4))
    store.append(docs.limit(0))
    store.compact(force=True)
    back = store.read()
    assert back.columns == [*docs.columns, "__sh_shard_"]
    assert sorted(map(tuple, back.select(*docs.columns).collect())) == sorted(rows)
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted(rows)
