"""Feature join, token counts and lexical search against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from glossweave.llm import features, search, token_counts
from glossweave.llm.common import table

from .conftest import words
from .test_text_operators import pairs_of


def numbers(i):
    h = hashlib.sha256(str(i).encode()).hexdigest()
    return [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]


def brute_features(docs, labels):
    source, by_source = {}, defaultdict(list)
    for r in docs:
        if r.doc_id is None:
            continue
        if r.source is not None:
            source[r.doc_id] = max(source.get(r.doc_id, r.source), r.source)
            a, b, c, _ = numbers(r.doc_id)
            e = a % 50000
            by_source[r.source].append((e, -(e - 60 + b % 600), r.doc_id, e + c % 900, r.n_chars, r.lang))
    out = Counter()
    for r in labels:
        t = None if r.doc_id is None else numbers(r.doc_id)[3] % 50000
        met = [v for v in by_source.get(source.get(r.doc_id), []) if v[0] <= t and -v[1] <= t < v[3]]
        if not met:
            out[r.doc_id, t, None, None, "none", None, None] += 1
            continue
        e, _, i, _, n, lang = max(met, key=lambda v: v[:3] + (v[4] is not None, v[4] or 0, v[5] or ""))
        fresh = t - e <= 120
        out[r.doc_id, t, i, t - e, "fresh" if fresh else "stale", n if fresh else None, lang if fresh else None] += 1
    return out


def test_features(spark, sf, odd_docs, no_docs):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = features.document_features(docs, labels)
    assert got.columns == ["doc_id", "t", "version_id", "age", "status", "n_chars", "lang"]
    assert Counter(map(tuple, got.collect())) == brute_features(docs.collect(), labels.collect())
    asked = spark.createDataFrame([(1,), (1,), (None,), (404,), (8,), (11,), (3,)], "doc_id long")
    for given in (odd_docs, no_docs):
        assert Counter(map(tuple, features.document_features(given, asked).collect())) == brute_features(given.collect(), asked.collect())
    assert features.document_features(docs, labels.where("false")).count() == 0


def test_features_of_one_hot_source(spark):
    """Two thirds of the rows in one source, many versions of one second, repeated questions, names that clash."""
    docs = spark.createDataFrame([(i, "hot" if i % 3 else f"s{i % 5}", i * 7, "en" if i % 2 else None) for i in range(6000)], "doc_id long, source string, n_chars long, lang string")
    labels = spark.createDataFrame([(i % 4500, i, "x") for i in range(6000)], "doc_id long, t int, winner string").select("doc_id")
    want = brute_features(docs.collect(), labels.collect())
    assert Counter(map(tuple, features.document_features(docs, labels).collect())) == want
    assert {s for _, _, _, _, s, _, _ in want} == {"none", "fresh", "stale"}


def test_versions_that_can_never_win_go(spark):
    rows = [("k", 10, 5, 30, i) for i in range(50)] + [("k", 10, 6, 29, 99), ("k", 10, 6, 31, 7), ("k", 10, 5, 40, 3), ("k", 10, 50, 45, 1), (None, 1, 1, 9, 1), ("k", None, 1, 9, 1)]
    versions = spark.createDataFrame(rows, "key string, event long, arrival long, expiry long, id long").selectExpr("*", "struct(id as x) as payload")
    kept = {(r.arrival, r.expiry, r.best.id) for r in features.thinned(versions).collect()}
    assert kept == {(5, 30, 49), (5, 40, 3)}
    questions = spark.createDataFrame([("k", t) for t in range(0, 60)], "key string, t long")
    got = {r.t: r.winner and r.winner.id for r in features.winners(versions, questions, 30).collect()}
    assert got == {t: 49 if 10 <= t < 30 else 3 if 30 <= t < 40 else None for t in range(60)}


@pytest.fixture(scope="module")
def pieces():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=token_counts.tokenizer_path())


def library_counts(pieces, docs):
    return Counter((i, len((t or "").encode()), n := len(pieces.encode(t or "")), n > 4096) for i, t in pairs_of(docs))


def test_token_counts(spark, sf, pieces, odd_docs, no_docs):
    for docs in (table(spark, sf, "documents"), odd_docs, no_docs):
        got = token_counts.count_tokens(docs)
        assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert Counter(map(tuple, got.collect())) == library_counts(pieces, docs)


@pytest.mark.parametrize("chunk, overlap", [(40, 12), (300, 20)])
def test_token_counts_by_chunks(spark, pieces, chunk, overlap):
    """Chunks of a few characters: letters that run on, spaces that run on, bytes, special strings, the
    vocabulary's own blank, copies; texts whose borders are never stable are widened to one chunk."""
    texts = [words(i, 40 + i) for i in range(8)] + ["a" * 700, " " * 900, "xy" * 333 + " z" * 200, "▁a ▁▁ " * 120, "\x00\n\t" * 90, "日本語のテキスト😀" * 60, "<s></s><unk><0x0A>" * 40, "é̂ " * 150, "ab" + " " * 333 + "cd" * 100]
    docs = spark.createDataFrame([(i % 20, t) for i, t in enumerate(texts + texts[:3] + ["", None, "short"])], "doc_id long, text string")
    got = token_counts.count_tokens(docs, long=30, chunk=chunk, overlap=overlap)
    assert Counter(map(tuple, got.collect())) == library_counts(pieces, docs)


def test_borders_are_stable(pieces):
    """What stands on either side of a stable border is encoded on its own, whatever follows or goes before."""
    with open(token_counts.tokenizer_path(), "rb") as f:
        own = token_counts.loaded(f.read())
    text = words(3, 30) + " aaaa  bbb\n日本 x<s>é" + words(4, 20)
    n, [(at, before)] = own.borders(text, [(0, len(text))])
    assert n == len(pieces.encode(text)) and len(at) > 50
    for p, k in zip(at, before, strict=True):
        assert len(pieces.encode(text[:p])) == k


def split_terms(text):
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute_rank(docs, items, k=20):
    """docs: (doc_id, text) pairs. Rows of all items, one after the other."""
    bags = [(i, Counter(split_terms(t))) for i, t in docs]
    bags = [(i, b, b.total()) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        asked, scores = split_terms(text), []
        for i, b, n in bags:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(w[t] * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t in asked if t in b)
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return Counter(out)


def test_search(spark, sf, odd_docs, no_docs, monkeypatch):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    got = search.rank(docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert Counter(map(tuple, got.collect())) == brute_rank(pairs_of(docs), [(r.item_id, r.text) for r in items.collect()])
    asked = [(1, words(7, 100)), (1, words(7, 100)), (2, None), (3, ""), (None, "THIS line is ÅÉ 中文 own own own"), (4, "!!! ..."), (5, "nowhere"), (6, words(1, 50) + " no id 0123")]
    questions = spark.createDataFrame([(i, t, 0.5, "x") for i, t in asked], "item_id long, text string, rn double, score string")
    for block in (search.BLOCK, 1):  # all items at once, and one a block
        monkeypatch.setattr(search, "BLOCK", block)
        for k in (2, 20):
            assert Counter(map(tuple, search.rank(odd_docs, questions, k).collect())) == brute_rank(pairs_of(odd_docs), asked, k)
    assert search.rank(no_docs, questions).count() == 0 and search.rank(odd_docs, questions.limit(0)).count() == 0


def test_search_prunes_terms_and_loses_nothing(spark):
    """Words of very different frequency, ties among copies, small batches that raise the thresholds."""
    docs = [(i, " ".join([f"common{i % 2} the"] * (1 + i % 5) + [f"w{(i * j) % (7 * j)}" for j in range(1, 12)])) for i in range(800)]
    items = [(q, f"the the common0 common1 w{q} w{2 * q} w{q * q % 50} w60") for q in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert Counter(map(tuple, search.rank(df, asked, 5).collect())) == brute_rank(docs, items, 5)
    terms = search.item_terms(asked)
    indexed, n = search.measured(search.index(df, search.slots(terms)))
    plan = search.seeded(terms, search.term_statistics(indexed, n, 5)).collect()
    assert {r.term for r in plan if not r.needed} and all(r.rest < r.threshold or r.rest == 0 for r in plan)
    whole = {r.doc_id: dict(zip(r.terms, r.counts, strict=True)) for r in search.index(df).collect()}
    assert all(whole[i] == Counter(split_terms(t)) for i, t in docs)
