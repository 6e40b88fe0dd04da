"""Line dedup, language ID, quality, BPE, toxicity against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from glossweave.llm import bpe, langid, line_dedup, quality, toxicity
from glossweave.llm.common import table

from .conftest import words

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(ASCII)
    docs = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars and i is not None:
                docs[key(x)].add(i)
    last = {k: max(v) for k, v in docs.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if key(x) not in last or last[key(x)] == i]
        out.append((i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", ["odd_docs", "no_docs"])
def test_line_dedup(request, name):
    docs = request.getfixturevalue(name)
    got = line_dedup.dedup_lines(docs)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got.collect()), key=repr) == brute_lines(pairs_of(docs))


def test_line_dedup_is_reversible(spark, sf):
    docs = table(spark, sf, "documents")
    a, b = docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")
    refs = lambda index: sorted(map(tuple, index.refs.collect()))
    only_a = line_dedup.build(a, min_docs=2)
    both = line_dedup.insert(only_a, b)
    assert refs(both) == refs(line_dedup.build(docs, min_docs=2))
    back = line_dedup.delete(both, b)
    assert refs(back) == refs(only_a)
    kept = lambda index, d: sorted((r.doc_id, r.kept_sha256) for r in line_dedup.clean(index, d, with_text=False).collect())
    assert kept(back, a) == kept(only_a, a)
    assert kept(both, docs) == sorted((i, h) for i, _, _, h in brute_lines(pairs_of(docs), min_docs=2))


def test_line_index_grows_and_is_kept(spark, monkeypatch, tmp_path):
    """Filters made for few keys are built anew as documents come, shards multiply, postings of a shard are
    dealt over several tasks, and a saved index goes on in another session."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 100)
    monkeypatch.setattr(line_dedup, "TASK_POSTINGS", 64)
    line = lambda k: f"line {k} " + words(k, 12)
    doc = lambda i, ks: (i, "\n".join(map(line, ks)))
    a = [doc(i, range(20)) for i in range(6)]
    b = [doc(100 + i, range(i % 2 * 10, 1500, 1 + i % 2)) for i in range(7)]
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    small = line_dedup.build(df(a))
    before = {r.shard: len(r.table) for r in small.filters.collect()}
    grown = line_dedup.insert(small, df([doc(50, range(700))] * 2 + [doc(51 + i, range(700)) for i in range(4)]))
    assert grown.n_shards == small.n_shards == 8 and all(len(r.table) > before[r.shard] for r in grown.filters.collect() if r.shard in before)
    for index in (grown, line_dedup.insert(grown, df(b))):
        hot = [bytes(r.key) for r in index.refs.where("n_docs >= 5").collect()]
        stored = [line_dedup.CuckooFilter(raw=bytes(r.table)) for r in index.filters.collect()]
        assert sum(f.stash.total() for f in stored) < 16 and sum(np.count_nonzero(f.table) for f in stored) + sum(f.stash.total() for f in stored) == len(hot)
    assert index.n_shards > 8
    line_dedup.save(index, f"file://{tmp_path}/index")
    held = line_dedup.load(spark.newSession(), f"file://{tmp_path}/index")
    rows = a + [doc(50, range(700))] * 2 + [doc(51 + i, range(700)) for i in range(4)] + b
    again = lambda i: sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.clean(i, df(rows)).collect()), key=repr)
    assert again(held) == brute_lines(rows)
    less = line_dedup.delete(held, df(b))
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.clean(less, df(rows[: -len(b)])).collect()), key=repr) == brute_lines(rows[: -len(b)])


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(i, "x" * 50 + f"\n{i}", 1, "h", "o", "n") for i in range(6)], "doc_id long, text string, __d int, __h string, __own string, __new string")
    out = line_dedup.replace_text(line_dedup.build(docs), docs)
    assert out.columns == docs.columns and sorted((r.text, r["__h"]) for r in out.collect()) == sorted((f"{i}" if i < 5 else docs.collect()[5].text, "h") for i in range(6))


def test_cuckoo_filter():
    r = random.Random(5)
    keys = [r.randbytes(16) for _ in range(5000)]
    f = line_dedup.CuckooFilter(1000)  # far too small: the rest goes to the stash
    f.insert(keys)
    f = line_dedup.CuckooFilter(raw=f.to_bytes())
    assert f.contains(keys).all()
    g = line_dedup.CuckooFilter(len(keys))
    g.insert(keys)
    assert g.contains([r.randbytes(16) for _ in range(5000)]).mean() < 0.01
    g.delete(keys[:4000])
    assert g.contains(keys[4000:]).all() and g.contains(keys[:4000]).mean() < 0.01
    assert not f.contains([]).size


def test_replace_text(spark, odd_docs, no_docs):
    got = line_dedup.replace_text(line_dedup.build(odd_docs), odd_docs)
    assert got.columns == odd_docs.columns
    hashes = sorted(((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got.collect()), key=repr)
    assert hashes == sorted(((i, h) for i, _, _, h in brute_lines(pairs_of(odd_docs))), key=repr)
    assert line_dedup.replace_text(line_dedup.build(no_docs), no_docs).count() == 0


def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = defaultdict(list)
    for i in range(len(w) - 7):
        grams[tuple(w[i : i + 8])].append(i)
    covered = {j for v in grams.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(c - 1 for c in Counter(lines).values())
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_quality_counts(spark, odd_docs, no_docs, sf):
    for docs in (odd_docs, no_docs, table(spark, sf, "documents")):
        got = quality.clean_lines(docs).collect()
        want = Counter((i, *brute_quality(t)) for i, t in pairs_of(docs))
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want


def test_quality_verdicts():
    clean = ". ".join(words(i, 9) for i in range(30)) + "."
    assert quality.judge(clean)[6]
    menu = "\n".join("Home | About | Contact | Shop" for _ in range(40))
    assert not quality.judge(menu + "\nOne sentence only.")[6]
    mixed = clean + "\nHome | About | Contact"
    verdict = quality.judge(mixed)
    assert verdict[6] and verdict[7] == 1 and verdict[-1] == clean
    assert quality.line_fault(" ".join("ABCD" for _ in range(9)) + ".") == "shouting"
    assert quality.line_fault(words(3, 12)) == "punctuation"
    assert quality.line_fault("Accept cookies to go on.") == "boilerplate"
    assert not quality.judge(None)[6] and not quality.judge("")[6]


def test_quality_agrees_with_labels(spark, sf):
    labels = {r.doc_id: r.quality for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    got = {r.doc_id: r.kept for r in quality.clean_lines(table(spark, "/root/testdata/sf0.01", "documents"), with_text=False).where("not base_failed").collect()}
    seen = Counter((labels[i], k) for i, k in got.items() if i in labels)
    assert seen[1, False] == 0 and seen[0, True] <= 0.1 * (seen[0, True] + seen[0, False])


def test_bpe_equals_the_library(spark, odd_docs, no_docs, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_path())
    for docs in (odd_docs, no_docs, table(spark, sf, "documents")):
        want = Counter()
        for i, text in pairs_of(docs):
            ids = t.encode(text or "", add_special_tokens=False).ids
            want[i, len(ids), tuple(ids), t.decode(ids, skip_special_tokens=False)] += 1
        assert Counter((r.doc_id, r.n_tokens, tuple(bpe.unpack(bytes(r.ids))), r.decoded) for r in bpe.encode(docs).collect()) == want


def test_bpe_on_random_texts():
    from tokenizers import Tokenizer

    own, lib, r = bpe.load(bpe.tokenizer_path()), Tokenizer.from_file(bpe.tokenizer_path()), random.Random(2)
    letters = "aabcdeehilnorstt  \n\t'.,sè中😀1²٣<|>\x85 ̈"
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randrange(1, 50)))
        ids = own.encode(text)
        assert ids == lib.encode(text, add_special_tokens=False).ids and own.decode(ids) == text
    for text in ("a" * 20000, " " * 5000 + "x", "<|endoftext|>" * 3, "x<|endoftext|> y"):
        assert own.encode(text) == lib.encode(text, add_special_tokens=False).ids
    assert own.decode([0xFFFFFF]) == "" and own.decode([own.ids[b"\xe4"]]) == "�"


def test_bpe_digests(spark, odd_docs):
    full = {(r.doc_id, hashlib.sha256(bytes(r.ids)).hexdigest(), hashlib.sha256(r.decoded.encode()).hexdigest()) for r in bpe.encode(odd_docs).collect()}
    assert {(r.doc_id, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(odd_docs).collect()} == full


def test_language_counts_do_not_depend_on_pieces(monkeypatch):
    text = words(1, 300) + " ÄÖ! " + words(2, 50)
    whole = langid.counts(text)
    for size in (7, 64, 1000):
        monkeypatch.setattr(langid, "PIECE", size)
        assert (langid.counts(text) == whole).all()


def test_language_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.fit(docs)
    langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = langid.predict(docs, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) >= 0.98
    again = {r.doc_id: r.score for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)


def brute_ngrams(text):
    """Bucket counts by definition: 2 to 4 code points inside words, word ends marked by a space."""
    out = Counter()
    for word in re.findall(r"[^\W\d_]+", "".join(c if c.isalpha() else " " for c in text.lower())):
        marked = f" {word} "
        for n in (2, 3, 4):
            for i in range(len(marked) - n + 1):
                if marked[i] == marked[i + n - 1] == " ":
                    continue  # one end of a word at a time
                h = n
                for c in marked[i : i + n]:
                    h = (h ^ ord(c)) * 0x9E3779B1 & 0xFFFFFFFF
                    h ^= h >> 15
                out[h & (langid.BUCKETS - 1)] += 1
    return out


def test_language_scores_against_brute_force(spark, sf):
    """The sample, the vectors, the model fitted to them and every score, one document after the other."""
    docs = table(spark, sf, "documents")
    rows = sorted((r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect())

    def vector(text):
        out = np.zeros(langid.BUCKETS)
        for b, n in brute_ngrams(text).items():
            out[b] = n
        return out / max(out.sum(), 1)

    learn = [(i, t, lang) for i, t, lang in rows if lang and zlib.crc32(str(i).encode()) % 5 and re.search(r"[^\W\d_]", t or "")]
    x = np.array([vector(t) for _, t, _ in learn] + [vector(langid.piece_of(t)) for _, t, _ in learn]).astype(np.float32).astype(np.float16).astype(np.float32)
    want = langid.train(x, [lang for *_, lang in learn] * 2, np.array([i for i, *_ in learn] * 2))
    model = langid.fit(docs)
    assert model.langs == sorted({lang for *_, lang in learn}) and model.threshold == pytest.approx(want.threshold, abs=1e-4) and model.temperature == want.temperature
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for i, t, _ in rows:
        r = got[i]
        if not re.search(r"[^\W\d_]", t or ""):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
            continue
        v = vector(t)
        hidden = [float((v * want.embeddings[:, d]).sum()) for d in range(langid.DIM)]
        z = [(sum(h * w for h, w in zip(hidden, want.weights[:, k], strict=True)) + want.bias[k]) / want.temperature for k in range(len(want.langs))]
        p = [math.exp(u - max(z)) / sum(math.exp(w - max(z)) for w in z) for u in z]
        assert abs(max(p) - r.score) < 1e-3 and (r.lang_pred == want.langs[int(np.argmax(p))] or max(p) - sorted(p)[-2] < 1e-3)


def test_language_edges(spark, odd_docs, no_docs):
    model = langid.fit(odd_docs)
    rows = langid.predict(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    for r, t in zip(rows, [t for _, t in pairs_of(odd_docs)], strict=True):
        assert (r.lang_pred == "und") == (not t or not re.search(r"[^\W\d_]", t))
    assert langid.predict(no_docs, langid.fit(no_docs)).count() == 0
    assert {r.lang_pred for r in langid.predict(odd_docs, langid.fit(no_docs)).collect()} == {"und"}


def brute_segments(scores):
    """Maximal scoring segments by definition: the best segment (longest prefix rule aside), then both sides."""
    if not len(scores) or max(scores) <= 0:
        return []
    best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    i, j = -best[2], -best[2] - best[1]
    return [*brute_segments(scores[:i]), (i, j), *((a + j, b + j) for a, b in brute_segments(scores[j:]))]


def test_segments():
    r = np.random.default_rng(4)
    for _ in range(300):
        s = r.normal(-0.2, 1, r.integers(0, 14))
        got = toxicity.segments(s)
        assert [(a, b) for a, b, _ in got] == brute_segments(list(s))
        assert all(abs(v - s[a:b].sum()) < 1e-9 for a, b, v in got)


def brute_toxicity(docs, labels):
    """The scores of docs (id, text) with labels (id, toxic), one document after the other."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    toxic = defaultdict(int)
    for i, y in labels:
        if i is not None and y is not None and fold(i):
            toxic[i] = max(toxic[i], int(y > 0))
    known = [(*toxicity.minima(t), i, toxic[i]) for i, t in docs if i in toxic]
    for k in range(4):  # of the rows that share the k-th min-hash, the first by id and label
        first = {}
        for row in known:
            key = (row[4], row[5], *(m for j, m in enumerate(row[:4]) if j != k))
            first[row[k]] = min(first.get(row[k], (key, row)), (key, row))
        known = [row for _, row in first.values()]
    label = {}
    for *_, i, y in known:
        label[i] = max(y, label.get(i, 0))
    texts = [(i, t) for i, t in docs if i in label]

    def counted(rows):
        c, n = {0: Counter(), 1: Counter()}, Counter()
        for i, t in rows:
            words_ = set(re.findall(r"[^\W_]+", (t or "").lower()))
            units = words_ | {w[:k] + "-" for w in words_ for k in (6, 5, 4, 3) if len(w) > k}
            c[label[i]].update({b for u in units for b in toxicity.places(u)})
            n[label[i]] += 1
        return c, n

    def scorer(c, base):
        def share(unit, prior):
            t, f = (min(c[y][b] for b in toxicity.places(unit)) for y in (1, 0))
            return (t + 8 * prior) / (t + f + 8)

        def of(word):
            p = base
            for k in (3, 4, 5, 6):
                if len(word) > k:
                    p = share(word[:k] + "-", p)
            p = share(word, p)
            v = math.log(max(p, 1e-4) / max(1 - p, 1e-4)) - math.log(base / (1 - base))
            return (min(v, 6) if v > 2.2 else -0.25 if v < -2.2 else 0) - 0.5

        return of

    def seen(t, of, rate, log_k):
        s = np.array([of(w) for w in re.findall(r"[^\W_]+", (t or "").lower())])
        normal = [rate * v - log_k - math.log(max(1, len(s))) for _, _, v in toxicity.segments(s)]
        return max(normal, default=-log_k - math.log(max(1, len(s)))), sum(v for v in normal if v > 0)

    c, n = counted([(i, t) for i, t in texts if fold(i) != 4])
    base = n[1] / (n[0] + n[1])
    of, held = scorer(c, base), [(i, t) for i, t in texts if fold(i) == 4]
    bins = Counter(int(np.clip(np.round(4 * of(w)) + 8, 0, 63)) for i, t in held if not label[i] for w in re.findall(r"[^\W_]+", (t or "").lower()))
    rate = toxicity.extreme_rate((np.array(sorted(bins)) - 8) / 4, np.array([bins[b] for b in sorted(bins)], float))
    points = Counter()
    for i, t in held:
        x, joined = seen(t, of, rate, 0.0)
        points[label[i], math.floor(min(max(x, -30), 60) * 4 + 0.5) / 4, math.floor(math.log1p(joined) * 10 + 0.5) / 10] += 1
    y, x, j = (np.array([p[k] for p in sorted(points)], float) for k in range(3))
    model = toxicity.calibrate(toxicity.Model(np.zeros(1), np.zeros(1), base, rate, 0.0, (0.0, 0.0, 0.0)), x, np.expm1(j), y, np.array([points[p] for p in sorted(points)], float))
    c, _ = counted(texts)
    of = scorer(c, base)
    return {i: float(model.probability(*map(np.array, seen(t, of, rate, model.log_k)))) for i, t in docs}


def test_toxicity_scores_against_brute_force(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    want = brute_toxicity(pairs_of(docs), [(r.doc_id, r.toxic) for r in labels.collect()])
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 1e-6


def test_toxicity_held_out(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    known = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    seen = Counter((known[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in known)
    assert seen[1, 1] >= 0.9 * (seen[1, 1] + seen[1, 0]) and seen[0, 1] <= 0.03 * (seen[0, 1] + seen[0, 0])


def test_toxicity_edges(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (3, None, None), (None, 1, 1), (11, 0, 1), (11, 0, 0), (404, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd_docs, labels)
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    nothing = toxicity.fit(no_docs, labels)
    assert {r.predicted for r in toxicity.score(odd_docs, nothing).collect()} == {0}
    assert toxicity.score(no_docs, model).count() == 0
    kept = toxicity.accept(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.predicted == 0 for r in rows)
