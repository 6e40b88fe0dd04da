"""The pipeline's stages, each against brute force on its own input."""

import hashlib
from collections import Counter

import corpus_pipeline
from glossweave.llm import bpe, toxicity
from glossweave.llm.common import materialize, table

from .test_table_operators import brute_near, brute_targets, near_target
from .test_text_operators import brute_lines, pairs_of


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dup", "mixing", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, sf), f"test-{name}")
        if name != "bpe":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        before, after = pairs_of(docs), pairs_of(out) if name != "bpe" else []
        if name == "toxicity":
            model = toxicity.fit(docs, table(spark, sf, "labels"))
            assert {r.doc_id for r in toxicity.score(docs, model).where("predicted = 0").collect()} == {i for i, _ in after}
            gone = [labels[i] for i in {i for i, _ in before} - {i for i, _ in after} if i in labels]
            assert sum(gone) >= 0.9 * len(gone)
        elif name == "line_dedup":
            want = sorted((i, h) for i, _, _, h in brute_lines(before))
            assert sorted((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in after) == want
            assert all(r.n_chars == len(r.text) for r in out.collect())
        elif name == "near_dup":
            assert {i for i, _ in after} == {i for i, (_, c) in brute_near(before, 5).items() if i == c}
            assert dict(after).items() <= dict(before).items()
        elif name == "mixing":
            size = {i: len(t.split()) for i, t in before}
            source = {r.doc_id: r.source for r in docs.collect()}
            total, taken = Counter(), Counter()
            for i, n in size.items():
                total[source[i]] += n
            drawn = Counter(i for i, _ in after)
            for i, n in drawn.items():
                taken[source[i]] += n * size[i]
            want = brute_targets(total)
            assert max(drawn.values()) <= 3 and all(near_target([n for i, n in size.items() if source[i] == s], taken[s], want[s]) for s in total)
        else:
            own = bpe.load(bpe.tokenizer_path())
            text = dict(before)
            rows = out.collect()
            assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in before)
            for r in rows[:200]:
                assert bpe.unpack(bytes(r.ids)) == own.encode(text[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
        docs = out


def test_recall_with_few_labels(spark):
    sf = "/root/testdata/sf0.01"
    toxic = {r.doc_id for r in table(spark, sf, "labels").where("toxic = 1").collect()}
    kept = {r.doc_id for r in corpus_pipeline.reject_toxic(spark, table(spark, sf, "documents"), sf).collect()}
    assert len(toxic - kept) >= 0.85 * len(toxic)


def test_stages_on_odd_documents(spark, odd_docs, no_docs, tmp_path):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing column names, empty tables: each
    stage gives the columns it was given, keeps what it has no reason to drop, and takes its predecessor's rows."""
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (3, None, None), (None, 1, 1), (11, 0, 0), (404, 0, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    for given in (odd_docs, no_docs):
        docs, n = given, given.count()
        for name, stage in corpus_pipeline.STAGES:
            out = materialize(stage(spark, docs, f"file://{tmp_path}"), f"odd-{name}")
            rows = out.collect()
            if name != "bpe":
                assert out.columns == given.columns and dict(out.dtypes) == dict(given.dtypes)
                assert name == "mixing" or {(r.doc_id, r.source) for r in rows} <= {(r.doc_id, r.source) for r in docs.collect()}
            if name == "line_dedup":
                assert len(rows) == docs.count()
            if name == "near_dup" and n:
                assert Counter(r.doc_id for r in rows)[11] == 2 and not {12, 13} & {r.doc_id for r in rows}  # repeated rows are one document
                assert {7, 8, 14} <= {r.doc_id for r in rows}  # empty texts are linked with nothing
            assert n or not rows
            docs = out


def test_run_on_an_empty_table(spark, no_docs, tmp_path):
    no_docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_run(spark, sf):
    assert corpus_pipeline.ORACLE_SQL is None
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and out.count() > 50
