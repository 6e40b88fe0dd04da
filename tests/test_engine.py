"""Flattening, files, drawings, end-to-end runs, the entry's contract and plans."""

import json
import os
import random
import subprocess
import sys

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import __spark_entry__ as entry
from glossweave.operators import apply, flatten, providers
from glossweave.operators.schema import ENTITIES
from glossweave.plans import localise
from glossweave.plans import queries as own
from glossweave.sources import dxf, files, sinks

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_oracle(spark, duck, name):
    df = own.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(own.ORACLES[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def entity(space, container, kind, text=None, tag=None, attribs=None, cells=None, alternatives=None, ix=0):
    return ("d", space, container, ix, kind, text, tag, attribs, cells, alternatives, "S")


def test_flatten(spark):
    rows = [
        entity("layout", "Model", "TEXT", " a "),
        entity("layout", "Sheet", "TEXT", "  "),
        entity("layout", "Model", "MTEXT", " ", alternatives=[None, "b"]),
        entity("layout", "Model", "DIMENSION", " <> "),
        entity("layout", "Model", "DIMENSION", "<> TYP"),
        entity("block", "B", "TABLE", cells=[["p", ""]]),
        entity("layout", "Model", "INSERT", attribs=[("T1", "x"), (None, None)]),
        entity("block", "B", "INSERT", attribs=[("T1", "x")]),
        entity("block", "", "ATTDEF", "t", tag="G"),
        entity("block", None, "LEADER", "l"),
        entity("layout", "Model", "LINE", "no"),
        entity(None, None, None, None),
        entity("layout", None, "TEXT", "no layout name"),
    ]
    got = flatten.text_bag(spark.createDataFrame(rows, ENTITIES))
    assert sorted(map(tuple, got.collect())) == sorted(
        [("TEXT", "", " a "), ("TEXT", "", "no layout name"), ("MTEXT", "", "b"), ("DIMENSION", "", "<> TYP"), ("BLOCK:B:TABLE", "r0c0", "p"), ("INSERT:ATTRIB", "T1", "x"), ("BLOCK:B:ATTRIB", "T1", "x"), ("BLOCK", "G", "t"), ("BLOCK", "", "l")]
    )


@pytest.mark.parametrize("native", [True, False])
def test_apply_to_entities(spark, monkeypatch, native):
    monkeypatch.setattr(apply, "NATIVE_PAIRS", 50 if native else 0)
    rows = [
        entity("layout", "Model", "TEXT", "a<>a", ix=1),
        entity("layout", "Model", "DIMENSION", "<>", ix=2),
        entity("layout", "Model", "DIMENSION", "gone", ix=3),
        entity("block", "B", "TABLE", cells=[["a", " "], [None, "b"]], ix=4),
        entity("layout", "Model", "INSERT", "a", attribs=[("T", "a")], ix=5),
        entity("layout", "Model", "LINE", "a", ix=6),
        entity("layout", "Model", "MTEXT", None, ix=7),
    ]
    pairs = [("gone", ""), ("a", "x"), ("x", "yy"), (" ", "-")]
    df = spark.createDataFrame(rows, ENTITIES)
    got = {r.entity_ix: r for r in apply.apply_to_entities(df, pairs).collect()}
    assert got[1].text == "yy<>yy" and got[1].style == "RU" and got[2].text == "<>" and got[3].text == "gone" and got[3].style == "S"
    assert got[4].cells == [["yy", " "], [None, "b"]] and got[5].text == "a" and got[5].attribs[0].text == "a" and got[6].text == "a" and got[7].text is None
    fixed = {r.entity_ix: r for r in apply.apply_to_entities(df, pairs, apply_attribs=True).collect()}
    assert fixed[5].attribs[0].text == "yy"


def write(path, text):
    path.write_bytes(text.encode("utf-8"))
    return f"file://{path}"


def test_csv_dictionary(spark, tmp_path):
    p = write(tmp_path / "a.csv", 'n,text_ru,text_en\r\n1," x ","a\nb"\r\n2,,"say ""hi"""\r\n3,z,  \r\n4,q,a\r\n4,r,a\r\n')
    assert [(r.en, r.ru) for r in files.read_csv_dictionary(spark, p).orderBy("pos").collect()] == [("a\nb", "x"), ('say "hi"', ""), ("a", "q"), ("a", "r")]
    p = write(tmp_path / "b.csv", "TEXT_EN,TEXT_RU\na,b\n")
    assert files.read_csv_dictionary(spark, p).count() == 0
    p = write(tmp_path / "c.csv", "k,v\na,b\n")
    assert [(r.en, r.ru) for r in files.read_csv_dictionary(spark, p).collect()] == [("a", "b")]
    with pytest.raises(PySparkException):
        files.dictionary_columns(["only"])


def test_text_pair_dictionary(spark, tmp_path):
    en = write(tmp_path / "en.txt", "[3] a\r\n\r\n[2] two words\n[1] a\n[1] long\n")
    ru = write(tmp_path / "ru.txt", "x\n   \ny\nz")
    assert sorted((r.en, r.ru) for r in files.read_text_pair_dictionary(spark, en, ru).collect()) == [("a", "x"), ("two words", "y")]


def test_sinks_and_coverage(spark, tmp_path):
    texts = ["plain", ' "q", x ', "two\nlines", "", 'é\\P\\"']
    keys = spark.createDataFrame([(i, 9 - i, t) for i, t in enumerate(texts, 1)], "rn long, count long, text_en string")
    at = lambda n: f"file://{tmp_path}/{n}"
    sinks.write_frequency_csv(keys, at("f.csv"))
    assert [(r["count"], r.text_en) for r in files.read_extract(spark, at("f.csv")).collect()] == [(9 - i, t) for i, t in enumerate(texts, 1)]
    sinks.write_frequency_json(keys, at("f.json"))
    assert [r.text_en for r in files.read_frequency_json(spark, at("f.json")).collect()] == texts
    sinks.write_frequency_txt(keys, at("f.txt"))
    part = next(p for p in os.listdir(tmp_path / "f.txt") if p.startswith("part"))
    assert (tmp_path / "f.txt" / part).read_text() == "".join(f"[{9 - i}] {t}\n" for i, t in enumerate(texts, 1))
    lines = files.read_frequency_txt(spark, at("f.txt/" + part)).orderBy("ix").collect()
    assert [(r["count"], r.text) for r in lines][:4] == [(8, "plain"), (7, '"q", x'), (6, "two"), (None, "lines")]
    ru = spark.createDataFrame([(1, "A"), (2, "B")], "rn long, text_ru string")
    sinks.write_translated_txt(keys, ru, at("t.txt"))
    assert "".join((tmp_path / "t.txt" / p).read_text() for p in os.listdir(tmp_path / "t.txt") if p.startswith("part")) == "[8] A\n[7] B\n"
    write(tmp_path / "tr.json", json.dumps({t: f"ru:{t}" for t in texts}))
    done = localise.check_and_enrich(spark, at("tr.json"), at("f.csv"), at("m.csv"))
    assert done.count() == 5
    assert [(r["count"], r.text_en, r.text_ru) for r in files.read_csv(spark, at("f.csv")).collect()] == [(str(9 - i), t, f"ru:{t}") for i, t in enumerate(texts, 1)]
    assert [(r.text_en, r.text_ru) for r in files.read_csv(spark, at("m.csv")).collect()] == [(t, f"ru:{t}") for t in texts]
    assert sinks.write_if(False, "x", print) is sinks.write_if(True, None, print) is False


DRAWING = """  0
SECTION
  2
BLOCKS
  0
BLOCK
  2
B1
  0
ATTDEF
  1
default
  2
TAG
  0
ENDBLK
  0
ENDSEC
  0
SECTION
  2
ENTITIES
  0
TEXT
  8
0
  1
Valve <> open
  0
MTEXT
  3
Long part, 
  1
rest\\PValve
  0
INSERT
  2
B1
  0
ATTRIB
  1
Valve
  2
TAG
  0
SEQEND
  0
DIMENSION
  1
<>
 410
Sheet
  0
ACAD_TABLE
 91
     1
 92
     2
302
Valve
302

  0
ENDSEC
  0
EOF
"""


def test_drawing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    source = write(tmp_path / "in" / "a.dxf", DRAWING)
    got = {r.entity_ix: r for r in dxf.read_entities(spark, source).collect()}
    assert [(r.space, r.container, r.dxftype, r.text) for r in (got[i] for i in range(6))] == [
        ("block", "B1", "ATTDEF", "default"), ("layout", "Model", "TEXT", "Valve <> open"), ("layout", "Model", "MTEXT", "Long part, rest\nValve"),
        ("layout", "Model", "INSERT", None), ("layout", "Sheet", "DIMENSION", "<>"), ("layout", "Model", "TABLE", None),
    ]
    assert got[2].alternatives == ["Long part, rest\\PValve"]
    assert got[3].attribs[0].text == "Valve" and got[5].cells == [["Valve", ""]]
    entities = dxf.read_entities(spark, source)
    done = localise.run_entities(entities, providers.Options("dictionary", dictionary={"Valve": "Klappe", "default": "Vorgabe"}))
    assert {r.text_en: r.text_ru for r in done.translated.collect()}["Valve"] == "Klappe"
    assert done.summary.first().items_translated == 4
    dxf.write_entities(done.entities, source, f"file://{tmp_path}/out").collect()
    back = {r.entity_ix: r for r in dxf.read_entities(spark, f"file://{tmp_path}/out").collect()}
    assert back[0].text == "Vorgabe" and back[1].text == "Klappe <> open" and back[2].text == "Long part, rest\nKlappe" and back[5].cells == [["Klappe", ""]]
    assert back[3].attribs[0].text == "Valve"  # attached attributes are translated but not written back
    assert dxf.with_texts(DRAWING.encode(), {}) == DRAWING.encode()
    assert dxf.input_kind("a/B.DWG") == "dwg"
    with pytest.raises(PySparkException):
        dxf.input_kind("a.pdf")


def test_ranked_keys_and_their_translations_are_not_shuffled_again(spark):
    """Numbers join the ranges' rows in place, and the count goes along with the text to the provider and back."""
    from glossweave.operators import frequency

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranked = frequency.ranked(spark.createDataFrame([("b", 2), ("a", 2), ("c", 3)], "text_en string, count long"))
        assert "SortMergeJoin" not in plan(ranked) and "BroadcastHashJoin" in plan(ranked)
        done = localise.translated_keys(ranked, providers.Options("noop"))
        assert "Join" not in plan(done)
        assert sorted(map(tuple, done.collect())) == [(1, 3, "c", "c"), (2, 2, "a", "a"), (3, 2, "b", "b")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pipeline_noop_changes_nothing(spark, tmp_path):
    bag = own.lines(spark, SF)
    outputs = localise.Outputs(f"file://{tmp_path}/t.txt", f"file://{tmp_path}/r.txt", f"file://{tmp_path}/m.csv")
    done = localise.run_bag(bag, providers.Options("noop"), outputs, "out.dwg")
    assert done.translated.where("text_en <> text_ru").count() == 0
    assert done.translated.agg(F.sum("count")).first()[0] == bag.count()
    s = done.summary.first()
    assert (s.output_path, s.backend, s.map_saved, s.extracted_txt_saved, s.translated_txt_saved) == ("out.dwg", "noop", True, True, True)


def test_plans(spark):
    count = own.QUERIES["text_frequency"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert count.count("Exchange") == 1 and "partial_count" in count
    scan = own.QUERIES["text_frequency"](spark, SF)._jdf.queryExecution().simpleString()
    assert "ReadSchema: struct<text:string>" in scan or "ReadSchema: struct<text:string," in scan
    assert "Exchange" not in own.QUERIES["apply_cascade"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    assert entry.entry(spark).columns == ["text_en", "count", "rn"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_optional_folders(tmp_path, pipeline):
    """With exactly the optional folders deleted (and the pipeline beside them or not) the registry
    imports and holds the engine's queries, and the other tests are still found."""
    import shutil

    to = tmp_path / "repo"
    shutil.copytree(REPO, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for folder in ("glossweave/llm", "tests/llm"):
        shutil.rmtree(to / folder, ignore_errors=True)
    if not pipeline:
        (to / "corpus_pipeline.py").unlink(missing_ok=True)
    code = "import __spark_entry__ as e, glossweave.cli; from glossweave.plans.queries import QUERIES as q, ORACLES as o; assert e.queries() == q and e.oracle_sql() == o"
    run_in(to, "-c", code)
    # collects everything; those run here need no session of their own
    run_in(to, "-m", "pytest", "tests", "-q", "-p", "no:cacheprovider", "-k", "test_message_of or test_replies")


def run_in(folder, *args):
    """Python in a copy of the repository, which comes before whatever else the path holds."""
    path = os.pathsep.join([str(folder), *filter(None, [os.environ.get("PYTHONPATH")])])
    done = subprocess.run([sys.executable, *args], cwd=folder, env=os.environ | {"PYTHONPATH": path}, capture_output=True, text=True)
    assert done.returncode == 0, f"{done.returncode}\n{done.stdout[-3000:]}\n{done.stderr[-3000:]}"
    return done.stderr


@pytest.mark.parametrize("package", ["xxhash", "no_such_package"])
def test_entry_without_a_package(package):
    """A package that only the operators need may be absent; the engine's queries stay, and a warning says so."""
    code = f"import sys; sys.modules[{package!r}] = None; import __spark_entry__ as e; from glossweave.plans.queries import QUERIES as q; assert q.keys() <= e.queries().keys(); print(e.queries().keys() == q.keys(), file=sys.stderr)"
    said = run_in(REPO, "-W", "always", "-c", code)
    assert ("package xxhash is not installed" in said) == (package == "xxhash" and os.path.isdir(f"{REPO}/glossweave/llm"))


def test_shared_folder(spark, monkeypatch):
    """A machine-local folder stands in for the shared one in local mode only; released tables leave it."""
    from glossweave.plans import tables

    assert tables.is_local("local") and tables.is_local("local[4]") and not any(map(tables.is_local, ("local-cluster[2,1,1024]", "yarn", "spark://h:7077", "k8s://h")))
    kept = tables.materialize(spark.range(3).toDF("x"), "kept")
    fs, p = tables.filesystem(spark, tables._WRITTEN[kept])
    assert fs.exists(p) and kept.count() == 3
    tables.release(kept, None, spark.range(1))
    assert not fs.exists(p)
    monkeypatch.setattr(tables, "is_local", lambda master: False)
    if not spark.conf.get("spark.checkpoint.dir", None):
        monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
        with pytest.raises(PySparkException):
            tables.shared_dir(spark)


@pytest.mark.parametrize("protect", [True, False])
def test_joined_dictionary_is_the_fold(spark, protect):
    """Few letters, so that nearly every pair makes keys of others, across borders and in the places of deletions."""
    r = random.Random(7)
    word = lambda low, high: "".join(r.choice("abc<>\\P ") for _ in range(r.randint(low, high)))
    pairs = [(word(1, 7), word(0, 5)) for _ in range(250)] + [("", "never"), ("zz", "y"), ("yx" * 20, "ab"), ("y", "yx"), ("\U0001f600é", "c")]
    texts = [word(0, 60) for _ in range(120)] + ["zzx" * 30, "", "\U0001f600é" * 3, None, "aaaa", "aaaa"]
    table = spark.createDataFrame([(i, en, ru) for i, (en, ru) in enumerate(pairs)] + [(9000, None, "x"), (9001, "q", None)], "pos long, en string, ru string")
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    order = apply.ordered([*pairs, ("q", "")])
    fold = apply.fold_protected if protect else apply.fold
    got = {x.i: x.text for x in apply.apply_to_texts(rows, table, protect=protect).collect()}
    assert got == {i: t if t is None else fold(t, order) for i, t in enumerate(texts)}
    assert sum(got[i] != t for i, t in enumerate(texts)) > 60
    empty = apply.apply_to_texts(rows, table.where("false")).collect()
    assert {x.i: x.text for x in empty} == dict(enumerate(texts))


def test_a_fold_goes_on_where_it_stopped(spark, monkeypatch):
    """Each pair makes the next one's key: a round goes on with the text as it is by then and with the pairs that are to
    come, whatever came before, and a text whose fold has ended is not taken along."""
    from glossweave.operators import large

    rounds, write = [], large.materialize
    monkeypatch.setattr(large, "materialize", lambda df, name: rounds.append(write(df, name)) or rounds[-1] if name == "fold-round" else write(df, name))
    keys = ["k" * 2 + "abcdefghijklmnopq"[: 9 - i] + str(i) for i in range(6)]
    pairs = [*zip(keys, keys[1:], strict=False), ("u" * 15, "v"), (keys[5] + "!", "never"), ("z", "y"), ("w" * 20 + "1", "zz"), ("w" * 20 + "2", "yz")]
    texts = [f"{keys[0]} {'u' * 15}<>x\\A{keys[0]}\\{keys[0]}z", "z only", f"{keys[4]}!", "w" * 20 + "1", "w" * 20 + "2", "none"]
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "pos long, en string, ru string")
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    order = apply.ordered(pairs)
    got = {x.i: x.text for x in apply.apply_to_texts(rows, table).collect()}
    assert got == {i: apply.fold_protected(t, order) for i, t in enumerate(texts)}
    ended = [[x.text for x in r.where("out is not null").collect()] for r in rounds]
    assert sorted(sum(ended, [])) == sorted(texts) and len(rounds) == 5 and ended[-1] == texts[:1]
    for n, r in enumerate(rounds):
        for x in r.where("out is null and text like 'kk%<>%'").collect():
            assert x.parts[0] == f"{keys[n + 1]} v" and [p.en for p in x.pairs] == ["z"] and x.parts[1] == "<>"


def test_the_table_of_anchors_grows_with_the_keys(spark):
    """However many keys there are, few anchors pass that no key has, and none where no key begins; every key's does."""
    import numpy as np

    from glossweave.operators import large

    pairs = spark.range(1 << 17).selectExpr("id as pos", "concat('k', id) as en", "'x' as ru")
    table, longest = large.bit_table(large.index(pairs))
    assert longest == 7 and table.lengths == (2, 3, 4, 5, 6, 7)
    keys = [f"k{i}" for i in range(1 << 17)]
    assert len(table.known(large.key_anchors(keys).astype(np.uint64))) == len(keys)
    others = np.random.default_rng(1).integers(1 << 63, size=100_000).astype(np.uint64)
    assert len(table.known(others)) < 500
    found = {(n, int(p)) for n, (at, _) in zip(table.lengths, table.found("ak17 kk b"), strict=True) for p in at}
    assert {(2, 1), (3, 1)} <= found and {p for _, p in found} <= {1, 5}


def test_entities_with_a_dictionary_of_any_size(spark, monkeypatch):
    """Past the size of a list the same pairs go through the joined index, with the same result, and no run collects
    its dictionary."""
    from glossweave.operators import dictionary

    entities = own.entities(spark, SF)
    pairs = spark.createDataFrame([(i, *p) for i, p in enumerate(own.PART_PAIRS)], "pos long, en string, ru string")
    listed = dictionary.ordered_or_table(pairs)
    assert isinstance(listed, list) and dictionary.ordered_or_table(pairs, 3) is pairs
    for attribs in (False, True):
        a, b = (apply.apply_to_entities(entities, p, apply_attribs=attribs) for p in (listed, pairs))
        assert a.columns == b.columns and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    options = providers.Options("dictionary", dictionary={"LARGE": "GROSS", "SMALL": "KLEIN"})
    small = localise.run_entities(entities, options).entities.collect()
    monkeypatch.setattr(dictionary, "LIST_PAIRS", 10)
    assert sorted(map(repr, localise.run_entities(entities, options).entities.collect())) == sorted(map(repr, small))


def test_folders_of_files_keep_their_order(spark, tmp_path):
    """Files of several sizes, a small one first, part numbers past five digits, split blocks, an empty file; the
    enriched extract and the map stand in the extract's order."""
    folder = tmp_path / "lines"
    folder.mkdir()
    sizes = {"part-00000-x.txt": 3, "part-00001-x.txt": 400, "part-00002-x.txt": 0, "part-99999-x.txt": 50, "part-100000-x.txt": 7}
    want, n = [], 0
    for name, k in sizes.items():
        own_lines = [f"line {n + i} {'y' * (i % 90)}" for i in range(k)]
        (folder / name).write_bytes("".join(x + ("\r\n" if i % 2 else "\n") for i, x in enumerate(own_lines)).encode())
        want, n = want + own_lines, n + k
    (folder / "part-100001-x.txt").write_bytes(b"caf\xc3\xa9 \xff\xfex\n\nlast")
    want += ["caf\u00e9 x", "", "last"]
    last = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("300", last):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {r.ix: r.value for r in files.read_lines(spark, f"file://{folder}").collect()}
            assert [got[i] for i in range(len(got))] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", last)
    keys = spark.createDataFrame([(i + 1, 5 + i % 3, f'key {i * 7919 % 1000}, "q"\nsecond') for i in range(600)], "rn long, count long, text_en string")
    extract, into = f"file://{tmp_path}/extract.csv", f"file://{tmp_path}/map.csv"
    by_range = keys.repartitionByRange(6, F.floor(F.log2("rn"))).sortWithinPartitions("rn")
    by_range.select("count", "text_en").write.options(**sinks.CSV_OUT).csv(extract)
    (tmp_path / "translations.json").write_text(json.dumps({r.text_en: f"ru {r.rn}" for r in keys.collect()}))
    localise.check_and_enrich(spark, f"file://{tmp_path}/translations.json", extract, into)
    for path, column in ((extract, "text_ru"), (into, "text_ru")):
        placed = files.in_file_order(files._csv(spark, path)).orderBy("rn").collect()
        assert [r[column] for r in placed] == [f"ru {i + 1}" for i in range(600)]


def test_requests_through_the_table_function(spark):
    from glossweave.operators import table_functions

    keys = spark.createDataFrame([(i + 1, f'text "{i}"\n\u00e9') for i in range(37)], "rn long, text string")
    parsed = lambda df: sorted((r.batch, json.dumps(json.loads(r.payload))) for r in df.collect())
    assert parsed(table_functions.requests(keys, 16)) == parsed(providers.requests(keys, 16))
    assert table_functions.requests(keys.limit(0), 16).count() == 0
