"""Goldens, derived by hand, for the text kernel and the table operators."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from glossweave.functions import text as T
from glossweave.operators import apply, dictionary, frequency, providers


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize(("text", "want"), [(" a ", "a"), ("  x\x1c\n", "x"), ("", ""), ("​x", "​x"), (None, None)])
def test_strip(spark, text, want):
    assert value(spark, T.strip(lit(text))) == want
    if text is not None:
        assert want == text.strip()


def test_strip_set_is_python_s(spark):
    points = [i for i in range(0x110000) if chr(i).isspace()]
    assert sorted(map(ord, T.WS)) == points and len(points) == 29


@pytest.mark.parametrize(("text", "want"), [("[12] The text", "The text"), ("[12]", ""), ("[1] [2] x", "[2] x"), (" plain ", "plain"), ("[1] a\nb", "[1] a\nb"), ("[x] a", "[x] a"), ("", "")])
def test_strip_count_prefix(spark, text, want):
    assert value(spark, T.strip_count_prefix(lit(text))) == want


@pytest.mark.parametrize(("text", "want"), [("A\\PB<>", "A\nB__DXF_DIM__"), ("", ""), (None, None)])
def test_prepare(spark, text, want):
    assert value(spark, T.prepare(lit(text))) == want


@pytest.mark.parametrize(
    ("original", "translated", "want"),
    [("A\\PB", "X\nY", "X\\PY"), ("A<>", "X__DXF_DIM__", "X<>"), ("A\\P\nB", "X\r\nY", "X\\PY"), ("a", "x\ny", "x\ny"), ("a", "", ""), (" a", "x ", " x")],
)
def test_recover(spark, original, translated, want):
    assert value(spark, T.recover(lit(original), lit(translated))) == want


@pytest.mark.parametrize(("original", "translated", "want"), [(" a ", "x", " x "), ("a", "   ", "   "), (" a", "   ", " "), ("  ", "x", "  x  "), ("a", " x ", "x"), ("", "x", "x"), (" a ", "", "")])
def test_edge_whitespace(spark, original, translated, want):
    assert value(spark, T.edge_whitespace(lit(original), lit(translated))) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [(x, True) for x in ("Title", "A B", "ABCD", "AbC", "ø9×6EA")] + [(x, False) for x in ("M", "X12", "ABC", "AB1", "N.S", "700", "王琪", "", None, "  ab  ")],
)
def test_worth_translating(spark, text, want):
    assert value(spark, T.worth_translating(lit(text))) is want
    assert providers.is_worth(text or "") is want


@pytest.mark.parametrize(
    ("text", "pairs", "want"),
    [
        ("Hello\\PWorld<>Hello", [("Hello", "H2"), ("World", "W2")], "H2\\PWorld<>H2"),
        ("\\~Hello", [("Hello", "H2")], "\\~H2"),
        ("<> TYP", [("<> TYP", "<> Z")], "<> TYP"),
        ("a\\", [("a", "b"), ("\\", "/")], "b/"),
        ("", [("a", "b")], ""),
        ("\\A1;x<>\\Px<>x", [("x", "y")], "\\A1;x<>\\Px<>y"),
        ("aa", [("a", "")], ""),
    ],
)
def test_protected(spark, text, pairs, want):
    assert value(spark, T.replace_protected(lit(text), lambda c: T.replace_literals(c, pairs))) == want
    assert apply.fold_protected(text, pairs) == want


def test_both_forms_of_the_fold_agree(spark):
    import random

    r = random.Random(1)
    texts = ["".join(r.choice(["a", "b", "ab", "<>", "\\P", "\\", "\\~", " ", "<", ">", "M", "\n"]) for _ in range(r.randrange(25))) for _ in range(400)]
    pairs = apply.ordered([("ab", "M"), ("a", "ba"), ("M", "<"), ("<", "\\P"), ("b", "")])
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    native = [x.text for x in apply.apply_to_texts(rows, pairs).collect()]
    held, apply.NATIVE_PAIRS = apply.NATIVE_PAIRS, 0
    try:
        assert [x.text for x in apply.apply_to_texts(rows, pairs).collect()] == native == [apply.fold_protected(t, pairs) for t in texts]
    finally:
        apply.NATIVE_PAIRS = held


def test_tokens_lose_nothing(spark):
    text = "a\\P b<>c\\~d\\\\A1;x\n<" + "y" * 200_000 + "\\"
    assert value(spark, F.array_join(T.tokens(lit(text)), "")) == text


def test_cascade(spark):
    assert value(spark, T.replace_literals(lit("AB C"), [("AB", "CD"), ("", "!"), ("C", "X")])) == "XD X"
    pairs = F.array(*(F.struct(F.lit(a).alias("en"), F.lit(b).alias("ru")) for a, b in [("AB", "CD"), ("", "!"), ("C", "X")]))
    assert value(spark, T.replace_in_order(lit("AB C"), pairs)) == "XD X"


def test_longest_first(spark):
    pairs = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(a).alias("en"), F.lit("").alias("ru")) for i, a in enumerate(["ab", "c", "de", "😀😀"])))
    assert [p.en for p in value(spark, T.longest_first(pairs))] == ["ab", "de", "😀😀", "c"]
    assert apply.ordered([("ab", ""), ("c", ""), ("de", ""), ("", "x")]) == [("ab", ""), ("de", ""), ("c", "")]
    rows = spark.createDataFrame([(1, "ab", ""), (2, "c", ""), (3, "de", "")], "pos long, en string, ru string")
    assert [r.en for r in dictionary.by_length(rows).orderBy("rn").collect()] == ["ab", "de", "c"]


@pytest.mark.parametrize(("v", "want"), [(-1.0, "low"), (0.34, "low"), (0.35, "medium"), (0.67, "medium"), (0.68, "high"), (2.0, "high"), (None, "medium")])
def test_strict_level(spark, v, want):
    assert value(spark, T.strict_level(T.clamp(F.lit(v).cast("double")))) == want


@pytest.mark.parametrize(("n", "size", "count"), [(39, 1, 39), (59, 2, 30), (632, 31, 21), (0, 1, 0)])
def test_batches(spark, n, size, count):
    assert frequency.pipeline_batch_size(n) == size
    rows = frequency.batches(spark.range(1, n + 1).select(F.col("id").alias("rn")), size)
    assert rows.select("batch").distinct().count() == count


def test_frequency_and_rank(spark):
    bag = spark.createDataFrame([("k", "", t) for t in ["A ", " A", "B", "", "  ", None]], "kind string, detail string, text string")
    assert {(r.text_en, r["count"]) for r in frequency.text_frequency(bag).collect()} == {("A", 2), ("B", 1)}
    freq = spark.createDataFrame([("b", 2), ("a", 2), ("c", 3), ("😀", 2), ("￿", 2)], "text_en string, count long")
    assert [r.text_en for r in frequency.ranked(freq).orderBy("rn").collect()] == ["c", "a", "b", "￿", "😀"]
    assert frequency.ranked(freq.limit(0)).count() == 0


def test_dictionary_algebra(spark):
    pairs = spark.createDataFrame([(1, "a", "1"), (2, "b", "2"), (3, "a", "3")], "pos long, en string, ru string")
    assert {(r.en, r.ru) for r in dictionary.first_wins(pairs).collect()} == {("a", "1"), ("b", "2")}
    items = spark.createDataFrame([(1, "1", ""), (2, "1", "y"), (3, "1", "z"), (1, "2", "x"), (2, "2", ""), (1, "3", "")], "pos long, id string, text string")
    assert {(r.id, r.text) for r in dictionary.last_wins(items).collect()} == {("1", "z"), ("2", ""), ("3", "")}
    assert {(r.id, r.text) for r in dictionary.first_non_empty(items).collect()} == {("1", "y"), ("2", "x"), ("3", None)}
    keys = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "rn long, en string")
    assert [(r.en, r.ru) for r in dictionary.padded(keys, spark.createDataFrame([(1, "x"), (4, "y")], "rn long, ru string")).orderBy("rn").collect()] == [("a", "x"), ("b", "b"), ("c", "c")]
    left, right = keys.withColumnRenamed("en", "original"), spark.createDataFrame([(1, "x"), (2, None), (9, "s")], "rn long, translated string")
    assert [tuple(r) for r in dictionary.zip_longest(left, right).orderBy("rn").collect()] == [(1, "a", "x"), (2, "b", "b"), (3, "c", "c"), (9, None, "s")]
    assert providers.longest(["a", "b"], ["x", None, "s"]) == ["x", "b", "s"]


def test_coverage(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "text_en string")
    mapping = spark.createDataFrame([("a", "1"), ("z", "")], "text_en string, text_ru string")
    assert sorted((r.text_en for r in dictionary.missing(rows, mapping).collect()), key=str) == [None, "b", "b"]
    with pytest.raises(PySparkException, match="3 texts"):
        dictionary.check_coverage(rows, mapping)
    with pytest.raises(PySparkException, match="'z'"):
        dictionary.check_coverage(rows.where("text_en = 'a'"), mapping)
    with pytest.raises(PySparkException):
        dictionary.check_not_empty(mapping.limit(0))
    dead = spark.createDataFrame([(1, "a<>", ""), (2, "\\Pa", ""), (3, "\\~", "")], "pos long, en string, ru string")
    assert {r.pos for r in dictionary.dead_keys(dead).collect()} == {1, 2}


def test_settings(spark):
    assert value(spark, T.output_format(lit(None), F.lit("a/b.DWG"))) == "dwg" and value(spark, T.output_format(F.lit("DXF"), F.lit("a.dwg"))) == "dxf"
    with pytest.raises(Exception, match="unsupported"):
        value(spark, T.output_format(F.lit("pdf"), F.lit("a.dwg")))
    assert value(spark, T.with_suffix(F.lit("x.y/plan.v1.dxf"), F.lit(".dwg"))) == "x.y/plan.v1.dwg"
    assert [value(spark, T.percent(F.lit(a), F.lit(b))) for a, b in ((1, 3), (29, 29), (5, 3), (0, 0))] == [33, 100, 100, 100]
    assert value(spark, T.provider_language(F.lit("auto"), "deepl")) is None


def test_replies():
    wanted = [("0", "a"), ("1", "b"), ("2", "c")]
    reply = '{"translations": [{"id": "0", "text": "x"}, {"id": "0", "text": "y"}, {"id": "1", "text": ""}, 5]}'
    assert providers.answers(reply, wanted) == ["y", "b", "c"]
    assert providers.answers(reply, wanted[:1], legacy=True) == ["x"]
    assert providers.answers(" plain ", wanted[:1], legacy=True) == ["plain"]
    with pytest.raises(PySparkException):
        providers.answers("no json", wanted)
    assert providers.request([("0", "é")]) == '{"items": [{"id": "0", "text": "é"}]}'


def test_provider_chain():
    assert providers.backend(providers.Options("noop")) == providers.backend(providers.Options("IDENTITY")) == "noop"
    assert providers.backend(providers.Options("auto")) in ("deep_translator", "googletrans", "google_free")
    for name in ("unknown", "deepl"):
        with pytest.raises(PySparkException):
            providers.backend(providers.Options(name))
    assert list(providers.chunks(list("abcde"), 2)) == [["a", "b"], ["c", "d"], ["e"]]


def test_options_from_the_environment():
    env = {"OPENAI_API_KEY": "k", "OPENAI_STRICT_MODE": " EFFORT ", "OPENAI_STRICT_VALUE": "7", "OPENAI_MODEL": "m"}
    got = providers.with_environment(providers.Options("openai", "", "", None, None, None, 0.2, None, None), env)
    assert (got.source_lang, got.target_lang, got.api_key, got.model, got.strict_mode, got.strict_value) == ("auto", "ru", "k", "m", "effort", 1.0)
    bare = providers.with_environment(providers.Options("deepl", model=None, strict_mode="x", strict_value=None), {"OPENAI_STRICT_VALUE": "much"})
    assert (bare.api_key, bare.model, bare.strict_mode, bare.strict_value) == (None, "gpt-4o-mini", "verbosity", 0.5)


def test_message_of():
    from types import SimpleNamespace as S

    assert providers.message_of(S(choices=[S(message=S(content=""), text=None), S(message=S(content="a"))])) == "a"
    assert providers.message_of({"choices": [{"message": {"content": [{"text": "a"}, "b"]}}]}) == "ab"
    assert providers.message_of({"choices": [{"text": "old"}]}) == "old" and providers.message_of({}) == "" and providers.message_of(None) == ""


def test_translate(spark):
    keys = spark.createDataFrame([(1, " a\\Pb "), (2, "c"), (3, "d<>")], "rn long, text_en string")
    got = providers.translate(keys, providers.Options("dictionary", dictionary={" a\nb ": "x\ny", "c": "", "d__DXF_DIM__": "__DXF_DIM__e"}), 2)
    assert {r.rn: r.text_ru for r in got.collect()} == {1: " x\\Py ", 2: "c", 3: "<>e"}
