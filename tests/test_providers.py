"""The network providers with stand-ins for their clients."""

import io
import json
import sys
import urllib.parse
from types import ModuleType, SimpleNamespace

import pytest
from pyspark.errors import PySparkException

from glossweave.operators import providers
from glossweave.operators.providers import Options


@pytest.fixture
def no_packages(monkeypatch):
    for name in ("deep_translator", "googletrans", "deepl", "openai"):
        monkeypatch.setitem(sys.modules, name, None)  # importing it fails
    for name in ("DEEPL_AUTH_KEY", "DEEPL_API_KEY", "OPENAI_API_KEY"):
        monkeypatch.delenv(name, raising=False)
    return monkeypatch


def module(monkeypatch, name, **members):
    m = ModuleType(name)
    vars(m).update(members)
    monkeypatch.setitem(sys.modules, name, m)
    return m


class Upper:
    """A client of deep-translator."""

    def __init__(self, source, target):
        self.mark = f"{source}>{target}:"

    def translate(self, text):
        return self.mark + text.upper()

    def translate_batch(self, texts):
        return [self.translate(t) for t in texts]


def broken(*args, **kwargs):
    raise ValueError("no such language")


def test_chain(no_packages):
    """Missing packages pass on; a client that fails to build passes on for auto and is an error for google."""
    assert providers.backend(Options("google")) == providers.backend(Options("auto")) == providers.backend(Options("googletrans")) == "google_free"
    for name in ("deep_google", "deepl", "chatgpt", "strange"):
        with pytest.raises(PySparkException):
            providers.backend(Options(name))
    module(no_packages, "googletrans", Translator=object)
    assert providers.backend(Options("google")) == "googletrans"
    module(no_packages, "deep_translator", GoogleTranslator=broken)
    assert providers.backend(Options("auto")) == "googletrans"
    for name in ("google", "deep_google"):
        with pytest.raises(PySparkException, match="no such language"):
            providers.backend(Options(name))
    module(no_packages, "googletrans", Translator=broken)
    assert providers.backend(Options("auto")) == providers.backend(Options("googletrans")) == "google_free"
    assert providers.CHAIN["auto"][-1] == "deepl"


def test_deep_translator(no_packages):
    module(no_packages, "deep_translator", GoogleTranslator=Upper)
    assert providers.backend(Options("google")) == "deep_translator"
    assert providers.build(Options("google", "en", "ru"))(["a", "b"]) == ["en>ru:A", "en>ru:B"]
    module(no_packages, "deep_translator", GoogleTranslator=type("One", (), {"__init__": lambda s, source, target: None, "translate": lambda s, t: t * 2}))
    assert providers.build(Options("deep_google"))(["a", "b"]) == ["aa", "bb"]


def test_googletrans(no_packages):
    """Batches of thirty; a batch of the wrong length or a failed one goes text by text, a failed text stays."""
    sizes = []

    class Translator:
        def translate(self, x, src, dest):
            sizes.append(len(x) if isinstance(x, list) else 1)
            if isinstance(x, list):
                if "short" in x:
                    return [SimpleNamespace(text="one")]
                if "bad" in x:
                    raise ValueError
                return [SimpleNamespace(text=t.upper()) for t in x]
            if x == "bad":
                raise ValueError
            return SimpleNamespace(text=None if x == "none" else x.upper())

    module(no_packages, "googletrans", Translator=Translator)
    ask = providers.build(Options("googletrans"))
    assert ask([f"t{i}" for i in range(65)]) == [f"T{i}" for i in range(65)] and sizes == [30, 30, 5]
    assert ask(["a", "short"]) == ["A", "SHORT"] and ask(["a", "bad", "none"]) == ["A", "bad", "none"]


def test_google_free(no_packages):
    """One request a text, languages in small letters; the first segment only; any failure gives the text."""

    def opened(url):
        query = dict(urllib.parse.parse_qsl(urllib.parse.urlparse(url).query))
        assert (query["sl"], query["tl"], query["client"], query["dt"]) == ("en", "ru", "gtx", "t")
        if query["q"] == "bad":
            raise OSError("no network")
        return io.BytesIO(json.dumps([[[query["q"].upper(), "x"], ["second", "y"]]]).encode())

    no_packages.setattr(providers.urllib.request, "urlopen", opened)
    assert providers.build(Options("google-free", "EN", "RU"))(["a & b", "bad", "c"]) == ["A & B", "bad", "C"]


def test_deepl(no_packages):
    """Keys from the options or the environment, never another service's; batches of forty; by position."""
    calls = []

    class Translator:
        def __init__(self, key):
            self.key = key

        def translate_text(self, x, source_lang, target_lang):
            calls.append((self.key, source_lang, target_lang, len(x) if isinstance(x, list) else 1))
            if isinstance(x, str):
                return SimpleNamespace(text=None if x == "none" else x.upper())
            if "bad" in x:
                raise ValueError
            return [SimpleNamespace(text=t.upper()) for t in x if t != "cut"]

    module(no_packages, "deepl", Translator=Translator)
    with pytest.raises(PySparkException):
        providers.backend(Options("deepl", api_key="another service's"))
    for env in ({"DEEPL_AUTH_KEY": "k", "DEEPL_API_KEY": "no"}, {"DEEPL_API_KEY": "k"}):
        options = providers.with_environment(Options("deepl", "auto", "de"), env)
        assert options.deepl_key == "k" and providers.backend(options) == "deepl"
    ask = providers.build(Options("deepl", "en", "de", deepl_key="k"))
    assert ask([f"t{i}" for i in range(41)]) == [f"T{i}" for i in range(41)]
    assert calls == [("k", "EN", "DE", 40), ("k", "EN", "DE", 1)]
    assert ask(["a", "b", "cut"]) == ["A", "B", "cut"] and ask(["a", "bad", "none"]) == ["A", "BAD", "none"]
    providers.build(Options("deepl", "auto", "de", deepl_key="k"))(["a"])
    assert calls[-1] == ("k", None, "DE", 1)


def chat(calls, reply):
    def create(**settings):
        calls.append(settings)
        return reply(json.loads(settings["messages"][1]["content"])["items"])

    return create


def answer(items):
    return {"choices": [{"message": {"content": json.dumps({"translations": [{"id": x["id"], "text": x["text"].upper()} for x in items]})}}]}


def test_chatgpt(no_packages):
    """Sixteen a request as JSON, only texts worth it by their originals; no temperature but a note for listed models."""
    calls, made = [], []
    client = lambda **kw: made.append(kw) or SimpleNamespace(chat=SimpleNamespace(completions=SimpleNamespace(create=chat(calls, answer))))
    module(no_packages, "openai", OpenAI=client)
    with pytest.raises(PySparkException):
        providers.build(Options("chatgpt"))
    ask = providers.build(Options("chatgpt", "en", "ru", "k", base_url="u", strict_mode="effort", strict_value=0.9))
    assert made[-1] == {"api_key": "k", "base_url": "u"}
    texts = [f"valve {i}" for i in range(20)] + ["M1", "12__DXF_DIM__"]
    assert ask(texts, [*texts[:-1], "12<>"]) == [t.upper() for t in texts[:20]] + texts[20:]
    assert [len(json.loads(c["messages"][1]["content"])["items"]) for c in calls] == [16, 4]
    assert calls[0]["temperature"] == 0.2 and calls[0]["response_format"] == {"type": "json_object"} and calls[0]["messages"][0]["content"].startswith("You are a professional technical translator.")
    providers.build(Options("gpt", "en", "ru", "k", "GPT-5", strict_mode="effort", strict_value=0.9))(["valve"])
    assert "temperature" not in calls[-1] and calls[-1]["messages"][0]["content"].endswith("Apply high reasoning effort to maximise translation accuracy and nuance.")
    module(no_packages, "openai", OpenAI=lambda **kw: SimpleNamespace(chat=SimpleNamespace(completions=SimpleNamespace(create=broken))))
    with pytest.raises(PySparkException, match="no such language"):
        providers.build(Options("openai", api_key="k"))(["valve"])


def test_chatgpt_of_the_old_kind(no_packages):
    """A package without the newer client: a request a text, no response format, replies that are no JSON count."""
    calls = []
    replies = {"valve": lambda x: answer(x), "pipe": lambda x: {"choices": [{"text": " Rohr "}]}, "bolt": lambda x: {"choices": []}}
    old = SimpleNamespace(create=chat(calls, lambda items: replies[items[0]["text"]](items)))
    m = module(no_packages, "openai", ChatCompletion=old)
    ask = providers.build(Options("openai", "en", "ru", "k", base_url="u"))
    assert (m.api_key, m.api_base) == ("k", "u")
    assert ask(["valve", "pipe", "bolt", "M1"]) == ["VALVE", "Rohr", "bolt", "M1"]
    assert len(calls) == 3 and all("response_format" not in c and c["temperature"] == 0.2 for c in calls)


def test_memory_through_a_failure(spark, tmp_path):
    """A run fails half-way; the next one sends only the requests that had not been answered, and a third sends none.
    Answers of another target language are others'. An empty table asks for nothing."""
    from glossweave.operators import memory

    log, broken = tmp_path / "log", tmp_path / "broken"
    log.mkdir()
    broken.touch()

    def build(options):
        def ask(texts, originals):
            import uuid

            if broken.exists() and any(t.endswith("7") for t in texts):
                raise RuntimeError("the line is dead")
            (log / uuid.uuid4().hex).write_text("\n".join(texts))
            return ["" if t == "text 3" else f"{options.target_lang}:{t}" for t in texts]

        return ask

    def sent():
        found = [t for f in log.iterdir() for t in f.read_text().split("\n")]
        for f in list(log.iterdir()):
            f.unlink()
        return sorted(found)

    keys = spark.createDataFrame([(i + 1, f"text {i}") for i in range(100)], "rn long, text_en string")
    held = memory.Memory(spark, f"file://{tmp_path}/memory")
    run = lambda of=keys, lang="ru": memory.translate(of, providers.Options("noop", target_lang=lang), held, 5, build)
    with pytest.raises(PySparkException):
        run()
    before = sent()
    assert 0 < len(before) < 100 and held.version() == 0
    broken.unlink()
    first = {r.text_en: (r.text_ru, r.requested) for r in run().collect()}
    after = sent()
    assert sorted(before + after) == sorted(r.text_en for r in keys.collect()) and held.version() == 1
    assert {t: ru for t, (ru, _) in first.items()} == {f"text {i}": "text 3" if i == 3 else f"ru:text {i}" for i in range(100)}
    assert sorted(t for t, (_, now) in first.items() if now) == after
    more = keys.unionByName(spark.createDataFrame([(101, "new")], "rn long, text_en string"))
    again = run(more).collect()
    assert sent() == ["new"] and len(again) == 101 and [r.text_en for r in again if r.requested] == ["new"] and held.version() == 2
    assert run(keys.limit(0)).count() == 0 and held.version() == 2
    assert {r.text_ru for r in run(keys.where("rn <= 2"), "de").collect()} == {"de:text 0", "de:text 1"} and sent() == ["text 0", "text 1"]
    assert held.folders() == [*held.folders(2), held.folders()[-1]] and len(held.folders(1)) == 1


def test_memory_writes_its_answers_once(spark, tmp_path, monkeypatch):
    """What was asked is written with the version and nowhere else; texts without rn are sent in their own order."""
    from glossweave.operators import frequency, memory
    from glossweave.plans import tables

    names = []
    for module in (memory, frequency):
        monkeypatch.setattr(module, "materialize", lambda df, name: names.append(name) or tables.materialize(df, name))
    keys = spark.createDataFrame([(f"text {i:02}",) for i in range(20)], "text_en string")
    held = memory.Memory(spark, f"file://{tmp_path}/memory")
    for n, (of, asked) in enumerate(((keys.where("text_en < 'text 08'"), 8), (keys, 12), (keys, 0))):
        got = memory.translate(of, providers.Options("noop"), held, 5)
        assert got.columns == ["text_en", "text_ru", "requested"]
        rows = got.collect()
        assert sum(r.requested for r in rows) == asked and len(rows) == of.count() and all(r.text_ru == r.text_en for r in rows)
        assert held.version() == min(n + 1, 2) and len(list((tmp_path / "memory" / "answers").iterdir())) == held.version()
    assert names == ["memory-known", "ranked"] * 3
