"""Translation providers: list of texts in, list of as many texts out, in order.

A provider is built in the Python worker from its name and options, so clients need not be serialised.
noop and dictionary work anywhere; the network ones need their packages and are tried in order until
one can be built. Every distinct text is sent once, and the result is written before it is used again.
"""

from __future__ import annotations

import json
import os
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.errors import PySparkRuntimeError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.tables import materialize

#: Prepared texts and, where a backend looks at them, their originals.
Translate = Callable[..., list[str]]

#: Texts a request, by backend. None: as many as a batch holds.
BATCH = {"deep_translator": None, "googletrans": 30, "google_free": 1, "deepl": 40, "chatgpt": 16, "chatgpt_legacy": 1, "noop": None, "dictionary": None}
#: The backends each provider name may use, in order.
CHAIN = {
    "google": ("deep_translator", "googletrans", "google_free"),
    "auto": ("deep_translator", "googletrans", "google_free", "deepl"),
    "deep_google": ("deep_translator",),
    "googletrans": ("googletrans", "google_free"),
    "google_free": ("google_free",),
    "google-free": ("google_free",),
    "deepl": ("deepl",),
    "chatgpt": ("chatgpt",),
    "gpt": ("chatgpt",),
    "openai": ("chatgpt",),
    "noop": ("noop",),
    "identity": ("noop",),
    "dictionary": ("dictionary",),
}
#: Fixed value: the instruction of a request.
SYSTEM = (
    "You are a professional technical translator. Translate the provided values from {source} to {target}. Preserve numbers, "
    "placeholders like '__DXF_DIM__', and DXF control sequences such as '\n'. Respond "
    'with strict JSON: {{"translations": [{{"id": "<id>", "text": "<translated>"}}, ...]}}'
)


@dataclass(frozen=True)
class Options:
    provider: str = "google"
    source_lang: str = "auto"
    target_lang: str = "ru"
    api_key: str | None = None
    model: str | None = "gpt-4o-mini"
    base_url: str | None = None
    temperature: float = 0.2
    strict_mode: str | None = "verbosity"
    strict_value: float | None = 0.5
    dictionary: dict[str, str] = field(default_factory=dict)
    deepl_key: str | None = None


def with_environment(options: Options, env: Mapping[str, str] = os.environ) -> Options:
    """Settings left open taken from the environment; strictness clamped to 0..1 (0.5 if it is no number),
    unknown modes verbosity."""
    mode = (options.strict_mode or env.get("OPENAI_STRICT_MODE", "")).strip().lower()
    value = options.strict_value
    if value is None:
        try:
            value = float(env.get("OPENAI_STRICT_VALUE", ""))
        except ValueError:
            value = 0.5
    return replace(
        options,
        provider=(options.provider or "google").lower(),
        source_lang=options.source_lang or "auto",
        target_lang=options.target_lang or "ru",
        api_key=options.api_key or env.get("OPENAI_API_KEY"),
        deepl_key=options.deepl_key or env.get("DEEPL_AUTH_KEY") or env.get("DEEPL_API_KEY"),
        model=options.model or env.get("OPENAI_MODEL", "gpt-4o-mini"),
        base_url=options.base_url or env.get("OPENAI_BASE_URL"),
        strict_mode=mode if mode in T.REASONING_NOTES else "verbosity",
        strict_value=max(0.0, min(1.0, value)),
    )


def message_of(reply) -> str:
    """The first text that is not empty in a chat reply: objects, mappings or models of either; the content
    of a choice's message (a text, or parts with texts), else the choice's own text."""
    if hasattr(reply, "model_dump"):
        reply = reply.model_dump()
    get = lambda x, k: x.get(k) if isinstance(x, Mapping) else getattr(x, k, None)
    for choice in get(reply, "choices") or []:
        content = get(get(choice, "message"), "content") or get(choice, "text")
        if isinstance(content, list):
            content = "".join(x if isinstance(x, str) else get(x, "text") or "" for x in content)
        if content:
            return content
    return ""


class Unavailable(Exception):
    """A backend that lacks its package or its key."""


def select(options: Options) -> tuple[str, Translate]:
    """The first backend of the provider's chain that can be built here, and it. A missing package passes to
    the next one; another failure does so for auto and for googletrans, and is raised otherwise."""
    name, tried = (options.provider or "google").lower(), []
    for b in CHAIN.get(name, ()):
        try:
            return b, BACKENDS[b](options)
        except (ImportError, Unavailable) as e:
            tried.append(f"{b}: {e}")
        except Exception as e:
            if name != "auto" and b != "googletrans":
                raise PySparkRuntimeError(f"{b} can't be used: {e}") from e
            tried.append(f"{b}: {e}")
    raise PySparkRuntimeError(f"no translation provider for {options.provider!r}" + "".join(f"; {x}" for x in tried))


def backend(options: Options) -> str:
    return select(options)[0]


def build(options: Options) -> Translate:
    return select(options)[1]


def _noop(options: Options) -> Translate:
    return lambda texts, originals=None: list(texts)


def _dictionary(options: Options) -> Translate:
    return lambda texts, originals=None: [options.dictionary.get(t, t) for t in texts]


def chunks(texts: list[str], size: int | None) -> Iterator[list[str]]:
    size = size or max(1, len(texts))
    for at in range(0, len(texts), size):
        yield texts[at : at + size]


def _google_free(options: Options) -> Translate:
    def one(text: str) -> str:
        query = urllib.parse.urlencode({"client": "gtx", "sl": options.source_lang.lower(), "tl": options.target_lang.lower(), "dt": "t", "q": text})
        try:
            with urllib.request.urlopen(f"https://translate.googleapis.com/translate_a/single?{query}") as reply:
                return json.load(reply)[0][0][0] or text
        except Exception:  # this provider gives the text itself for any failure
            return text

    return lambda texts, originals=None: [one(t) for t in texts]


def _deep_translator(options: Options) -> Translate:
    from deep_translator import GoogleTranslator

    client = GoogleTranslator(source=options.source_lang, target=options.target_lang)
    return lambda texts, originals=None: list(client.translate_batch(list(texts))) if hasattr(client, "translate_batch") else [client.translate(t) for t in texts]


def _one_by_one(texts: list[str], ask: Callable[[str], object]) -> list[str]:
    """Each text on its own; the text itself where that fails or gives none."""
    out = []
    for t in texts:
        try:
            got = getattr(ask(t), "text", None)
        except Exception:  # a failure costs one text its translation, no more
            got = None
        out.append(t if got is None else got)
    return out


def _googletrans(options: Options) -> Translate:
    from googletrans import Translator

    client = Translator()
    ask = lambda x: client.translate(x, src=options.source_lang, dest=options.target_lang)

    def run(texts: list[str], originals: list[str] | None = None) -> list[str]:
        out: list[str] = []
        for part in chunks(texts, BATCH["googletrans"]):
            try:
                got = ask(part)
                found = [getattr(x, "text", None) for x in (got if isinstance(got, list) else [got])]
            except Exception:  # then text by text
                found = []
            out += found if len(found) == len(part) and None not in found else _one_by_one(part, ask)
        return out

    return run


def _deepl(options: Options) -> Translate:
    if not options.deepl_key:
        raise Unavailable("a key is needed: deepl_key, DEEPL_AUTH_KEY or DEEPL_API_KEY")
    import deepl

    client = deepl.Translator(options.deepl_key)
    source = options.source_lang.strip().upper()
    ask = lambda x: client.translate_text(x, source_lang=None if source in ("", "AUTO") else source, target_lang=options.target_lang.strip().upper() or "RU")

    def run(texts: list[str], originals: list[str] | None = None) -> list[str]:
        out: list[str] = []
        for part in chunks(texts, BATCH["deepl"]):
            try:
                got = ask(part)
            except Exception:  # then text by text
                out += _one_by_one(part, ask)
                continue
            out += longest(part, [getattr(x, "text", None) for x in (got if isinstance(got, list) else [got])])
        return out

    return run


def longest(originals: list[str], answers: list[str | None]) -> list[str | None]:
    """Answers by position, originals where one is missing; surplus answers stay."""
    n = max(len(originals), len(answers))
    at = lambda xs, i: xs[i] if i < len(xs) else None
    return [at(answers, i) if at(answers, i) is not None else at(originals, i) for i in range(n)]


def request(items: list[tuple[str, str]]) -> str:
    return json.dumps({"items": [{"id": i, "text": t} for i, t in items]}, ensure_ascii=False)


def answers(message: str, wanted: list[tuple[str, str]], legacy: bool = False) -> list[str]:
    """The texts of a reply for the (id, text) wanted. The last answer of an id counts, even if empty, and an
    empty or missing one gives the text itself; in legacy mode the first answer that is not empty counts,
    and a reply that is no JSON is the text."""
    try:
        found = json.loads(message or "{}").get("translations", [])
    except json.JSONDecodeError as e:
        if not legacy:
            raise PySparkRuntimeError("the reply is not JSON") from e
        return [message.strip() or t for _, t in wanted]
    rows = [(x.get("id"), x.get("text")) for x in found if isinstance(x, dict)]
    rows = [(i, t) for i, t in reversed(rows) if isinstance(t, str) and t] if legacy else rows
    by_id = dict(rows)
    return [by_id.get(i) or t for i, t in wanted]


def is_worth(text: str) -> bool:
    """The Python form of functions.text.worth_translating, for use inside a worker."""
    t = text.strip()
    latin = any(c.isascii() and c.isalpha() for c in t)
    tag = len(t) > 1 and t[0].isascii() and t[0].isalpha() and t[1:].isdecimal()
    return len(t) >= 3 and latin and not tag and not (t.isupper() and len(t) <= 3 and " " not in t)


def _chatgpt(options: Options) -> Translate:
    """Texts worth it, by their originals, in batches; with a client of the old kind one by one."""
    if not options.api_key:
        raise Unavailable("a key is needed: api_key or OPENAI_API_KEY")
    import openai

    try:
        create, legacy = openai.OpenAI(api_key=options.api_key, **({"base_url": options.base_url} if options.base_url else {})).chat.completions.create, False
    except (AttributeError, ImportError, TypeError):
        openai.api_key = options.api_key
        if options.base_url:
            openai.api_base = options.base_url
        create, legacy = openai.ChatCompletion.create, True
    model, value = options.model or "gpt-4o-mini", 0.5 if options.strict_value is None else options.strict_value
    listed = model.lower() in T.REASONING_MODELS
    level = "low" if value <= 0.34 else "medium" if value <= 0.67 else "high"
    system = SYSTEM.format(source=options.source_lang or "auto-detected", target=options.target_lang)
    if listed:
        system += " " + T.REASONING_NOTES[options.strict_mode if options.strict_mode in T.REASONING_NOTES else "verbosity"][level]
    extra = ({} if listed else {"temperature": options.temperature}) | ({} if legacy else {"response_format": {"type": "json_object"}})

    def run(texts: list[str], originals: list[str] | None = None) -> list[str]:
        shown = originals or texts
        out, asked = list(texts), [i for i, t in enumerate(texts) if is_worth(shown[i] if i < len(shown) else t)]
        for part in chunks(asked, BATCH["chatgpt_legacy" if legacy else "chatgpt"]):
            wanted = [(str(i), texts[i]) for i in part]
            messages = [{"role": "system", "content": system}, {"role": "user", "content": request(wanted)}]
            try:
                reply = create(model=model, messages=messages, **extra)
            except Exception as e:
                raise PySparkRuntimeError(f"the translation request failed: {e}") from e
            for i, t in zip(part, answers(message_of(reply) or "{}", wanted, legacy), strict=True):
                out[i] = t
        return out

    return run


BACKENDS: dict[str, Callable[[Options], Translate]] = {
    "noop": _noop,
    "dictionary": _dictionary,
    "google_free": _google_free,
    "deep_translator": _deep_translator,
    "googletrans": _googletrans,
    "deepl": _deepl,
    "chatgpt": _chatgpt,
}


def translate(keys: DataFrame, options: Options, batch: int = 512) -> DataFrame:
    """keys: rn, text_en (distinct). Adds text_ru: prepared, sent in batches, empty answers replaced by the
    original, recovered. A count among the keys' columns goes along. A batch whose answers are too few is refused rather than shifted. Written once, so
    that no consumer asks the provider again."""
    backend(options)  # fails on the driver
    along = [c for c in keys.columns if c == "count"]
    sent = keys.select("rn", *along, "text_en", T.prepare("text_en").alias("prepared"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = build(options)
        for pdf in parts:
            out: list[str | None] = []
            originals = list(pdf["text_en"])
            for k, part in enumerate(chunks(list(pdf["prepared"]), batch)):
                got = ask(part, originals[k * batch : (k + 1) * batch])
                if len(got) < len(part):
                    raise PySparkRuntimeError(f"{len(part)} texts were sent, {len(got)} came back")
                out += got[: len(part)]
            yield pdf[["rn", *along, "text_en"]].assign(answer=out)

    got = sent.mapInPandas(run, f"rn long, {'count long, ' if along else ''}text_en string, answer string")
    done = got.select("rn", *along, "text_en", T.recover("text_en", T.fallback("answer", "text_en")).alias("text_ru"))
    return materialize(done, "translated")


def requests(keys: DataFrame, size: int = BATCH["chatgpt"]) -> DataFrame:
    """keys: rn, text. batch and payload: the JSON request of each batch, ids counted from 0."""
    item = F.struct(F.col("rn"), F.struct((F.col("rn") - 1).cast("string").alias("id"), F.col("text").alias("text")).alias("i"))
    items = F.transform(F.sort_array(F.collect_list(item)), lambda x: x["i"])  # at most size
    return keys.groupBy(F.floor((F.col("rn") - 1) / size).cast("long").alias("batch")).agg(F.to_json(F.struct(items.alias("items"))).alias("payload"))


def parsed(replies: DataFrame) -> DataFrame:
    """replies: payload. pos, id, text of each answer; a payload that is no JSON gives none."""
    items = F.from_json("payload", "translations array<struct<id:string,text:string>>")["translations"]
    return replies.select(F.posexplode(items).alias("pos", "i")).select(F.col("pos").cast("long").alias("pos"), "i.id", "i.text")
