"""Text kernel: column functions, all inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode strips it (29 code points).
WS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Fixed values of the drawing text format: the dimension placeholder and what stands for it in requests.
DIM = "<>"
DIM_TOKEN = "__DXF_DIM__"
PARAGRAPH = "\\P"
#: Tokens of a text: the placeholder; a control code with all up to the next backslash; plain text.
TOKENS = r"<>|\\[A-Za-z](?:(?!<>)[^\\])*+|(?:(?!<>)(?:\\(?![A-Za-z])|[^\\]))++"
PROTECTED = r"\A\\[A-Za-z]"

#: Models whose requests carry no temperature but a note, and the notes by mode and level.
REASONING_MODELS = ("gpt-5-chat-latest", "gpt-5-mini", "gpt-5-codex", "gpt-5-pro", "gpt-5")
REASONING_NOTES = {
    "effort": {
        "low": "Keep reasoning effort minimal to prioritise speed over exhaustive detail.",
        "medium": "Balance reasoning effort to maintain accuracy without unnecessary verbosity.",
        "high": "Apply high reasoning effort to maximise translation accuracy and nuance.",
    },
    "verbosity": {
        "low": "Keep the response concise while still delivering an accurate translation.",
        "medium": "Provide a balanced level of detail to ensure clarity and accuracy.",
        "high": "Provide exhaustive detail to ensure every nuance of the translation is captured.",
    },
}

Text = Column | str


def _col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Text) -> Column:
    """Without Unicode white space at both ends; null stays null."""
    return F.btrim(_col(c), F.lit(WS))


def text_or_empty(c: Text) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def is_blank(c: Text) -> Column:
    """Null, empty and white space alike."""
    return strip(text_or_empty(c)) == ""


def non_blank(c: Text) -> Column:
    return ~is_blank(c)


def prepare(c: Text) -> Column:
    """For a provider: paragraph codes become line feeds, the placeholder a word."""
    return F.replace(F.replace(_col(c), F.lit(PARAGRAPH), F.lit("\n")), F.lit(DIM), F.lit(DIM_TOKEN))


def edge_whitespace(original: Text, translated: Text) -> Column:
    """translated with the white space of original around it; an all-blank original counts at both ends.
    Without any there, a blank translation stays as it is. Empty or null translations pass."""
    o, t = text_or_empty(original), _col(translated)
    lead = F.length(o) - F.length(F.ltrim(o, F.lit(WS)))
    trail = F.length(o) - F.length(F.rtrim(o, F.lit(WS)))
    core = F.when((lead > 0) | (trail > 0), strip(t)).otherwise(F.coalesce(F.nullif(strip(t), F.lit("")), t))
    suffix = F.when(trail > 0, F.right(o, trail)).otherwise(F.lit(""))
    return F.when(t == "", t).otherwise(F.concat(F.substring(o, F.lit(1), lead), core, suffix))


def recover(original: Text, translated: Text) -> Column:
    """The inverse of prepare() on a translation, with the original's edges."""
    t = F.replace(_col(translated), F.lit(DIM_TOKEN), F.lit(DIM))
    lines = F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\n"), F.lit(PARAGRAPH))
    t = F.when(F.contains(text_or_empty(original), F.lit(PARAGRAPH)), lines).otherwise(t)
    return F.when(_col(translated) == "", _col(translated)).otherwise(edge_whitespace(original, t))


def fallback(translated: Text, original: Text) -> Column:
    return F.coalesce(F.nullif(_col(translated), F.lit("")), _col(original))


def strip_count_prefix(c: Text) -> Column:
    """Without one leading [digits] and the white space around it; stripped. A text with a line feed after
    the prefix keeps it."""
    s = strip(c)
    rest = F.regexp_replace(s, r"(?U)\A\[\d+\][\s\x1c-\x1f]*", "")
    return F.when(F.contains(rest, F.lit("\n")), s).otherwise(rest)


def with_count(count: Text, text: Text) -> Column:
    return F.concat(F.lit("["), _col(count).cast("string"), F.lit("] "), _col(text))


def worth_translating(c: Text) -> Column:
    """Three characters or more, a Latin letter, no letter-and-digits tag, no short word in capitals."""
    t = strip(text_or_empty(c))
    tag = t.rlike(r"(?U)\A[A-Za-z]\d+\z")
    capitals = (F.upper(t) == t) & (F.lower(t) != t) & (F.length(t) <= 3) & (F.instr(t, " ") == 0)
    return (F.length(t) >= 3) & t.rlike("[A-Za-z]") & ~tag & ~capitals


def replace_literals(c: Text, pairs: list[tuple[str, str]]) -> Column:
    """Each key in turn replaced by its value, so later pairs see earlier output; empty keys are skipped."""
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), (p for p in pairs if p[0]), _col(c))


def replace_in_order(c: Text, pairs: Text) -> Column:
    """As replace_literals() with pairs from an array of (en, ru) in order."""
    some = F.filter(_col(pairs), lambda p: p["en"] != "")
    return F.aggregate(some, _col(c), lambda t, p: F.replace(t, p["en"], p["ru"]))


def tokens(c: Text) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(TOKENS), F.lit(0))


def replace_protected(c: Text, replace) -> Column:
    """replace(text) on the plain tokens only; placeholders and control codes with what follows stay."""
    kept = lambda k: (k == DIM) | k.rlike(PROTECTED)
    return F.array_join(F.transform(tokens(c), lambda k: F.when(kept(k), k).otherwise(replace(k))), "")


def longest_first(pairs: Text) -> Column:
    """An array of (pos, en, ru) by falling length in code points, then position, as (en, ru)."""
    keyed = F.transform(_col(pairs), lambda p: F.struct((-F.length(p["en"])).alias("k"), p["pos"].alias("pos"), p["en"].alias("en"), p["ru"].alias("ru")))
    return F.transform(F.sort_array(keyed), lambda p: F.struct(p["en"].alias("en"), p["ru"].alias("ru")))


def clamp(value: Text, fallback_value: Text | None = None, default: float = 0.5) -> Column:
    """The value, else the fallback, else the default, within 0 and 1."""
    found = F.coalesce(_col(value).cast("double"), *([] if fallback_value is None else [_col(fallback_value).cast("double")]), F.lit(default))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), found))


def strict_mode(mode: Text) -> Column:
    m = F.lower(strip(text_or_empty(mode)))
    return F.when(m.isin("verbosity", "effort"), m).otherwise(F.lit("verbosity"))


def strict_level(value: Text) -> Column:
    v = _col(value)
    return F.when(v <= 0.34, "low").when(v <= 0.67, "medium").otherwise("high")


def reasoning_note(model: Text, mode: Text, level: Text) -> Column:
    """The sentence a request carries for listed models; empty for others."""
    listed = F.lower(text_or_empty(model)).isin(*REASONING_MODELS)
    note = F.coalesce(*(F.when((strict_mode(mode) == m) & (_col(level) == lv), F.lit(text)) for m, by in REASONING_NOTES.items() for lv, text in by.items()), F.lit(""))
    return F.when(listed, note).otherwise(F.lit(""))


def request_temperature(model: Text, temperature: Text) -> Column:
    """Null (left out) for listed models."""
    return F.when(~F.lower(text_or_empty(model)).isin(*REASONING_MODELS), _col(temperature))


def percent(done: Text, total: Text) -> Column:
    """min(100, int(done / total * 100)), in doubles; 100 for a total of 0."""
    share = _col(done).cast("double") / F.nullif(_col(total), F.lit(0)).cast("double") * 100
    return F.coalesce(F.least(F.lit(100), share.cast("int")), F.lit(100))


def output_format(fmt: Text, path: Text) -> Column:
    """The format named, else dwg for a .dwg path, else dxf; an error for other names."""
    by_suffix = F.when(F.lower(_col(path)).rlike(r"[^/\\]\.dwg\z"), "dwg").otherwise("dxf")
    chosen = F.coalesce(F.nullif(F.lower(_col(fmt)), F.lit("")), by_suffix)
    return F.when(chosen.isin("dwg", "dxf"), chosen).otherwise(F.raise_error(F.concat(F.lit("unsupported format: "), chosen)))


def with_suffix(path: Text, suffix: Text) -> Column:
    """The last path part with its extension (if it has one) replaced."""
    return F.concat(F.regexp_replace(_col(path), r"(?<=[^/])\.[^./]+\z", ""), _col(suffix))


def default_path(path: Text, kind: str, fmt: str = "dwg") -> Column:
    """Where the output, map, texts or translated texts of an input go if nothing else is said."""
    return with_suffix(path, F.lit({"output": f"_ru.{fmt}", "map": "_map.csv", "texts": "_texts.txt", "translated": "_texts_ru.txt"}[kind]))


def provider_language(lang: Text, provider: str) -> Column:
    """As providers want it: deepl in capitals with auto left out, the free endpoint in small letters."""
    if provider == "deepl":
        return F.nullif(F.upper(_col(lang)), F.lit("AUTO"))
    return F.lower(_col(lang)) if provider in ("google_free", "google-free") else _col(lang)
