"""Line-first quality rules.

Every line is judged alone by punctuation, navigation and boilerplate rules; failing lines are
removed; a document that loses too much of its text is rejected afterwards. Whole-text counts
(repetition, symbols, duplicate lines) come from the same pass. One narrow map over the scan: no
shuffle, memory bounded by an Arrow batch and one text at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import SPACE

#: Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
#: Rule parameters.
MIN_KEPT_SHARE = 0.6
MAX_SYMBOLS_PER_WORD = 0.3
MAX_SEPARATORS_PER_WORD = 0.15
MAX_UPPER_SHARE = 0.7  # of words
MIN_LONG_LINE = 8
MEAN_WORD = (2.0, 25.0)
SENTENCE_END = re.compile("[.!?:;…\"'”’»)。！？](?=[\\x20\\x09-\\x0D]|$)")
SEPARATORS = frozenset((b"|", b">", b"<", "»".encode(), "«".encode(), "•".encode(), "·".encode(), b"/", b"::"))
BOILERPLATE = (
    "lorem ipsum", "cookie policy", "cookie settings", "accept cookies", "use cookies", "terms of use", "terms of service",
    "privacy policy", "enable javascript", "all rights reserved", "sign up for our newsletter", "skip to content",
    "skip to main content", "click here to", "share on facebook", "share on twitter", "powered by wordpress",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "accepter les cookies",
    "alle rechte vorbehalten", "datenschutzerklärung", "cookies akzeptieren", "nutzungsbedingungen",
    "todos los derechos reservados", "política de privacidad", "política de cookies", "aceptar cookies",
)

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, n_failed_lines long, kept_share double, clean_text string"
)


def symbols(raw: bytes) -> int:
    return len(raw) - len(raw.translate(None, SYMBOLS))


def line_fault(line: str, stock: bool = True) -> str | None:
    """The rule a line breaks, or None. A line without a word breaks none.

    navigation: separators standing alone make up 0.15 of its words; symbols: more than 0.3 symbols
    of [#*$%&|<>] a word; boilerplate: a stock phrase (not looked for unless stock); shouting: of 8
    words or more, 0.7 are in capitals; punctuation: of 8 words or more, none ends a sentence.
    """
    raw = line.encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return None
    n = len(words)
    if (alone := SEPARATORS.intersection(words)) and sum(map(words.count, alone)) >= max(2, MAX_SEPARATORS_PER_WORD * n):
        return "navigation"
    if symbols(raw) > max(2, MAX_SYMBOLS_PER_WORD * n):
        return "symbols"
    if stock and any(x in line.lower() for x in BOILERPLATE):
        return "boilerplate"
    if n >= MIN_LONG_LINE:
        if sum(map(str.isupper, line.split())) > MAX_UPPER_SHARE * n:
            return "shouting"
        if not SENTENCE_END.search(line):
            return "punctuation"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words covered by the 8-word windows that occur twice or more, first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):  # a mixing fold: order matters, 64 bits
            h = (h ^ ids[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def judge(text: str | None, min_kept_share: float = MIN_KEPT_SHARE) -> tuple:
    """All columns of SCHEMA but the id, for one whole text; null counts as a text without words."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACE))
    n_symbols = symbols(raw)
    lower = text.lower()
    stock = any(x in lower for x in BOILERPLATE)
    seen: set[str] = set()
    dup = failed = 0
    clean: list[str] = []
    kept_chars = 0
    for line in text.split("\n"):
        if not line.strip(SPACE):
            clean.append(line)
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        if line_fault(line, stock):
            failed += 1
        else:
            clean.append(line)
            kept_chars += len(line) - sum(map(line.count, SPACE))
    repeat = repeated_words(words)
    base = n < MIN_WORDS or 100 * repeat > 30 * n
    share = kept_chars / word_chars if word_chars else 0.0
    kept = (
        not base
        and share >= min_kept_share
        and n_symbols <= MAX_SYMBOLS_PER_WORD * n
        and MEAN_WORD[0] <= word_chars / n <= MEAN_WORD[1]
    )
    return n, word_chars, n_symbols, dup, repeat, base, kept, failed, share, "\n".join(clean)


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_kept_share: float = MIN_KEPT_SHARE, with_text: bool = True) -> DataFrame:
    """One row per row of docs: the whole-text counts, the verdict and, if asked, the cleaned text.

    Null or empty text: no words, so base_failed and not kept. Null ids, repeated rows and ties pass
    through row by row. Other columns of docs are ignored, whatever their names. An empty table
    gives an empty table.
    """
    schema = SCHEMA if with_text else SCHEMA.rsplit(",", 1)[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(",")]
        for pdf in batches:
            ids = pdf.iloc[:, 0].astype("Int64")
            rows = [judge(t, min_kept_share) for t in pdf.iloc[:, 1]]
            rows = rows if with_text else [r[:-1] for r in rows]
            out = pd.DataFrame(rows, columns=names[1:])
            out.insert(0, names[0], ids.to_numpy(dtype=object, na_value=None))
            yield out

    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInPandas(run, schema)
