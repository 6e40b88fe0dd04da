"""Drawing exchange files (ASCII DXF) as entities, and back.

A file is a list of (group code, value) pairs. The reader gives one row an entity of the model space,
the paper space (as layout names) and named blocks, with the text of its type; the writer puts changed
texts and styles back into the pairs they came from and leaves every other byte as it was. Files are read
whole, one a task's row: a drawing is the unit of parallelism. DWG goes through an external converter
(convert_dwg).

Drawings since 2007 are UTF-8, older ones are in the code page that their header names; bytes that this
does not decode are kept for the writer and shown as U+FFFD. New characters that a code page lacks are
written as \\U+XXXX.
"""

from __future__ import annotations

import codecs
import os
import re
import shutil
import subprocess
import tempfile
from collections.abc import Iterator, Mapping
from pathlib import Path

import pandas as pd
from pyspark.errors import PySparkRuntimeError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.schema import ATTRIBUTES, ENTITIES, INSERTS, LEADERS, STYLED
from ..plans.tables import filesystem, fresh_path

#: Fixed values of the format: codes of type, text, its continuation, tag, name, layout, paper space, style.
TYPE, TEXT, MORE, TAG, NAME, LAYOUT, PAPER, STYLE = 0, 1, 3, 2, 2, 410, 67, 7
LEADER_TEXT, CELL_TEXT, CELL_TEXT_MORE, CELL, ROWS, COLUMNS, MARKER = 304, 302, 303, 171, 91, 92, 100
CHUNK = 250  # characters that one pair of a long text holds
#: Fixed values of the format: first version with UTF-8, first with handles and subclass markers.
UNICODE_VERSION, MARKER_VERSION = "AC1021", "AC1012"
CONVERTER_VERSION, STYLE_FONT = "ACAD2018", "Arial.ttf"
Entity = dict


def _escape(error: UnicodeError) -> tuple[str | bytes, int]:
    """Bytes that were not decoded as they were; characters that the code page lacks as an escape."""
    if not isinstance(error, UnicodeEncodeError):
        raise error
    done = b""
    for c in error.object[error.start : error.end]:
        done += bytes([ord(c) - 0xDC00]) if 0xDC80 <= ord(c) <= 0xDCFF else f"\\U+{ord(c):04X}".encode("ascii")
    return done, error.end


codecs.register_error("glossweave-dxf", _escape)


def encoding_of(raw: bytes) -> str:
    """By the header: UTF-8 from the version on that has it (and without a known header), else its code page."""
    setting = lambda name: (re.search(rb"\$" + name + rb"\s+\d+\s+(\S+)", raw[:65536]) or [b"", b""])[1].decode("ascii", "replace")
    version, page = setting(b"ACADVER").upper(), setting(b"DWGCODEPAGE").lower()
    if page and (not version or version < UNICODE_VERSION):
        name = re.sub(r"^(ansi_|dos|windows-?)", "cp", page)
        try:
            return codecs.lookup(name).name
        except LookupError:
            pass
    return "utf-8"


def shown(text: str) -> str:
    """A value as a table can hold it: escapes as characters, undecoded bytes as U+FFFD."""
    text = re.sub(r"\\U\+([0-9A-Fa-f]{4})", lambda m: chr(int(m[1], 16)), text) if "\\U+" in text else text
    return "".join("�" if 0xD800 <= ord(c) <= 0xDFFF else c for c in text) if not text.isascii() else text


class Drawing:
    """The pairs of a file, with what is needed to write it back byte by byte."""

    def __init__(self, raw: bytes):
        self.encoding = encoding_of(raw)
        self.mark = raw.startswith(codecs.BOM_UTF8)
        text = raw[3 * self.mark :].decode(self.encoding, "surrogateescape")
        self.end = "\r\n" if "\r\n" in text else "\n"
        lines = text.split("\n")
        self.returns = [x.endswith("\r") for x in lines]
        lines = [x[: len(x) - r] for x, r in zip(lines, self.returns, strict=True)]
        self.rest = lines[len(lines) // 2 * 2 :]
        self.codes: list[int] = []
        for at in range(0, len(lines) // 2 * 2, 2):
            code = lines[at].strip()
            if not code.lstrip("-").isdigit():
                raise PySparkRuntimeError(f"no group code in line {at + 1}")
            self.codes.append(int(code))
        self.lines = lines

    def __len__(self) -> int:
        return len(self.codes)

    def value(self, i: int) -> str:
        return self.lines[2 * i + 1]

    def pairs(self) -> list[tuple[int, str]]:
        return [(c, self.value(i)) for i, c in enumerate(self.codes)]

    def records(self) -> Iterator[tuple[int, int]]:
        """Start and end of each run that begins with a type."""
        starts = [i for i, c in enumerate(self.codes) if c == TYPE]
        return zip(starts, [*starts[1:], len(self)], strict=True)

    def first(self, start: int, end: int, code: int, default: str = "") -> str:
        return next((self.value(i) for i in range(start, end) if self.codes[i] == code), default)

    def written(self, new: dict[int, list[tuple[int, str]]]) -> bytes:
        """The file with the pairs at some places replaced by others (or none), all else as it was."""
        out: list[str] = []
        for i in range(len(self)):
            if i in new:
                out += [f"{code:>3}{self.end}{value}{self.end}" for code, value in new[i]]
            else:
                out += [self.lines[j] + "\r" * self.returns[j] + "\n" * (j + 1 < len(self.lines)) for j in (2 * i, 2 * i + 1)]
        tail = len(self.lines) - len(self.rest)
        out += [x + "\r" * self.returns[tail + k] + "\n" * (tail + k + 1 < len(self.lines)) for k, x in enumerate(self.rest)]
        errors = "surrogateescape" if self.encoding == "utf-8" else "glossweave-dxf"
        return codecs.BOM_UTF8 * self.mark + "".join(out).encode(self.encoding, errors)


def plain_text(raw: str) -> str:
    """The visible text of an MTEXT value: paragraphs as line feeds, stacks with a slash, no formatting."""
    out: list[str] = []
    at = 0
    special = {"c": "Ø", "d": "°", "p": "±"}
    while at < len(raw):
        c, after = raw[at], raw[at + 1 : at + 2]
        at += 1
        if c in "{}":
            continue
        if c == "\\" and after:
            at += 1
            if after in "\\{}":
                out.append(after)
            elif after in "PXN":
                out.append("\n")
            elif after == "~":
                out.append("\xa0")
            elif after == "U" and re.match(r"\+[0-9A-Fa-f]{4}", raw[at : at + 5]):
                out.append(chr(int(raw[at + 1 : at + 5], 16)))
                at += 5
            elif after == "S":
                end = raw.find(";", at)
                end = len(raw) if end < 0 else end
                out.append(re.sub(r"\s*[\^#]\s*", "/", raw[at:end]))
                at = end + 1
            elif after in "ACcfFHQTWp":
                end = raw.find(";", at)
                at = len(raw) if end < 0 else end + 1
            elif after not in "LlOoKk":
                out.append(c + after)
        elif c == "^" and after:
            at += 1
            out.append({"I": "\t", "J": "\n", "M": "", " ": "^"}.get(after, c + after))
        elif c == "%" and raw[at : at + 1] == "%" and raw[at + 1 : at + 2].lower() in ("c", "d", "p", "u", "o"):
            out.append(special.get(raw[at + 1].lower(), ""))
            at += 2
        else:
            out.append(c)
    return "".join(out)


def as_mtext(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\n", "\\P")


def entities_of(d: Drawing) -> list[Entity]:
    """Entities in file order; at: for each text part, the positions of the pairs that hold it."""
    section, block, out = None, None, []
    insert: Entity | None = None
    for start, end in d.records():
        kind, body = d.value(start).strip(), start + 1
        if kind == "SECTION":
            section, block = d.first(body, end, NAME).strip(), None
        elif kind == "ENDSEC":
            section, insert = None, None
        elif section == "BLOCKS" and kind == "BLOCK":
            block, insert = shown(d.first(body, end, NAME)), None
        elif section == "BLOCKS" and kind == "ENDBLK":
            block, insert = None, None
        elif kind == "SEQEND":
            insert = None
        elif section in ("ENTITIES", "BLOCKS"):
            space = "block" if block is not None else "layout"
            paper = "Paper" if d.first(body, end, PAPER).strip() == "1" else "Model"
            name = block if block is not None else shown(d.first(body, end, LAYOUT, paper))
            style = next((i for i in range(body, end) if d.codes[i] == STYLE), None)
            e = {"space": space, "container": name, "dxftype": kind, "text": None, "tag": None, "attribs": None, "cells": None, "alternatives": None}
            e |= {"style": None if style is None else shown(d.value(style)), "style_at": style}
            e["at"] = _texts(kind, d, body, end, e)
            if kind == "ATTRIB" and insert is not None:
                insert["attribs"].append({"tag": e["tag"] or "", "text": e["text"] or ""})
                insert["attrib_at"].append(e["at"])
                continue
            insert = e if kind in INSERTS else insert if kind in ("VERTEX",) else None
            if kind in INSERTS:
                e["attribs"], e["attrib_at"] = [], []
            out.append(e)
    return out


def _texts(kind: str, d: Drawing, start: int, end: int, e: Entity) -> list:
    """Fills the texts of an entity and gives the positions they were read from."""
    where = lambda *codes: [i for i in range(start, end) if d.codes[i] in codes]
    joined = lambda at: "".join(d.value(i) for i in at)
    if kind in ("TEXT", "DIMENSION", *ATTRIBUTES):
        at = where(TEXT)[:1]
        e["text"] = shown(joined(at))
        if kind in ATTRIBUTES:
            e["tag"] = shown(next((d.value(i) for i in where(TAG)), ""))
        return at
    if kind == "MTEXT":
        at = where(MORE, TEXT)
        raw = joined(at)
        e["text"], e["alternatives"] = shown(plain_text(raw)), [shown(raw)]  # the visible text comes first
        return at
    if kind in LEADERS:
        at = where(LEADER_TEXT)[:1]
        e["text"] = shown(joined(at))
        return at
    if kind in ("TABLE", "ACAD_TABLE"):
        e["dxftype"] = "TABLE"
        body = next((i for i in where(MARKER) if d.value(i).strip() == "AcDbTable"), start)
        number = lambda code: int(next((d.value(i) for i in range(body, end) if d.codes[i] == code), "0").strip() or 0)
        columns, cells = number(COLUMNS), _cells(d, body, end)
        if number(ROWS) and columns:
            cells = cells[: number(ROWS) * columns]
        texts = [shown(joined(c["display"] or c["value"])) for c in cells]
        e["cells"] = [texts[k : k + columns] for k in range(0, len(texts), columns)] if columns else []
        return cells
    return []


def _cells(d: Drawing, start: int, end: int) -> list[dict[str, list[int]]]:
    """The positions of each cell's text as displayed (parts, then their last) and as value (likewise). A cell
    begins with its type; in a table without types every last part ends a cell, of the displayed ones if there
    are any."""
    starts = [i for i in range(start, end) if d.codes[i] == CELL]
    if starts:
        spans = list(zip(starts, [*starts[1:], end], strict=True))
        return [{"display": _run(d, *s, CELL_TEXT_MORE, CELL_TEXT), "value": _run(d, *s, TAG, TEXT)} for s in spans]
    more, last = (CELL_TEXT_MORE, CELL_TEXT) if any(d.codes[i] == CELL_TEXT for i in range(start, end)) else (TAG, TEXT)
    out, own = [], []
    for i in range(start, end):
        if d.codes[i] in (more, last):
            own.append(i)
            if d.codes[i] == last:
                out.append({"display": own if last == CELL_TEXT else [], "value": own if last == TEXT else []})
                own = []
    return out


def _run(d: Drawing, start: int, end: int, more: int, last: int) -> list[int]:
    at = [i for i in range(start, end) if d.codes[i] in (more, last)]
    ends = [k for k, i in enumerate(at) if d.codes[i] == last]
    return at[: ends[0] + 1] if ends else []


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """The entities of all files below a path, doc_id being the file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ", 1)[0] for c in ("doc_id", "space", "container", "entity_ix", "dxftype", "text", "tag", "attribs", "cells", "alternatives", "style")]
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                found = entities_of(Drawing(bytes(raw)))
                rows = [{"doc_id": name, "entity_ix": i, **{k: e[k] for k in names if k not in ("doc_id", "entity_ix")}} for i, e in enumerate(found)]
                yield pd.DataFrame(rows, columns=names)

    return _drawings(spark, path).select("path", "content").mapInPandas(run, ENTITIES)


def _drawings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[dD][xX][fF]").option("recursiveFileLookup", "true").load(path)


def _parts(codes: tuple[int, int], text: str) -> list[tuple[int, str]]:
    """A long text as pairs: all but the last of the first code."""
    pieces = [text[k : k + CHUNK] for k in range(0, len(text), CHUNK)] or [""]
    return [*((codes[0], p) for p in pieces[:-1]), (codes[1], pieces[-1])]


def _put(new: dict, at: list[int], pairs: list[tuple[int, str]]) -> None:
    for i in at[1:]:
        new[i] = []
    new[at[0]] = pairs


def with_texts(raw: bytes, changed: dict[int, Entity], font: str = STYLE_FONT) -> bytes:
    """A file with the texts and styles of some entities (by entity_ix) replaced where they differ from what
    was read; styles that it lacks are added with the font. All other bytes stay as they are."""
    d = Drawing(raw)
    new: dict[int, list[tuple[int, str]]] = {}
    styles: set[str] = set()
    for ix, e in enumerate(entities_of(d)):
        c = changed.get(ix)
        if c is None:
            continue
        if e["dxftype"] == "TABLE":
            texts = [t for row in c["cells"] for t in row]
            was = [t for row in e["cells"] for t in row]
            for cell, old, text in zip(e["at"], was, texts, strict=False):
                if (text or "") != old:
                    for at, codes in ((cell["display"], (CELL_TEXT_MORE, CELL_TEXT)), (cell["value"], (TAG, TEXT))):
                        if at:
                            _put(new, at, _parts(codes, text or ""))
        elif e["at"] and (c["text"] or "") != e["text"]:
            text = c["text"] or ""
            _put(new, e["at"], _parts((MORE, TEXT), as_mtext(text)) if e["dxftype"] == "MTEXT" else [(d.codes[e["at"][0]], text)])
        for at, was, a in zip(e.get("attrib_at") or [], e["attribs"] or [], c.get("attribs") or [], strict=False):
            if at and (a["text"] or "") != was["text"]:
                new[at[0]] = [(TEXT, a["text"] or "")]
        style = c.get("style")
        if style and e["dxftype"] in STYLED and style != e["style"]:
            styles.add(style)
            if e["style_at"] is not None:
                new[e["style_at"]] = [(STYLE, style)]
            elif e["at"]:
                last = e["at"][-1]
                new[last] = [*new.get(last, [(d.codes[last], d.value(last))]), (STYLE, style)]
    for style in sorted(styles):
        _add_style(d, new, style, font)
    return d.written(new)


def _add_style(d: Drawing, new: dict[int, list[tuple[int, str]]], style: str, font: str) -> None:
    """Sets the font of a text style, or puts the style at the end of the table of styles; a drawing without
    that table gets one."""
    section = in_table = None
    owner, table_end, header_end, body = "", None, None, None
    for start, end in d.records():
        kind = d.value(start).strip()
        if kind == "SECTION":
            section = d.first(start, end, NAME).strip()
            if section in ("BLOCKS", "ENTITIES") and body is None:
                body = start
        elif kind == "ENDSEC":
            header_end = end if section == "HEADER" else header_end
        elif section == "TABLES" and kind == "TABLE":
            in_table = d.first(start + 1, end, NAME).strip()
            owner = d.first(start + 1, end, 5) if in_table == "STYLE" else owner
        elif section == "TABLES" and kind == "STYLE" and in_table == "STYLE" and d.first(start + 1, end, NAME) == style:
            at = next((i for i in range(start + 1, end) if d.codes[i] == 3), None)
            if at is not None and d.value(at) != font:
                new[at] = [(3, font)]
            return
        elif section == "TABLES" and kind == "ENDTAB":
            table_end = start if in_table == "STYLE" else table_end
            in_table = None
    setting = lambda name, code: next((i + 1 for i in range(len(d) - 1) if d.codes[i] == 9 and d.value(i).strip() == name and d.codes[i + 1] == code), None)
    version, seed = setting("$ACADVER", 1), setting("$HANDSEED", 5)
    marked = version is not None and d.value(version).strip() >= MARKER_VERSION
    record = [(TYPE, "STYLE")]
    if seed is not None and marked:
        held = new.get(seed, [(5, d.value(seed))])[0][1].strip()
        record += [(5, held), *([(330, owner)] if owner else [])]
        new[seed] = [(5, f"{int(held, 16) + 1:X}")]
    record += [(MARKER, "AcDbSymbolTableRecord"), (MARKER, "AcDbTextStyleTableRecord")] if marked else []
    record += [(NAME, style), (70, "0"), (40, "0.0"), (41, "1.0"), (50, "0.0"), (71, "0"), (42, "2.5"), (3, font), (4, "")]
    if table_end is not None:
        new[table_end] = [*record, *new.get(table_end, [(TYPE, d.value(table_end))])]
        return
    at = header_end if header_end is not None and header_end < len(d) else body
    if at is not None:
        table = [(TYPE, "SECTION"), (NAME, "TABLES"), (TYPE, "TABLE"), (NAME, "STYLE"), (70, "1"), *record, (TYPE, "ENDTAB"), (TYPE, "ENDSEC")]
        new[at] = [*table, *new.get(at, [(d.codes[at], d.value(at))])]


def _store(to: str, raw: bytes) -> None:
    """Writes a file from a worker."""
    from pyarrow import fs as pafs

    fs, path = pafs.FileSystem.from_uri("file:///" + to[len("file:") :].lstrip("/") if to.startswith("file:") else to)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path) as f:
        f.write(raw)


def write_files(files: DataFrame, out: str) -> DataFrame:
    """files: name, content (binary). Writes a file a row below out; gives name and output."""
    fs_of, p = filesystem(files.sparkSession, out)
    target = fs_of.makeQualified(p).toString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            to = [f"{target}/{name}" for name in pdf["name"]]
            for path, content in zip(to, pdf["content"], strict=True):
                _store(path, bytes(content))
            yield pd.DataFrame({"name": pdf["name"], "output": to})

    return files.select("name", "content").mapInPandas(run, "name string, output string")


def write_entities(entities: DataFrame, source: str, out: str, font: str = STYLE_FONT) -> DataFrame:
    """Writes each source file, with the texts and styles of entities in it, and gives doc_id and output. Files
    go below out under the path that they have below the source; if out names a .dxf file, the one drawing
    goes there.

    Entities of a file are gathered by file: a drawing is read and written whole.
    """
    spark = entities.sparkSession
    files = _drawings(spark, source).select(F.col("path").alias("doc_id"), "content")
    fs_of, root = filesystem(spark, re.split(r"[*?\[{]", source, maxsplit=1)[0].rstrip("/") or "/")
    base, single = fs_of.makeQualified(root).toString(), out.lower().endswith(".dxf")
    if single and files.select("doc_id").limit(2).count() > 1:
        raise PySparkRuntimeError("several drawings can't be written to one file; name a folder")
    target = filesystem(spark, out)[0].makeQualified(filesystem(spark, out)[1]).toString()

    def below(path: str) -> str:
        same = re.sub(r"^file:/+", "file:/", path), re.sub(r"^file:/+", "file:/", base)
        return same[0][len(same[1]) :].lstrip("/") if same[0].startswith(same[1] + "/") else path.rsplit("/", 1)[1]

    def run(key: tuple, mine: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame({"doc_id": [], "output": []})
        some = lambda v: [] if v is None else list(v)
        changed = {
            int(r["entity_ix"]): {"text": r["text"], "style": r["style"], "cells": [some(row) for row in some(r["cells"])], "attribs": some(r["attribs"])}
            for r in rows.to_dict("records")
        }
        to = target if single else f"{target.rstrip('/')}/{below(str(key[0]))}"
        _store(to, with_texts(bytes(mine["content"].iloc[0]), changed, font))
        return pd.DataFrame({"doc_id": [key[0]], "output": [to]})

    rows = entities.select("doc_id", "entity_ix", "text", "cells", "attribs", "style")
    return files.groupBy("doc_id").cogroup(rows.groupBy("doc_id")).applyInPandas(run, "doc_id string, output string")


def input_kind(path: str) -> str:
    """dxf or dwg, by the suffix in any case."""
    suffix = Path(path).suffix.lower()
    if suffix not in (".dxf", ".dwg"):
        raise PySparkRuntimeError("inputs are .dxf or .dwg files")
    return suffix[1:]


def is_drawing(path: str) -> bool:
    """Whether a path names one drawing, and not a folder or a pattern."""
    return Path(path).suffix.lower() in (".dxf", ".dwg")


def converter(env: Mapping[str, str] = os.environ, windows: bool = os.name == "nt", command: str = "ODAFileConverter") -> str | None:
    """The external converter: on the path, else where the settings of the environment say, else (on Windows)
    the newest one below the program folders."""
    found = shutil.which(command, path=env.get("PATH"))
    if found:
        return found
    places = [Path(env["ODA_FILE_CONVERTER"])] if env.get("ODA_FILE_CONVERTER") else []
    home = env.get("ODAFC_PATH") or env.get("ODAFC_HOME")
    if home:
        places += [Path(home) / f"{command}.exe", Path(home) / command]
    if windows:
        for base in filter(None, (env.get("ProgramFiles"), env.get("ProgramFiles(x86)"))):
            places += [p / f"{command}.exe" for p in sorted((Path(base) / "ODA").glob(f"{command}*"), reverse=True)]
    return next((str(p) for p in places if p.exists()), None)


def convert_dwg(source: str, target: str, version: str = CONVERTER_VERSION, command: str | None = None) -> None:
    """Converts one local file into another, of the kind that the target's suffix names, with the external
    converter (driver side). It works from folder to folder and keeps names, so both are folders of their own."""
    found = command or converter()
    if not found:
        raise PySparkRuntimeError("no converter for DWG files: install ODAFileConverter and put it on the path")
    with tempfile.TemporaryDirectory(prefix="glossweave-") as folder:
        given, made = Path(folder, "in"), Path(folder, "out")
        given.mkdir()
        made.mkdir()
        shutil.copy(source, given / Path(source).name)
        kind = input_kind(target)
        done = subprocess.run([found, str(given), str(made), version, kind.upper(), "0", "1"], capture_output=True, text=True)
        results = [p for p in made.iterdir() if p.suffix.lower() == f".{kind}"]
        if done.returncode or not results:
            raise PySparkRuntimeError(f"the converter failed on {Path(source).name}: {done.stderr.strip() or 'no output'}")
        Path(target).parent.mkdir(parents=True, exist_ok=True)
        shutil.move(str(results[0]), target)


def prepared_input(spark: SparkSession, path: str) -> str:
    """A .dxf path, a folder or a pattern as it is; a .dwg file converted into the shared folder, where all
    executors see it; any other file is refused."""
    fs, p = filesystem(spark, path)
    if not is_drawing(path) and (re.search(r"[*?\[{]", path) or (fs.exists(p) and fs.getFileStatus(p).isDirectory())):
        return path
    if input_kind(path) == "dxf":
        return path
    to = f"{fresh_path(spark, 'dwg')}/{Path(path).stem}_source.dxf"
    with tempfile.TemporaryDirectory(prefix="glossweave-") as folder:
        local, made = f"{folder}/{Path(path).name}", f"{folder}/made/{Path(path).stem}_source.dxf"
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs.copyToLocalFile(False, p, hadoop(f"file://{local}"), True)
        convert_dwg(local, made)
        out, q = filesystem(spark, to)
        out.copyFromLocalFile(hadoop(f"file://{made}"), q)
    return to


def final_path(source: str, output: str, fmt: str) -> str:
    """The output of one drawing with the suffix of the format; a folder as it is."""
    return output if not is_drawing(source) else output[: len(output) - len(Path(output).suffix)] + f".{fmt}"


def save_drawing(entities: DataFrame, source: str, output: str, fmt: str, font: str = STYLE_FONT) -> str:
    """Writes one drawing to a path whose suffix the format forces (dwg through the converter), or a folder of
    drawings as .dxf files; gives the path."""
    spark = entities.sparkSession
    final = final_path(source, output, fmt)
    if fmt == "dxf" or not is_drawing(source):
        write_entities(entities, source, final, font).count()
        return final
    between = f"{fresh_path(spark, 'dxf')}/{Path(final).stem}.dxf"
    write_entities(entities, source, between, font).count()
    with tempfile.TemporaryDirectory(prefix="glossweave-") as folder:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        local, made = f"{folder}/{Path(final).stem}.dxf", f"{folder}/made/{Path(final).stem}.dwg"
        fs, p = filesystem(spark, between)
        fs.copyToLocalFile(False, p, hadoop(f"file://{local}"), True)
        convert_dwg(local, made)
        out, q = filesystem(spark, final)
        out.copyFromLocalFile(False, True, hadoop(f"file://{made}"), q)
    return final
