"""Drawings: code pages, formatted texts, cells, styles, names of files, the external converter, commands."""

import os
import stat

import pytest
from pyspark.errors import PySparkException

from glossweave import cli
from glossweave.operators import apply, flatten
from glossweave.plans import localise
from glossweave.sources import dxf, files


def pairs(*flat, end="\n"):
    return "".join(f"{c:>3}{end}{v}{end}" for c, v in zip(flat[::2], flat[1::2], strict=True))


def header(version, page=None, seed=None):
    out = pairs(0, "SECTION", 2, "HEADER", 9, "$ACADVER", 1, version)
    out += pairs(9, "$DWGCODEPAGE", 3, page) if page else ""
    out += pairs(9, "$HANDSEED", 5, seed) if seed else ""
    return out + pairs(0, "ENDSEC")


def entities(body):
    return pairs(0, "SECTION", 2, "ENTITIES") + body + pairs(0, "ENDSEC", 0, "EOF")


def texts(raw):
    return [(e["dxftype"], e["text"], e["style"]) for e in dxf.entities_of(dxf.Drawing(raw))]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("plain", "plain"),
        (r"{\fArial|b0;Valve} \H2.5x;open", "Valve open"),
        (r"a\Pb\~c", "a\nb\xa0c"),
        (r"\A1;{\C1;\Lred\l} \S1^2; \S3#4; \S5/6;", "red 1/2 3/4 5/6"),
        (r"back\\slash \{braces\}", "back\\slash {braces}"),
        (r"50%%d %%c10 %%p1 %%uline%%u", "50° Ø10 ±1 line"),
        (r"\U+041F^Itab^ caret", "П\ttab^caret"),
        ("open {brace", "open brace"),
        (r"end\fArial", "end"),
        ("", ""),
    ],
)
def test_plain_text(raw, want):
    assert dxf.plain_text(raw) == want


@pytest.mark.parametrize(
    ("version", "page", "encoding"),
    [("AC1015", "ANSI_1251", "cp1251"), ("AC1009", "dos850", "cp850"), ("AC1018", "ANSI_936", "gbk"), ("AC1021", "ANSI_1251", "utf-8"), ("AC1032", None, "utf-8"), ("AC1015", "strange", "utf-8")],
)
def test_encoding(version, page, encoding):
    assert dxf.encoding_of(header(version, page).encode()) == encoding


def test_code_pages_and_untouched_bytes():
    """What is not changed is written byte by byte, in any code page; what a page lacks is escaped."""
    body = entities(pairs(0, "TEXT", 1, "Привет Valve", 7, "Standard", 0, "TEXT", 1, "Чертёж", 0, "TEXT", 1, "Valve")).replace("\n", "\r\n")
    old = (header("AC1015", "ANSI_1251").replace("\n", "\r\n") + body).encode("cp1251") + b"999\r\n\x98 undefined\r\n"
    assert dxf.with_texts(old, {}) == old
    assert [t for _, t, _ in texts(old)] == ["Привет Valve", "Чертёж", "Valve"]
    new = dxf.with_texts(old, {0: {"text": "Привет Клапан", "style": "Standard"}, 1: {"text": "Чертёж", "style": None}, 2: {"text": "王 é", "style": None}})
    assert new == old.replace("Привет Valve".encode("cp1251"), "Привет Клапан".encode("cp1251")).replace(b"\r\nValve\r\n", b"\r\n\\U+738B \\U+00E9\r\n")
    assert [t for _, t, _ in texts(new)] == ["Привет Клапан", "Чертёж", "王 é"]
    broken = header("AC1032").encode() + entities(pairs(0, "TEXT", 1, "X\udcff Valve", 0, "TEXT", 1, "Valve")).encode("utf-8", "surrogateescape")
    assert [t for _, t, _ in texts(broken)] == ["X\ufffd Valve", "Valve"]
    assert dxf.with_texts(broken, {0: {"text": "X\ufffd Valve"}, 1: {"text": "Ж"}}) == broken.replace(b"\nValve\n", b"\n\xd0\x96\n")
    marked = b"\xef\xbb\xbf" + broken
    assert dxf.with_texts(marked, {}) == marked


def test_long_mtext():
    """Formatting stays where no text changes; a changed text is written plain, in pieces."""
    raw = header("AC1032").encode() + entities(pairs(0, "MTEXT", 3, "a" * 250, 3, "b" * 250, 1, r"\fArial;end", 0, "MTEXT", 1, "{\\C1;short}")).encode()
    (_, one, _), (_, two, _) = texts(raw)
    assert one == "a" * 250 + "b" * 250 + "end" and two == "short"
    assert dxf.with_texts(raw, {0: {"text": one}, 1: {"text": two}}) == raw
    long = "line\n" * 120 + "last"
    new = dxf.with_texts(raw, {0: {"text": long}, 1: {"text": "s"}})
    assert [t for _, t, _ in texts(new)] == [long, "s"]
    codes = [c for c, v in dxf.Drawing(new).pairs() if c in (1, 3) and v != "AC1032"]
    assert codes == [3, 3, 1, 1]


def test_cells():
    """Continued cells are one text; a cell that holds its value and its display is one cell; written to both."""
    cell = pairs(171, "1", 300, "CELL_VALUE", 1, "value", 303, "long ", 302, "text", 304, "ACVALUE_END")
    old = pairs(171, "1", 2, "x" * 250, 1, "tail")
    body = pairs(0, "ACAD_TABLE", 100, "AcDbBlockReference", 2, "*T1", 100, "AcDbTable", 91, "2", 92, "2") + cell + pairs(171, "1") + old + cell
    raw = entities(body).encode()
    (e,) = dxf.entities_of(dxf.Drawing(raw))
    assert e["cells"] == [["long text", ""], ["x" * 250 + "tail", "long text"]]
    new = dxf.with_texts(raw, {0: {"text": None, "cells": [["long text", ""], ["short", "y" * 300]]}})
    (e,) = dxf.entities_of(dxf.Drawing(new))
    assert e["cells"] == [["long text", ""], ["short", "y" * 300]]
    assert new.count(b"value\n") == 1 and dxf.with_texts(raw, {}) == raw


@pytest.mark.parametrize("version", ["AC1009", "AC1015"])
def test_styles(version):
    """A style that the drawing lacks is added with its font and a handle of its own; one it has gets the font."""
    styles = pairs(0, "SECTION", 2, "TABLES", 0, "TABLE", 2, "STYLE", 5, "3", 70, "1", 0, "STYLE", 5, "11", 2, "Standard", 3, "txt", 0, "ENDTAB", 0, "ENDSEC")
    body = entities(pairs(0, "TEXT", 1, "a", 7, "Standard", 0, "MTEXT", 1, "b", 0, "DIMENSION", 1, "c"))
    change = {i: {"text": t, "style": "RU"} for i, t in enumerate("abc")}
    for raw in (header(version, seed="2F") + styles + body, header(version) + body, body):
        new = dxf.with_texts(raw.encode(), change, "Cyr.ttf")
        assert [s for _, _, s in texts(new)] == ["RU", "RU", None]
        made = dxf.Drawing(new)
        assert [(c, v) for c, v in made.pairs() if v in ("RU", "Cyr.ttf")][:2] == [(2, "RU"), (3, "Cyr.ttf")]
        handles = [v for c, v in made.pairs() if c == 5]
        if version == "AC1015" and "HANDSEED" in raw:
            assert handles == ["30", "3", "11", "2F"] and (330, "3") in made.pairs() and (100, "AcDbTextStyleTableRecord") in made.pairs()
        else:
            assert (100, "AcDbTextStyleTableRecord") not in made.pairs() or version == "AC1015"
        again = dxf.with_texts(new, {i: {"text": t, "style": "RU"} for i, t in enumerate("xbc")}, "Other.ttf")
        assert again.count(b"\nRU\n") == new.count(b"\nRU\n")
    font = dxf.with_texts(body.replace("Standard", "RU").encode(), change)
    assert b"Arial.ttf" in font


def test_names_below_the_source_stay(spark, tmp_path):
    for name, word in (("a/x.dxf", "one"), ("b/x.DXF", "two"), ("c.dxf", "three")):
        (tmp_path / "in.v2" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in.v2" / name).write_text(header("AC1032") + entities(pairs(0, "TEXT", 1, word)))
    source = f"file://{tmp_path}/in.v2"
    assert dxf.prepared_input(spark, source) == source and dxf.final_path(source, "out.v3", "dwg") == "out.v3"
    with pytest.raises(PySparkException, match="inputs are"):
        dxf.prepared_input(spark, f"file://{tmp_path}/x.pdf")
    found = dxf.read_entities(spark, source)
    done = apply.apply_to_entities(found, [("one", "1"), ("two", "2")], None)
    assert dxf.write_entities(done, source, f"file://{tmp_path}/out").count() == 3
    made = {str(p.relative_to(tmp_path / "out")): texts(p.read_bytes())[0][1] for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.startswith(".")}
    assert made == {"a/x.dxf": "1", "b/x.DXF": "2", "c.dxf": "three"}
    with pytest.raises(PySparkException):
        dxf.write_entities(done, source, f"file://{tmp_path}/one.dxf")
    assert sorted(r.text for r in flatten.text_bag(dxf.read_entities(spark, f"file://{tmp_path}/in.v2/*/x.*")).collect()) == ["one", "two"]


def fake_converter(folder):
    """A stand-in that works from folder to folder and keeps names, as the real one does."""
    folder.mkdir(parents=True, exist_ok=True)
    p = folder / "ODAFileConverter"
    p.write_text('#!/bin/sh\ntest "$3" = ACAD2018 || exit 2\nfor f in "$1"/*; do b=$(basename "$f"); e=$(echo "$4" | tr A-Z a-z); cp "$f" "$2/${b%.*}.$e"; done\n')
    p.chmod(p.stat().st_mode | stat.S_IEXEC)
    return p


def test_converter_lookup(tmp_path):
    """The path, then the settings, then the newest of the program folders."""
    on_path, set_, home = fake_converter(tmp_path / "bin"), fake_converter(tmp_path / "set"), fake_converter(tmp_path / "home")
    programs = [tmp_path / "pf" / "ODA" / f"ODAFileConverter {v}" for v in ("25.1", "26.4")]
    for p in programs:
        p.mkdir(parents=True)
        (p / "ODAFileConverter.exe").write_text("")
    env = {"PATH": str(tmp_path / "bin"), "ODA_FILE_CONVERTER": str(set_), "ODAFC_PATH": str(tmp_path / "home"), "ProgramFiles": str(tmp_path / "pf")}
    assert dxf.converter(env) == str(on_path)
    env["PATH"] = str(tmp_path / "none")
    assert dxf.converter(env) == str(set_)
    env["ODA_FILE_CONVERTER"] = "/missing"
    assert dxf.converter(env) == str(home)
    env = {"PATH": str(tmp_path / "none"), "ODAFC_HOME": str(tmp_path / "home"), "ProgramFiles": str(tmp_path / "pf")}
    assert dxf.converter(env) == str(home)
    del env["ODAFC_HOME"]
    assert dxf.converter(env, windows=True) == str(programs[1] / "ODAFileConverter.exe") and dxf.converter(env, windows=False) is None


def test_commands(spark, tmp_path, monkeypatch, capsys):
    """translate and apply from and to DWG through a stand-in for the converter; suffixes and side outputs."""
    drawing = header("AC1032") + entities(pairs(0, "TEXT", 1, "Valve", 0, "TEXT", 1, "Valve open"))
    (tmp_path / "in.dwg").write_text(drawing)
    (tmp_path / "in.dxf").write_text(drawing)
    monkeypatch.chdir(tmp_path)
    run = lambda *args: cli.run(spark, cli.parser().parse_args(list(map(str, args))))
    monkeypatch.setenv("PATH", "/nowhere")
    with pytest.raises(PySparkException, match="converter"):
        run("extract", f"file://{tmp_path}/in.dwg")
    monkeypatch.setenv("ODA_FILE_CONVERTER", str(fake_converter(tmp_path / "bin")))
    monkeypatch.setenv("PATH", os.defpath)
    at = lambda x: f"file://{tmp_path}/{x}"
    run("translate", at("in.dwg"), at("out.dxf"), "--translator", "noop", "--map-csv", at("m.csv"), "--extracted-txt", at("e.txt"), "--translated-txt", at("r.txt"))
    assert "out.dwg" in capsys.readouterr().out and (tmp_path / "out.dwg").exists() and not (tmp_path / "out.dxf").exists()
    assert [(r.text_en, r.text_ru) for r in files.read_csv(spark, at("m.csv")).collect()] == [("Valve", "Valve"), ("Valve open", "Valve open")]
    assert spark.read.text(at("e.txt")).count() == spark.read.text(at("r.txt")).count() == 2
    assert [s for _, _, s in texts((tmp_path / "out.dwg").read_bytes())] == ["RU", "RU"]
    run("translate", at("in.dxf"), "--translator", "noop", "--output-format", "dxf", "--no-map", "--skip-txt", "--style-font", "F.ttf")
    assert b"F.ttf" in (tmp_path / "in_ru.dxf").read_bytes() and not (tmp_path / "map_auto.csv").exists()
    (tmp_path / "d.csv").write_text("text_en,text_ru\nValve,Клапан\n")
    run("apply", at("in.dxf"), at("d.csv"), at("applied.dxf"))
    assert [t for _, t, _ in texts((tmp_path / "applied.dxf").read_bytes())] == ["Клапан", "Клапан open"]
    (tmp_path / "en.txt").write_text("[2] Valve\n")
    (tmp_path / "ru.txt").write_text("K\n")
    assert run("apply", at("in.dwg"), at("ru.txt"), at("a.dwg"), "--source-en", at("en.txt")) == 0 and (tmp_path / "a.dwg").exists()
    assert run("apply", at("in.dxf"), at("ru.txt"), at("a.dxf")) == 2
    args = cli.parser().parse_args(["translate", "a.dwg", "b"])
    assert (args.source_lang, args.target_lang, args.map_csv, args.extracted_txt, args.translated_txt, args.output_format, args.translator) == ("en", "ru", "map_auto.csv", "extracted_texts.txt", "extracted_texts_ru.txt", "dwg", "google")
    assert cli.options_of(cli.parser().parse_args(["translate", "a", "b", "--deepl-key", "k", "--openai-strict-value", "3"])).deepl_key == "k"
    assert localise.default_paths("/x.1/a.dwg", "dxf") == {"output": "/x.1/a_ru.dxf", "map": "/x.1/a_map.csv", "texts": "/x.1/a_texts.txt", "translated": "/x.1/a_texts_ru.txt"}
