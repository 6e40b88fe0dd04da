"""Command line: extract, apply, translate, coverage."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import flatten
from .operators.apply import STYLE_NAME
from .operators.providers import CHAIN, Options, with_environment
from .plans import localise
from .plans.localise import Outputs
from .sources import dxf, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glossweave", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("extract", help="count the texts of drawings")
    e.add_argument("input")
    for kind in ("csv", "json", "txt"):
        e.add_argument(f"--{kind}")
    a = sub.add_parser("apply", help="apply a dictionary file to drawings")
    a.add_argument("input")
    a.add_argument("mapping")
    a.add_argument("output")
    a.add_argument("--source-en")
    a.add_argument("--style-font", default=dxf.STYLE_FONT)
    t = sub.add_parser("translate", help="extract, translate and apply")
    t.add_argument("input", help="a .dxf or .dwg file, or a folder of .dxf files")
    t.add_argument("output", nargs="?", help="its suffix is forced by the format; by default beside the input")
    t.add_argument("--translator", "--provider", default="google", help="|".join(CHAIN))
    t.add_argument("--source-lang", "--source", default="en")
    t.add_argument("--target-lang", "--target", default="ru")
    t.add_argument("--map-csv", default="map_auto.csv")
    t.add_argument("--extracted-txt", "--texts-txt", default="extracted_texts.txt")
    t.add_argument("--translated-txt", default="extracted_texts_ru.txt")
    t.add_argument("--no-map", action="store_true")
    t.add_argument("--skip-txt", "--no-txt", action="store_true")
    t.add_argument("--style", default=STYLE_NAME)
    t.add_argument("--style-font", default=dxf.STYLE_FONT)
    t.add_argument("--deepl-key", help="or DEEPL_AUTH_KEY, DEEPL_API_KEY")
    t.add_argument("--openai-key", "--api-key", help="or OPENAI_API_KEY")
    t.add_argument("--openai-model", "--model")
    t.add_argument("--openai-base-url", "--base-url")
    t.add_argument("--openai-temperature", "--temperature", type=float, default=0.2)
    t.add_argument("--openai-strict-mode", "--strict-mode", choices=("verbosity", "effort"))
    t.add_argument("--openai-strict-value", "--strict-value", type=float)
    t.add_argument("--output-format", choices=("dwg", "dxf"), default="dwg")
    c = sub.add_parser("coverage", help="check a dictionary against an extract and enrich it")
    c.add_argument("--translations", default="translations.json")
    c.add_argument("--extract", default="extracted_texts.csv")
    c.add_argument("--map", default="map.csv")
    return p


def options_of(args: argparse.Namespace) -> Options:
    return with_environment(
        Options(
            args.translator, args.source_lang, args.target_lang, args.openai_key, args.openai_model, args.openai_base_url, args.openai_temperature,
            args.openai_strict_mode, args.openai_strict_value, deepl_key=args.deepl_key,
        )
    )


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.command == "coverage":
        print(localise.check_and_enrich(spark, args.translations, args.extract, args.map).count())
        return 0
    if args.command == "apply" and args.mapping.lower().endswith(".txt") and not args.source_en:
        print("a .txt dictionary needs --source-en", file=sys.stderr)
        return 2
    source = dxf.prepared_input(spark, args.input)
    entities = dxf.read_entities(spark, source)
    if args.command == "extract":
        keys = localise.extract(flatten.text_bag(entities))
        sinks.write_if(True, args.csv, lambda p: sinks.write_frequency_csv(keys, p))
        sinks.write_if(True, args.json, lambda p: sinks.write_frequency_json(keys, p))
        sinks.write_if(True, args.txt, lambda p: sinks.write_frequency_txt(keys, p))
        print(keys.agg(F.count(F.lit(1))).first()[0])
    elif args.command == "apply":
        fmt = "dwg" if args.output.lower().endswith(".dwg") else "dxf"
        print(dxf.save_drawing(localise.apply_dictionary(entities, args.mapping, args.source_en), source, args.output, fmt, args.style_font))
    else:
        outputs = Outputs(args.extracted_txt, args.translated_txt, args.map_csv, not args.skip_txt, not args.no_map)
        to = args.output or localise.default_paths(args.input, args.output_format)["output"]
        done = localise.run_entities(entities, options_of(args), outputs, dxf.final_path(source, to, args.output_format), args.style)
        dxf.save_drawing(done.entities, source, to, args.output_format, args.style_font)
        done.summary.show(truncate=False)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("glossweave").getOrCreate()
    try:
        return run(spark, args)
    except PySparkException as e:
        print(e, file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
