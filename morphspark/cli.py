"""spark-submit entry: tokenize text files, build dictionaries, dump their parts."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from morphspark.operators import formats
from morphspark.operators.analyzer import Analyzer
from morphspark.sources.config import Config, register_edition
from morphspark.sources.dictionary import Dictionary, build_system_dic, build_user_dic
from morphspark.sources.formats import read_lines
from morphspark.sources.sample import sample


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="morphspark")
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("tokenize", help="lines of text files to morphemes")
    t.add_argument("input")
    t.add_argument("output")
    t.add_argument("--dictionary", help="folder of a dictionary; the sample if not given")
    t.add_argument("--edition", help="name of a registered dictionary")
    t.add_argument("--user", action="append", default=[], help="folder of a user dictionary; may be given again")
    t.add_argument("--config", help="JSON file or text")
    t.add_argument("--mode", default="C", choices=list("ABCabc"))
    t.add_argument("--all", action="store_true", help="all forms of each morpheme")
    t.add_argument("--wakati", action="store_true", help="surfaces with spaces between")
    t.add_argument("--split-sentences", default="yes", choices=["yes", "no", "only"])
    for name in ("build", "ubuild"):
        b = sub.add_parser(name, help="a system dictionary" if name == "build" else "a user dictionary")
        b.add_argument("--matrix" if name == "build" else "--system", required=True)
        b.add_argument("--description", default="")
        if name == "build":
            b.add_argument("--characters", help="character definitions: classes and category rows")
            b.add_argument("--unknown", help="unknown-word definitions")
            b.add_argument("--rewrites", help="rewrite rules")
        b.add_argument("output")
        b.add_argument("lexicon", nargs="+")
    e = sub.add_parser("edition", help="names the folder of a dictionary for --edition")
    e.add_argument("name")
    e.add_argument("folder")
    d = sub.add_parser("dump", help="a part of a dictionary as lines")
    d.add_argument("dictionary")
    d.add_argument("what", choices=["pos", "matrix", "words"])
    d.add_argument("output")
    return p


def tokenize(spark: SparkSession, args: argparse.Namespace) -> None:
    """A row of output for each sentence, in the order of the lines within each file."""
    config = Config.of(args.config)
    if args.edition or args.dictionary or config.system:
        d = Dictionary.open(spark, config, dictionary=args.dictionary, kind=args.edition)
    else:
        d = sample(spark) if args.config is None else sample(spark).with_config(config).with_files()
    for path in args.user:
        d = d.with_user(Dictionary.load(spark, path, kind="user"))
    a = Analyzer(d, args.mode, max_bytes=None)
    lines = read_lines(spark, args.input)
    if args.split_sentences == "no":
        texts = lines.select(F.col("value").alias("text"))
    else:
        texts = lines.select(F.explode_outer(a.sentences("value")).alias("s")).select(F.coalesce("s.text", F.lit("")).alias("text"))
    if args.split_sentences == "only":
        return formats.write_lines(texts, "text", args.output)
    m = a.analyze("text")
    formats.write_lines(texts.select((formats.wakati(m, a.projection) if args.wakati else formats.tsv(m, args.all)).alias("out")), "out", args.output)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("morphspark").getOrCreate()
    if args.command == "tokenize":
        tokenize(spark, args)
    elif args.command == "build":
        build_system_dic(spark, args.matrix, args.lexicon, args.output, args.description, args.characters, args.unknown, args.rewrites).show(truncate=False)
    elif args.command == "edition":
        register_edition(args.name, args.folder, keep=True)
    elif args.command == "ubuild":
        build_user_dic(spark, args.system, args.lexicon, args.output, args.description).show(truncate=False)
    else:
        dumped = formats.dump(Dictionary.load(spark, args.dictionary), args.what)
        formats.write_lines(dumped.orderBy("id"), "line", args.output)


if __name__ == "__main__":
    main()
