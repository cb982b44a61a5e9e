"""python -m textquarry clean | prepare | verify | windows | instruct | evaluate: whole runs from the command line."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from textquarry.functions import fixed
from textquarry.operators.verify import VerificationError
from textquarry.plans import clean, evaluate, prepare
from textquarry.sources import files, sinks


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="textquarry")
    run = out.add_subparsers(dest="run", required=True)
    for name, about in (("clean", "audit a corpus and write it without template duplicates"), ("prepare", "split, learn a vocabulary and tokenize"), ("verify", "make a prepared dataset again and compare"), ("windows", "write fixed evaluation windows"), ("instruct", "split instruction examples"), ("evaluate", "score answers to a behavioural benchmark")):
        sub = run.add_parser(name, help=about)
        if name != "windows":
            sub.add_argument("--source", required=True)
        sub.add_argument("--out", required=True)
        if name in ("prepare", "instruct"):
            sub.add_argument("--seed", type=int, default=fixed.SPLIT_SEED)
        if name == "prepare":
            sub.add_argument("--vocab-size", type=int, default=fixed.VOCABULARY)
            sub.add_argument("--ratios", type=float, nargs=3, default=(fixed.TRAIN_RATIO, fixed.VALIDATION_RATIO, fixed.TEST_RATIO))
            sub.add_argument("--sample-bytes", type=int, default=fixed.SAMPLE_BYTES)
            sub.add_argument("--families", help="a family manifest")
        if name == "verify":
            sub.add_argument("--families", help="a family manifest")
        if name == "windows":
            sub.add_argument("--split", choices=("validation", "test"), required=True)
            sub.add_argument("--context", type=int, default=1024)
            sub.add_argument("--windows", type=int, default=256)
        if name == "evaluate":
            sub.add_argument("--answers", required=True, help="JSON lines of id and answer")
        if name == "instruct":
            sub.add_argument("--tokenizer", required=True)
            sub.add_argument("--validation-ratio", type=float, default=fixed.INSTRUCTION_VALIDATION_RATIO)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("textquarry").getOrCreate()
    families = files.read_families(spark, args.families) if getattr(args, "families", None) else None
    if args.run == "clean":
        print(clean.clean_corpus(spark, args.source, args.out))
    elif args.run == "prepare":
        done = prepare.prepare_dataset(spark, args.source, args.out, vocabulary_size=args.vocab_size, seed=args.seed, ratios=tuple(args.ratios), sample_bytes=args.sample_bytes, families=families)
        print(done.manifest["splits"])
    elif args.run == "verify":
        try:
            prepare.verify_dataset(spark, args.source, args.out, families)
        except VerificationError as e:
            for check, detail in e.failures:
                print(f"{check}: {detail}", file=sys.stderr)
            return 1
        print("verified")
    elif args.run == "windows":
        found = prepare.fixed_windows(spark, files.read_manifest(spark, f"{args.out}/manifest.json"), args.split, args.context, args.windows)
        sinks.write_json(f"{args.out}/{args.split}_windows.json", found)
    elif args.run == "evaluate":
        print(evaluate.evaluate(spark, args.source, args.answers, args.out)["behavioral"]["summary_by_dimension"])
    else:
        prepare.prepare_instructions(spark, args.source, files.read_vocabulary(spark, args.tokenizer), args.out, args.seed, args.validation_ratio)
    return 0


if __name__ == "__main__":
    sys.exit(main())
