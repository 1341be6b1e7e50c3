"""Command line: materialise files and print what is wrong with them."""

from __future__ import annotations

import argparse
import json
import logging
import sys
import time

from pyspark.sql import SparkSession

from axiomill.session import Options, Reasoner

FIELDS = ("code", "rule", "severity", "message")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="axiomill", description="Materialise the closure of triples under OWL 2 RL and RDFS rules.")
    p.add_argument("input_files", nargs="+", help="Turtle (.ttl) or N-Triples (.n3, .nt) files")
    p.add_argument("-o", "--output-file", default="output.ttl")
    p.add_argument("--error-format", choices=("text", "json", "ndjson"), default="text", help="how to print diagnostics")
    p.add_argument("--fail-on", action="append", default=[], help="exit with 2 if one of these rules or codes occurs (repeat, or part by commas)")
    p.add_argument("--max-diagnostics", type=int, help="print at most so many")
    p.add_argument("--summary-only", action="store_true", help="print only the number of diagnostics")
    p.add_argument("--mode", choices=("spec", "compat"), default="spec", help="rules as specified, or as common engines of the profile have them")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    log = logging.getLogger("axiomill")
    spark = spark or SparkSession.builder.appName("axiomill").getOrCreate()
    r = Reasoner(spark, mode=args.mode, options=Options())
    for f in args.input_files:
        log.info("loading %s", f)
        r.load_file(f)
    began = time.time()
    r.reason()
    log.info("reasoning took %.2f s", time.time() - began)
    r.dump_file(args.output_file)
    diags = r.diagnostics().select(*FIELDS)
    wanted = {w.strip().lower() for f in args.fail_on for w in f.split(",") if w.strip()}
    if args.summary_only:
        print(f"diagnostics: {diags.count()}")
    else:
        shown = diags.orderBy("code", "message")
        shown = shown.limit(args.max_diagnostics) if args.max_diagnostics is not None else shown
        rows = ({k: x[k] for k in FIELDS} for x in shown.toLocalIterator())
        if args.error_format == "json":
            print("[", end="")
            for k, d in enumerate(rows):
                print(", " if k else "", json.dumps(d, ensure_ascii=False), sep="", end="")
            print("]")
        else:
            for d in rows:
                print(json.dumps(d, ensure_ascii=False) if args.error_format == "ndjson" else f"{d['code']} {d['rule']}: {d['message']}")
    if wanted:
        hit = {x.lower() for row in diags.select("code", "rule").distinct().collect() for x in row}
        if hit & wanted:
            return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
