"""Token gate over files or standard input: a report as JSON or lines, and an exit code that says whether all are within the budget.

``python -m lectern.plans.gate [--budget N] [--body-only] [--json] [PATH...]``; without paths the text of standard input is counted.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.library import gate_totals, token_gate
from lectern.session import prepare
from lectern.sources.files import read_files


def stdin_source(spark: SparkSession, stream=None) -> DataFrame:
    """(path, text): the text of ``stream`` (standard input) under the path ``-``."""
    return spark.createDataFrame([("-", (stream or sys.stdin).read())], "path string, text string")


def report(files: DataFrame, budget: int | None, body_only: bool = False) -> dict:
    """Totals and the files of a listing, as a report for people is; tables of web size stay with ``token_gate`` and ``gate_totals``."""
    gated = token_gate(files.select("path", "text"), (1 << 31) - 1 if budget is None else budget, body_only).select("path", "tokens", "over")
    total = gate_totals(gated).first()
    rows = [{"path": r.path, "tokens": r.tokens, **({"over_budget": True} if r.over else {})} for r in gated.orderBy("path").toLocalIterator()]
    return {"budget": budget, "files": rows, "over": total.over, "total_tokens": total.total_tokens}


def main(given=None, stream=None) -> int:
    args = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    args.add_argument("paths", nargs="*")
    args.add_argument("--budget", type=int)
    args.add_argument("--body-only", action="store_true")
    args.add_argument("--json", action="store_true")
    a = args.parse_args(given)
    spark = prepare(SparkSession.builder.getOrCreate())
    if a.paths:
        files = read_files(spark, a.paths).select(F.regexp_replace("path", r"\Afile:/+", "/").alias("path"), F.decode("content", "UTF-8").alias("text"))
    else:
        files = stdin_source(spark, stream)
    got = report(files, a.budget, a.body_only)
    if a.json:
        print(json.dumps(got, indent=2))
    else:
        for r in got["files"]:
            print(f"{r['path']}  {r['tokens']:,}{'  OVER' if r.get('over_budget') else ''}")
        if len(got["files"]) > 1:
            print(f"all  {got['total_tokens']:,}")
    return 1 if got["over"] else 0


if __name__ == "__main__":
    raise SystemExit(main())
