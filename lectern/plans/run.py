"""From files to a corpus: parsed, sanitised, measured, placed and written.

``python -m lectern.plans.run OUT PATH...`` writes four tables into OUT: ``sources`` and
``failures`` (Parquet), ``lines`` (Parquet, the corpus by source and line) and ``full_text``
(text with fences). ``--metadata`` adds ``metadata``, all of it as one JSON document in one
row: for libraries, not for corpora of web size.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.errors import UnsupportedFormat
from lectern.operators import extract, lines
from lectern.session import prepare
from lectern.sources.files import FORMATS, MODES, capabilities, parse_files, read_files


def run(spark: SparkSession, paths: list[str], out: str, mode: str = "text", metadata: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sources, failures) of the files, as written to ``out``; no supported file at all is an error."""
    prepare(spark)
    found = read_files(spark, paths)
    parsed = parse_files(found, mode).join(found.select("seq", "path"), "path").checkpoint()
    if parsed.isEmpty():
        raise UnsupportedFormat(f"no supported documents; supported are {' '.join(sorted(FORMATS))}")
    sources, failures = extract.extract(parsed)
    sources.write.mode("overwrite").parquet(f"{out}/sources")
    failures.write.mode("overwrite").parquet(f"{out}/failures")
    sources, failures = spark.read.parquet(f"{out}/sources"), spark.read.parquet(f"{out}/failures")
    lines.write_lines(sources, ["seq", "filename"], f"{out}/lines")
    lines.write_corpus(lines.fenced_blocks(sources, F.col("filename"), F.col("path"), F.col("text")), ["seq"], f"{out}/full_text")
    if metadata:
        extract.metadata_json(sources, failures, mode).select(F.col("metadata").alias("value")).write.mode("overwrite").text(f"{out}/metadata")
    return sources, failures


def main(given=None) -> int:
    about = __doc__.splitlines()[0]
    args = argparse.ArgumentParser(description=about)
    args.add_argument("out", nargs="?")
    args.add_argument("paths", nargs="*")
    args.add_argument("--mode", choices=MODES, default="text")
    args.add_argument("--check", help="list what each family of formats needs, and stop", action="store_true")
    args.add_argument("--metadata", help="also write all records as one JSON document", action="store_true")
    a = args.parse_args(given)
    if a.check:
        for c in capabilities():
            print(f"{'+' if c['available'] else '-'} {c['formats']}: {c['requirement']}")
        return 0
    if not a.paths:
        args.error("no paths")
    sources, failures = run(SparkSession.builder.getOrCreate(), a.paths, a.out, a.mode, a.metadata)
    sources.drop("text").orderBy("seq").show(truncate=40)
    failures.show(truncate=80)
    return 0 if sources.count() else 1


if __name__ == "__main__":
    raise SystemExit(main())
