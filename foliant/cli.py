"""Command line: build an index from a folder of tables, replay a build, compare two ledgers, sample for review."""

from __future__ import annotations

import argparse
import os
import random
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import index, verify
from foliant.session import local_session
from foliant.sources import sinks

FORMS = ("md", "docx")


def build(spark: SparkSession, sf_dir: str, out: str) -> dict[str, str]:
    """Ledger, entries and rendered index in out; returns the hash of each table."""
    from foliant.plans import indexing, tree

    os.makedirs(out, exist_ok=True)
    ledger = indexing._ledger(spark, sf_dir)
    sinks.write_sorted(ledger, f"{out}/ledger", ["canonical_term", "pdf_page", "token_offset"])
    swept = verify.sweep(spark.read.parquet(f"{out}/ledger"))
    index.evidence_ids(swept, "canonical_term").write.mode("overwrite").parquet(f"{out}/evidence")
    lines = tree.index_of(swept)
    sinks.replace_file(f"{out}/index.md", sinks.markdown(lines, "Index"))
    sinks.docx(lines, f"{out}/index.docx", "Index")
    hashes = {name: sinks.content_hash(spark.read.parquet(f"{out}/{name}").drop("section_path")).first()[0] for name in ("ledger", "evidence")}
    sinks.replace_file(f"{out}/hashes.json", sinks.stable_json(hashes))
    return hashes


def replay(spark: SparkSession, sf_dir: str, out: str) -> bool:
    """Builds again elsewhere and compares the hashes and the rendered bytes."""
    again = f"{out}.replay"
    same = build(spark, sf_dir, out) == build(spark, sf_dir, again)
    return same and all(open(f"{out}/index.{f}", "rb").read() == open(f"{again}/index.{f}", "rb").read() for f in FORMS)


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries added, removed or changed between two ledgers."""
    place = lambda df: df.groupBy("canonical_term").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "section_ref", "folio"))), "|"), 256).alias("places"))
    return index.diff(place(old), place(new), "canonical_term", "places")


def review_sample(entries: list[str], n: int, seed: int = 0) -> list[str]:
    """A seeded sample of a sorted list of entries."""
    return sorted(random.Random(seed).sample(sorted(entries), min(n, len(entries))))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="foliant")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("build", "replay"):
        p = sub.add_parser(name)
        p.add_argument("tables")
        p.add_argument("out")
    p = sub.add_parser("verify-against")
    p.add_argument("old")
    p.add_argument("new")
    p.add_argument("--most", type=int, default=0)
    p = sub.add_parser("review")
    p.add_argument("ledger")
    p.add_argument("--n", type=int, default=25)
    given = parser.parse_args(args)
    spark = local_session()
    if given.command == "build":
        print(build(spark, given.tables, given.out))
    elif given.command == "replay":
        return 0 if replay(spark, given.tables, given.out) else 1
    elif given.command == "verify-against":
        changed = drift(spark.read.parquet(given.old), spark.read.parquet(given.new))
        changed.orderBy("canonical_term").show(100, truncate=False)
        return 0 if changed.count() <= given.most else 1
    else:
        terms = [r[0] for r in spark.read.parquet(given.ledger).groupBy("canonical_term").agg(F.countDistinct("section_ref", "folio").alias("n")).where("n > 1").collect()]
        print("\n".join(review_sample(terms, given.n)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
