"""Command line: list the queries, run one, ingest a folder, check an index.

Exit codes: 0 done; 1 an invariant fails; 2 the arguments or the input are wrong.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import chunking, index, invariants
from quarrylight.plans import catalog
from quarrylight.sources import artifacts, corpus


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quarrylight", description="Retrieval, cited answers and their measurement on Spark.")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    run = commands.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("name")
    run.add_argument("tables")
    run.add_argument("--rows", type=int, default=20, help="rows to show")
    run.add_argument("--out", help="write the whole result as Parquet instead")
    ingest = commands.add_parser("ingest", help="chunk and index the files of a folder into a new version")
    ingest.add_argument("root")
    ingest.add_argument("out")
    ingest.add_argument("--strategy", choices=chunking.STRATEGIES, default="header_aware_parent")
    check = commands.add_parser("reconcile", help="run the invariants of the current version")
    check.add_argument("out")
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments().parse_args(argv)
    if args.command == "list":
        print("\n".join(catalog.QUERIES))
        return 0
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "run":
        if args.name not in catalog.QUERIES:
            print(f"no query {args.name!r}", file=sys.stderr)
            return 2
        found = catalog.QUERIES[args.name](spark, args.tables)
        found.write.parquet(args.out) if args.out else found.show(args.rows, truncate=False)
        return 0
    if args.command == "ingest":
        blocks, _ = corpus.parse(corpus.walk(spark, args.root))
        blocks = blocks.withColumn("owner", F.lit(""))
        sources = blocks.select("owner", "source_id", F.col("source_id").alias("title"), F.lit("corpus").alias("origin")).distinct()
        chunks = chunking.chunk_blocks(blocks, sources, strategy=args.strategy, fingerprint=args.strategy)
        posted = index.postings(chunks.filter("role = 'child'"), text="embed_text")
        stats = index.corpus_stats(chunks.filter("role = 'child'"), posted)
        print(artifacts.save_version({"chunks": chunks, "postings": posted, "terms": index.term_stats(posted, stats), "stats": stats}, args.out))
        return 0
    chunks = artifacts.load(spark, args.out, "chunks")
    checks = invariants.prefix_checks(chunks)
    checks.show(truncate=False)
    return int(checks.filter("state = 'FAILS'").count() > 0)


if __name__ == "__main__":
    sys.exit(main())
