"""python -m intentlake.cli search QUERY [PATH]: search a folder and print JSON."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from intentlake.functions.encoders import HashEncoder, StaticModelEncoder
from intentlake.operators.index import Index, IndexParams, result_json
from intentlake.operators.ranking import SearchParams


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="intentlake")
    search = p.add_subparsers(dest="command", required=True).add_parser("search", help="find code by intent")
    search.add_argument("query")
    search.add_argument("path", nargs="?", default=".")
    search.add_argument("-k", "--top-k", type=int, default=10)
    search.add_argument("--include-text-files", action="store_true")
    search.add_argument("--rrf-k", type=float, default=60.0)
    search.add_argument("--min-score-ratio", type=float, default=0.12)
    search.add_argument("--def-weight", type=float, default=1.0)
    search.add_argument("--candidates", type=int, default=5)
    search.add_argument("--chunk-size", type=int, default=1500)
    search.add_argument("--max-file-bytes", type=int, default=1_000_000)
    search.add_argument("--model", default="hash", help="'hash', a model's folder, or the name of a cached model")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    for name in ("candidates", "chunk_size"):
        if getattr(args, name) < 1:
            print(f"--{name.replace('_', '-')} must be at least 1.", file=sys.stderr)
            return 1
    try:
        encoder = HashEncoder() if args.model == "hash" else StaticModelEncoder(args.model)
        spark = spark or SparkSession.builder.appName("intentlake").getOrCreate()
        index = Index.from_path(spark, args.path, encoder, text_files=args.include_text_files, params=IndexParams(args.chunk_size, args.max_file_bytes))
    except (ValueError, OSError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    params = SearchParams(args.rrf_k, args.min_score_ratio, args.def_weight, args.candidates)
    print(result_json(index.search(args.query, args.top_k, params)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
