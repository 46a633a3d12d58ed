"""Entry points for ``spark-submit``: ``preprocess``, ``build`` and ``query``."""

from __future__ import annotations

import argparse
import logging
import sys
import time
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import IndexConfig, QueryConfig, from_env
from ..providers import EmptyGraph, RuleAnnotator, embedder as make_embedder
from ..sources import documents, html
from . import build as builder
from .retrieve import QueryService

log = logging.getLogger("tessellum")


@contextmanager
def phase(name: str, **fields):
    """Logs a phase's beginning, and its seconds at the end."""
    began = time.time()
    log.info("%s begins %s", name, " ".join(f"{k}={v}" for k, v in fields.items()))
    yield
    log.info("%s took %.1f s", name, time.time() - began)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessellum")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("preprocess")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--flat", action="store_true", help="leave folders below the input out")
    b = sub.add_parser("build")
    b.add_argument("docs")
    b.add_argument("root")
    b.add_argument("--manifest")
    q = sub.add_parser("query")
    q.add_argument("root")
    q.add_argument("question", nargs="+")
    args = parser.parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    spark = SparkSession.builder.appName("tessellum").getOrCreate()
    embedder = make_embedder(from_env(IndexConfig).embedding_model)
    if args.command == "preprocess":
        with phase("preprocess", input=args.input):
            html.preprocess(documents.word_files(spark, args.input, not args.flat)).write.mode("overwrite").parquet(args.output)
    elif args.command == "build":
        with phase("build", docs=args.docs):
            manifest = documents.source_manifest(spark, args.manifest) if args.manifest else None
            print(builder.build(spark, documents.load_markdown(spark, args.docs, manifest), args.root, from_env(IndexConfig), RuleAnnotator(), EmptyGraph(), embedder))
    else:
        asked = spark.createDataFrame([(i, t) for i, t in enumerate(args.question)], "query_id bigint, query_text string")
        with phase("query", questions=len(args.question)):
            found = QueryService.open(spark, args.root, embedder, config=from_env(QueryConfig)).answer(asked)
            for r in found.answers.orderBy(F.col("query_id")).collect():  # one row a question typed on the command line
                print(r["answer"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
