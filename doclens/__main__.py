"""Command line: python -m doclens {normalize,index,search,ask,evaluate,models,queries} ...."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from doclens.functions import text as tx
from doclens.functions.stemming import normalize_stemmed, stemmed_words
from doclens.operators.corpus import require_documents
from doclens.operators.evaluate import full_report
from doclens.operators.search import SearchIndex
from doclens.session import import_path, local_session
from doclens.sources.corpus import text_corpus
from doclens.sources.sinks import report_lines

#: The words that end a session.
EXIT_WORDS = {"exit", "quit", "salir"}


def _corpus(spark, root: str, least: int):
    docs = text_corpus(spark, root).withColumn("doc_id", F.xxhash64("path")).withColumn("w", stemmed_words(F.col("text")))
    return require_documents(docs, least)


def _show(index: SearchIndex, spark, lines: list[str], k: int) -> None:
    asked = spark.createDataFrame(list(enumerate(lines, 1)), "query_id int, query string").withColumn("w", stemmed_words(F.col("query")))
    index.search(asked, tx.ngrams(F.col("w"), 1, 2), k).orderBy("query_id", "rank").show(k * len(lines), truncate=60)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="doclens", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, names in {"normalize": ["root", "out"], "index": ["root", "out"], "search": ["index", "query"], "ask": ["index"], "evaluate": ["predictions"], "models": ["tables", "out"], "queries": []}.items():
        command = commands.add_parser(name)
        for n in names:
            command.add_argument(n, nargs="+" if n == "query" else None)
        command.add_argument("--top-k", type=int, default=5)
    args = parser.parse_args(arguments)
    spark = local_session()
    import_path(spark)
    if args.command == "normalize":
        _corpus(spark, args.root, 1).select("class", "path", normalize_stemmed(F.col("text")).alias("text")).write.mode("overwrite").partitionBy("class").parquet(args.out)
    elif args.command == "index":
        SearchIndex.build(_corpus(spark, args.root, 1), tx.ngrams(F.col("w"), 1, 2)).save(args.out)
    elif args.command == "search":
        _show(SearchIndex.load(spark, args.index), spark, args.query, args.top_k)
    elif args.command == "ask":
        index = SearchIndex.load(spark, args.index)
        while (line := input("query> ").strip()).lower() not in EXIT_WORDS:
            if line:
                _show(index, spark, [line], args.top_k)
    elif args.command == "evaluate":
        report_lines(full_report(spark.read.parquet(args.predictions))).orderBy("model", "place", "class").show(1000, truncate=False)
    elif args.command == "models":
        import doclens.catalog_files  # noqa: F401 - registers queries
        from doclens.plans.models import run_models

        found = run_models(spark, args.tables, args.out)
        print("trained:", ", ".join(n for n, r in found.items() if r.ran and n.endswith("_predictions")) or "none")
        found["comparison"].table.orderBy("position").show(100, truncate=False)
    else:
        import doclens.catalog_files  # noqa: F401 - registers queries
        from doclens.catalog import ORACLE, QUERIES

        for name in QUERIES:
            print(name, "sql" if name in ORACLE else "rows")


if __name__ == "__main__":
    main()
