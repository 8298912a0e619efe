"""python -m loomlex.cli: build a corpus, query it, serve it."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from loomlex.operators import collocations
from loomlex.sources import conllu
from loomlex.sources.corpus import Corpus, tokens_of
from loomlex.sources.grammar import english


def session() -> SparkSession:
    return SparkSession.builder.appName("loomlex").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomlex")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index", help="a corpus from CoNLL-U files, or from a Parquet table of texts")
    i.add_argument("--input", required=True)
    i.add_argument("--output", required=True)
    i.add_argument("--texts", action="store_true", help="the input has columns doc_id and text")
    i.add_argument("--append", action="store_true")
    q = sub.add_parser("query", help="collocates of a lemma")
    q.add_argument("--index", required=True)
    q.add_argument("--lemma", required=True)
    q.add_argument("--deprel")
    q.add_argument("--relation")
    q.add_argument("--min-logdice", type=float, default=0.0)
    q.add_argument("--limit", type=int, default=20)
    s = sub.add_parser("serve", help="HTTP on this machine")
    s.add_argument("--index", required=True)
    s.add_argument("--port", type=int, default=8080)
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = session()
    if a.command == "index":
        tokens = tokens_of(spark.read.parquet(a.input)) if a.texts else conllu.parse(conllu.read(spark, a.input))
        Corpus.of(tokens).save(a.output, "append" if a.append else "overwrite")
        return 0
    corpus = Corpus.open(spark, a.index)
    if a.command == "query":
        more = {"heads": [a.lemma], "min_log_dice": a.min_logdice, "top": a.limit}
        if a.deprel:
            rows = collocations.by_dependency(corpus, a.deprel, **more)
        elif a.relation:
            rows = collocations.collocates(corpus, {a.relation: english()[a.relation].pattern}, **more)
        else:
            rows = collocations.following(corpus, "[]", **more)
        for r in rows.orderBy("rank").collect():
            print(f"{r['collocate']}\t{r['pos']}\t{r['freq']}\t{r['log_dice']:.2f}")
        return 0
    from loomlex.server import serve

    serve(corpus, english(), a.port)
    return 0


if __name__ == "__main__":
    sys.exit(main())
