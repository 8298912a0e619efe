"""Concordances: hits in document order with the words around them, and examples made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlex.functions import text as T
from loomlex.plans import bcql, matching
from loomlex.sources.corpus import Corpus, documents_of, exploded
from loomlex.sources.grammar import Grammar, resolve

CONTEXT, SHORT_CONTEXT = 60, 5


def page(hits: DataFrame, size: int, offset: int = 0) -> DataFrame:
    """Hits by document and place, from ``offset``."""
    return hits.orderBy("doc_id", "start", "end").offset(offset).limit(size)


def with_context(tokens: DataFrame, hits: DataFrame, window: int = CONTEXT) -> DataFrame:
    """Hits with left, match and right text, and the fragments with their annotations. The hits are a page: they are
    joined to the tokens of their documents only, within the window."""
    h = hits.select("doc_id", "start", "end")
    t = tokens.select(F.col("doc_id").alias("d"), "pos", "sent_id", "word", "lemma", "upos", "xpos", "deprel")
    near = h.join(t, (F.col("d") == F.col("doc_id")) & F.col("pos").between(F.col("start") - window, F.col("end") + window - 1))
    side = F.when(F.col("pos") < F.col("start"), 0).when(F.col("pos") < F.col("end"), 1).otherwise(2)
    esc = T.xml_escape
    xml = F.concat(F.lit('<w lemma="'), esc(F.col("lemma")), F.lit('" upos="'), esc(F.col("upos")), F.lit('" xpos="'), esc(F.col("xpos")), F.lit('" deprel="'), esc(F.col("deprel")), F.lit('">'), esc(F.col("word")), F.lit("</w>"))
    rows = near.groupBy("doc_id", "start", "end").agg(F.array_sort(F.collect_list(F.struct("pos", side.alias("side"), "sent_id", "word", xml.alias("xml")))).alias("t"))
    part = lambda k, f: F.array_join(F.transform(F.filter("t", lambda x: x["side"] == k), lambda x: x[f]), " ")
    match = F.filter("t", lambda x: x["side"] == 1)
    low, high = F.array_min(F.transform(match, lambda x: x["sent_id"])), F.array_max(F.transform(match, lambda x: x["sent_id"]))
    whole = F.filter("t", lambda x: (x["sent_id"] >= low) & (x["sent_id"] <= high))
    return rows.select(
        "doc_id", "start", "end", part(0, "word").alias("left"), part(1, "word").alias("match"), part(2, "word").alias("right"),
        T.detokenize(F.array_join(F.transform(whole, lambda x: x["word"]), " ")).alias("sentence"), F.array_join(F.transform(whole, lambda x: x["xml"]), "").alias("raw_xml"),
    )


def concordance(corpus: Corpus, pattern: str, size: int = 20, offset: int = 0, window: int = CONTEXT, guard: bool = False) -> DataFrame:
    """One page of a pattern's hits with context; the collocate is the token labelled 2, else the hit's last."""
    parsed = bcql.parse(pattern, guard)
    hits = page(found(corpus, {"q": parsed}), size, offset)
    tokens = corpus.tokens
    if corpus.texts is not None:
        hits = hits.persist()  # a page of rows, read twice: only its documents' texts are made tokens
        tokens = exploded(documents_of(corpus.texts.join(F.broadcast(hits.select("doc_id").distinct()), "doc_id", "left_semi")))
    return with_context(tokens, hits, window).orderBy("doc_id", "start", "end")


def found(corpus: Corpus, patterns: dict, **more) -> DataFrame:
    """Hits of patterns by what the corpus has: blocks, or a table of tokens."""
    return matching.matches(corpus.tokens, patterns, docs=corpus.docs, blocks=corpus.blocks, **more)


def count(corpus: Corpus, pattern: str) -> int:
    return found(corpus, {"q": pattern}).count()


def bcql_page(corpus: Corpus, pattern: str, size: int = 20, offset: int = 0) -> dict:
    """Total, the window asked for and its rows. An empty page has the size asked for, others their number of rows."""
    rows = concordance(corpus, pattern, size, offset, guard=True)
    got = rows.count()
    return {"total": count(corpus, pattern), "offset": offset, "page_size": got or size, "results": rows}


def proximity(left: str, right: str, gap: int = 5) -> str:
    """Two lemmas in order with up to ``gap`` tokens between them."""
    return f'1:"{bcql.escape(left.lower())}" []{{0,{gap}}} 2:"{bcql.escape(right.lower())}"'


def first_of_each(rows: DataFrame, size: int) -> DataFrame:
    """Each sentence once, at its first hit, the first ``size`` of them."""
    first = Window.partitionBy("sentence").orderBy("doc_id", "start", "end")
    return rows.where("sentence <> ''").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n").orderBy("doc_id", "start", "end").limit(size)


def examples(corpus: Corpus, grammar: Grammar, seed: str, collocate: str, relation: str, size: int = 10, distinct: bool = True, strict: bool = False) -> DataFrame:
    """Sentences for a pair under a relation; under a relation that the grammar lacks, by proximity. Column
    ``fallback`` tells which."""
    known = relation is not None and resolve(relation) in grammar
    pattern = grammar[relation].full_pattern(seed, collocate, strict) if known else proximity(seed, collocate)
    rows = concordance(corpus, pattern, size * (5 if distinct else 1)).withColumn("fallback", F.lit(not known))
    return first_of_each(rows, size) if distinct else rows
