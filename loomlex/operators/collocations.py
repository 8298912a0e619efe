"""Collocates of head words under patterns: counted, scored and ranked."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlex.functions import scoring
from loomlex.plans import bcql, matching
from loomlex.sources.corpus import Corpus
from loomlex.sources.grammar import Relation

#: Scores are rounded before they rank, so that engines agree on ties.
DIGITS = 6
SKETCH_TOP, RELATION_TOP = 20, 50
#: Heads of a table that are sought as a list is: first, and then what is near them.
FEW_HEADS = 100


def joint(hits: DataFrame) -> DataFrame:
    """rel, head, collocate, pos (the most frequent tag, then the greatest) and freq. A hit without both labels has no
    collocate and doesn't count."""
    pairs = hits.where("lemma_1 is not null and lemma_2 is not null").groupBy("rel", F.lower("lemma_1").alias("head"), F.lower("lemma_2").alias("collocate"), F.col("xpos_2").alias("tag")).agg(F.count("*").alias("n"))
    return summed(pairs)


def summed(pairs: DataFrame) -> DataFrame:
    """``joint`` of counted rows (rel, head, collocate, tag, n)."""
    best = F.max_by("tag", F.when(F.trim("tag") != "", F.struct("n", "tag")))
    return pairs.groupBy("rel", "head", "collocate").agg(F.sum("n").alias("freq"), F.coalesce(best, F.lit("unknown")).alias("pos"))


def scored(pairs: DataFrame, freq: DataFrame, min_log_dice: float = 0.0) -> DataFrame:
    """Pairs with head_freq, coll_freq and log_dice. A pair whose upper bound is below the minimum goes before its
    collocate is looked up; a head of no frequency has no rows, a collocate of none scores 0."""
    heads = freq.select(F.col("lemma_lc").alias("head"), F.col("freq").alias("head_freq"))
    colls = freq.select(F.col("lemma_lc").alias("collocate"), F.col("freq").alias("coll_freq"))
    rows = pairs.join(heads, "head")
    if min_log_dice > 0:
        rows = rows.where(scoring.upper_bound("freq", "head_freq") >= min_log_dice)
    rows = rows.join(colls, "collocate", "left")
    rows = rows.withColumn("log_dice", F.round(scoring.log_dice_or_zero("freq", "head_freq", "coll_freq"), DIGITS))
    return rows.where(F.col("log_dice") >= min_log_dice)


def ranked(rows: DataFrame, top: int | None, by: tuple[str, ...] = ("rel", "head")) -> DataFrame:
    """Rows with their rank for each relation and head: logDice, frequency, then the collocate decide."""
    order = Window.partitionBy(*by).orderBy(F.desc("log_dice"), F.desc("freq"), "collocate")
    rows = rows.withColumn("rank", F.row_number().over(order))
    return rows.where(F.col("rank") <= top) if top else rows


def collocates(corpus: Corpus, patterns: Mapping[str, str | bcql.Pattern], heads: list[str] | DataFrame | None = None, min_log_dice: float = 0.0, top: int | None = SKETCH_TOP, scope: str = "doc") -> DataFrame:
    """Ranked collocates of all patterns in one plan. heads: lemmas, a table with a column ``head``, or all."""
    if isinstance(heads, DataFrame):
        few = [r["head"] for r in heads.select("head").distinct().limit(FEW_HEADS + 1).collect()]
        heads = few if len(few) <= FEW_HEADS else heads
    pairs = summed(matching.pair_counts(corpus.tokens, patterns, scope, heads if isinstance(heads, list) and heads else None, corpus.docs, corpus.blocks))
    pairs = of_heads(pairs, heads)
    rows = ranked(scored(pairs, corpus.freq, min_log_dice), top)
    return rows.select("rel", "head", "collocate", "pos", "freq", "head_freq", "coll_freq", "log_dice", F.round(scoring.relative_frequency("freq", "head_freq"), DIGITS).alias("relative_freq"), "rank")


def of_heads(pairs: DataFrame, heads: list[str] | DataFrame | None) -> DataFrame:
    if heads is None:
        return pairs
    if isinstance(heads, DataFrame):
        return pairs.join(heads.select("head").distinct(), "head", "left_semi")
    return pairs.where(F.col("head").isin(*[h.lower() for h in heads])) if heads else pairs.limit(0)


def following(corpus: Corpus, pattern: str, **more) -> DataFrame:
    """Tokens of a one-token pattern right after the head."""
    if not pattern.lstrip().startswith("["):
        raise bcql.PatternError("the pattern must begin with [")
    return collocates(corpus, {"following": f"1:[] 2:{pattern.lstrip()}"}, **more)


def surface(corpus: Corpus, pattern: str, **more) -> DataFrame:
    """A pattern with labels and the head's lemma in it."""
    head = bcql.headword(pattern)
    return collocates(corpus, {"surface": pattern}, [head.replace("\\", "")] if head else None, **more)


def by_dependency(corpus: Corpus, deprel: str, heads=None, head_tag: str | None = None, min_log_dice: float = 0.0, top: int | None = SKETCH_TOP) -> DataFrame:
    """Children of heads by a dependency relation, along HEAD."""
    if not deprel:
        raise bcql.PatternError("a dependency relation is needed")
    pairs = of_heads(summed(matching.dependency_counts(corpus.tokens, deprel, head_tag, corpus.blocks)), heads)
    rows = ranked(scored(pairs, corpus.freq, min_log_dice), top)
    return rows.select("rel", "head", "collocate", "pos", "freq", "head_freq", "coll_freq", "log_dice", "rank")


def sketch(corpus: Corpus, relations: list[Relation], heads=None, collocate_group: str | None = None, head_group: str | None = None, min_log_dice: float = 0.0, top: int | None = SKETCH_TOP, scope: str = "doc") -> DataFrame:
    """All relations in one pass, those of equal patterns matched once; empty relations have no rows. The order of the
    grammar is in ``ord``."""
    chosen = [r for r in relations if (not collocate_group or r.collocate_group == collocate_group) and (not head_group or r.head_group == head_group)]
    if not chosen:
        raise bcql.PatternError("no relation is of these parts of speech")
    first: dict[str, str] = {}
    for r in chosen:
        first.setdefault(r.pattern, r.id)
    rows = collocates(corpus, {i: p for p, i in first.items()}, heads, min_log_dice, top, scope)
    names = rows.sparkSession.createDataFrame([(first[r.pattern], r.id, k) for k, r in enumerate(chosen)], "rel string, id string, ord int")
    return rows.join(F.broadcast(names), "rel").drop("rel").withColumnRenamed("id", "rel")


def total_matches(sketched: DataFrame) -> DataFrame:
    """Frequencies of the returned rows, summed for each relation and head."""
    return sketched.groupBy("rel", "head").agg(F.sum("freq").alias("total_matches"))


def association(pairs: DataFrame, total: Column) -> DataFrame:
    """Scored pairs with the documented further measures."""
    args = ("freq", "head_freq", "coll_freq")
    r = lambda c: F.round(c, DIGITS)
    return pairs.withColumns({"mi": r(scoring.mutual_information(*args, total)), "t_score": r(scoring.t_score(*args, total)), "g2": r(scoring.log_likelihood(*args, total)), "per_million": r(scoring.per_million("freq", total))})


def integrity(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Of each head: pairs, those whose frequencies differ between two sketches, and their share; ``systemic`` where at
    least max(5, half of all heads) have a share of 0.95 or more."""
    both = expected.select("head", "collocate", F.col("freq").alias("a")).join(found.select("head", "collocate", F.col("freq").alias("b")), ["head", "collocate"], "full")
    heads = both.groupBy("head").agg(F.count("*").alias("pairs"), F.sum((~F.col("a").eqNullSafe(F.col("b"))).cast("long")).alias("mismatches"))
    heads = heads.withColumn("ratio", F.col("mismatches") / F.col("pairs")).persist()  # a row a head, read twice
    flag = heads.agg((F.sum((F.col("ratio") >= 0.95).cast("long")) >= F.greatest(F.lit(5), F.ceil(F.count("*") * 0.5))).alias("systemic"))
    return heads.crossJoin(F.broadcast(flag))
