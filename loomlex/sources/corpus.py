"""The corpus: a table of tokens, one row each, and its lemma frequencies."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import blocks as B

COLUMNS = ["doc_id", "sent_id", "pos", "wordnum", "word", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc"]
#: Words of any script, numbers, and marks that sentences and clauses end with.
TOKEN = r"([\p{L}\p{M}]+|\p{N}+|[.!?,;:])"
#: Function words of the rule tagger.
LEXICON = {
    "DT": ("the", "a", "an", "this"),
    "IN": ("of", "in", "for", "on", "with", "by", "at", "from", "as", "that"),
    "TO": ("to",),
    "CC": ("and", "or"),
    "PRP": ("it", "he", "they"),
    "VBZ": ("is",),
    "VBD": ("was",),
    "VBP": ("are",),
    "VB": ("be",),
}
SUFFIXES = (("ly", "RB"), ("ing", "VBG"), ("ed", "VBD"), ("al|ous|ive|ic|able|ent|ant|er|an", "JJ"), ("s", "NNS"))
COPULAS = ("is", "was", "are", "be")


def tag(lower: Column) -> Column:
    """The tag of a word in lower case, by the first rule that fits."""
    number = ((lower < "a") | (lower >= "{")) & lower.rlike(r"^\p{N}")  # words from a to z are spared the expression
    out = F.when(lower.isin(*".!?,;:"), ".").when(number, "CD")
    for t, words in LEXICON.items():
        out = out.when(lower.isin(*words), t)
    for ends, t in SUFFIXES:
        out = out.when(reduce(lambda a, b: a | b, [lower.endswith(e) for e in ends.split("|")]), t)
    return out.otherwise("NN")


def universal(xpos: Column) -> Column:
    out = F.when(xpos == ".", "PUNCT")
    for start, name in (("NN", "NOUN"), ("VB", "VERB"), ("JJ", "ADJ"), ("RB", "ADV"), ("DT", "DET"), ("IN", "ADP"), ("TO", "PART"), ("CC", "CCONJ"), ("PRP", "PRON"), ("CD", "NUM")):
        out = out.when(xpos.startswith(start), name)
    return out.otherwise("X")


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its words: null for a null text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.regexp_extract_all(F.col(text_col), F.lit(TOKEN), F.lit(1)).alias("word"))


def tagged_words(rows: DataFrame) -> DataFrame:
    """Rows with an array ``word``, and beside it lower, xpos and lemma: what a word alone decides."""
    rows = rows.withColumn("lower", F.transform("word", lambda w: F.lower(w)))
    return rows.withColumns({"xpos": F.transform("lower", tag), "lemma": F.transform("lower", lambda w: F.when(w.isin(*COPULAS), "be").otherwise(w))})


def blocks_of(texts: DataFrame, most: int | None = None) -> DataFrame:
    """Blocks of documents (doc_id, text), with what their distinct words alone decide."""
    rows = B.blocks_of(texts, TOKEN[1:-1].replace(r"\p{N}+", r"[\p{N}]+"), most)
    return tagged_words(rows.withColumnRenamed("words", "word")).withColumnRenamed("word", "words").drop("lower")


def documents_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, tag and attach by rules: a row for each document, an array for each annotation, all of one length.
    Everything is made within the row, so nothing is shuffled or sorted, and arrays that nobody reads are not made."""
    rows = tagged_words(words_of(docs, id_col, text_col))
    # sentences end with . ! or ?, the last one with the text
    ends = F.array_compact(F.transform("word", lambda w, i: F.when(w.isin(".", "!", "?"), i)))
    rows = rows.withColumn("ends", F.when(F.col("word").isNotNull(), F.concat(ends, F.array(F.size("word") - 1))))
    rows = rows.withColumn("sizes", F.transform("ends", lambda e, k: e - F.coalesce(F.get(F.col("ends"), k - 1), F.lit(-1))))
    rows = rows.withColumn("sent_id", F.flatten(F.transform("sizes", lambda n, k: F.array_repeat(k, n))))
    rows = rows.withColumn("wordnum", F.flatten(F.transform("sizes", lambda n: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")))))

    def near(i: Column, k: int, start: str) -> Column:
        same = F.get(F.col("sent_id"), i + k) == F.get(F.col("sent_id"), i)
        return F.coalesce(same & F.get(F.col("xpos"), i + k).startswith(start), F.lit(False))

    def step(x: Column, i: Column) -> Column:
        noun = lambda k: near(i, k, "NN")
        verb = lambda k: near(i, k, "VB")
        return (
            F.when(x.startswith("JJ"), F.when(noun(1), 1).when(noun(2), 2).when(noun(3), 3))
            .when(x.startswith("NN"), F.when(verb(1), 1).when(verb(-1), -1))
            .when(x.startswith("RB"), F.when(verb(1), 1))
            .when(x == "IN", F.when(noun(1), 1))
        )

    # arrays that a lambda reads once are zipped: read by name, the optimiser would make the whole array for each token
    def relation(s: Column, x: Column) -> Column:
        rel = F.when(x.startswith("JJ"), "amod").when(x.startswith("NN"), F.when(s == 1, "nsubj").otherwise("obj")).when(x.startswith("RB"), "advmod").otherwise("case")
        return F.when(s.isNotNull(), rel).otherwise("_")

    rows = rows.withColumn("step", F.transform("xpos", step))
    none = F.array_repeat(F.lit("_"), F.size("word"))
    return rows.select(
        "doc_id", "sent_id", "wordnum", "word", "lemma", F.transform("xpos", universal).alias("upos"), "xpos", none.alias("feats"),
        F.zip_with("step", "wordnum", lambda s, n: F.coalesce((n + s).cast("string"), F.lit("_"))).alias("head"),
        F.zip_with("step", "xpos", relation).alias("deprel"), none.alias("deps"), none.alias("misc"),
    )


def exploded(docs: DataFrame) -> DataFrame:
    """A row for each token of documents with arrays."""
    # lemmas lead: most readers want no more than those. An inner explosion would test the arrays' sizes at the scan,
    # for which all are made again
    rows = docs.select("*", F.posexplode_outer("lemma").alias("pos", "_lemma")).where("pos is not null")
    return rows.select(*["pos" if c == "pos" else "doc_id" if c == "doc_id" else F.col("_lemma").alias(c) if c == "lemma" else F.get(F.col(c), F.col("pos")).alias(c) for c in COLUMNS])


def tokens_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, tag and attach by rules. Null and empty texts have no tokens. One shuffle, by document, whose order
    all windows here and over the result share."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(TOKEN), F.lit(1))).alias("pos", "word"))
    lower = F.lower("word")
    doc = Window.partitionBy("doc_id").orderBy("pos")
    before = doc.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("xpos", tag(lower)).withColumn("lemma", F.when(lower.isin(*COPULAS), "be").otherwise(lower))
    rows = rows.withColumn("sent_id", F.coalesce(F.sum(F.col("word").isin(".", "!", "?").cast("int")).over(before), F.lit(0)).cast("int"))
    first = F.min("pos").over(Window.partitionBy("doc_id", "sent_id"))
    rows = rows.withColumn("wordnum", (F.col("pos") - first + 1).cast("int"))
    near = {k: F.when(F.lead("sent_id", k).over(doc) == F.col("sent_id"), F.lead("xpos", k).over(doc)) if k > 0 else F.when(F.lag("sent_id", -k).over(doc) == F.col("sent_id"), F.lag("xpos", -k).over(doc)) for k in (-1, 1, 2, 3)}
    rows = rows.select("*", *[v.alias(f"near{k + 1}") for k, v in near.items()])
    is_ = lambda k, t: F.coalesce(F.col(f"near{k + 1}").startswith(t), F.lit(False))
    x = F.col("xpos")
    step = (
        F.when(x.startswith("JJ") & is_(1, "NN"), 1)
        .when(x.startswith("JJ") & is_(2, "NN"), 2)
        .when(x.startswith("JJ") & is_(3, "NN"), 3)
        .when(x.startswith("NN") & is_(1, "VB"), 1)
        .when(x.startswith("NN") & is_(-1, "VB"), -1)
        .when(x.startswith("RB") & is_(1, "VB"), 1)
        .when((x == "IN") & is_(1, "NN"), 1)
    )
    rel = F.when(x.startswith("JJ"), "amod").when(x.startswith("NN") & is_(1, "VB"), "nsubj").when(x.startswith("NN"), "obj").when(x.startswith("RB"), "advmod").otherwise("case")
    rows = rows.withColumn("step", step).withColumn("deprel", F.when(F.col("step").isNotNull(), rel).otherwise("_"))
    rows = rows.withColumn("head", F.coalesce((F.col("wordnum") + F.col("step")).cast("string"), F.lit("_")))
    none = F.lit("_")
    return rows.select("doc_id", "sent_id", "pos", "wordnum", "word", "lemma", universal(x).alias("upos"), "xpos", none.alias("feats"), "head", "deprel", none.alias("deps"), none.alias("misc"))


def lemma_frequencies(tokens: DataFrame) -> DataFrame:
    """lemma_lc and freq, over all parts of speech."""
    return tokens.where("lemma is not null").groupBy(F.lower("lemma").alias("lemma_lc")).agg(F.count("*").alias("freq"))


@dataclass
class Corpus:
    """Tokens and frequencies. Where texts are at hand they are here too, and the tokens once more, as ``documents_of``
    and as ``blocks_of`` have them: patterns are then sought along blocks, or a document's arrays, and no token is
    shuffled. ``kinds`` has how often each lemma has each tag."""

    tokens: DataFrame
    freq: DataFrame
    docs: DataFrame | None = None
    texts: DataFrame | None = None
    blocks: DataFrame | None = None
    kinds: DataFrame | None = None

    @classmethod
    def of(cls, tokens: DataFrame) -> "Corpus":
        return cls(tokens, lemma_frequencies(tokens))

    @classmethod
    def of_texts(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> "Corpus":
        texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        return cls.of_blocks(texts, blocks_of(texts))

    @classmethod
    def of_blocks(cls, texts: DataFrame, blocks: DataFrame, keep: bool = False) -> "Corpus":
        """Of texts and their blocks; with ``keep`` frequencies stay in memory and on disk once they are made."""
        words = blocks.select(F.explode(F.arrays_zip("lemma", "xpos", "counts")).alias("w"))
        kinds = words.groupBy("w.lemma", "w.xpos").agg(F.sum("w.counts").alias("freq"))
        kinds = kinds.persist() if keep else kinds
        freq = kinds.groupBy(F.lower("lemma").alias("lemma_lc")).agg(F.sum("freq").alias("freq"))
        return cls(tokens_of(texts), freq.persist() if keep else freq, documents_of(texts), texts, blocks, kinds)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "Corpus":
        """A saved corpus; an error where there is none."""
        return cls(spark.read.parquet(f"{path}/tokens"), spark.read.parquet(f"{path}/lemma_freq").groupBy("lemma_lc").agg(F.sum("freq").alias("freq")))

    def save(self, path: str, mode: str = "overwrite") -> "Corpus":
        """Tokens in the order of their documents, so that a document's rows and a lemma's pages lie together, and
        frequencies beside them. With mode ``append`` to a saved corpus: frequencies add up when it is opened."""
        by = self.tokens.repartition("doc_id").sortWithinPartitions("doc_id", "pos")
        by.write.mode(mode).parquet(f"{path}/tokens")
        self.freq.write.mode(mode).parquet(f"{path}/lemma_freq")
        return Corpus.open(self.tokens.sparkSession, path)

    def append(self, tokens: DataFrame, path: str) -> "Corpus":
        return Corpus.of(tokens).save(path, "append")

    def views(self) -> None:
        """``tokens`` and ``lemma_freq`` for Spark SQL."""
        self.tokens.createOrReplaceTempView("tokens")
        self.freq.createOrReplaceTempView("lemma_freq")

    def frequency(self, lemma: str) -> int:
        row = self.freq.where(F.col("lemma_lc") == lemma.lower()).first()
        return int(row["freq"]) if row else 0
