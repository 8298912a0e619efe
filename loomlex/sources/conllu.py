"""CoNLL-U: read, write, and cut into documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from loomlex import workers

from .blocks import DEPRELS, Along, rows_in
from .corpus import universal

FIELDS = ["wordnum", "word", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc"]
#: Multi-word tokens (1-2) and empty nodes (1.1).
SKIPPED = r"^\d+-\d+\t|^\d+\.\d+\t"
SENTENCES_A_DOCUMENT = 10_000
#: Tokens of a batch of records that are rendered from a block; a sentence is never divided.
RECORD_TOKENS = 1 << 16
#: Lemmas that a worker holds before it starts anew; only speed depends on it.
HELD_LEMMAS = 1 << 18


def read(spark: SparkSession, path: str) -> DataFrame:
    """source (the whole path), ord and value: a row for each record between blank lines. Files are split, so large ones are read by
    many tasks; ``ord`` orders the records of a file."""
    rows = spark.read.option("lineSep", "\n\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("source"), F.monotonically_increasing_id().alias("ord"), F.col("value"))


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """As ``read``, for files with CRLF or with blanks in their empty lines: each file is one value first."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), "value")
    clean = F.regexp_replace(F.regexp_replace("value", r"\r\n?", "\n"), r"\n[ \t]*\n\s*?", "\n\n")
    return rows.select("source", F.posexplode(F.split(clean, "\n\n")).alias("ord", "value"))


def lines_of(value: Column) -> Column:
    """A record's token lines: no comments, no multi-word tokens, no empty nodes."""
    return F.filter(F.split(value, "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#") & ~x.rlike(SKIPPED))


def parse(records: DataFrame, sentences: int = SENTENCES_A_DOCUMENT) -> DataFrame:
    """The token table of records (source, ord, value). ``sentences`` of them make a document. Records without tokens
    are no sentence; a line with fewer columns passes through with nulls, as does one without any tab as a word."""
    rows = records.withColumn("lines", lines_of(F.col("value"))).where(F.size("lines") > 0)
    # a file's sentences are numbered within the parts that tasks have read, after those of the parts before: the high
    # bits of ``ord`` name a part
    rows = rows.withColumn("part", F.shiftright("ord", 33))
    parts = rows.groupBy("source", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("source", "part").orderBy("ord")) - 1).join(parts, ["source", "part"])
    rows = rows.withColumn("n", F.col("n") + F.col("offset"))
    rows = rows.withColumn("sent_id", (F.col("n") % sentences).cast("int")).withColumn("chunk", F.floor(F.col("n") / sentences))
    rows = rows.withColumn("doc_id", F.xxhash64("source").bitwiseAND(F.lit((1 << 43) - 1)) * (1 << 20) + F.col("chunk"))
    before = Window.partitionBy("doc_id").orderBy("sent_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.size("lines")).over(before), F.lit(0)))
    rows = rows.select("doc_id", "sent_id", "start", F.posexplode("lines").alias("k", "line"))
    cells = F.split("line", "\t")
    cell = lambda i: F.try_element_at(cells, F.lit(i + 1))
    single = F.size(cells) == 1
    out = {f: cell(i) for i, f in enumerate(FIELDS)}
    out["word"] = F.when(single, F.col("line")).otherwise(out["word"])
    out["wordnum"] = F.when(~single, out["wordnum"]).try_cast("int")
    return rows.select("doc_id", "sent_id", (F.col("start") + F.col("k")).cast("int").alias("pos"), *[c.alias(f) for f, c in out.items()])


def parse_tagged(records: DataFrame, sentences: int = SENTENCES_A_DOCUMENT) -> DataFrame:
    """The token table of word-per-line records: word, tag and lemma between tabs."""
    numbered = F.transform(F.split(F.regexp_replace("value", "\r", ""), "\n"), lambda x, i: F.when(F.trim(x) != "", F.concat((i + 1).cast("string"), F.lit("\t"), F.try_element_at(F.split(x, "\t"), F.lit(1)), F.lit("\t"), F.coalesce(F.try_element_at(F.split(x, "\t"), F.lit(3)), F.lit("_")), F.lit("\t_\t"), F.coalesce(F.try_element_at(F.split(x, "\t"), F.lit(2)), F.lit("_")))).otherwise(""))
    return parse(records.withColumn("value", F.array_join(numbered, "\n")), sentences)


def render(tokens: DataFrame) -> DataFrame:
    """Records (source, ord, value) of a token table: a value for each sentence."""
    line = F.concat_ws("\t", *[F.coalesce(F.col(f).cast("string"), F.lit("_")) for f in FIELDS])
    rows = tokens.groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("t"))
    return rows.select(F.col("doc_id").cast("string").alias("source"), F.col("sent_id").cast("long").alias("ord"), F.array_join(F.transform("t", lambda x: x["line"]), "\n").alias("value"))


def _sentences(a: Along) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's sentences: their first tokens, their documents, and their numbers within these."""
    starts = np.flatnonzero(np.diff(a.sentence, prepend=0))
    of, k = a.doc[starts], np.arange(len(starts))
    return starts, of, k - np.maximum.accumulate(np.where(np.diff(of, prepend=-1) != 0, k, 0))


def _rendered(kind: pa.DataType):
    """A mapInArrow function from blocks with upos to records."""

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = pa.scalar("_")
        tails = pa.array([f"{d}\t_\t_" for d in DEPRELS])
        for a in rows_in(batches):
            words = pc.binary_join_element_wise(a.row["words"], a.row["lemma"], a.row["upos"], a.row["xpos"], none, "\t")
            starts, of, numbers = _sentences(a)
            ends = np.append(starts[1:], a.n)
            k = 0
            while k < len(starts):
                upto = max(k + 1, int(np.searchsorted(ends, starts[k] + RECORD_TOKENS, "right")))
                first, own = starts[k], slice(starts[k], ends[upto - 1])
                sizes = ends[k:upto] - starts[k:upto]
                wordnum = np.arange(own.start, own.stop) - np.repeat(starts[k:upto], sizes) + 1
                step = a.step[own]
                head = pc.if_else(pa.array(step != 0), pc.cast(pa.array(wordnum + step), pa.string()), none)
                lines = pc.binary_join_element_wise(pc.cast(pa.array(wordnum), pa.string()), words.take(pa.array(a.places[own])), head, tails.take(pa.array(a.deprel[own])), "\t")
                offsets = pa.array(np.append(starts[k:upto], own.stop) - first, pa.int32())
                values = pc.binary_join(pa.ListArray.from_arrays(offsets, lines), "\n")
                source = a.row["ids"].take(pa.array(of[k:upto]))
                yield pa.RecordBatch.from_arrays([source.cast(kind), pa.array(numbers[k:upto], pa.int64()), values.cast(pa.string())], ["source", "ord", "value"])
                k = upto

    return render


def render_blocks(blocks: DataFrame) -> DataFrame:
    """As ``render``, of blocks of documents as ``corpus.blocks_of`` has them: made along a block, so that no token is a
    row and none is shuffled. Documents of equal identifiers are rendered one by one."""
    kind = blocks.schema["ids"].dataType.elementType
    workers.ship(blocks.sparkSession)
    rows = blocks.select("ids", "sizes", "places", "words", "lemma", "xpos", F.transform("xpos", universal).alias("upos"))
    rows = rows.mapInArrow(_rendered(to_arrow_type(kind)), f"source {kind.simpleString()}, ord bigint, value string")
    return rows.withColumn("source", F.col("source").cast("string"))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of records: how many have token lines and how many lines these are, in a row without a lemma, and the lemmas of
    the lines, each in a row of its own, at least once."""
    held: set = set()
    for b in batches:
        split = pc.split_pattern(b.column(0), "\n")
        lines, record = pc.list_flatten(split), pc.list_parent_indices(split)
        # as in ``lines_of``
        skipped = pc.or_(pc.or_(pc.equal(pc.ascii_trim(lines, " "), ""), pc.starts_with(lines, "#")), pc.match_substring_regex(lines, SKIPPED))
        kept = pc.invert(skipped)
        lines, record = lines.filter(kept), record.filter(kept).to_numpy()
        cells = pc.split_pattern(lines, "\t", max_splits=3)
        third = cells.offsets.to_numpy()[:-1][pc.list_value_length(cells).to_numpy() >= 3] + 2
        new = [x for x in pc.unique(cells.values.take(pa.array(third))).to_pylist() if x not in held]
        if len(held) > HELD_LEMMAS:
            held.clear()
        held.update(new)
        none = [0] * len(new)
        counts = (pa.array([int(np.count_nonzero(np.diff(record, prepend=-1))), *none], pa.int64()), pa.array([len(lines), *none], pa.int64()))
        yield pa.RecordBatch.from_arrays([*counts, pa.array([None, *new], pa.string())], ["sentences", "tokens", "lemma"])


def counters_of(records: DataFrame) -> DataFrame:
    """``counters`` of what ``parse`` makes of the records, each of which is a sentence: every record is parsed, but
    sentences aren't numbered and no table of tokens is made; the lemmas alone are shuffled."""
    workers.ship(records.sparkSession)
    found = records.select("value").mapInArrow(_found, "sentences bigint, tokens bigint, lemma string")
    by_lemma = found.groupBy(F.lower("lemma").alias("lemma")).agg(F.sum("sentences").alias("sentences"), F.sum("tokens").alias("tokens"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c)
    return by_lemma.agg(total("sentences"), total("tokens"), F.count("lemma").alias("lemmas"))


def marked(tokens: DataFrame) -> DataFrame:
    """Sentence-marked lines (doc_id, ord, value), as indexers of vertical text read them."""
    rows = render(tokens).select(F.col("source").cast("long").alias("doc_id"), "ord", F.concat(F.lit("<s>\n"), "value", F.lit("\n</s>")).alias("value"))
    return rows


def counters(tokens: DataFrame) -> DataFrame:
    return tokens.agg(F.countDistinct("doc_id", "sent_id").alias("sentences"), F.count("*").alias("tokens"), F.countDistinct(F.lower("lemma")).alias("lemmas"))


def malformed(tokens: DataFrame) -> DataFrame:
    """Rows that lack columns: what an index builder reports and passes on."""
    return tokens.where(F.col("misc").isNull() | F.col("wordnum").isNull())


def without_boilerplate(records: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """Records whose ``# text = `` comment begins with none of the prefixes; records without it stay."""
    text = F.regexp_extract("value", r"(?m)^# text = (.*)$", 1)
    bad = F.lit(False)
    for p in prefixes:
        bad = bad | text.startswith(p)
    return records.where(~bad)
