"""Blocks of documents and their dictionaries: how a value is found once per distinct word and brought back to texts.

A block is a run of documents of one input partition. It holds each of its distinct words once and its documents as
places in that list, so that joining words with what is known of them costs a row for each distinct word of a block,
not one for each word of a text. Blocks are written once, bucketed by their number; the values of their words are
shuffled to the same buckets and meet them there, and no text or document moves again.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

#: Bytes of text after which a block is closed. A document is never divided, so a longer one is a block of its own.
BLOCK_BYTES = 48 << 20


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, each transposed by byte so that equal high bytes lie together."""
    import zstandard

    head, body = {}, []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        data = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
        head[name] = [a.dtype.str, len(a)]
        body.append(data)
    head_bytes = json.dumps(head).encode()
    return zstandard.ZstdCompressor(level=3).compress(struct.pack("<I", len(head_bytes)) + head_bytes + b"".join(body))


def unpack(data: bytes) -> dict[str, np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n = struct.unpack_from("<I", raw)[0]
    at, out = 4 + n, {}
    for name, (kind, length) in json.loads(raw[4 : 4 + n]).items():
        width = np.dtype(kind).itemsize
        out[name] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, length * width, at).reshape(width, length).T).view(kind).reshape(length)
        at += length * width
    return out


def builder(split: Callable[[list], list[list]], count_words: Callable[[int | None], bool] | None, block_bytes: int):
    """A mapInArrow function from (id, text) to blocks. split: words (str or bytes) of each text of a batch.
    count_words: of which identifiers the words are counted."""

    def close(k: int, part: int, ids: list, known: list, sizes: list, lengths: list[int], places: list[np.ndarray], seen: dict, counted: list[bool]):
        flat = np.concatenate(places) if places else np.zeros(0, np.int32)
        lens = np.array(lengths, np.int32)
        totals = np.bincount(flat, minlength=len(seen))
        order = np.argsort(-totals, kind="stable")  # common words get small numbers
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        words = list(seen)
        words = [words[i] for i in order]
        if words and isinstance(words[0], bytes):
            words = [w.decode() for w in words]
        of = np.repeat(np.array(counted, bool), lens)
        counts = np.bincount(rank[flat[of]], minlength=len(words)).astype(np.int64) if count_words else np.zeros(0, np.int64)
        payload = pack(ids=np.array(ids, np.int64), known=np.array(known, np.uint8), sizes=np.array(sizes, np.int64), counted=np.array(counted, np.uint8), lens=lens, flat=rank[flat])
        kinds = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(((part << 32) + k, words, counts, payload), kinds)], ["block", "words", "counts", "payload"])

    def numbers() -> dict:
        """A dictionary that numbers words as they are first asked for."""
        return defaultdict(count().__next__)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, held = TaskContext.get().partitionId(), 0, 0
        ids, known, sizes, lengths, places, seen, counted = [], [], [], [], [], numbers(), []
        for b in batches:
            docs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for doc, text, words in zip(docs, texts, split(texts)):
                size = len(text.encode()) if text else 0
                if ids and held + size > block_bytes:
                    yield close(k, part, ids, known, sizes, lengths, places, seen, counted)
                    k, held = k + 1, 0
                    ids, known, sizes, lengths, places, seen, counted = [], [], [], [], [], numbers(), []
                held += size
                places.append(np.fromiter(map(seen.__getitem__, words), np.int32, len(words)))
                ids.append(doc or 0)
                known.append(doc is not None)
                sizes.append(size)
                lengths.append(len(words))
                counted.append(count_words is None or count_words(doc))
        if ids:
            yield close(k, part, ids, known, sizes, lengths, places, seen, counted)

    return build


def build_blocks(docs: DataFrame, split: Callable, id_col: str, text_col: str, count_words: Callable | None = None, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """The blocks (block, words, counts, payload) of a table's documents (no counts without ``count_words``), written to the shared folder in buckets by
    block, and the number of buckets."""
    spark = docs.sparkSession
    runtime.prepare(spark)
    rows = runtime.only(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), F.col("text").cast("string"))
    blocks = rows.mapInArrow(builder(split, count_words, block_bytes), "block long, words array<string>, counts array<long>, payload binary")
    buckets, table = runtime.shuffle_partitions(spark), f"loomlex_blocks_{uuid.uuid4().hex}"
    blocks.write.format("parquet").option("path", runtime.scratch_path(spark, "blocks")).option("compression", "zstd").bucketBy(buckets, "block").saveAsTable(table)
    return spark.table(table), buckets


def word_rows(blocks: DataFrame) -> DataFrame:
    """block, place, word and count: a row for each distinct word of a block."""
    rows = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w"))
    return rows.select("block", "place", F.col("w.words").alias("word"), F.col("w.counts").alias("count"))


#: A word's rows are dealt anew for every so many blocks, so that a word of all blocks is not one task's.
SALT_BLOCKS = 1 << 16


def salts(blocks: DataFrame) -> int:
    """How many parts a word's rows are dealt to: one as long as there are at most SALT_BLOCKS blocks."""
    return max(1, -(-blocks.count() // SALT_BLOCKS))


def salted(rows: DataFrame, salts: int) -> DataFrame:
    """``rows`` with a column salt, the part of their block."""
    return rows.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int") if salts > 1 else F.lit(0))


#: Rows of values that a task holds before it packs them by block.
PACK_ROWS = 1 << 20


def packer(names: list[str]):
    """A mapInArrow function from rows of (block, place, *names) to a row of packed arrays for each block: places in
    order, so that they pack to a byte or two, and numbers or lists of numbers in the order of the places."""

    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += len(b)
            if rows >= PACK_ROWS:
                yield close(held)
                held, rows = [], 0
        if rows:
            yield close(held)

    def close(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        block, place = t.column("block").to_numpy(), t.column("place").to_numpy()
        order = np.lexsort((place, block))
        t = t.take(pa.array(order)).combine_chunks()
        block, cuts = np.unique(block[order], return_index=True)
        data = []
        for a, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(t)]):
            arrays = {"place": np.diff(t.column("place").slice(a, e - a).to_numpy().astype(np.int32), prepend=np.int32(0))}
            for n in names:
                column = t.column(n).slice(a, e - a)
                if pa.types.is_list(column.type):
                    arrays[f"{n} lengths"] = pc.list_value_length(column).to_numpy()
                    arrays[f"{n} values"] = pc.list_flatten(column).to_numpy()
                else:
                    arrays[n] = column.to_numpy()
            data.append(pack(**arrays))
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(data, pa.binary())], ["of", "data"])

    return pack_rows


def by_block(blocks: DataFrame, buckets: int, values: DataFrame, apply: Callable[[dict, dict], pa.Table], schema: str) -> DataFrame:
    """``apply`` of every block's arrays and of its values: arrays by the names of the columns of ``values`` (block,
    place and more), in the order of the places 0, 1, ...; lists as their lengths and their values. A block has a bounded number of bytes,
    and so has what meets in one call."""
    names = [c for c in values.columns if c not in ("block", "place")]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [unpack(d) for d in right.column("data").to_pylist()]
        found: dict = {}
        if parts:
            order = np.argsort(np.concatenate([np.cumsum(p["place"]) for p in parts]), kind="stable")
        for n in names:
            if parts and n in parts[0]:
                found[n] = np.concatenate([p[n] for p in parts])[order]
            elif parts:
                lengths, values = (np.concatenate([p[f"{n} {what}"] for p in parts]) for what in ("lengths", "values"))
                starts, lengths = (np.cumsum(lengths) - lengths)[order], lengths[order].astype(np.int64)
                shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
                found[n] = lengths, values[np.arange(len(shift)) + shift]
            else:
                found[n] = np.zeros(0, np.int64)
        return pa.concat_tables([apply(unpack(payload), found) for payload in left.column("payload").to_pylist()])

    packed = values.select("block", "place", *names).mapInArrow(packer(names), "of long, data binary")
    near = packed.repartition(buckets, "of").groupBy("of")
    return blocks.select("block", "payload").groupBy("block").cogroup(near).applyInArrow(lambda left, right: meet(left, right), schema)
