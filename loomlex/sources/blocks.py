"""Blocks of documents: a run of documents as places in the list of its distinct words. What follows from a word alone
(tag, lemma, whether it meets a condition) is then found once for each of these and looked up by place, and what follows
from the words around is found along the places, for all tokens of a block at once. No token is a row, none is shuffled."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomlex import workers

#: Tokens after which a block is closed. A document is never divided.
BLOCK_TOKENS = 1 << 22
#: Relations of the rule tagger by their number.
DEPRELS = ("_", "amod", "nsubj", "obj", "advmod", "case")
ENDS = (".", "!", "?")


@cache
def splitters(token: str, jvm) -> tuple[str, str, str]:
    """The expression for tokens as Python has it: its classes of characters (letters and such) are those of the
    engine's own expressions, asked for once. One for all texts, and quicker ones for texts below U+10000 and U+80."""
    every = "".join(chr(x) for x in range(0x20, 0x110000) if not 0xD800 <= x < 0xE000)

    @cache
    def members(name: str) -> list[int]:
        return [ord(x) for x in jvm.java.util.regex.Pattern.compile(rf"[^\p{{{name}}}]+").matcher(every).replaceAll("")]

    def ranges(name: str, below: int) -> str:
        points = [x for x in members(name) if x < below]
        firsts = [x for x, before in zip(points, [-1, *points]) if x != before + 1]
        lasts = [x for x, after in zip(points, [*points[1:], -1]) if x + 1 != after]
        return "".join(f"\\U{x:08x}-\\U{y:08x}" for x, y in zip(firsts, lasts))

    return tuple(re.sub(r"\\p\{(\w+)\}", lambda m, below=below: ranges(m[1], below), token) for below in (0x110000, 0x10000, 0x80))


def builder(kind: pa.DataType, tokens: tuple[str, str, str], most: int):
    """A mapInArrow function from (doc_id, text as bytes) to blocks."""

    def close(ids: list, places: list[np.ndarray], seen: dict) -> pa.RecordBatch:
        lengths, flat = np.array([len(p) for p in places], np.int32), np.concatenate(places)
        counts = np.bincount(flat, minlength=len(seen)).astype(np.int64)
        values = ([pa.array(ids, kind)], [lengths.tobytes()], [flat.tobytes()], [list(seen)], [counts])
        kinds = (pa.list_(kind), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], ["ids", "sizes", "places", "words", "counts"])

    def numbers() -> dict:
        """A dictionary that numbers words as they are first asked for."""
        return defaultdict(count().__next__)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, find_below, find_ascii = (re.compile(t).findall for t in tokens)
        beyond = re.compile("[\U00010000-\U0010ffff]").findall

        def split(data: bytes) -> list[str]:
            if data.isascii():
                return find_ascii(data.decode())
            text = data.decode("utf-8", "replace")
            # most characters beyond are in no token, and the quicker expression tells no more of them
            return find(text) if find("".join(set(beyond(text)))) else find_below(text)

        ids, places, seen, n = [], [], numbers(), 0
        for b in batches:
            for doc, text in zip(b.column(0), b.column(1)):
                words = split(text.as_py() or b"")
                if words:
                    ids.append(doc)
                    places.append(np.fromiter(map(seen.__getitem__, words), np.int32, len(words)))
                    n += len(words)
                if n >= most:
                    yield close(ids, places, seen)
                    ids, places, seen, n = [], [], numbers(), 0
        if n:
            yield close(ids, places, seen)

    return build


def blocks_of(texts: DataFrame, token: str, most: int | None = None) -> DataFrame:
    """ids, sizes, places, words and counts: a row for each block of documents (doc_id, text); ``token`` is the
    expression for tokens. Documents without tokens are left out."""
    spark, kind = texts.sparkSession, texts.schema["doc_id"].dataType
    workers.ship(spark)
    schema = f"ids array<{kind.simpleString()}>, sizes binary, places binary, words array<string>, counts array<bigint>"
    build = builder(to_arrow_type(kind), splitters(token, spark._jvm), most or BLOCK_TOKENS)
    return texts.select("doc_id", F.col("text").cast("string").cast("binary")).mapInArrow(build, schema)


class Along:
    """A block's tokens as arrays: places, and what is made from them when it is first asked for."""

    def __init__(self, row: dict):
        self.row = row
        self.sizes = np.frombuffer(row["sizes"], np.int32)
        self.places = np.frombuffer(row["places"], np.int32)
        self.n, self.words = len(self.places), len(row["words"])
        self._made: dict = {}

    def made(self, key, make):
        if key not in self._made:
            self._made[key] = make()
        return self._made[key]

    @property
    def doc(self) -> np.ndarray:
        return self.made("doc", lambda: np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes))

    @property
    def start(self) -> np.ndarray:
        """Of each document, its first token."""
        return self.made("start", lambda: np.cumsum(self.sizes, dtype=np.int64) - self.sizes)

    @property
    def sentence(self) -> np.ndarray:
        """A number of its own for each sentence of each document: they end with marks, and with documents."""

        def make():
            first = np.zeros(self.n, bool)
            ends = pc.is_in(self.row["words"], value_set=pa.array(ENDS)).to_numpy(zero_copy_only=False)
            first[1:] = ends[self.places[:-1]]
            first[self.start[self.sizes > 0]] = True
            return np.cumsum(first, dtype=np.int32)

        return self.made("sentence", make)

    def together(self, length: int, sentence: bool) -> np.ndarray:
        """Of each token that has so many tokens from it on, whether these are in one document, or one sentence."""
        of = self.sentence if sentence else self.doc
        return self.made(("together", length, sentence), lambda: of[: self.n - length + 1] == of[length - 1 :])

    def tagged(self, starts: str) -> np.ndarray:
        """Of each token, whether its tag starts so."""
        return self.made(("tag", starts), lambda: pc.starts_with(self.row["xpos"], starts).to_numpy(zero_copy_only=False)[self.places])

    @property
    def step(self) -> np.ndarray:
        """How far a token's head is from it, 0 where it has none."""

        def make():
            s = self.sentence

            def near(k: int, starts: str) -> np.ndarray:
                out = np.zeros(self.n, bool)
                a, b = (slice(None, -k), slice(k, None)) if k > 0 else (slice(-k, None), slice(None, k))
                out[a] = self.tagged(starts)[b] & (s[a] == s[b])
                return out

            step, is_in = np.zeros(self.n, np.int8), pc.equal(self.row["xpos"], "IN").to_numpy(zero_copy_only=False)[self.places]
            verb, noun = near(1, "VB"), near(1, "NN")
            for k in (3, 2, 1):
                step[self.tagged("JJ") & (noun if k == 1 else near(k, "NN"))] = k
            step[self.tagged("NN") & near(-1, "VB")] = -1
            step[(self.tagged("NN") | self.tagged("RB")) & verb] = 1
            step[is_in & noun] = 1
            return step

        return self.made("step", make)

    @property
    def deprel(self) -> np.ndarray:
        """Of each token, its relation's number."""

        def make():
            rel = np.zeros(self.n, np.int8)
            for starts, name in (("JJ", "amod"), ("NN", "nsubj"), ("RB", "advmod"), ("IN", "case")):
                rel[self.tagged(starts)] = DEPRELS.index(name)
            rel[self.tagged("NN") & (self.step < 0)] = DEPRELS.index("obj")
            rel[self.step == 0] = 0
            return rel

        return self.made("deprel", make)


def rows_in(batches: Iterator[pa.RecordBatch]) -> Iterator[Along]:
    """Blocks of the batches: lists as arrays, bytes as buffers."""
    for b in batches:
        for i in range(len(b)):
            yield Along({name: b.column(name)[i].as_buffer() if pa.types.is_binary(b.column(name).type) else b.column(name)[i].values for name in b.schema.names})
