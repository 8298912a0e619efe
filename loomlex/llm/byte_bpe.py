"""Byte-level BPE with Spark's higher-order functions.

Each distinct pre-token of the corpus is encoded once (once for every SALT_BLOCKS blocks): a fold over its byte array
merges the adjacent pair of the lowest rank, leftmost first, until no pair has a rank. The rank map is one array, in
which a pair of pieces stands in one of two places, so that a lookup reads two entries of the vocabulary at most. It is
read from a file by a scalar subquery: a literal of it would be printed, a megabyte long, by every plan that holds it.
Documents get the ids of their words by blocks; decoding concatenates the ids' binary pieces.

A fold copies its arrays once for each merge. So a long word is folded in overlapping windows, which are put together
at pieces that neighbours share. That is exact: merges within a stretch of text depend on the stretch alone until one
crosses its border, so pieces are a text's encoding if and only if every two neighbours among them are the encoding
of what they spell; and of two encodings joined at a shared piece, every two neighbours are neighbours in one of them.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import blocks as B
from . import pretokens, runtime

#: Bits of a rank: three must go into a number, and leave room for where a piece starts.
MOST_BITS = 20
#: A length beyond every word.
ALL = 1 << 28


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a piece in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}


def _next_prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _last_merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, int, int] | None:
    """The two pieces that a piece is made of, and its rank. No other two that spell it ever stand side by side: what
    happens within a stretch that no merge has crossed is what happens to the stretch alone. None for a single byte,
    and for a piece that merges never make."""
    parts, none = [piece[k : k + 1] for k in range(len(piece))], 1 << 62
    while len(parts) > 2:
        low, k = min((ranks.get(a + b, none), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
        if low == none:
            return None
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return (ranks[parts[0]], ranks[parts[1]], ranks[piece]) if len(parts) == 2 else None


class Literals:
    """What the fold looks up, as arrays of type array<long>: literals, for single words, or a row of a file. JSON is
    the public way to literals of this size; Catalyst folds them once, when it plans."""

    def __init__(self, ranks: dict[bytes, int]):
        #: Bits of a rank where a word's pieces are held; the highest number of so many bits is no rank.
        self.bits = (max(ranks.values()) + 1).bit_length()
        if self.bits > MOST_BITS:
            raise ValueError(f"ranks of more than {MOST_BITS} bits")
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"bytes without a rank: {missing[:5]}")
        pairs = {(left << self.bits) + right: rank for left, right, rank in filter(None, (_last_merge(p, ranks) for p in ranks))}
        size = max(1000, 2 * len(pairs))
        while True:  # a larger table where no arrangement is found
            self.primes = (a := _next_prime(size)), _next_prime(a + size // 8)
            self.pairs = self._placed(pairs)
            if self.pairs:
                break
            size = size * 5 // 4
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        #: Windows of a long word overlap by two of the longest pieces.
        self.overlap = max(64, 2 * max(map(len, ranks)))

    def _placed(self, pairs: dict[int, int]) -> list[int] | None:
        """Each pair in one of its two places: who is displaced goes to the other."""
        table: list[int | None] = [None] * max(self.primes)
        for key in pairs:
            turn = 0
            for _ in range(500):
                at = key % self.primes[turn]
                key, table[at] = table[at], key
                if key is None:
                    break
                turn = 1 if key % self.primes[0] == at else 0
            else:
                return None
        return [-1 if k is None else (k << self.bits) + pairs[k] for k in table]

    def column(self, values: list[int]) -> Column:
        return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), "array<long>")

    def tables(self) -> Column:
        return F.struct(self.column(self.bytes).alias("bytes"), self.column(self.pairs).alias("pairs"))

    def written(self, spark: SparkSession) -> Column:
        """``tables``, written to the shared folder and read when a plan is run: the plan has the file's name only."""
        row = spark.createDataFrame([(self.bytes, self.pairs)], "bytes array<long>, pairs array<long>").coalesce(1)
        return runtime.materialise(row, "ranks").select(F.struct("bytes", "pairs")).scalar()


def _one(value: Column) -> Column:
    """An array of one value; this function is evaluated much faster than the one that takes any number."""
    return F.array_repeat(value, 1)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(_one(value), body), 1)


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def encode_word(word: Column, literals: Literals, tables: Column | None = None) -> Column:
    """The ids of one pre-token, an array<int>; an empty one has none. tables: those of ``literals``, where they are
    written."""
    # one character for each byte
    letters = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
    ids = lambda held: F.when(F.length(letters) > 0, F.transform(F.split(letters, ""), lambda c: F.get(held, F.ascii(c)))).otherwise(F.array().cast("array<long>"))
    found = lambda t: _let(t["bytes"], lambda held: _let(ids(held), lambda i: _let(t["pairs"], lambda pairs: _encode(i, pairs, literals))))
    return _let(literals.tables() if tables is None else tables, found)


def _encode(ids: Column, pairs: Column, literals: Literals) -> Column:
    """A piece is held as one number: the rank of its pair with the next piece, where it starts, and its id. So the
    least number is the pair of the lowest rank, the leftmost of those."""
    bits, starts = literals.bits, 62 - 2 * literals.bits
    long = lambda n: F.lit(n).cast("long")
    none, id_mask, low_mask = long((1 << bits) - 1), long((1 << bits) - 1), long((1 << bits + starts) - 1)
    top = long(1 << bits + starts)
    last = (1 << bits) - 1 << bits + starts
    pad = long(last + (1 << bits) - 1)

    def rank(key: Column) -> Column:
        """Of a pair, its left piece above the right one's bits."""
        places = [F.get(pairs, (key % long(p)).cast("int")) for p in literals.primes]
        return F.coalesce(*[F.when(F.shiftright(v, bits) == key, v.bitwiseAND(id_mask)) for v in places], none)

    pair = lambda left, right: left * long(1 << bits) + right
    above = lambda left, right: _let(pair(left, right), rank) * top

    def merge(held: Column, low: Column, j: Column) -> Column:
        new = F.shiftright(low, bits + starts)
        before = _let(F.element_at(held, j - 1), lambda x: above(x.bitwiseAND(id_mask), new) + x.bitwiseAND(low_mask))
        own = above(new, F.element_at(held, j + 2).bitwiseAND(id_mask)) + low.bitwiseAND(low_mask - id_mask) + new
        return F.concat(F.slice(held, 1, j - 2), _one(before), _one(own), F.slice(held, j + 2, F.lit(ALL)))

    def step(held: Column, _: Column) -> Column:
        return _let(F.array_min(held), lambda low: F.when(low < long(last), _let(F.array_position(held, low).cast("int"), lambda j: merge(held, low, j))).otherwise(held))

    def fold(ids: Column) -> Column:
        """The pieces of a word, without ranks."""
        start = F.transform(ids, lambda x, k: above(x, F.coalesce(F.get(ids, k + 1), none)) + k * long(1 << bits) + x)
        whole = F.aggregate(_upto(F.size(ids) - 1), F.concat(_one(pad), start, _one(pad)), step)
        return _let(whole, lambda p: F.transform(F.slice(p, 2, F.size(p) - 2), lambda x: x.bitwiseAND(low_mask)))

    def in_windows(ids: Column) -> Column:
        """Null where two neighbouring windows share no piece."""
        over = literals.overlap
        window = lambda k: F.transform(fold(F.slice(ids, k * over + 1, F.lit(2 * over))), lambda x: x + k * long(over << bits))
        windows = F.transform(_upto(F.ceil((F.size(ids) - over) / over).cast("int")), lambda k: window(k - 1))

        def joined(w: Column) -> Column:
            # the first piece that a window shares with the next is where it ends
            ends = F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.get(F.array_intersect(a, b), F.lit(0)))
            ends = F.concat(_one(long(-1)), ends, _one(long(2**62)))
            cut = lambda e: F.flatten(F.transform(w, lambda x, k: F.filter(x, lambda t: (t > F.element_at(e, k + 1)) & (t <= F.element_at(e, k + 2)))))
            return _let(ends, lambda e: F.when(~F.exists(e, lambda x: x.isNull()), cut(e)))

        return _let(windows, joined)

    found = F.when(F.size(ids) <= 2 * literals.overlap, fold(ids)).otherwise(F.coalesce(in_windows(ids), fold(ids)))
    return F.transform(found, lambda x: x.bitwiseAND(id_mask).cast("int"))


def split_by(pattern: str) -> Callable[[list], list[list[str]]]:
    held: list = []

    def split(texts: list) -> list[list[str]]:
        if not held:
            held.append(pretokens.finder(pattern))
        return [held[0](t) if t else [] for t in texts]

    return split


def encode_blocks(blocks: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """block, place and ids of each distinct word of a block; a word is encoded at the first of its rows, and the rest
    of them take it from there."""
    rows = B.salted(B.word_rows(blocks).select("word", "block", "place"), B.salts(blocks))
    same = Window.partitionBy("word", "salt").orderBy("block")
    rows = rows.withColumn("n", F.row_number().over(same))
    literals = Literals(ranks)
    # the analyser wants no subquery in the fold; read once, the column is put there by the optimiser, and not into rows
    rows = rows.withColumn("tables", literals.written(blocks.sparkSession))
    own = F.when(F.col("n") == 1, encode_word(F.col("word"), literals, F.col("tables")))
    rows = rows.select("block", "place", "word", "salt", own.alias("own"))
    return rows.select("block", "place", F.first("own", ignorenulls=True).over(same.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("ids"))


def _documents(pieces: dict[int, bytes], whole: bool):
    names = [str(i) for i in range(max(pieces, default=0) + 1)]

    def gather(block: dict[str, np.ndarray], found: dict[str, tuple[np.ndarray, np.ndarray]]) -> pa.Table:
        lengths, known = found["ids"] if len(found["ids"]) else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        cuts = np.cumsum(lengths).tolist()
        own = [known[a:e].tolist() for a, e in zip([0, *cuts[:-1]], cuts)]
        words = [" ".join([names[i] for i in w]) for w in own]
        decoded = [b"".join([pieces[i] for i in w]) for w in own]
        flat, ends = block["flat"], np.cumsum(block["lens"])
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths[flat])])
        # a document's values are made, used and left before the next one's
        values, at = [], 0
        for e in ends.tolist():
            mine = flat[at:e].tolist()
            text = b"".join([decoded[k] for k in mine])
            if whole:
                values.append(([i for k in mine for i in own[k]], text))
            else:
                ids = " ".join([words[k] for k in mine]).encode()
                values.append((hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()))
            at = e
        kinds = {"ids": pa.list_(pa.int32()), "text": pa.binary()} if whole else {"ids_sha256": pa.string(), "decoded_sha256": pa.string()}
        out = {"id": pa.array(block["ids"], mask=block["known"] == 0), "n_tokens": pa.array(upto[ends] - upto[ends - block["lens"]])}
        return pa.table(out | {name: pa.array([v[k] for v in values], kind) for k, (name, kind) in enumerate(kinds.items())})

    return gather


def _encoded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, whole: bool, schema: str) -> DataFrame:
    ranks = read_ranks(ranks_path)
    blocks, buckets = B.build_blocks(docs, split_by(pattern), id_col, text_col)
    return B.by_block(blocks, buckets, encode_blocks(blocks, ranks), _documents({r: p for p, r in ranks.items()}, whole), schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids and text (the bytes that the ids decode to) of every row. Null and empty texts have no ids;
    repeated rows come out as often; an empty table gives no rows; other columns of ``docs`` aren't read."""
    return _encoded(docs, ranks_path, pattern, id_col, text_col, True, "id long, n_tokens long, ids array<int>, text binary")


def roundtrip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode``, with digests in place of the values: id, n_tokens, ids_sha256 (of decimal ids joined by a space)
    and decoded_sha256."""
    return _encoded(docs, ranks_path, pattern, id_col, text_col, False, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """id and text (binary) of arrays of ids: their pieces, concatenated. Null and empty arrays give empty bytes; an id
    outside the vocabulary is an error."""
    ranks = read_ranks(ranks_path)
    order: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        order[rank] = piece
    pieces = F.from_json(F.lit(json.dumps([p.hex() for p in order], separators=(",", ":"))), "array<string>")
    ids = F.coalesce(F.col(f"`{ids_col}`"), F.array().cast("array<int>"))
    # pieces in hexadecimal, joined at once: a fold of growing binaries would copy a long text for each of its ids
    return encoded.select(F.col(f"`{id_col}`").alias("id"), F.unhex(_let(pieces, lambda p: F.array_join(F.transform(ids, lambda i: F.element_at(p, i + 1)), ""))).alias("text"))
