"""Log-likelihood of documents under a gated recurrent language model that is learnt from the corpus itself.

Counts of all training words are found once for each distinct word and brought to the documents by blocks. Every
task then learns a replica of the network from the training documents of its blocks; the replicas' weights are
averaged, by the tokens they were learnt from, and go into the next round. Scores mix the network with the counts,
so that they are chances over all words, also those never seen.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import blocks as B
from . import gru, runtime

#: Rounds of learning and averaging; each training document is in one of them.
ROUNDS = 3
#: Weight of the network in the mixture, of words and again of documents; counts have the rest.
SHARE = 0.9
#: Floats of a piece of the weights, as they are averaged.
PIECE = 1 << 14
LN10 = np.log(10)


def split(texts: list) -> list[list[bytes]]:
    """Words between ASCII white space, A-Z in lower case; ends of documents are added later."""
    return [(t or "").encode().lower().split() for t in texts]


def trains(doc: int | None) -> bool:
    """Four identifiers in five, by CRC-32 of their decimal text."""
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 5 != 1


def with_ends(block: dict[str, np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens (places of words, ``end`` after each document), and the documents' starts and lengths."""
    lengths = block["lens"].astype(np.int64) + 1
    starts = np.cumsum(lengths) - lengths
    tokens = np.full(int(lengths.sum()), end, np.int32)
    inner = np.ones(len(tokens), bool)
    inner[starts + lengths - 1] = False
    tokens[inner] = block["flat"]
    return tokens, starts, lengths


class Vocabulary:
    """What is known of all words: totals, the shortlist and the mass of the other words' classes."""

    def __init__(self, total: int, distinct: int, ends: int, short: list[tuple[str | None, int]], mass: np.ndarray):
        self.total, self.distinct, self.ends, self.short, self.mass = total, distinct, ends, short, mass
        self.end = next(k for k, (w, _) in enumerate(short) if w is None)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log((counts + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def within(self, models: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log of the chance of a word in its class of other words, where one unseen word has its share."""
        tail = models >= gru.SHORTLIST
        out = np.zeros(len(models))
        out[tail] = np.log((counts[tail] + 0.5) / (self.mass[models[tail] - gru.SHORTLIST] + 0.5))
        return out


def _code(block: dict[str, np.ndarray], found: dict[str, np.ndarray]) -> pa.Table:
    models, counts = found["model"].astype(np.int16), found["c"].astype(np.int64)
    block |= {"models": models, "counts": counts}
    block.pop("sizes")
    return pa.table({"payload": pa.array([B.pack(**block)], pa.binary())})


def _learn(weights: dict[str, np.ndarray], turn: int, end: int):
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        network, seen = gru.Network({k: v.copy() for k, v in weights.items()}), 0
        for b in batches:
            for payload in b.column(0).to_pylist():
                block = B.unpack(payload)
                models = np.append(block["models"].astype(np.int32), np.int32(end))
                tokens, starts, lengths = with_ends(block, len(models) - 1)
                mine = (block["counted"] == 1) & (np.arange(len(starts)) % ROUNDS == turn)
                gru.train(network, models[tokens], starts[mine], lengths[mine])
                seen += int(lengths[mine].sum())
        if seen:
            flat = np.concatenate([v.reshape(-1) for v in network.w.values()])
            pieces = [flat[k : k + PIECE] for k in range(0, len(flat), PIECE)]
            n, part = len(pieces), TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([part % 64] * n, pa.int32()), pa.array([float(seen)] * n), pa.array([p.astype(np.float64) * seen for p in pieces], pa.list_(pa.float64()))], ["piece", "part", "n", "w"])

    return learn


def _added(keys: list[str]):
    def add(t: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(w.values.to_numpy()) for w in t.column("w")], axis=0)
        return pa.table({k: t.column(k).slice(0, 1).combine_chunks() for k in keys} | {"n": pa.array([sum(t.column("n").to_pylist())]), "w": pa.array([total], pa.list_(pa.float64()))})

    return add


def learn(coded: DataFrame, weights: dict[str, np.ndarray], end: int, turn: int) -> dict[str, np.ndarray]:
    """One round: replicas learn, and their weighted mean comes back, added up in two steps."""
    replicas = coded.select("payload").mapInArrow(_learn(weights, turn, end), "piece int, part int, n double, w array<double>")
    parts = replicas.groupBy("piece", "part").applyInArrow(_added(["piece", "part"]), "piece int, part int, n double, w array<double>")
    rows = parts.groupBy("piece").applyInArrow(_added(["piece"]), "piece int, n double, w array<double>").orderBy("piece").toArrow()
    if not len(rows):
        return weights
    flat = np.concatenate([np.asarray(w.values.to_numpy()) / n for w, n in zip(rows.column("w"), rows.column("n").to_pylist())]).astype(gru.FLOAT)
    out, at = {}, 0
    for k, v in weights.items():
        out[k] = flat[at : at + v.size].reshape(v.shape).copy()
        at += v.size
    return out


def _score(weights: dict[str, np.ndarray], vocabulary: Vocabulary):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = gru.Network(weights)
        for b in batches:
            for payload in b.column(0).to_pylist():
                block = B.unpack(payload)
                models = np.append(block["models"].astype(np.int32), np.int32(vocabulary.end))
                counts = np.append(block["counts"], vocabulary.ends)
                tokens, starts, lengths = with_ends(block, len(models) - 1)
                base, within = vocabulary.base(counts)[tokens], vocabulary.within(models, counts)[tokens]
                own = gru.score(network, models[tokens], starts, lengths) + within
                mixed = np.logaddexp(own + np.log(SHARE), base + np.log(1 - SHARE))
                added = lambda x: np.add.reduceat(x, starts)  # noqa: E731  no document is without its end
                # a whole document may be of either kind, so none scores much below its counts
                counted, both = added(base), added(mixed)
                score = np.logaddexp(both + np.log(SHARE), counted + np.log(1 - SHARE))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block["ids"], mask=block["known"] == 0),
                        pa.array(block["counted"] == 0),
                        pa.array(lengths),
                        pa.array(added((counts > 0)[tokens].astype(np.int64))),
                        pa.array(np.full(len(starts), vocabulary.total, np.int64)),
                        pa.array(counted / LN10),
                        pa.array(score / LN10),
                    ],
                    ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return score


def _tail() -> Column:
    return F.pmod(F.xxhash64(F.substring("word", -3, 3)), F.lit(gru.TAIL_CLASSES)).cast("int")


def lm_scores(docs: DataFrame, trains: Callable[[int | None], bool] = trains, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out (not learnt from), n_tokens (words and one end), n_known (of them counted in training),
    train_tokens, base_score and score: log10 of the chance of the whole text by smoothed counts and by the model.

    Null and empty texts are an end alone. Repeated rows are scored, and learnt from, as often as they occur; other
    columns aren't read; an empty table gives no rows. Counts and base_score don't depend on how the table is divided;
    score does a little, as each task learns a replica from the documents it holds and the replicas are averaged.
    """
    spark = docs.sparkSession
    blocks, buckets = B.build_blocks(docs, split, id_col, text_col, trains)
    salts = B.salts(blocks)
    rows = B.salted(B.word_rows(blocks), salts).withColumn("tail", _tail())
    same = Window.partitionBy("word", "salt")
    rows = rows.withColumn("n", F.row_number().over(same.orderBy("block"))).withColumn("c", F.sum("count").over(same)).drop("count")
    rows = runtime.materialise(rows, "words")
    once = rows.where("n = 1")
    if salts > 1:
        # a word's parts are added up, and the sum goes to each part's rows
        sums = runtime.materialise(once.groupBy("word").agg(F.sum("c").alias("c")), "sums")
        parts = runtime.materialise(once.select("word", "salt").join(sums, "word"), "parts")
        rows, once = rows.drop("c").join(parts, ["word", "salt"]), sums.withColumn("tail", _tail())
    once = once.where("c > 0")
    totals = once.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("c")).first()
    ends = sum(r["n"] for r in blocks.select("payload").mapInArrow(_training_documents, "n long").agg(F.sum("n").alias("n")).collect() if r["n"])
    best = once.orderBy(F.desc("c"), "word").select("word", "c", "tail").limit(gru.SHORTLIST - 1).collect()
    short = sorted([(r["word"], r["c"]) for r in best] + [(None, ends)], key=lambda x: (-x[1], x[0] or ""))
    mass = np.zeros(gru.TAIL_CLASSES)
    for r in once.groupBy("tail").agg(F.sum(F.col("c") + 0.5).alias("m")).collect():
        mass[r["tail"]] = r["m"]
    for r in best:
        mass[r["tail"]] -= r["c"] + 0.5
    vocabulary = Vocabulary(totals["c"] + ends, totals["v"] + (ends > 0), ends, short, mass)

    # the shortlist has a fixed number of words
    listed = spark.createDataFrame([(w, k) for k, (w, _) in enumerate(short) if w is not None] or [("", 0)], "word string, short int")
    values = rows.join(F.broadcast(listed), "word", "left").select("block", "place", "c", F.coalesce("short", F.col("tail") + gru.SHORTLIST).alias("model"))
    coded = runtime.materialise(B.by_block(blocks, buckets, values, _code, "payload binary"), "coded")

    weights = gru.start(np.array([c for _, c in short], float), mass)
    for turn in range(ROUNDS):
        weights = learn(coded, weights, vocabulary.end, turn)
    return coded.mapInArrow(_score(weights, vocabulary), "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _training_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([int(B.unpack(p)["counted"].sum()) for p in b.column(0).to_pylist()], pa.int64())], ["n"])
