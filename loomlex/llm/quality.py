"""Quality selection by ordinal regression on graded ratings.

A cumulative-link model: P(grade <= k) is the logistic of threshold k less one score, and the score is linear in
hashed words and the shape of the text, with weights shared by all grades. It gives each document the expected grade
and the chance of reaching a wanted grade, by which documents are selected. The weights are fit on a bounded sample
of rated rows (``sample_rows``, chosen by a hash of the identifier over the whole table).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import runtime

BITS = 16
#: Places after the hashed words hold the text's shape: so many ranges of each measure.
RANGES = 12
MEASURES = 7
DIMS = (1 << BITS) + RANGES * MEASURES
#: Rated rows that the weights are fit on.
SAMPLE_ROWS = 12000
#: Bound on distinct grades; more are an error, not a cut.
MAX_GRADES = 1000
SHAPE = 0.5

_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_UPPER = bytes(range(65, 91))
_SYMBOLS = b"!#$%&*+/<=>@\\^_`{|}~"


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values: square roots of word counts, of length 1 together, and the ranges of the shape's measures."""
    raw = (text or "").encode()
    counts = Counter(raw.translate(_WORDS).split())
    places = np.array([zlib.crc32(w) >> (32 - BITS) for w in counts], np.int32)
    values = np.sqrt(np.array(list(counts.values()), np.float32))
    if len(values):
        values /= np.linalg.norm(values)
    total, n = max(1, sum(counts.values())), max(1, len(raw))
    lines = raw.split(b"\n")
    measures = (
        (len(raw) - len(raw.translate(None, _UPPER))) / n,
        (len(raw) - len(raw.translate(None, _SYMBOLS))) / n * 4,
        len(counts) / total,
        max(counts.values(), default=0) / total,
        min(1.0, n / total / 20),
        len(set(lines)) / len(lines),
        min(1.0, len(raw).bit_length() / 20),
    )
    shape = [(1 << BITS) + k * RANGES + min(RANGES - 1, int(m * RANGES)) for k, m in enumerate(measures)]
    return np.append(places, np.array(shape, np.int32)), np.append(values, np.full(MEASURES, SHAPE, np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    #: grades in order; the thresholds between them rise
    grades: list[int]
    thresholds: np.ndarray
    weights: np.ndarray

    def chances(self, scores: np.ndarray) -> np.ndarray:
        """P(grade) by row."""
        upto = np.hstack([np.zeros((len(scores), 1)), _sigmoid(self.thresholds[None, :] - scores[:, None]), np.ones((len(scores), 1))])
        return np.diff(upto, axis=1)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], rounds: int = 250, rate: float = 0.05, penalty: float = 1e-5) -> Model:
    """Maximum likelihood by Adam; every grade weighs the same in sum, so that rare grades aren't lost."""
    grades = sorted({g for g, _, _ in rows})
    if len(grades) == 1:
        return Model(grades, np.zeros(0), np.zeros(DIMS, np.float32))
    y = np.array([grades.index(g) for g, _, _ in rows])
    share = (1 / np.bincount(y))[y] / len(grades)
    lengths = np.array([len(p) for _, p, _ in rows])
    starts = np.cumsum(lengths) - lengths
    places, values = np.concatenate([p for _, p, _ in rows]), np.concatenate([v for _, _, v in rows])
    # what fewer than three rated rows have says nothing of others
    values = np.where(np.bincount(places, minlength=DIMS)[places] >= 3, values, 0)
    of = np.repeat(np.arange(len(rows)), lengths)
    k = len(grades) - 1
    # gaps between thresholds are exponentials, so that they stay in order
    free = np.concatenate([[-(k - 1) / 2], np.zeros(k - 1)])
    w = np.zeros(DIMS)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(free), np.zeros_like(free)]
    for t in range(1, rounds + 1):
        gaps = np.exp(free[1:])
        theta = free[0] + np.concatenate([[0], np.cumsum(gaps)])
        s = np.add.reduceat(w[places] * values, starts)
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        high, low = _sigmoid(np.where(np.isinf(edge[y + 1]), 40, edge[y + 1] - s)), _sigmoid(np.where(np.isinf(edge[y]), -40, edge[y] - s))
        p = np.maximum(high - low, 1e-12)
        dh, dl = share * high * (1 - high) / p, share * low * (1 - low) / p
        ds = dh - dl  # of the negative log-likelihood, by the score
        gw = np.bincount(places, values * ds[of], DIMS) + penalty * w
        gt = np.zeros(k)
        np.add.at(gt, y[y < k], -dh[y < k])
        np.add.at(gt, y[y > 0] - 1, dl[y > 0])
        gf = np.concatenate([[gt.sum()], [gt[j:].sum() * gaps[j - 1] for j in range(1, k)]])
        for x, g, m, v in ((w, gw, *moments[:2]), (free, gf, *moments[2:])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * 10 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-5)
    return Model(grades, free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))]), w.astype(np.float32))


def _rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(g, *(x.tobytes() for x in features(t))) for g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["grade", "places", "values"])


def train(docs: DataFrame, ratings: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on documents with a rating. ratings: id and grade (whole numbers; nulls don't count, a document rated more
    than once counts with each of its grades; of an identifier's texts the one of the least hash); ``trains`` is over the column ``id``. None where nothing is rated; over
    ``MAX_GRADES`` distinct grades are an error."""
    spark = docs.sparkSession
    runtime.prepare(spark)
    rated = ratings.select(F.col("id").cast("long"), F.col("grade").cast("int")).where("id is not null and grade is not null").where(trains)
    counts = {r["grade"]: r["n"] for r in rated.groupBy("grade").agg(F.count("*").alias("n")).limit(MAX_GRADES + 1).collect()}
    if len(counts) > MAX_GRADES:
        raise ValueError(f"over {MAX_GRADES} distinct grades; raise MAX_GRADES if the driver can hold them")
    if not counts:
        return None
    # an equal share for every grade, as far as it has rows: by a bound on the hash, then the smallest hashes
    share, rate = max(1, sample_rows // len(counts)), F.lit(0.0)
    for g, n in counts.items():
        rate = F.when(F.col("grade") == g, min(1.0, share / n)).otherwise(rate)
    some = rated.where(F.pmod(F.xxhash64(F.lit(23), "id"), F.lit(1 << 40)) < rate * float(1 << 40))
    some = some.orderBy(F.xxhash64(F.lit(29), "id"), "id", "grade").limit(2 * sample_rows)  # the bound, whatever the hashes do
    rows = runtime.only(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), "text").join(F.broadcast(some), "id").select("id", "grade", F.col("text").cast("string"))
    one = Window.partitionBy("id", "grade").orderBy(F.xxhash64("text"), "text")
    rows = rows.withColumn("turn", F.row_number().over(one)).where("turn = 1").select("grade", "text")
    got = rows.mapInArrow(_rated, "grade int, places binary, values binary").toArrow()
    found = sorted(zip(*(got.column(i).to_pylist() for i in range(3))))
    return fit([(g, np.frombuffer(p, np.int32), np.frombuffer(v, np.float32)) for g, p, v in found]) if found else None


def _grader(model: Model | None, wanted: int, least: float):
    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = len(b)
            if model is None:
                expected, tail = np.zeros(n), np.ones(n)
            else:
                scores = np.empty(n)
                for k, text in enumerate(b.column(1).to_pylist()):
                    places, values = features(text)
                    scores[k] = model.weights[places] @ values
                p, grades = model.chances(scores), np.array(model.grades)
                expected, tail = p @ grades, p[:, grades >= wanted].sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(expected), pa.array(tail), pa.array(tail >= least)], ["id", "expected_grade", "tail_prob", "kept"])

    return grade


def grade(docs: DataFrame, model: Model | None, wanted: int, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, expected_grade, tail_prob (the chance of grade ``wanted`` or more) and kept (that it is at least ``least``)
    of every row, from its whole text. Null and empty texts are graded by their shape; without a model every row has
    0, 1 and is kept; a chance of just ``least`` is kept. Repeated rows come out as often; an empty table gives no rows;
    other columns aren't read."""
    runtime.prepare(docs.sparkSession)
    rows = runtime.only(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_grader(model, wanted, least), "id long, expected_grade double, tail_prob double, kept boolean")
