"""Language identification in two steps: the family by linear discrimination, then within it one-versus-one linear
support vector machines between the closely related languages.

Features are hashed byte n-grams of the whole lower-cased text, square-rooted and normalised. The machines are fit on
a bounded sample of labelled rows (``sample_rows``, shared equally by the languages and chosen by a hash of identifier
and text over the whole table), in one task: only weights come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import runtime

#: ISO 639-1 codes by language family. A language in none is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bg", "mk"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}
BITS = 13
DIMS = 1 << BITS
#: Rows that the machines are fit on, over all languages.
SAMPLE_ROWS = 2400
UNKNOWN = "und"

#: ASCII other than letters parts words; bytes of other scripts stay.
_TABLE = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def family(lang: str) -> str:
    return next((name for name, langs in FAMILIES.items() if lang in langs), f"only {lang}")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Normalised square roots of the counts of hashed 1- to 4-grams of the whole text."""
    raw = b" " + b" ".join(text.lower().encode().translate(_TABLE).split()) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    gram, counts = b, np.zeros(DIMS, np.int64)
    for n in range(1, 5):
        if n > 1:
            if len(b) < n:
                break
            gram = (gram[:-1] << np.uint32(8)) | b[n - 1 :]
        counts += np.bincount((gram * np.uint32(2654435761) + np.uint32(n) * np.uint32(40503)) >> np.uint32(32 - BITS), minlength=DIMS)
    x = np.sqrt(counts.astype(np.float32))
    return x / np.linalg.norm(x)


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 150) -> np.ndarray:
    """A linear machine with squared hinge loss, by accelerated gradient steps; the last weight is the bias.
    Both sides weigh the same, however many rows they have."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * c * len(y) / 100
    margins = lambda v: x @ v[:-1] + v[-1]
    back = lambda g: np.append(x.T @ g, g.sum())
    v = np.ones(x.shape[1] + 1, np.float32)
    for _ in range(8):
        v = back(share * margins(v))
        norm = np.linalg.norm(v)
        v /= norm
    step, w, z, t = 1 / (2 * norm + 1), np.zeros_like(v), np.zeros_like(v), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * margins(z))
        new = z - step * (z - 2 * back(share * y * slack))
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, w, t = new + (t - 1) / after * (new - w), new, after
    return w


@dataclass
class Model:
    langs: list[str]
    families: list[str]
    #: pairs of families, then pairs of languages of one family, each with its machine
    family_pairs: list[tuple[int, int]]
    lang_pairs: list[tuple[int, int]]
    weights: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores of rows of features. Pairwise votes decide; sums of margins break their ties."""
        margins = x @ self.weights[:-1] + self.weights[-1] if self.weights.shape[1] else np.zeros((len(x), 0), np.float32)
        chances = 1 / (1 + np.exp(-3 * margins))
        own = np.array([self.families.index(family(lang)) for lang in self.langs])
        top, sure = self._vote(len(self.families), self.family_pairs, margins, chances, 0)
        best, near = self._vote(len(self.langs), self.lang_pairs, margins, chances, len(self.family_pairs))
        out, scores = [], np.empty(len(x))
        for r in range(len(x)):
            f = int(np.argmax(top[r]))
            mine = np.flatnonzero(own == f)
            k = mine[int(np.argmax(best[r, mine]))]
            out.append(self.langs[k])
            scores[r] = sure[r, f] * near[r, k]
        return out, np.clip(scores, 0, 1)

    @staticmethod
    def _vote(n: int, pairs: list[tuple[int, int]], margins: np.ndarray, chances: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        votes, sure = np.zeros((len(margins), n)), np.ones((len(margins), n))
        for k, (a, b) in enumerate(pairs, first):
            m = np.tanh(margins[:, k]) * 1e-3
            votes[:, a] += (margins[:, k] > 0) + m
            votes[:, b] += (margins[:, k] <= 0) - m
            sure[:, a] = np.minimum(sure[:, a], chances[:, k])
            sure[:, b] = np.minimum(sure[:, b], 1 - chances[:, k])
        return votes, sure


def pairs_of(names: list[str]) -> tuple[list[str], list[tuple[int, int]], list[tuple[int, int]]]:
    """Families of the languages, pairs of families, and pairs of languages of one family."""
    families = sorted({family(n) for n in names})
    return families, list(combinations(range(len(families)), 2)), [(a, b) for a, b in combinations(range(len(names)), 2) if family(names[a]) == family(names[b])]


def model_of(names: list[str], weights: np.ndarray) -> Model:
    return Model(names, *pairs_of(names), weights)


def fit(x: np.ndarray, langs: list[str]) -> Model:
    names = sorted(set(langs))
    families, family_pairs, lang_pairs = pairs_of(names)
    y = np.array(langs)
    fam = np.array([family(n) for n in langs])
    machines = []
    for values, kinds, pairs in ((fam, families, family_pairs), (y, names, lang_pairs)):
        for a, b in pairs:
            rows = (values == kinds[a]) | (values == kinds[b])
            machines.append(svm(x if rows.all() else x[rows], np.where(values[rows] == kinds[a], 1, -1).astype(np.float32)))
    return model_of(names, np.array(machines, np.float32).T if machines else np.zeros((DIMS + 1, 0), np.float32))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and values of what isn't zero."""
    for b in batches:
        kept = []
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if has_letter(text):
                x = features(text)
                places = np.flatnonzero(x)
                kept.append((lang, places.astype(np.uint16).tobytes(), x[places].tobytes()))
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), (pa.string(), pa.binary(), pa.binary()))], ["lang", "places", "values"])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(3)))]
    if not rows:
        return
    rows.sort()  # alike whatever the partitions' order
    x = np.zeros((len(rows), DIMS), np.float32)
    for k, (_, places, values) in enumerate(rows):
        x[k, np.frombuffer(places, np.uint16)] = np.frombuffer(values, np.float32)
    langs = [lang for lang, _, _ in rows]
    rows.clear()
    model = fit(x, langs)
    yield pa.RecordBatch.from_arrays([pa.array([model.langs], pa.list_(pa.string())), pa.array([model.weights.tobytes()], pa.binary())], ["langs", "weights"])


def sample(rows: DataFrame, sample_rows: int) -> DataFrame:
    """Up to an equal share of ``sample_rows`` for each language: the rows of the smallest hashes over the whole table,
    rows of equal identifier and text once. A bound from the languages' counts drops rows that can't be among them
    before any are moved or ordered. More languages than ``sample_rows`` are an error, not a cut."""
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(sample_rows + 1).collect()}
    if len(counts) > sample_rows:
        raise ValueError(f"over {sample_rows} languages; raise sample_rows, so that each has a row")
    if not counts:
        return rows.limit(0).select("lang", "text")
    share = max(1, sample_rows // len(counts))
    rate = F.lit(0.0)
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == lang, min(1.0, (2 * share + 50) / n)).otherwise(rate)
    hashed = rows.withColumn("h", F.pmod(F.xxhash64(F.lit(11), "id", "text"), F.lit(1 << 40))).where(F.col("h") < rate * F.lit(float(1 << 40)))
    first = Window.partitionBy("lang", "h").orderBy("id", "text")
    once = hashed.withColumn("copy", F.row_number().over(first)).where("copy = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= share).select("lang", "text")


def train(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on rows of ``docs`` where ``trains`` holds and the language isn't null, also those of null or repeated
    identifiers; repeated rows count once. None where no such row has a letter."""
    runtime.prepare(docs.sparkSession)
    rows = docs.where(trains).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).where("lang is not null")
    vectors = sample(rows, sample_rows).mapInArrow(_vectors, "lang string, places binary, values binary")
    got = vectors.repartition(1).mapInArrow(_fitted, "langs array<string>, weights binary").first()
    return model_of(list(got["langs"]), np.frombuffer(got["weights"], np.float32).reshape(DIMS + 1, -1)) if got else None


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score (0 to 1) of each row from its whole text alone. A text that is null or has no letter
    gives ``und`` and 0, as does a model of no languages. Of languages with equal votes the first by name is given.
    Repeated rows come out as often; an empty table gives no rows; other columns aren't read."""
    runtime.prepare(docs.sparkSession)
    rows = runtime.only(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(predictor(model), "id long, lang_pred string, score double")


def predictor(model: Model | None):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = predictions(model, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    return predict


def predictions(model: Model | None, texts: list) -> tuple[list[str], np.ndarray]:
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    told = [k for k, t in enumerate(texts) if model is not None and has_letter(t)]
    for at in range(0, len(told), 128):
        some = told[at : at + 128]
        found, sure = model.predict(np.stack([features(texts[k]) for k in some]))
        for k, lang, s in zip(some, found, sure):
            langs[k], scores[k] = lang, s
    return langs, scores


def accepted(docs: DataFrame, model: Model | None, least: float = 0.1, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all of their columns, whose language is told with a score of at least ``least``.
    Null texts, texts without a letter, and with no model all texts are rejected; repeated rows share a fate."""
    runtime.prepare(docs.sparkSession)
    place = docs.columns.index(text_col)

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = predictions(model, b.column(place).to_pylist())
            yield b.filter(pa.array([lang != UNKNOWN and s >= least for lang, s in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(accept, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """One identifier in five, by CRC-32 of its decimal text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 5 == 0
