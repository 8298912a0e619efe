"""Near-duplicate detection by circulant MinHash, with every link confirmed on full shingle sets.

A document's shingles are hashed to a ring of positions. One permutation scatters the positions; a second one,
shifted by one step for each coordinate, gives all coordinates of the signature, so that a position's values are a
run of consecutive entries of one table. Signatures are cut into bands, and documents that share a band meet.

Documents of equal sets are one node from the start. Of the nodes that share a band with another, shingles that no
other such node has are counted: they bound every intersection from above, so that nodes that have too many of them,
and pairs that can't be similar, need no comparison. The rest are compared with the node of their band that has the
fewest, the one nearest to what they were copied from, and not with each other; links that hold join components, and
what is then outside its hub's component is compared with a second hub.

Nodes of a band that are still in different components are told apart by their differences from one node. If two sets
are similar and one of them isn't similar to that node, they share many of their differences from it: so a pair is
compared only if it shares one of the rarest differences of both, at places that leave enough for the rest (a prefix
filter, exact for every pair of a band). A group of near copies thus costs a few comparisons a member, and no link
between different components stays unchecked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime

#: 32 bands of 4 coordinates: a pair at a similarity of 0.8 shares none with a chance of 5 in 100 million.
BANDS, ROWS = 32, 4
#: Bands of the first round; what they join needn't be compared again in the second, nor in the third, which takes
#: second hubs.
FIRST_BANDS = 8
#: Positions of the ring.
RING_BITS = 22
SEED = 20240229
#: Word hashes that a worker holds before it starts anew; only speed depends on it.
HELD_WORDS = 1 << 20
#: Keys and identifiers of texts to compare that are broadcast, some 100 bytes each; more are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Members that one task compares with a copy of their hub, as long as there are at most so many hubs of more.
SPREAD, HEAVY = 128, 10_000

_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode().lower().split()


def shingle_set(words: list[bytes], size: int) -> set:
    """Distinct shingles; a shorter text is one shingle, an empty one has none."""
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size))))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Signer:
    """Sets, their keys and bands; its tables are made once for each worker."""

    def __init__(self, size: int, bands: int = BANDS, rows: int = ROWS, ring_bits: int = RING_BITS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.size, self.bands, self.rows, self.bits = size, bands, rows, ring_bits
        ring, k = 1 << ring_bits, bands * rows
        self.scatter = rng.permutation(ring).astype(np.int32)
        values = rng.permutation(ring).astype(np.int32)
        # entry p + j is what the second permutation, shifted by j, gives for position p
        self.runs = np.lib.stride_tricks.sliding_window_view(np.concatenate([values, values[:k]]), k)
        self.odd = rng.integers(1, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.names = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_MIX[0])
        self.held: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        held, new = self.held, xxhash.xxh3_64_intdigest
        if len(held) > HELD_WORDS:
            held.clear()
        out = []
        for w in words:
            h = held.get(w)
            if h is None:
                h = held[w] = new(w)
            out.append(h)
        return np.array(out, np.uint64)

    def shingles(self, words: list[bytes]) -> np.ndarray:
        h = self.hashes(words)
        n = min(len(h), self.size)
        if not n:
            return h
        s = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            s = _mixed(s * np.uint64(_MIX[1]) + h[k : len(h) - n + 1 + k])
        return np.unique(s)

    def sign(self, shingles: np.ndarray) -> np.ndarray:
        places = self.scatter[(shingles >> np.uint64(64 - self.bits)).astype(np.int64)]
        low = np.full(self.bands * self.rows, np.iinfo(np.int32).max, np.int32)
        for at in range(0, len(places), 2048):
            np.minimum(low, self.runs[places[at : at + 2048]].min(axis=0), out=low)
        return low

    def band_hashes(self, signature: np.ndarray) -> np.ndarray:
        parts = signature.astype(np.uint64).reshape(self.bands, self.rows)
        return _mixed(_mixed((parts * self.odd).sum(axis=1, dtype=np.uint64)) + self.names).view(np.int64)

    def key(self, shingles: np.ndarray) -> bytes:
        import xxhash

        return xxhash.xxh3_128_digest(shingles.tobytes())


def _signatures(size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(size)
        for b in batches:
            n, keys, bands = [], [], []
            for text in b.column(1).to_pylist():
                s = signer.shingles(words_of(text))
                n.append(len(s))
                keys.append(signer.key(s) if len(s) else None)
                bands.append(signer.band_hashes(signer.sign(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), b.column(2)], ["id", "n", "key", "bands", "row"])

    return sign


def _confirm(size: int, percent: int):
    """Rows ordered by hub and part, the hub's own text first. Full sets of words decide, not their hashes."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, set()
        for b in batches:
            a, c = [], []
            for this, _, member, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                mine = shingle_set(words_of(text), size)
                if member is None:
                    hub, own = this, mine
                elif this == hub:
                    shared = len(own & mine)
                    if 100 * shared >= percent * (len(own) + len(mine) - shared):
                        a.append(this)
                        c.append(member)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(c, pa.binary())], ["a", "b"])

    return confirm


def _with_key(size: int):
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(size, ring_bits=8)
        for b in batches:
            right = [k for k, (text, key) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())) if signer.key(signer.shingles(words_of(text))) == key]
            yield b.take(pa.array(right, pa.int64()))

    return keyed


def _keyed(size: int):
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(size, ring_bits=8)
        for b in batches:
            sets = (signer.shingles(words_of(text)) for text in b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([signer.key(x) if len(x) else None for x in sets], pa.binary())], ["text", "key"])

    return keyed


def _shingle_rows(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(size, ring_bits=8)
        for b in batches:
            for node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = signer.shingles(words_of(text)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), node)), pa.array(s)], ["node", "shingle"])

    return rows


def _differences(size: int):
    """Rows ordered as for ``_confirm``: hashes of the shingles that a member and its hub don't share."""

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, hub, own = Signer(size, ring_bits=8), None, np.zeros(0, np.uint64)
        for b in batches:
            rows = []
            for this, _, member, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                mine = signer.shingles(words_of(text))
                if member is None:
                    hub, own = this, mine
                elif this == hub:
                    rows.append((this, member, len(own), np.setxor1d(own, mine, assume_unique=True).view(np.int64)))
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["hub", "member", "hub_n", "others"])

    return differ


def _texts(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """text and key of the nodes in ``wanted`` (key, rep), once each. An identifier may occur with several texts: the
    key tells. Where it is that of several nodes, or null, its rows are joined by their keys."""
    small = wanted.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else lambda x: x
    by_key = wanted.groupBy("rep").agg(F.count("*").alias("c")).where("rep is null or c > 1").select("rep")
    plain = wanted.join(by_key, "rep", "left_anti") if not by_key.isEmpty() else wanted
    texts = docs.join(hint(plain), F.col("id") == F.col("rep")).select("text", "key").mapInArrow(_with_key(size), "text string, key binary")
    if plain is not wanted:
        odd = docs.join(hint(by_key), F.col("id").eqNullSafe(F.col("rep")), "left_semi").select("text").mapInArrow(_keyed(size), "text string, key binary")
        texts = texts.unionByName(odd.join(hint(wanted.select("key")), "key", "left_semi").select("text", "key"))
    return texts.dropDuplicates(["key"])


def candidates(nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Nodes that may have a link, with ``own``, how many of their shingles no other candidate has (or fewer, where
    hashes meet); and the candidates' texts by key."""
    bands = nodes.select("key", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band")
    some = runtime.materialise(bands.join(shared, "band").select("key").distinct().join(nodes, "key"), "candidates")
    texts = runtime.materialise(_texts(docs, some.select("key", "rep"), size).withColumn("node", F.monotonically_increasing_id()), "texts")
    rows = texts.select("node", "text").mapInArrow(_shingle_rows(size), "node long, shingle long")
    alone = rows.groupBy("shingle").agg(F.count("*").alias("c"), F.first("node").alias("node")).where("c = 1")
    own = texts.select("key", "node").join(alone.groupBy("node").agg(F.count("*").alias("own")), "node").select("key", "own")
    lively = some.join(own, "key", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    return runtime.materialise(lively.where(100 * (F.col("n") - F.col("own")) >= percent * F.col("n")), "lively"), texts.select("key", "text")


def _met(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (hub, member) of node keys with their texts, ordered: a hub's own text, then its members'. A hub of many
    members is copied, so that they're shared among tasks; by the bound on what is many there are at most HEAVY such."""
    spark = pairs.sparkSession
    most = max(SPREAD, pairs.count() // HEAVY)
    heavy = pairs.groupBy("hub").agg(F.ceil(F.count("*") / most).cast("int").alias("parts")).where("parts > 1")
    heavy = F.broadcast(runtime.materialise(heavy, "heavy"))
    parts = F.coalesce("parts", F.lit(1))
    hubs = pairs.select("hub").distinct().join(heavy, "hub", "left").select("hub", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    hubs = hubs.join(texts, F.col("hub") == F.col("key")).select("hub", "part", F.lit(None).cast("binary").alias("member"), "text")
    members = pairs.join(heavy, "hub", "left").select("hub", F.pmod(F.xxhash64("member"), parts).cast("int").alias("part"), "member")
    members = members.join(texts, F.col("member") == F.col("key")).select("hub", "part", "member", "text")
    return hubs.unionByName(members).repartition(runtime.shuffle_partitions(spark), "hub", "part").sortWithinPartitions("hub", "part", F.col("member").asc_nulls_first())


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs (hub, member) of node keys those that are similar, as (a, b)."""
    return runtime.materialise(_met(pairs, texts).mapInArrow(_confirm(size, percent), "a binary, b binary"), "links")


def components(links: DataFrame) -> DataFrame:
    """key and label, the least key of its component, of every key in ``links`` (a, b): least neighbouring labels and
    pointer jumping, until nothing changes. What is joined is read from files, so that a hub's many links, which have
    one key, are split among tasks by the engine's skew join; sums are made before they are shuffled."""
    edges = runtime.materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = runtime.materialise(edges.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("key")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("key") == F.col("a")).select("key", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        # only labels that have themselves gone to another lead further
        jump = labels.where("label <> key").select(F.col("key").alias("k"), F.col("label").alias("beyond"))
        new = lower.join(jump, F.col("label") == F.col("k"), "left").select("key", "was", F.least("label", F.coalesce("beyond", "label")).alias("label"))
        new = runtime.materialise(new, "labels")
        changed = new.where("label <> was").limit(1).count()
        labels = new.select("key", "label")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """id, row (what ``row_col`` holds, or null), n_shingles, component_id (the least identifier that links reach, the row's own included) and component (a key that
    tells components apart whatever their identifiers, null where a text has no shingle) of every row.

    Two documents are linked when 100 * intersection >= percent * union of their sets of ``size``-word shingles. A text
    of fewer words is one shingle; a null or empty one, or one of white space, has none and is linked with nothing.
    Rows that occur twice are alike and linked. A null identifier counts as none: its row takes the least identifier
    of its component, or null where there is none. Other columns aren't read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    runtime.prepare(spark)
    docs = runtime.rows_of(docs, id_col, text_col, row_col)
    signed = runtime.materialise(docs.mapInArrow(_signatures(size), "id long, n long, key binary, bands array<long>, row long"), "signed")
    nodes = signed.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = runtime.materialise(nodes, "nodes")

    lively, texts = candidates(nodes, docs, size, percent)
    labels = None
    for last, second in ((FIRST_BANDS, False), (BANDS, False), (BANDS, True)):
        rows = _banded(lively, labels, last)
        first = F.min(F.struct("own", "key", "label", "n"))
        hubs = runtime.materialise(rows.groupBy("band").agg(first.alias("h"), F.count("*").alias("c")).where("c > 1").select("band", "h"), "hubs")
        pairs = rows.join(hubs, "band").where(F.col("label") != F.col("h.label"))
        if second:
            rows = runtime.materialise(pairs.drop("h"), "rest")
            hubs = runtime.materialise(rows.groupBy("band").agg(first.alias("h"), F.count("*").alias("c")).where("c > 1").select("band", "h"), "hubs")
            pairs = rows.join(hubs, "band").where(F.col("label") != F.col("h.label"))
        pairs = pairs.where(_possible(F.col("n"), F.col("own"), F.col("h.n"), F.col("h.own"), percent))
        labels = _grown(pairs.select(F.col("h.key").alias("hub"), F.col("key").alias("member")), texts, size, percent, labels)
    # what is left in a band in different components
    labels = _grown(unlike(lively, labels, texts, size, percent), texts, size, percent, labels)

    classes = nodes.select("key", "rep")
    if labels is not None:
        joined = classes.join(labels, "key")
        least = runtime.materialise(joined.groupBy("label").agg(F.min("rep").alias("least")), "least")
        least = joined.join(least, "label").select("key", "label", "least")
        classes = classes.join(least, "key", "left").select("key", F.coalesce("label", "key").alias("component"), F.coalesce("least", "rep").alias("component_id"))
    else:
        classes = classes.select("key", F.col("key").alias("component"), F.col("rep").alias("component_id"))
    # written, as are others that are joined to hot keys: the engine splits those when both sides come from files
    classes = runtime.materialise(classes, "classes")
    component_id = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    return signed.select("id", "row", "n", "key").join(classes, "key", "left").select("id", "row", F.col("n").alias("n_shingles"), component_id, "component")


def _banded(nodes: DataFrame, labels: DataFrame | None, last: int) -> DataFrame:
    """band, key, n, own and label: a row for each node and band."""
    rows = nodes.select("key", "n", "own", F.slice("bands", 1, last).alias("bands"))
    rows = rows.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key")) if labels is not None else rows.withColumn("label", F.col("key"))
    return rows.select("key", "n", "own", "label", F.explode("bands").alias("band"))


def _possible(n: Column, own: Column, other_n: Column, other_own: Column, percent: int) -> Column:
    """Whether two sets can be similar: their intersection is at most what either shares with any other."""
    most = F.least(n - own, other_n - other_own)
    return 100 * most >= percent * (n + other_n - most)


def unlike(lively: DataFrame, labels: DataFrame | None, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (hub, member) in different components that share a band and may be similar, by their differences.

    Let a and b be similar sets, A and B their differences from a third one, h. Then |A & B| is at least
    (|A| + |B|) / 2 - (100 - p) / (200 + 2 p) * (|a| + |b|), and if b and h aren't similar, at least
    ((100 + p) |B| - (100 - p) (|h| + |b|)) / 200, which is above zero. Ordered alike, rarest first, the first common
    difference of the pair stands where as many are left in both.
    """
    below, above = 100 - percent, 100 + percent
    rows = _banded(lively, labels, BANDS)
    mixed = rows.groupBy("band").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.min(F.struct("own", "key")).alias("h")).where("least <> most").select("band", "h")
    rows = runtime.materialise(rows.join(runtime.materialise(mixed, "mixed"), "band"), "unlike")
    # one h for as many bands as possible: the least that any of a band's members has in one of its bands
    of_node = runtime.materialise(rows.groupBy("key").agg(F.min("h").alias("near")), "near")
    of_band = runtime.materialise(rows.join(of_node, "key").groupBy("band").agg(F.min("near.key").alias("hub")), "near")
    pairs = rows.join(of_band, "band").groupBy("hub", F.col("key").alias("member")).agg(F.first("label").alias("label"), F.first("n").alias("n"), F.first("own").alias("own"))
    pairs = runtime.materialise(pairs, "unlike")
    found = _met(pairs.select("hub", "member"), texts).mapInArrow(_differences(size), "hub binary, member binary, hub_n long, others array<long>")
    found = found.join(pairs, ["hub", "member"]).withColumn("d", F.size("others").cast("long"))
    found = runtime.materialise(found.withColumn("far", above * F.col("d") > below * (F.col("hub_n") + F.col("n"))), "differences")
    direct = found.where("not far and hub <> member").select("hub", "member")

    # differences that one member alone has come first in the order and match nothing
    each = found.select("hub", "member", F.explode("others").alias("x"))
    common = runtime.materialise(each.groupBy("hub", "x").agg(F.count("*").alias("c")).where("c > 1"), "common")
    ranked = each.join(common, ["hub", "x"]).groupBy("hub", "member").agg(F.array_sort(F.collect_list(F.struct("c", "x"))).alias("order"))
    ranked = ranked.join(found.drop("others"), ["hub", "member"])
    least = F.greatest(F.lit(1), F.ceil((above * F.col("d") - below * (F.col("hub_n") + F.col("n"))) / F.lit(200.0)))
    placed = ranked.withColumn("alone", F.col("d") - F.size("order")).withColumn("upto", F.greatest(F.lit(0), F.col("d") - least + 1 - F.col("alone")).cast("int"))
    placed = placed.select("hub", "member", "label", "n", "own", "d", "far", "alone", F.posexplode(F.slice("order", 1, F.col("upto"))).alias("place", "o"))
    placed = placed.select("hub", "member", "label", "n", "own", "d", "far", F.col("o.x").alias("x"), (F.col("d") - F.col("alone") - F.col("place")).alias("left"))
    placed = runtime.materialise(placed, "placed")
    other = placed.select("hub", "x", *[F.col(c).alias(f"other_{c}") for c in ("member", "label", "n", "own", "d", "far", "left")])
    enough = 2 * above * F.least("left", "other_left") >= above * (F.col("d") + F.col("other_d")) - below * (F.col("n") + F.col("other_n"))
    near = placed.join(other, ["hub", "x"]).where("label < other_label and (far or other_far)").where(enough)
    near = near.where(_possible(F.col("n"), F.col("own"), F.col("other_n"), F.col("other_own"), percent))
    return near.select(F.col("member").alias("hub"), F.col("other_member").alias("member")).unionByName(direct)


def _grown(pairs: DataFrame, texts: DataFrame, size: int, percent: int, labels: DataFrame | None) -> DataFrame | None:
    """Labels after the links among ``pairs``: components of what has a label, of which only those that a new link
    joins are found anew."""
    pairs = runtime.materialise(pairs.distinct(), "pairs")
    if pairs.isEmpty():
        return labels
    links = confirm(pairs, texts, size, percent)
    if labels is None:
        return components(links)
    sides = links.select("a", "b")
    for side in ("a", "b"):
        own = labels.select(F.col("key").alias(side), F.col("label").alias("of"))
        sides = sides.join(own, side, "left").withColumn(side, F.coalesce("of", side)).drop("of")
    sides = runtime.materialise(sides.where("a <> b"), "sides")
    if sides.isEmpty():
        return labels
    joined = components(sides)
    # a key without a label is its own
    moved = joined.select(F.col("key").alias("was"), F.col("label").alias("now"))
    fresh = joined.join(labels.select("key"), "key", "left_anti")
    return runtime.materialise(labels.join(moved, F.col("label") == F.col("was"), "left").select("key", F.coalesce("now", "label").alias("label")).unionByName(fresh), "labels")
