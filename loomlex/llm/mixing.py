"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Words flow from patterns to the
sources' quotas; each further pass over a pattern's words costs more than the one before, so repetition is spread as
thinly as the quotas allow. Documents are then chosen by seeded hash within each pattern: whole passes go to every
document, and what is left of a pass goes to the documents of the smallest hashes.

The flow runs on the driver over the aggregate, whose size is that of the source catalogue; ``MAX_ARCS`` bounds it
and a larger catalogue is an error, not a cut.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import runtime

#: Bound on pairs of a pattern and one of its sources that the driver takes.
MAX_ARCS = 1_000_000
#: Hash ranges of a pattern for distributed running sums, by the hash's top bits: coarse ones, and as many within one.
RANGE_BITS = 10
#: Words of a document, as ASCII white space divides them.
WORDS = r"[^\x20\x09-\x0D]+"


def water_fill(sizes: list[int], weights: list[int], total: int, most: int) -> list[Fraction]:
    """Shares of ``total`` by weight, none above ``most`` times its size; the excess goes to the others by weight."""
    targets, open_, left = [Fraction(0)] * len(sizes), [k for k in range(len(sizes)) if sizes[k] > 0], Fraction(total)
    while open_:
        weight = sum(weights[k] for k in open_)
        above = [k for k in open_ if left * weights[k] > weight * most * sizes[k]]
        if not above:
            for k in open_:
                targets[k] = left * weights[k] / weight
            break
        for k in above:
            targets[k] = Fraction(most * sizes[k])
            left -= targets[k]
        open_ = [k for k in open_ if k not in set(above)]
    return targets


class Flow:
    """Min-cost flow by successive shortest paths with potentials; whole capacities and non-negative costs."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = []  # to, capacity, cost; arc k ^ 1 goes back
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, capacity: int, cost: int) -> int:
        self.out[a].append(len(self.arcs))
        self.arcs.append([b, capacity, cost])
        self.out[b].append(len(self.arcs))
        self.arcs.append([a, 0, -cost])
        return len(self.arcs) - 2

    def run(self, source: int, sink: int) -> int:
        n, sent = len(self.out), 0
        potential = [0] * n
        while True:
            far, via = [None] * n, [-1] * n
            far[source], heap = 0, [(0, source)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > far[a]:
                    continue
                for k in self.out[a]:
                    b, capacity, cost = self.arcs[k]
                    if capacity and (far[b] is None or d + cost + potential[a] - potential[b] < far[b]):
                        far[b], via[b] = d + cost + potential[a] - potential[b], k
                        heapq.heappush(heap, (far[b], b))
            if far[sink] is None:
                return sent
            potential = [p + (f if f is not None else far[sink]) for p, f in zip(potential, far)]
            # augment along every shortest path at once: a blocking flow over arcs of no reduced cost
            seen_dead = [False] * n
            while True:
                path, on, a = [], {source}, source
                while a != sink:
                    k = next((k for k in self.out[a] if self.arcs[k][1] and not seen_dead[self.arcs[k][0]] and self.arcs[k][0] not in on and self.arcs[k][2] + potential[a] - potential[self.arcs[k][0]] == 0), None)
                    if k is None:
                        seen_dead[a] = True
                        if not path:
                            break
                        on.discard(a)
                        a = self.arcs[path.pop() ^ 1][0]
                    else:
                        path.append(k)
                        a = self.arcs[k][0]
                        on.add(a)
                if a != sink:
                    break
                step = min(self.arcs[k][1] for k in path)
                for k in path:
                    self.arcs[k][1] -= step
                    self.arcs[k ^ 1][1] += step
                sent += step


def route(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], most: int) -> list[list[int]]:
    """Words that each pattern gives to each of its sources. patterns: (members, words); a pass costs one more than
    the pass before, so total cost is convex in repetition."""
    p = len(patterns)
    flow = Flow(p + len(quotas) + 2)
    start, end = p + len(quotas), p + len(quotas) + 1
    for k, (_, words) in enumerate(patterns):
        for turn in range(most):
            flow.add(start, k, words, turn)
    links = [[flow.add(k, p + s, most * words, 0) for s in members] for k, (members, words) in enumerate(patterns)]
    for s, quota in enumerate(quotas):
        flow.add(p + s, end, quota, 0)
    flow.run(start, end)
    return [[flow.arcs[x ^ 1][1] for x in xs] for xs in links]


def _edges(held: DataFrame, place: Column, before: Column) -> DataFrame:
    """pattern, edge and before: the range where a pattern's rest ends, and the words in the ranges before it. Sums are
    made by range first, so that no window has more rows of a pattern than there are ranges."""
    totals = held.select("pattern", place.alias("edge"), "rest", before.alias("before"), "size").groupBy("pattern", "edge", "rest", "before").agg(F.sum("size").alias("words"))
    upto = F.col("before") + F.sum("words").over(Window.partitionBy("pattern").orderBy("edge"))
    ends = totals.withColumn("upto", upto).where("upto > rest and upto - words <= rest")
    return ends.select("pattern", "edge", (F.col("upto") - F.col("words")).alias("before"))


def mix(docs: DataFrame, members: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, most: int = 3, row_col: str | None = None) -> DataFrame:
    """Mix all of ``docs`` to target weights.

    members: an array of the sources a document belongs to; by default the one in ``source_col``. A document of no
    source (an empty array, or null) is never taken; an empty name and null are sources like others. Sources ordered by
    code point, null last, weigh 1, 2, 3, repeating, and share all words by weight; a source's target stops at ``most``
    times its words and what is above goes to the others by weight. Returns a row for each row of ``docs``: id, row
    (what ``row_col`` holds, else a number of its own), size (its words; null and empty texts have 0), source_size and
    target (of its sources, added up), copies (how often the mix takes it, at most ``most`` times) and taken (its words,
    repeats counted). Documents are taken whole, so the sum over a
    pattern differs from its flow by what one document of the best size leaves. Equal
    input gives equal results whatever its partitioning; rows alike in every respect share a fate only in number. An
    empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    runtime.prepare(spark)
    own = F.array(F.col(f"`{source_col}`").cast("string")) if members is None else F.array_sort(F.array_distinct(members.cast("array<string>")))
    row = F.col(f"`{row_col}`").cast("long") if row_col else F.monotonically_increasing_id()
    sized = docs.select(row.alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(own, F.array().cast("array<string>")).alias("members"), F.regexp_count(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.lit(WORDS)).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")).alias("hash"))
    sized = runtime.materialise(sized, "sizes")

    patterns = [(tuple(r["members"]), r["size"]) for r in sized.groupBy("members").agg(F.sum("size").alias("size")).limit(MAX_ARCS + 1).collect()]
    if sum(len(m) for m, _ in patterns) > MAX_ARCS or len(patterns) > MAX_ARCS:
        raise ValueError(f"over {MAX_ARCS} pairs of a pattern and a source; raise MAX_ARCS if the driver can hold them")
    order = lambda x: (x is None, (x or "").encode("utf-8"))
    patterns.sort(key=lambda p: [order(x) for x in p[0]])
    sources = sorted({s for m, _ in patterns for s in m}, key=order)
    place = {s: k for k, s in enumerate(sources)}
    sizes = [0] * len(sources)
    for m, words in patterns:
        for s in m:
            sizes[place[s]] += words
    targets = water_fill(sizes, [k % 3 + 1 for k in range(len(sources))], sum(w for _, w in patterns), most)
    routed = route([(tuple(place[s] for s in m), w) for m, w in patterns], [round(t) for t in targets], most)

    schema = "pattern int, members array<string>, source_size long, target double, passes long, rest long"
    rows = []
    for k, ((m, words), sent) in enumerate(zip(patterns, routed)):
        passes, rest = divmod(sum(sent), words) if words else (0, 0)
        rows.append((k, list(m), sum(sizes[place[s]] for s in m), float(sum(targets[place[s]] for s in m)), passes, rest))
    plan = spark.createDataFrame(rows, schema)
    held = sized.join(F.broadcast(plan) if len(rows) <= 10_000 else plan, "members").drop("members")
    held = held.withColumn("range", F.shiftrightunsigned("hash", 64 - 2 * RANGE_BITS).cast("int"))

    # running sums: over ranges from their totals, and row by row only in the range where the last pass ends
    small = len(rows) <= 10_000
    edges = _edges(held.where("rest > 0"), F.shiftright("range", RANGE_BITS), F.lit(0))
    within = held.join(F.broadcast(edges) if small else edges, "pattern").where(F.shiftright("range", RANGE_BITS) == F.col("edge"))
    edges = _edges(within.drop("edge"), F.col("range"), F.col("before"))
    held = held.join(F.broadcast(edges) if small else edges, "pattern", "left")
    at_edge = F.col("range") == F.col("edge")
    inner = Window.partitionBy("pattern").orderBy("hash", "id", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    border = held.where(at_edge).withColumn("more", F.sum("size").over(inner) + F.col("before") <= F.col("rest"))
    others = held.where(F.coalesce(~at_edge, F.lit(True))).withColumn("more", (F.col("rest") > 0) & F.coalesce(F.col("range") < F.col("edge"), F.lit(True)))
    columns = ["pattern", "id", "size", "source_size", "target", "passes", "rest", "more", "hash", "row"]
    chosen = runtime.materialise(border.select(*columns).unionByName(others.select(*columns)), "chosen")

    # what the last pass still lacks goes to the one document whose size comes nearest, if that is nearer than none
    gaps = chosen.where("rest > 0").groupBy("pattern").agg((F.first("rest") - F.sum(F.when(F.col("more"), F.col("size")).otherwise(0))).alias("gap"))
    near = chosen.where("rest > 0 and not more").join(F.broadcast(gaps) if small else gaps, "pattern").where("abs(size - gap) < gap")
    last = near.groupBy("pattern").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "hash", "id", "row")).alias("last")).select("pattern", F.col("last.row").alias("last"))
    final = chosen.join(F.broadcast(last) if small else last, "pattern", "left")
    turns = F.col("passes") + (F.col("more") | F.coalesce(F.col("row") == F.col("last"), F.lit(False))).cast("long")
    return final.select("id", "row", "size", "source_size", "target", turns.alias("copies"), (turns * F.col("size")).alias("taken"))
