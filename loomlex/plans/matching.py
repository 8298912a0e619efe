"""Patterns as DataFrame plans. Every condition of every pattern becomes a bit of one mask for each token, and a form of
a pattern is a test of the bits of a token and of those that follow it. All patterns given together share one scan:
along blocks of documents or the arrays of each, or over a table of tokens with one shuffle and one window."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from loomlex import workers
from loomlex.sources.blocks import DEPRELS
from loomlex.sources.corpus import universal

from . import bcql, blockwise

_LITERAL = re.compile(r"[^.^$*+?{}\[\]\\()|]+")
#: Conditions that one mask holds.
BITS = 62


def regex_column(column: Column, regex: str) -> Column:
    """The whole annotation matches, whatever its case. ``^`` and ``$`` are plain characters, as tags have them.
    Alternatives of plain text are a list, and a plain start is a prefix: both can be pushed to the files."""
    lower = F.lower(column)
    parts = regex.lower().split("|")
    plain = [p.replace("$", "").replace("^", "") for p in parts]
    if all(_LITERAL.fullmatch(p) for p in plain):
        return lower == parts[0] if len(parts) == 1 else lower.isin(*parts)
    if len(parts) == 1 and parts[0].endswith(".*") and _LITERAL.fullmatch(parts[0][:-2]):
        return lower.startswith(parts[0][:-2])
    return column.rlike("(?i)^(?:" + re.sub(r"(?<!\\)([$^])", r"\\\1", regex) + ")$")


def condition_column(condition, columns: Mapping[str, Column]) -> Column:
    if isinstance(condition, bcql.Attr):
        if condition.name not in columns:
            raise bcql.PatternError(f"no annotation {condition.name!r}")
        return F.coalesce(regex_column(columns[condition.name], condition.regex), F.lit(False))
    if isinstance(condition, bcql.Not):
        return ~condition_column(condition.part, columns)
    parts = [condition_column(p, columns) for p in condition.parts]
    if isinstance(condition, bcql.Both):
        return reduce(lambda a, b: a & b, parts, F.lit(True))
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _flat(condition) -> list:
    """A conjunction's parts, so that patterns share what they have in common."""
    if isinstance(condition, bcql.Both):
        return [x for p in condition.parts for x in _flat(p)]
    return [condition]


def longest_runs(tokens: DataFrame, pattern: bcql.Pattern, scope: str) -> dict:
    """How often each open repetition of a pattern can follow on itself in a document, or in a sentence where hits
    stay in one: the longest run of tokens that a repeated token matches, and for groups the number of tokens."""
    parts = bcql.open_parts(pattern.root)
    if not parts:
        return {}
    keys = ["doc_id", "sent_id"] if scope == "sentence" or pattern.sentence else ["doc_id"]
    columns, order = {c: F.col(c) for c in tokens.columns}, Window.partitionBy(*keys).orderBy("pos")
    tests = [condition_column(p.condition, columns) if isinstance(p, bcql.Token) else F.lit(True) for p in parts]
    rows = tokens.select(*keys, "pos", *[t.alias(f"c{k}") for k, t in enumerate(tests)])
    longest = {}
    for k, part in enumerate(parts):
        runs = rows.select(*keys, f"c{k}", F.sum(F.when(F.col(f"c{k}"), 0).otherwise(1)).over(order).alias("run")).where(f"c{k}")
        longest[part] = runs.groupBy(*keys, "run").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("n")).first()["n"]
    return longest


def certain(test: Column) -> Column:
    """A test in whose place null is false. A plain one lets the optimiser test arrays for null at the scan, for which
    all are made again there."""
    return F.coalesce(test, F.lit(False))


def _names(condition) -> set[str]:
    """The annotations that a condition reads."""
    if isinstance(condition, bcql.Attr):
        return {condition.name}
    parts = [condition.part] if isinstance(condition, bcql.Not) else condition.parts
    return {n for p in parts for n in _names(p)}


#: Annotations that a word of a text alone decides, and those that are the same everywhere in texts.
BY_WORD, NOTHING = ("word", "lemma", "xpos", "upos"), ("feats", "deps", "misc")


class _Plan:
    """Patterns in forms, and rows in which a token has those that follow at hand: ``at(d, name)`` is an annotation of
    the d-th token from a row's first one. Where there are blocks these are looked along (``tests``), and where documents
    have arrays of annotations these; else a window over a document brings the following tokens beside each."""

    def __init__(self, tokens: DataFrame, parsed: Mapping[str, bcql.Pattern], scope: str, carry: tuple[str, ...], heads: list[str] | None, docs: DataFrame | None, blocks: DataFrame | None = None):
        self.parsed, self.scope = parsed, scope
        self.forms = {k: bcql.variants(p, longest_runs(tokens, p, scope)) for k, p in parsed.items()}
        self.bits: dict = {}
        for vs in self.forms.values():
            for v in vs:
                for _, c in v.places:
                    for part in _flat(c):
                        self.bits.setdefault(part, len(self.bits))
        self.heads = [h.lower() for h in heads] if heads is not None and "lemma" in carry and all("1" in dict(v.labels) for vs in self.forms.values() for v in vs) else None
        self.masks = -(-max(1, len(self.bits)) // BITS)
        self.most = max(v.length for vs in self.forms.values() for v in vs)
        self.kinds = dict(tokens.dtypes)
        agreeing = {a for p in parsed.values() for g in p.agreements for a in (g.left_name, g.right_name)}
        kept = list(dict.fromkeys([*carry, *sorted(agreeing)]))
        read = {n for c in self.bits for n in _names(c)}
        self.arrays = docs is not None and {*kept, *read} <= set(docs.columns) - {"doc_id"}
        self.tests = None
        if blocks is not None and set(kept) <= {*BY_WORD, *NOTHING} and read <= {*BY_WORD, *NOTHING, "deprel"}:
            self._in_blocks(blocks, kept, read)
        elif self.arrays:
            self._along(docs, kept, sorted(read))
        else:
            self._beside(tokens, kept)

    def _mask(self, k: int, columns: Mapping[str, Column]) -> Column:
        own = [(c, b % BITS) for c, b in self.bits.items() if b // BITS == k]
        return reduce(lambda a, b: a.bitwiseOR(b), [F.when(condition_column(c, columns), F.lit(1 << b)).otherwise(F.lit(0)).cast("long") for c, b in own], F.lit(0).cast("long"))

    def _in_blocks(self, blocks: DataFrame, kept: list[str], read: set[str]) -> None:
        by_deprel = "deprel" in read
        self.rows = _block_rows(blocks, kept, self.heads, [lambda columns, k=k: self._mask(k, columns) for k in range(self.masks)], read)
        shapes = []
        for i, (name, vs) in enumerate(self.forms.items()):
            same: dict = {}
            for v in vs:
                same.setdefault((v.length, v.labels), []).append(tuple((d, self.wanted(c)) for d, c in v.places))
            pattern = self.parsed[name]
            for (length, labels), forms in same.items():
                places = dict(labels)
                agreements = tuple((places[g.left], g.left_name, places[g.right], g.right_name, g.equal) for g in pattern.agreements)
                shapes.append(blockwise.Shape(i, length, labels, tuple(forms), self.scope == "sentence" or pattern.sentence, agreements))
        self.tests = blockwise.Tests(tuple(shapes), self.masks, by_deprel, self.heads is not None)

    def wanted(self, condition) -> tuple:
        """The bits that a condition wants: (mask, bits) for each mask of which it wants any."""
        want: dict = {}
        for part in dict.fromkeys(_flat(condition)):
            k, b = divmod(self.bits[part], BITS)
            want[k] = want.get(k, 0) | 1 << b
        return tuple(sorted(want.items()))

    def _along(self, docs: DataFrame, kept: list[str], read: list[str]) -> None:
        def masks(k: int) -> Column:
            if not read:
                return F.transform("lemma", lambda _: self._mask(k, {}))
            if len(read) == 1:
                return F.transform(read[0], lambda x: self._mask(k, {read[0]: x}))
            return F.transform(F.arrays_zip(*read), lambda x: self._mask(k, {n: x[n] for n in read}))

        rows = docs.select("doc_id", *dict.fromkeys(["lemma", "sent_id", *kept]), *[masks(k).alias(f"m{k}") for k in range(self.masks)])
        # an inner one would test the arrays' sizes at the scan, for which all are made again
        rows = rows.select("*", F.posexplode_outer("m0").alias("pos", "m0_0")).where("pos is not null")
        ahead = [F.get(F.col(f"m{k}"), F.col("pos") + d).alias(f"m{k}_{d}") for k in range(self.masks) for d in range(self.most) if (k, d) != (0, 0)]
        self.rows = rows.select("*", *ahead)

    def _beside(self, tokens: DataFrame, kept: list[str]) -> None:
        if self.heads is not None:
            reach = self.most - 1
            at = tokens.where(F.lower("lemma").isin(*self.heads)).select("doc_id", F.explode(F.sequence(F.col("pos") - reach, F.col("pos") + reach)).alias("pos"))
            tokens = tokens.join(at.distinct(), ["doc_id", "pos"], "left_semi")
        columns = {c: F.col(c) for c in tokens.columns}
        own = [f"m{k}" for k in range(self.masks)]
        flagged = tokens.select("doc_id", "pos", "sent_id", *kept, *[self._mask(k, columns).alias(f"m{k}") for k in range(self.masks)])
        order = Window.partitionBy("doc_id").orderBy("pos")
        item = F.struct("pos", "sent_id", *kept, *own)
        self.rows = flagged.select("doc_id", item.alias("t0"), *[F.lead(item, d).over(order).alias(f"t{d}") for d in range(1, self.most)])

    def sql(self, d: int, name: str) -> str:
        if not self.arrays:
            return f"t{d}.`{name}`"
        if name == "pos":
            return f"pos + {d}" if d else "pos"
        return f"{name}_{d}" if re.fullmatch(r"m\d+", name) else f"get(`{name}`, pos + {d})"

    def at(self, d: int, name: str) -> Column:
        return F.expr(self.sql(d, name))

    def shapes(self, name: str) -> list[tuple[int, dict[str, int], Column]]:
        """A pattern's forms of equal length and labels, which give the same hits, with the test of whether one of
        them fits."""
        same: dict = {}
        for v in self.forms[name]:
            same.setdefault((v.length, v.labels), []).append(v)
        return [(length, dict(labels), self._test(name, length, dict(labels), alike)) for (length, labels), alike in same.items()]

    def _test(self, name: str, length: int, places: dict[str, int], alike: list) -> Column:
        tests = []
        for v in alike:
            bits = [f"{self.sql(length - 1, 'm0')} is not null"]
            for d, c in v.places:
                for k in range(self.masks):
                    want = sum(1 << self.bits[part] % BITS for part in _flat(c) if self.bits[part] // BITS == k)
                    if want:
                        bits.append(f"({self.sql(d, f'm{k}')} & {want}L) = {want}L")
            tests.append("(" + " and ".join(bits) + ")")
        test = F.expr(" or ".join(tests))
        if self.scope == "sentence" or self.parsed[name].sentence:
            test &= self.at(0, "sent_id") == self.at(length - 1, "sent_id")
        if self.heads is not None:  # what stands between two heads' reaches is not there
            if not self.arrays:
                test &= self.at(length - 1, "pos") == self.at(0, "pos") + (length - 1)
            test &= F.lower(self.at(places["1"], "lemma")).isin(*self.heads)
        for g in self.parsed[name].agreements:
            a, b = (F.lower(self.at(places[x], n)) for x, n in ((g.left, g.left_name), (g.right, g.right_name)))
            test &= (a == b) if g.equal else (a != b)
        return test


def _block_rows(blocks: DataFrame, kept: list[str], heads: list[str] | None, masks: list, read: set[str]) -> DataFrame:
    """Blocks with what their distinct words have: annotations that are read, those in lower case as low_..., masks
    (for each relation, where they read it), and whether a word is one of the heads."""
    workers.ship(blocks.sparkSession)
    rows = blocks.withColumnRenamed("words", "word").withColumn("upos", F.transform("xpos", universal))
    for name in NOTHING:
        rows = rows.withColumn(name, F.transform("word", lambda _: F.lit("_")))
    by_deprel = "deprel" in read
    nothing = {name: F.lit("_") for name in NOTHING}
    found = {f"low_{n}": F.transform(n, lambda x: F.lower(x)) for n in dict.fromkeys(["lemma", *kept])}
    if heads is not None:
        found["own"] = F.transform("lemma", lambda x: F.lower(x).isin(*heads))

    def of_words(mask, columns: Mapping[str, Column]) -> Column:
        own = [n for n in BY_WORD if n in read] or ["word"]
        if len(own) == 1:
            return F.transform(own[0], lambda x: mask({own[0]: x} | columns))
        return F.transform(F.arrays_zip(*own), lambda x: mask({n: x[n] for n in own} | columns))

    for k, mask in enumerate(masks):
        found |= {f"m{k}_{v}": of_words(mask, nothing | {"deprel": F.lit(d)}) for v, d in enumerate(DEPRELS)} if by_deprel else {f"m{k}": of_words(mask, nothing)}
    return rows.select("ids", "sizes", "places", F.col("word").alias("words"), *dict.fromkeys(["xpos", *kept]), *[c.alias(n) for n, c in found.items()])


#: Forms whose hits are told apart in one expression; of more, each is a function of its own.
FEW_FORMS = 8


def matches(tokens: DataFrame, patterns: Mapping[str, bcql.Pattern | str], scope: str = "doc", carry: tuple[str, ...] = ("lemma", "xpos"), heads: list[str] | None = None, docs: DataFrame | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """Hits of all patterns: rel, doc_id, start, end (exclusive), and for the labels 1, 2 and 3 their position and
    ``carry``ed annotations (pos_1, lemma_1, xpos_1, ...), null where a pattern lacks the label. A hit that several
    forms of a pattern give counts once. scope: ``doc`` lets hits cross sentences, ``sentence`` doesn't. An open
    repetition reaches as far as the tokens go, for which they are read once more; a pattern that then has too many
    forms is a PatternError. A pattern of two tokens and an arrow between them gives the span from one to the other.
    heads: only hits whose token labelled 1 has one of these lemmas; where each form has that label, no more is read
    than the tokens that a form can reach from such a one. docs, blocks: the same tokens as arrays and in blocks, where there are such.
    """
    parsed = {k: bcql.parse(p) if isinstance(p, str) else p for k, p in patterns.items()}
    arrows = [arrow_matches(tokens, k, p, carry) for k, p in parsed.items() if bcql.arrow_of(p)]
    parsed = {k: p for k, p in parsed.items() if not bcql.arrow_of(p)}
    if not parsed and arrows:
        return reduce(DataFrame.unionByName, arrows)
    plan = _Plan(tokens, parsed, scope, carry, heads, docs, blocks)
    labels = ("1", "2", "3")
    if plan.tests:
        kind = dict(tokens.dtypes)["doc_id"]
        schema = [f"doc_id {kind}", "rel string", "start int", "end int", *[x for i in labels for x in (f"pos_{i} int", *[f"{c}_{i} string" for c in carry])]]
        find = blockwise.hit_finder(plan.tests, list(parsed), labels, carry, to_arrow_type(tokens.schema["doc_id"].dataType))
        return reduce(DataFrame.unionByName, arrows, plan.rows.mapInArrow(find, ", ".join(schema)))

    def hit(name: str, length: int, places: dict[str, int]) -> Column:
        fields = [F.lit(name).alias("rel"), plan.at(0, "pos").alias("start"), (plan.at(0, "pos") + length).alias("end")]
        for x in labels:
            for a in ("pos", *carry):
                fields.append((plan.at(places[x], a) if x in places else F.lit(None)).cast(plan.kinds[a]).alias(f"{a}_{x}"))
        return F.struct(*fields)

    shapes = [(name, *shape) for name in parsed for shape in plan.shapes(name)]
    if len(shapes) == 1:
        name, length, places, test = shapes[0]
        hits = plan.rows.where(certain(test)).select("doc_id", hit(name, length, places).alias("h"))
    else:
        found = F.array(*[F.when(test, hit(name, length, places)) for name, length, places, test in shapes])
        hits = plan.rows.select("doc_id", F.explode(found if len(shapes) <= FEW_FORMS else F.array_compact(found)).alias("h")).where("h is not null")
    return reduce(DataFrame.unionByName, arrows, hits.select("doc_id", "h.*"))


def pair_counts(tokens: DataFrame, patterns: Mapping[str, bcql.Pattern | str], scope: str = "doc", heads: list[str] | None = None, docs: DataFrame | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """rel, head, collocate, tag and n: how often hits of ``matches`` have these, those without both labels left out.
    Relations are bits of a mask until the pairs are counted: however many share a pair, it is one row. The rows are
    dealt by head."""
    parsed = {k: bcql.parse(p) if isinstance(p, str) else p for k, p in patterns.items()}
    names = list(parsed)
    if any(bcql.arrow_of(p) for p in parsed.values()):
        hits = matches(tokens, parsed, scope, heads=heads, docs=docs, blocks=blocks).where("lemma_1 is not null and lemma_2 is not null")
        return hits.groupBy("rel", F.lower("lemma_1").alias("head"), F.lower("lemma_2").alias("collocate"), F.col("xpos_2").alias("tag")).agg(F.count("*").alias("n"))
    plan = _Plan(tokens, parsed, scope, ("lemma", "xpos"), heads, docs, blocks)
    if plan.tests:
        return _named(plan.rows.mapInArrow(blockwise.pair_counter(plan.tests, BITS), blockwise.PAIRS), names)
    shapes: dict = {}
    for i, name in enumerate(names):
        for length, places, test in plan.shapes(name):
            if {"1", "2"} <= set(places):
                shapes.setdefault((i // BITS, length, tuple(sorted(places.items()))), []).append((i % BITS, test))
    rows = plan.rows
    for k, alike in enumerate(shapes.values()):
        rows = rows.withColumn(f"r{k}", reduce(lambda a, b: a.bitwiseOR(b), [F.when(test, F.lit(1 << b)).otherwise(F.lit(0)).cast("long") for b, test in alike]))

    def pair(k: int, part: int, places: dict[str, int]) -> Column:
        own = F.struct(F.lit(part).alias("part"), F.col(f"r{k}").alias("rels"), F.lower(plan.at(places["1"], "lemma")).alias("head"), F.lower(plan.at(places["2"], "lemma")).alias("collocate"), plan.at(places["2"], "xpos").alias("tag"))
        return F.when(F.col(f"r{k}") != 0, own)

    # a filter over the masks would go below them, with all tests of all forms once more
    found = [pair(k, part, dict(places)) for k, (part, _, places) in enumerate(shapes)]
    found = found or [F.lit(None).cast("struct<part:int,rels:bigint,head:string,collocate:string,tag:string>")]
    hits = rows.select(F.explode(F.array(*found)).alias("h")).select("h.*").where("rels <> 0 and head is not null and collocate is not null")
    return _named(hits.withColumn("n", F.lit(1)), names)


def _named(counted: DataFrame, names: list[str]) -> DataFrame:
    """Counted pairs (part, rels, head, collocate, tag, n), summed and dealt by head, with a row for each relation."""
    keys = ("part", "rels", "head", "collocate", "tag")
    counted = counted.groupBy(*keys).agg(F.sum("n").alias("n")).repartition("head")
    if len(names) == 1:
        return counted.select(F.lit(names[0]).alias("rel"), *keys[2:], "n")
    every = F.array(*[F.struct(F.lit(i // BITS).alias("part"), F.lit(1 << i % BITS).cast("long").alias("bit"), F.lit(name).alias("rel")) for i, name in enumerate(names)])
    own = F.filter(every, lambda r: (r["part"] == F.col("part")) & (r["bit"].bitwiseAND(F.col("rels")) != 0))
    return counted.select(F.explode(own).alias("r"), *keys[2:], "n").select("r.rel", *keys[2:], "n")


def dependency_counts(tokens: DataFrame, deprel: str, head_tag: str | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """rel, head, collocate, tag and n of ``dependency_pairs``, the relation being ``deprel``."""
    child, head = bcql.Attr("deprel", bcql.escape(deprel)), bcql.Attr("xpos", head_tag) if head_tag else None
    if blocks is None:
        hits = dependency_pairs(tokens, deprel)
        if head:
            hits = hits.where(regex_column(F.col("xpos_1"), head_tag))
        hits = hits.where("lemma_1 is not null and lemma_2 is not null")
        return hits.groupBy(F.lit(deprel).alias("rel"), F.lower("lemma_1").alias("head"), F.lower("lemma_2").alias("collocate"), F.col("xpos_2").alias("tag")).agg(F.count("*").alias("n"))

    def mask(columns: Mapping[str, Column]) -> Column:
        bits = [F.when(condition_column(c, columns), F.lit(1 << b)).otherwise(F.lit(0)) for b, c in enumerate((child, head)) if c]
        return reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long")

    rows = _block_rows(blocks, ["lemma", "xpos"], None, [mask], {"deprel", "xpos"})
    find = blockwise.dependency_counter(blockwise.Tests((), 1, True), ((0, 1),), ((0, 2),) if head else ())
    return _named(rows.mapInArrow(find, blockwise.PAIRS), [deprel])


def arrow_matches(tokens: DataFrame, name: str, pattern: bcql.Pattern, carry: tuple[str, ...] = ("lemma", "xpos")) -> DataFrame:
    """Hits of a pattern of two tokens with a dependency arrow between them, with the columns of ``matches``."""
    left, arrow, right = bcql.arrow_of(pattern)
    lacking = {"head", "deprel", "wordnum"} - set(tokens.columns)
    if lacking:
        raise bcql.PatternError(f"no annotation {min(lacking)!r}")
    columns = {c: F.col(c) for c in tokens.columns}
    agreeing = [a for g in pattern.agreements for a in (g.left_name, g.right_name)]
    kept = list(dict.fromkeys([*carry, *sorted(agreeing)]))
    flagged = tokens.withColumns({"is_left": condition_column(left.condition, columns), "is_right": condition_column(right.condition, columns)})
    pairs = dependency_pairs(flagged, arrow.relation, (*kept, "is_left", "is_right"))
    # dependency_pairs has heads under 1 and children under 2
    first, second = ("2", "1") if arrow.child_first else ("1", "2")
    pairs = pairs.where(f"is_left_{first} and is_right_{second}")
    places = {t.label: side for t, side in ((left, first), (right, second)) if t.label}
    for g in pattern.agreements:
        a, b = (F.lower(F.col(f"{n}_{places[x]}")) for x, n in ((g.left, g.left_name), (g.right, g.right_name)))
        pairs = pairs.where((a == b) if g.equal else (a != b))
    kinds = dict(tokens.dtypes)
    labelled = [(F.col(f"{a}_{places[x]}") if x in places else F.lit(None)).cast(kinds[a]).alias(f"{a}_{x}") for x in ("1", "2", "3") for a in ("pos", *carry)]
    return pairs.select("doc_id", F.lit(name).alias("rel"), F.least("pos_1", "pos_2").alias("start"), (F.greatest("pos_1", "pos_2") + 1).alias("end"), *labelled)


def dependency_pairs(tokens: DataFrame, deprel: str, carry: tuple[str, ...] = ("lemma", "xpos")) -> DataFrame:
    """Tokens and their heads in the same sentence, by the HEAD annotation: child and head positions and annotations."""
    child = tokens.where(regex_column(F.col("deprel"), bcql.escape(deprel))).select("doc_id", "sent_id", F.col("head").cast("int").alias("wordnum"), F.col("pos").alias("pos_2"), *[F.col(c).alias(f"{c}_2") for c in carry])
    head = tokens.select("doc_id", "sent_id", "wordnum", F.col("pos").alias("pos_1"), *[F.col(c).alias(f"{c}_1") for c in carry])
    return child.join(head, ["doc_id", "sent_id", "wordnum"])
