"""Patterns along blocks. Conditions are tested by the engine on a block's distinct words, and come as bits of masks;
forms are tests of these bits at the places of tokens, made for a block at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from loomlex.sources.blocks import DEPRELS, Along, rows_in

#: Rows of a batch of results.
RESULT_ROWS = 1 << 16
PAIRS = "part int, rels bigint, head string, collocate string, tag string, n bigint"


@dataclass(frozen=True)
class Shape:
    """Forms of one pattern of equal length and labels; ``forms`` has for each the wanted bits (mask, bits) by distance."""

    rel: int
    length: int
    places: tuple
    forms: tuple
    sentence: bool
    #: distance and annotation of one side and of the other, and whether they are to be equal
    agreements: tuple = ()


@dataclass(frozen=True)
class Tests:
    shapes: tuple
    masks: int
    #: whether masks are told apart by the token's relation
    by_deprel: bool
    #: whether the token labelled 1 has to be one of given heads
    heads: bool = False

    def token(self, a: Along, want: tuple) -> np.ndarray:
        """Of each token, whether it has the wanted bits."""

        def make():
            ok = None
            for k, bits in want:
                names = [f"m{k}_{v}" for v in range(len(DEPRELS))] if self.by_deprel else [f"m{k}"]
                mask = a.made(("mask", k), lambda names=names: np.concatenate([a.row[x].to_numpy(zero_copy_only=False) for x in names]))
                own = (mask & bits) == bits
                ok = own if ok is None else ok & own
            return ok[a.made("at", lambda: a.places + a.deprel * np.int32(a.words)) if self.by_deprel else a.places]

        return a.made(("token", want), make)

    def fits(self, a: Along, s: Shape) -> np.ndarray:
        """The first tokens of a shape's hits."""
        m = a.n - s.length + 1
        if m <= 0:
            return np.zeros(0, np.int64)
        found = None
        for form in s.forms:
            test = a.together(s.length, s.sentence).copy()
            for d, want in form:
                if want:
                    test &= self.token(a, want)[d : d + m]
            found = test if found is None else found | test
        places = dict(s.places)
        if self.heads:
            own = a.made("own", lambda: a.row["own"].to_numpy(zero_copy_only=False)[a.places])
            found &= own[places["1"] : places["1"] + m]
        at = np.flatnonzero(found)
        for d, x, e, y, equal in s.agreements:
            # one numbering for both, so that different annotations can agree
            both = a.made(("agree", x, y), lambda x=x, y=y: pa.concat_arrays([a.row[f"low_{x}"], a.row[f"low_{y}"]]).dictionary_encode().indices.to_numpy())
            at = at[(both[a.places[at + d]] == both[a.places[at + e] + a.words]) == equal]
        return at


def _numbers(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    found = values.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def counted(a: Along, groups: list) -> Iterator[pa.RecordBatch]:
    """Of groups (part, rels, heads' places, collocates' places): how often each part and rels have a head, a collocate
    and its tag."""
    if not groups:
        return
    kinds, kind_of = {}, []
    for part, rels, heads, _ in groups:
        values, back = np.unique(rels, return_inverse=True)
        kind_of.append(np.array([kinds.setdefault((part, int(v)), len(kinds)) for v in values], np.int64)[back])
    kind, head, coll = (np.concatenate(x) for x in (kind_of, [g[2] for g in groups], [g[3] for g in groups]))
    lemma, lemmas = _numbers(a.row["low_lemma"])
    tag, tags = _numbers(a.row["xpos"])
    # lemmas and tags number few enough for one key: a block's words are fewer than 2 to the 24th
    pair = lemma * len(tags) + tag
    values, pair = np.unique(pair, return_inverse=True)
    keys = np.sort((kind * len(lemmas) + lemma[a.places[head]]) * len(values) + pair[a.places[coll]])
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    n, keys = np.diff(np.append(first, len(keys))), keys[first]
    keys, own = np.divmod(keys, len(values))
    kind, head = np.divmod(keys, len(lemmas))
    parts, rels = (np.array(x) for x in zip(*kinds))
    for i in range(0, len(n), RESULT_ROWS):
        cut = slice(i, i + RESULT_ROWS)
        v = values[own[cut]]
        columns = [
            pa.array(parts[kind[cut]], pa.int32()), pa.array(rels[kind[cut]], pa.int64()), lemmas.take(pa.array(head[cut])),
            lemmas.take(pa.array(v // len(tags))), tags.take(pa.array(v % len(tags))), pa.array(n[cut], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["part", "rels", "head", "collocate", "tag", "n"])


def pair_counter(tests: Tests, bits: int):
    """A mapInArrow function from blocks to counted pairs; relations are bits of a mask, so many in each part."""
    alike: dict = {}
    for s in tests.shapes:
        if {"1", "2"} <= set(dict(s.places)):
            alike.setdefault((s.rel // bits, s.length, s.places), []).append(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a in rows_in(batches):
            groups = []
            for (part, _, places), shapes in alike.items():
                found = [(np.int64(1 << s.rel % bits), tests.fits(a, s)) for s in shapes]
                if len(found) == 1:
                    at, rels = found[0][1], np.full(len(found[0][1]), found[0][0])
                else:
                    mask = np.zeros(a.n, np.int64)
                    for bit, at in found:
                        mask[at] |= bit
                    at = np.flatnonzero(mask)
                    rels = mask[at]
                if len(at):
                    one, two = (dict(places)[x] for x in "12")
                    groups.append((part, rels, at + one, at + two))
            yield from counted(a, groups)

    return run


def dependency_counter(tests: Tests, child: tuple, head: tuple):
    """A mapInArrow function from blocks to counted pairs of heads and children, by the bits that each has to have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a in rows_in(batches):
            at = np.flatnonzero((a.step != 0) & tests.token(a, child))
            up = at + a.step[at]
            if head:
                own = tests.token(a, head)[up]
                at, up = at[own], up[own]
            if len(at):
                yield from counted(a, [(0, np.ones(len(at), np.int64), up, at)])

    return run


def hit_finder(tests: Tests, names: list[str], labels: tuple, carry: tuple, kind: pa.DataType):
    """A mapInArrow function from blocks to hits, as ``matching.matches`` has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a in rows_in(batches):
            for s in tests.shapes:
                found, places = tests.fits(a, s), dict(s.places)
                for i in range(0, len(found), RESULT_ROWS):
                    at = found[i : i + RESULT_ROWS]
                    doc = a.doc[at]
                    first = a.start[doc]
                    out = {"doc_id": a.row["ids"].take(pa.array(doc)), "rel": pa.array([names[s.rel]] * len(at), pa.string())}
                    out |= {"start": pa.array(at - first, pa.int32()), "end": pa.array(at - first + s.length, pa.int32())}
                    for x in labels:
                        d = places.get(x)
                        out[f"pos_{x}"] = pa.nulls(len(at), pa.int32()) if d is None else pa.array(at + d - first, pa.int32())
                        for c in carry:
                            out[f"{c}_{x}"] = pa.nulls(len(at), pa.string()) if d is None else a.row[c].take(pa.array(a.places[at + d]))
                    yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run
