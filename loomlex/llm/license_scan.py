"""License scans: exact phrases by words, and notices found in spite of small errors.

A notice with up to k edits, cut into k+1 pieces, holds at least one piece unchanged. One automaton looks for the
pieces of all notices; around each hit the regex library's bounded-error matching verifies the whole notice and
gives its span and its edits.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

#: Phrases of whole words and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Short notices: label, normalised words, most edits (insertions, deletions and substitutions of characters).
NOTICES = (
    ("mit", "released under the mit license", 2),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 4),
    ("apache", "licensed under the apache license version 2 0", 3),
    ("gpl", "licensed under the gnu general public license", 3),
    ("gpl", "gnu general public license version", 2),
    ("lgpl", "gnu lesser general public license", 3),
    ("bsd", "redistribution and use in source and binary forms", 3),
    ("mpl", "mozilla public license", 2),
    ("cc-by-nc", "licensed under cc by nc 4 0", 2),
    ("cc-by-sa", "licensed under cc by sa 4 0", 2),
    ("cc-by", "creative commons attribution", 2),
    ("proprietary", "all rights reserved", 1),
)

#: ASCII that isn't a letter or digit becomes a space, A-Z lower case; other bytes stay, so words of any script do too.
_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """edits+1 pieces of nearly equal length, each with its place in the notice."""
    n = edits + 1
    cuts = [len(notice) * k // n for k in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, notices=NOTICES):
        import ahocorasick
        import regex

        self.notices = [(label, text, edits, regex.compile(f"(?e)(?<![^ ])(?:{regex.escape(text)}){{e<={edits}}}(?![^ ])")) for label, text, edits in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, edits) in enumerate(notices):
            for at, piece in pieces(text, edits):
                seeds.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def find(self, line: str) -> list[tuple[str, int, int, int, int]]:
        """(label, start, end, edits, length of the notice) of notices in words joined by single spaces; overlapping finds of a notice count once."""
        windows: dict[int, list[list[int]]] = {}
        for last, (n, uses) in self.automaton.iter(line):
            for k, at in uses:
                _, text, edits, _ = self.notices[k]
                start = last + 1 - n - at
                # the notice may begin and end up to `edits` away, and a blank beyond shows the word's border
                a, b = max(0, start - edits - 1), start + len(text) + edits + 1
                spans = windows.setdefault(k, [])
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
        found = []
        for k, spans in windows.items():
            label, text, _, pattern = self.notices[k]
            spans.sort()
            for a, b in spans:
                for m in pattern.finditer(line, a, min(b, len(line))):
                    if (m.start() == 0 or line[m.start() - 1] == " ") and (m.end() == len(line) or line[m.end()] == " "):
                        found.append((label, m.start(), m.end(), sum(m.fuzzy_counts), len(text)))
        return sorted(set(found), key=lambda x: (x[1], x[2], x[0]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("byte_start", pa.int64()), ("byte_end", pa.int64()), ("edits", pa.int32())])
    phrases = [(tuple(p.split()), label) for p, label in PHRASES.items()]
    names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(span)]
    for b in batches:
        rows = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            flat = (text or "").encode().translate(_TABLE)
            words = flat.split()
            line = b" ".join(words).decode()
            starts, base = [], set()
            if "license" in line:
                for phrase, label in phrases:
                    first, rest = phrase[0].encode(), [w.encode() for w in phrase[1:]]
                    at = -1
                    if " ".join(phrase) in line:
                        while True:
                            try:
                                at = words.index(first, at + 1)
                            except ValueError:
                                break
                            if words[at + 1 : at + 1 + len(rest)] == rest:
                                starts.append(at)
                                base.add(label)
            spans, best = [], 1.0 if base else 0.0
            found = scanner.find(line)
            if found:
                places, at = [], 0
                for w in words:
                    at = flat.index(w, at)
                    places.append((at, at + len(w)))
                    at += len(w)
                begins = list(accumulate((len(w) + 1 for w in line.split(" ")), initial=0))
                for label, s, e, edits, size in found:
                    one, last = bisect_right(begins, s) - 1, bisect_left(begins, e) - 1
                    spans.append({"label": label, "first_word": one, "last_word": last, "byte_start": places[one][0], "byte_end": places[last][1], "edits": edits})
                    best = max(best, 1.0 - edits / size)
            labels = base | {s["label"] for s in spans}
            rows.append((doc, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best, spans))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, n_words, n_base (places of the exact phrases), first_word and last_word (their
    smallest and largest start, else null), base_labels, labels (with the notices'), score (1 for an exact find, less
    by the share of edited characters, 0 for none) and spans (label, words, UTF-8 byte range in the text, edits).

    Null and empty texts have no words and no labels; finds that tie in place are ordered by label; rows that occur
    twice come out twice; an empty table gives no rows; other columns are not read. Time is linear in a text's length
    and its finds.
    """
    runtime.prepare(docs.sparkSession)
    rows = runtime.only(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_scan, "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:bigint,last_word:bigint,byte_start:bigint,byte_end:bigint,edits:int>>")
