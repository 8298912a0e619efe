"""The split of byte-level BPE before its merges."""

from __future__ import annotations

import re
from collections.abc import Callable

#: The split of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space, letters and numbers up to U+024F, where all versions of Unicode agree; the standard library's
#: expressions, which don't know these classes by name, are twice as fast there.
SPACE, LETTER, NUMBER = "\t-\r \x85\xa0", "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
NARROW = rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def finder(pattern: str, odd: Callable[[str], list[str]] | None = None) -> Callable[[str], list[str]]:
    """All pieces of a text by ``pattern``; those of texts with characters above U+024F by ``odd``, if given."""
    import regex

    whole = odd or regex.compile(pattern).findall
    if pattern != PATTERN:
        return whole
    narrow, wide = re.compile(NARROW).findall, re.compile("[^\x00-ɏ]").search
    return lambda text: narrow(text) if wide(text) is None else whole(text)
