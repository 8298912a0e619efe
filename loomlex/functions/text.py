"""Text functions over concordance lines, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def detokenize(text: Column) -> Column:
    """Blanks before closing and after opening punctuation go."""
    return F.regexp_replace(F.regexp_replace(text, r"\s+([.,!?:;)\]])", "$1"), r"([(\[{])\s+", "$1")


def trim_left(context: Column) -> Column:
    """What follows the last end of a sentence."""
    return F.trim(F.regexp_replace(context, r"(?s)^.*[.!?]\s+(?=[A-Z]|$)", ""))


def trim_right(context: Column) -> Column:
    """Up to the first end of a sentence, that included."""
    found = F.regexp_extract(context, r"(?s)^(.*?[.!?])(?=\s+[A-Z]|\s*$)", 1)
    return F.trim(F.when(found != "", found).otherwise(context))


def sentence(left: Column, match: Column, right: Column) -> Column:
    """The sentence around a match, trimmed on both sides and joined by single blanks."""
    parts = F.filter(F.array(trim_left(left), F.trim(match), trim_right(right)), lambda x: x != "")
    return detokenize(F.array_join(parts, " "))


def nth_token(text: Column, n: int) -> Column:
    """The n-th token between blanks, from 1, or null."""
    return F.try_element_at(F.split(F.trim(text), r"\s+"), F.lit(n))


def xml_attribute_values(xml: Column, name: str) -> Column:
    return F.regexp_extract_all(xml, F.lit(rf'\b{name}="([^"]*)"'), F.lit(1))


def nth_lemma(xml: Column, n: int) -> Column:
    """The n-th lemma of a fragment, else its last one."""
    found = xml_attribute_values(xml, "lemma")
    return F.coalesce(F.try_element_at(found, F.lit(n)), F.try_element_at(found, F.lit(-1)))


def lemma_or_word(xml: Column) -> Column:
    """The last lemma of a fragment, or the last token of a text without any."""
    plain = F.try_element_at(F.split(F.trim(xml), r"\s+"), F.lit(-1))
    return F.lower(F.coalesce(F.try_element_at(xml_attribute_values(xml, "lemma"), F.lit(-1)), F.when(~xml.contains("<"), plain)))


def part_of_speech(xml: Column) -> Column:
    """xpos of a fragment's last token, else its upos, else ``unknown``."""
    last = lambda name: F.nullif(F.try_element_at(xml_attribute_values(xml, name), F.lit(-1)), F.lit(""))
    return F.coalesce(last("xpos"), last("upos"), F.lit("unknown"))


def plain_text(xml: Column) -> Column:
    """Words of a fragment joined by blanks; without words what is left when tags go."""
    words = F.regexp_extract_all(xml, F.lit(r"<w\b[^>]*>([^<]*)</w>"), F.lit(1))
    stripped = F.trim(F.regexp_replace(F.regexp_replace(xml, r"<[^>]*>", " "), r"\s+", " "))
    return detokenize(F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(stripped))


def inner_sentence(xml_left: Column, xml_right: Column) -> tuple[Column, Column]:
    """Fragments cut to the sentence: after the last opening mark, before the first closing one."""
    return F.regexp_replace(xml_left, r"(?s)^.*<s\b[^>]*>", ""), F.regexp_replace(xml_right, r"(?s)</s>.*$", "")


def csv_field(x: Column) -> Column:
    """RFC 4180: quoted where it holds a comma, a quote or a line end."""
    text = F.coalesce(x.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def xml_escape(x: Column) -> Column:
    out = F.coalesce(x.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
