"""Grammatical relations: the built-in catalogue, JSON files, their checks, and patterns built from them."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from loomlex.plans import bcql

# The relations of the English grammar, in its order. 1: marks the head and 2: the collocate.
COPULA = "be|appear|seem|look|sound|feel|smell|taste|remain|become|get|grow|turn|prove"
CATALOGUE = f"""
noun_adj_predicates | 1:[xpos="NN.*"] [lemma="{COPULA}"] 2:[xpos="JJ.*"]
noun_modifiers | 2:[xpos="JJ.*"] 1:[xpos="NN.*"]
subject_of | 1:[xpos="NN.*"] 2:[xpos="VB.*"]
object_of | 1:[xpos="VB.*"] 2:[xpos="NN.*"]
verb_subjects | 2:[xpos="NN.*"] []{{0,3}} 1:[xpos="VB.*"]
noun_verbs | 1:[xpos="NN.*"] []{{0,3}} 2:[xpos="VB.*"]
noun_compounds | 1:[xpos="NN.*"] 2:[xpos="NN.*"]
noun_prepositions | 1:[xpos="NN.*"] 2:[xpos="IN"]
noun_adverbs | 2:[xpos="RB.*"] 1:[xpos="NN.*"]
noun_possessives | 2:[xpos="NN.*"] [xpos="POS"] 1:[xpos="NN.*"]
predicate_of | 1:[xpos="NN.*"] [lemma="{COPULA}"] 2:[xpos="NN.*"]
pro_object | 2:[xpos="VB.*"] 1:[xpos="PRP"]
pro_subject | 2:[xpos="PRP"] 1:[xpos="VB.*"]
modifier_n | 2:[xpos="NN.*"] 1:[xpos="NN.*"]
modifier_j | 2:[xpos="RB.*"] 1:[xpos="JJ.*"]
modifier_v | 2:[xpos="RB.*"] 1:[xpos="VB.*"]
possessor | 2:[xpos="NN.*"] [xpos="POS"] 1:[xpos="NN.*"]
pro_possessor | 2:[xpos="PRP$"] 1:[xpos="NN.*"]
wh_comp | 1:[xpos="VB.*"] 2:[xpos="W.*"]
infincomp | 1:[xpos="VB.*"] [xpos="TO"] 2:[xpos="VB.*"]
ing_comp | 1:[xpos="VB.*"] 2:[xpos="VBG"]
passive | 1:[xpos="VBN"] [word="by"] 2:[xpos="NN.*"]
reflexive | 1:[xpos="VB.*"] 2:[xpos="PRP" & word=".*self|.*selves"]
it_cleft | 2:[word="it"] [xpos="VB.*"] 1:[xpos="JJ.*"]
prep_phrase | 1:[xpos="NN.*"] [xpos="IN"] 2:[xpos="NN.*"]
np_adj_comp | 1:[xpos="VB.*"] 2:[xpos="JJ.*"]
adj_comp | 1:[xpos="VB.*"] 2:[xpos="JJ.*"]
part_intrans | 1:[xpos="VB.*"] 2:[xpos="RP"]
part_trans | 1:[xpos="VB.*"] [xpos="NN.*"] 2:[xpos="RP"]
verb_nouns | 1:[xpos="NN.*"]
verb_particles | 1:[xpos="VB.*"] 2:[xpos="RP"]
verb_prepositions | 1:[xpos="VB.*"] 2:[xpos="IN"]
verb_adverbs | 2:[xpos="RB.*"] 1:[xpos="VB.*"]
verb_adjectives | 1:[xpos="VB.*"] 2:[xpos="JJ.*"]
verb_to | 1:[xpos="VB.*"] 2:[xpos="TO"]
verb_verbs | 1:[xpos="VB.*"] [xpos="TO"] 2:[xpos="VB.*"]
adj_nouns | 2:[xpos="JJ.*"] 1:[xpos="NN.*"]
adj_adverbs | 2:[xpos="RB.*"] 1:[xpos="JJ.*"]
adj_verbs | 1:[xpos="VB.*"] 2:[xpos="JJ.*"]
adj_prepositions | 1:[xpos="JJ.*"] 2:[xpos="IN"]
adj_coordinated | 1:[xpos="JJ.*"] [lemma="and|or"] 2:[xpos="JJ.*"]
dep_nsubj | 2:[xpos="NN.*" & deprel="nsubj"] 1:[xpos="VB.*"]
dep_nsubj_pass | 1:[xpos="VB.*"] 2:[xpos="NN.*" & deprel="nsubj:pass"]
dep_obj | 1:[xpos="VB.*"] 2:[xpos="NN.*" & deprel="obj"]
dep_iobj | 1:[xpos="VB.*"] 2:[xpos="NN.*|PRP" & deprel="iobj"]
dep_obl | 1:[xpos="VB.*"] 2:[xpos="NN.*" & deprel="obl"]
dep_obl_agent | 1:[xpos="VBN"] 2:[xpos="NN.*" & deprel="obl:agent"]
dep_amod | 1:[xpos="NN.*"] 2:[xpos="JJ.*" & deprel="amod"]
dep_case | 1:[xpos="NN.*"] 2:[xpos="IN" & deprel="case"]
dep_nmod | 1:[xpos="NN.*"] 2:[xpos="NN.*" & deprel="nmod"]
dep_nmod_poss | 1:[xpos="NN.*"] 2:[xpos="NN.*|PRP" & deprel="nmod:poss"]
dep_compound | 1:[xpos="NN.*"] 2:[xpos="NN.*" & deprel="compound"]
dep_appos | 1:[xpos="NN.*"] 2:[xpos="NN.*" & deprel="appos"]
dep_acl_relcl | 1:[xpos="NN.*"] 2:[xpos="VB.*" & deprel="acl:relcl"]
dep_acl | 1:[xpos="NN.*"] 2:[xpos="VB.*" & deprel="acl"]
dep_conj_n | 1:[xpos="NN.*"] 2:[xpos="NN.*" & deprel="conj"]
dep_conj_v | 1:[xpos="VB.*"] 2:[xpos="VB.*" & deprel="conj"]
dep_advmod | 1:[xpos="VB.*|JJ.*"] 2:[xpos="RB.*" & deprel="advmod"]
dep_aux | 1:[xpos="VB.*"] 2:[xpos="MD|VB.*" & deprel="aux"]
dep_aux_pass | 1:[xpos="VB.*"] 2:[xpos="VB.*" & deprel="aux:pass"]
dep_cop | 1:[xpos="NN.*|JJ.*"] 2:[xpos="VB.*" & deprel="cop"]
dep_mark | 1:[xpos="VB.*"] 2:[xpos="IN|TO" & deprel="mark"]
dep_ccomp | 1:[xpos="VB.*|JJ.*"] 2:[xpos="VB.*|JJ.*" & deprel="ccomp"]
dep_ccomp_adj | 1:[xpos="JJ.*"] 2:[xpos="VB.*|JJ.*" & deprel="ccomp"]
dep_xcomp | 1:[xpos="VB.*"] 2:[xpos="VB.*|JJ.*" & deprel="xcomp"]
dep_compound_prt | 1:[xpos="VB.*"] 2:[xpos="RP" & deprel="compound:prt"]
dep_flat | 1:[xpos="NNP"] 2:[xpos="NNP" & deprel="flat"]
dep_pred_adj | 1:[xpos="NN.*"] [xpos="VB.*" & deprel="cop"] 2:[xpos="JJ.*" & deprel="ccomp"]
dep_xcomp_pred_adj | 1:[xpos="VB.*"] 2:[xpos="JJ.*" & deprel="xcomp"]
"""
DUAL = {"verb_nouns"}
ALIASES = {
    "adj_modifier": "noun_modifiers",
    "modifier": "noun_modifiers",
    "adj_predicate": "noun_adj_predicates",
    "predicate": "noun_adj_predicates",
    "subject": "subject_of",
    "object": "object_of",
}
#: Groups of parts of speech: what their tags begin with, in the order in which they are tried.
GROUPS = {"adj": "JJ", "verb": "VB", "noun": "NN", "adv": "RB"}


class GrammarError(ValueError):
    """A grammar or relation breaks a rule."""


@dataclass(frozen=True)
class Relation:
    id: str
    pattern: str
    type: str = "SURFACE"
    name: str = ""
    description: str = ""
    head_position: int = 1
    collocate_position: int = 2
    dual: bool = False
    default_slop: int = 10

    @cached_property
    def parsed(self) -> bcql.Pattern:
        return bcql.parse(self.pattern)

    def group_at(self, place: int) -> str:
        tokens = bcql.split_tokens(self.pattern)
        text = tokens[place - 1].lower() if 1 <= place <= len(tokens) else ""
        return next((g for g, tag in GROUPS.items() if f'xpos="{tag.lower()}' in text), "other")

    @property
    def head_group(self) -> str:
        return self.group_at(self.head_position)

    @property
    def collocate_group(self) -> str:
        return self.group_at(self.collocate_position)

    @property
    def deprel(self) -> str | None:
        """Of a dependency relation: the one its pattern asks for, else its name without the prefix."""
        if self.type != "DEP":
            return None
        return bcql.attribute(self.pattern, "deprel") or self.id.removeprefix("dep_")

    def full_pattern(self, head: str | None, collocate: str | None = None, strict: bool = False) -> str:
        """The pattern with lemmas at the head's and the collocate's place; blank ones change nothing."""
        text = self.pattern
        for lemma, place in ((head, self.head_position), (collocate, self.collocate_position)):
            if lemma and lemma.strip():
                text = bcql.substitute(text, lemma.lower(), place, strict)
        return text

    def reverse_pattern(self) -> str:
        """A token of the collocates' part of speech."""
        if self.collocate_group == "other":
            raise GrammarError(f"{self.id}: its collocates are of no part of speech that can be searched")
        return f'[xpos="{GROUPS[self.collocate_group]}.*"]'


class Grammar:
    def __init__(self, relations: Iterable[Relation], version: str = "1"):
        self.relations, self.version = list(relations), version
        self._by_id = {r.id: r for r in self.relations}

    def __getitem__(self, name: str) -> Relation:
        found = self._by_id.get(resolve(name))
        if found is None:
            raise GrammarError(f"no relation {name!r}")
        return found

    def __contains__(self, name: str) -> bool:
        return resolve(name) in self._by_id

    def of_type(self, kind: str) -> list[Relation]:
        return [r for r in self.relations if r.type == kind.upper()]

    def best_collocate_pattern(self, group: str, fallback: str, *kinds: str) -> str:
        return next((r.reverse_pattern() for k in kinds or ("SURFACE",) for r in self.of_type(k) if r.collocate_group == group), fallback)

    def merged(self, other: "Grammar") -> "Grammar":
        """Both grammars' relations in their order; where both have one, the other's holds at the first's place."""
        found = {r.id: r for r in self.relations}
        found |= {r.id: r for r in other.relations}
        return Grammar(found.values(), other.version)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, r.id, r.type.lower(), r.pattern, r.head_position, r.collocate_position, r.head_group, r.collocate_group, r.dual, r.deprel) for k, r in enumerate(self.relations)]
        return spark.createDataFrame(rows, "ord int, id string, type string, pattern string, head_position int, collocate_position int, head_group string, collocate_group string, dual boolean, deprel string")


def resolve(name: str) -> str:
    """A short name's relation; others in lower case."""
    if name is None:
        raise GrammarError("a relation needs a name")
    return ALIASES.get(name.lower(), name.lower())


def checked(r: Relation, given: bool) -> Relation:
    """given: whether positions were stated, not derived; one that is missing then is an error."""
    tokens = bcql.split_tokens(r.pattern)
    if not tokens:
        raise GrammarError(f"{r.id}: no token in its pattern")
    for place in (r.head_position, r.collocate_position):
        if place < 1 or place > len(tokens) and not r.dual and given:
            raise GrammarError(f"{r.id}: position {place} is outside its pattern")
    bcql.variants(r.parsed)
    return r


def relation(id: str, pattern: str, **more) -> Relation:
    """A relation with the places of its labels, where they aren't given."""
    places, given = {}, bool(more.get("head_position") or more.get("collocate_position"))
    for k, key, default in ((1, "head_position", 1), (2, "collocate_position", 2)):
        at = bcql.label_index(pattern, k)
        places[key] = more.pop(key, None) or (at if at > 0 else default)
    return checked(Relation(id, pattern, **places, **more), given)


def english() -> Grammar:
    rows = [tuple(x.strip() for x in line.split(" | ", 1)) for line in CATALOGUE.strip().splitlines()]
    return Grammar(relation(i, p, type="DEP" if i.startswith("dep_") else "SURFACE", name=i.removeprefix("dep_").replace("_", " "), dual=i in DUAL) for i, p in rows)


def from_json(text: str) -> Grammar:
    """A grammar from JSON: it needs a version and relations of unique ids; old keys are refused."""
    try:
        data = json.loads(text)
    except ValueError as e:
        raise GrammarError(f"not JSON: {e}") from e
    if not data.get("version"):
        raise GrammarError("a grammar needs a version")
    if not data.get("relations"):
        raise GrammarError("a grammar needs relations")
    if "copulas" in data:
        raise GrammarError("copulas belong into the patterns")
    found: dict[str, Relation] = {}
    for x in data["relations"]:
        if "cql_pattern" in x:
            raise GrammarError("cql_pattern is now pattern")
        if not x.get("id") or not x.get("pattern"):
            raise GrammarError("a relation needs an id and a pattern")
        if x["id"] in found:
            raise GrammarError(f"{x['id']} occurs twice")
        found[x["id"]] = relation(x["id"], x["pattern"], type=(x.get("relation_type") or "SURFACE").upper(), name=x.get("name") or "", description=x.get("description") or "", head_position=x.get("head_position"), collocate_position=x.get("collocate_position"), dual=bool(x.get("dual", False)), default_slop=int(x.get("default_slop", 10)))
    return Grammar(found.values(), str(data["version"]))


def from_sketch_grammar(text: str) -> Grammar:
    """A grammar in the older text form: ``*DUAL``, ``*SYMMETRIC``, ``*UNARY``, ``*TRINARY``, ``*UNIMAP`` and
    ``*STRUCTLIMIT`` lines, ``=name`` (of a dual: ``=name/inverse``) and patterns, one a line. Macros, other
    directives and patterns outside the language are left out."""
    found: dict[str, Relation] = {}
    names, dual, sentence = ["rel"], False, False
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if line.startswith("*"):
            word = line[1:].split()[0].upper() if len(line) > 1 else ""
            sentence |= word == "STRUCTLIMIT"
            if word in ("DUAL", "SYMMETRIC", "UNARY", "TRINARY", "UNIMAP"):
                dual = word in ("DUAL", "SYMMETRIC")
        elif line.startswith("="):
            names = [n.strip() for n in line[1:].split("/")]
        elif line:
            k = sum(r.name == names[0] for r in found.values()) + 1
            id_ = f"{re.sub(r'[^0-9a-z]+', '_', names[0].lower()).strip('_')}_{k}"
            try:
                found[id_] = relation(id_, line + (" within <s/>" if sentence else ""), name=names[0], dual=dual)
            except (bcql.PatternError, GrammarError):
                continue
    return Grammar(found.values(), "legacy")


def validate_aliases(grammar: Grammar) -> None:
    missing = sorted({r for r in ALIASES.values() if r not in grammar})
    if missing:
        raise GrammarError(f"aliases of relations that the grammar lacks: {', '.join(missing)}")
