import pytest

from loomlex.plans import bcql
from loomlex.sources import grammar as G


@pytest.mark.parametrize(
    "text, forms",
    [
        ('1:[xpos="NN.*"] 2:[xpos="VB.*"]', 1),
        ('2:[xpos="NN.*"] []{0,3} 1:[xpos="VB.*"]', 4),
        ('"house"', 1),
        ("[]", 1),
        ('[word="a"]? [word="b"]+', 16),
        ('("a" | "b" "c"){1,2}', 6),
        ('[xpos="VB"] ~{-2,2} [lemma="x"]', 4),
        ('1:[tag="A" & (word!="b" | !(lemma="c"))] 2:![] & 1.tag = 2.tag within <s/>', 1),
    ],
)
def test_patterns(text, forms):
    assert len(bcql.variants(bcql.parse(text))) == forms


@pytest.mark.parametrize("text", ["", '[xpos="NN"', "[xpos=]", "%", '[xpos="a"] ]', '"a" & 1.tag'])
def test_errors(text):
    with pytest.raises(bcql.PatternError):
        bcql.variants(bcql.parse(text))


def test_guards():
    with pytest.raises(bcql.PatternError):
        bcql.parse("[]" * 21, guard=True)
    with pytest.raises(bcql.PatternError):
        bcql.parse('"' + "a" * 1030 + '"', guard=True)


def test_text_of_patterns():
    p = '2:[xpos="NN.*"] []{0,3} 1:[xpos="VB.*" & deprel="root"]'
    assert bcql.split_tokens(p) == ['[xpos="NN.*"]', "[]{0,3}", '[xpos="VB.*" & deprel="root"]']
    assert (bcql.label_index(p, 1), bcql.label_index(p, 2), bcql.label_index(p, 3)) == (3, 1, -1)
    assert bcql.substitute(p, "go", 3) == '2:[xpos="NN.*"] []{0,3} 1:[lemma="go" & xpos="VB.*"]'
    assert bcql.substitute(p, "go", 3, strict=True).endswith('1:[lemma="go" & xpos="VB.*" & deprel="root"]')
    assert bcql.headword(bcql.substitute(p, "go", 3)) == "go" and bcql.headword("[]") is None
    assert bcql.escape('a.b"c') == 'a\\.b\\"c'


def test_catalogue():
    g = G.english()
    G.validate_aliases(g)
    assert len(g.relations) == 69 and len(g.of_type("DEP")) == 28
    assert (g["noun_modifiers"].head_position, g["noun_modifiers"].collocate_position) == (2, 1)
    assert g["predicate"].id == "noun_adj_predicates" and g["dep_obl_agent"].deprel == "obl:agent"
    assert [g[r].collocate_group for r in ("noun_modifiers", "subject_of", "noun_adverbs", "wh_comp")] == ["adj", "verb", "adv", "other"]
    assert g["noun_modifiers"].full_pattern("theory", "good") == '2:[lemma="good" & xpos="JJ.*"] 1:[lemma="theory" & xpos="NN.*"]'
    assert g["noun_modifiers"].full_pattern(None, " ") == g["noun_modifiers"].pattern
    assert g["noun_modifiers"].reverse_pattern() == '[xpos="JJ.*"]'
    with pytest.raises(G.GrammarError):
        g["wh_comp"].reverse_pattern()
    assert g.best_collocate_pattern("noun", "x") == '[xpos="NN.*"]' and g.best_collocate_pattern("none", "x") == "x"


def test_json_grammar():
    ok = '{"version": "1", "relations": [{"id": "r", "pattern": "1:[xpos=\\"NN\\"] 2:[]"}]}'
    g = G.from_json(ok)
    assert g["R"].default_slop == 10 and g.version == "1"
    for bad in ("{", "{}", '{"version": "1"}', ok.replace('"version"', '"copulas": [], "version"'), ok.replace('"pattern"', '"cql_pattern": "x", "pattern"'), ok.replace("}]", '}, {"id": "r", "pattern": "[]"}]'), ok.replace('"id"', '"head_position": 5, "id"')):
        with pytest.raises(G.GrammarError):
            G.from_json(bad)
    merged = g.merged(G.from_json(ok.replace("NN", "VB").replace("}]", '}, {"id": "s", "pattern": "[]"}]')))
    assert [r.id for r in merged.relations] == ["r", "s"] and "VB" in merged["r"].pattern


def test_older_grammar():
    text = '*STRUCTLIMIT s\n*DUAL\n=object/object_of\n1:[tag="VB.*"] [tag="DT"]? 2:[tag="NN.*"]\n# note\n*UNARY\n=passive\n1:[tag="VBN"]\nnot a pattern ((\n'
    g = G.from_sketch_grammar(text)
    assert [(r.id, r.dual, r.parsed.sentence) for r in g.relations] == [("object_1", True, True), ("passive_1", False, True)]
