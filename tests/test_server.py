import json

import pytest

from loomlex.server import Service, status_of
from loomlex.sources.corpus import Corpus, tokens_of
from loomlex.sources.grammar import english


@pytest.fixture(scope="module")
def service(spark):
    text = "The final theory is good. A final model is real. The final theory of a real model. "
    docs = spark.createDataFrame([(k, text * 3) for k in range(3)], "doc_id long, text string")
    return Service(Corpus.of(tokens_of(docs).persist()), english())


def ask(service, target, method="GET", body=None):
    kind, text = service.answer(method, target, json.dumps(body).encode() if body else b"")
    return json.loads(text) if kind == "application/json" else text


def test_sketches(service):
    assert len(ask(service, "/api/relations")["relations"]) == 41 and len(ask(service, "/api/relations/dep")["relations"]) == 28
    rows = ask(service, "/api/sketch/theory/noun_modifiers")["sketch"]
    assert [r["collocate"] for r in rows] == ["final"]
    csv = ask(service, "/api/sketch/theory/noun_modifiers?format=csv&limit=1")
    assert csv.splitlines()[1].startswith("noun_modifiers,theory,final,JJ,18,")
    assert "<sketch>" in ask(service, "/api/sketch/theory/dep/dep_nsubj?format=xml")
    whole = ask(service, "/api/sketch/theory")
    assert not whole["partial"] and not whole["warnings"] and "noun_modifiers" not in whole["empty"] and whole["empty"]


def test_a_relation_that_fails_costs_its_own_rows(service, monkeypatch):
    from loomlex.operators import collocations as C
    from loomlex.plans.bcql import PatternError

    make = C.sketch

    def sometimes(corpus, relations, *args, **more):
        if any(r.id == "noun_modifiers" for r in relations):
            raise PatternError("too many forms")
        return make(corpus, relations, *args, **more)

    monkeypatch.setattr(C, "sketch", sometimes)
    some = [service.grammar[n] for n in ("noun_modifiers", "subject_of")]
    rows, warnings = service._sketched("theory", some, 20, {})
    assert warnings == ["noun_modifiers: too many forms"] and {r["rel"] for r in rows.collect()} <= {"subject_of"}


def test_exploration(service):
    found = ask(service, "/api/semantic-field/explore?seed=theory&relation=modifier&min_shared=1&min_logdice=0")
    assert [s["collocate"] for s in found["seeds"]] == ["final"] and [n["noun"] for n in found["nouns"]] == ["model"]
    both = ask(service, "/api/semantic-field/compare?seeds=theory,model&relation=modifier&min_logdice=0")
    assert {c["collocate"]: c["category"] for c in both["collocates"]} == {"final": "fully_shared", "real": "specific"}
    assert ask(service, "/api/semantic-field/explore-multi?seeds=theory,model&relation=modifier&min_logdice=0")["common"][0]["collocate"] == "final"


def test_exploration_as_xml(service):
    text = ask(service, "/api/semantic-field/explore?seed=theory&relation=modifier&min_shared=1&min_logdice=0&format=xml")
    assert "<exploration>" in text and '<seed_collocate word="final"' in text
    text = ask(service, "/api/semantic-field/compare?seeds=theory,model&relation=modifier&min_logdice=0&format=xml")
    assert "<comparison>" in text and 'word="final" category="fully_shared" present_in="2"' in text


def test_explorations_that_fail_are_unavailable(service, monkeypatch):
    monkeypatch.setattr(service, "_explore", lambda p: 1 / 0)
    with pytest.raises(Exception) as e:
        service.answer("GET", "/api/semantic-field/explore?seed=x")
    assert status_of(e.value) == 503


def test_concordances_and_plot(service):
    page = ask(service, "/api/bcql", "POST", {"query": '"theory"', "top": 2})
    assert page["total"] == 18 and len(page["results"]) == 2
    assert ask(service, "/api/semantic-field/examples?seed=theory&collocate=final&relation=modifier")["examples"]
    assert ask(service, "/api/concordance/examples?word1=theory&word2=good")["examples"][0]["fallback"] is True
    assert "<svg" in ask(service, "/api/visual/radial", "POST", {"center": "x", "items": [{"label": "a", "score": 3}]})


@pytest.mark.parametrize(
    "method, target, body, code",
    [
        ("GET", "/api/none", b"", 404),
        ("POST", "/api/relations", b"", 405),
        ("POST", "/api/bcql", b"x" * 70_000, 413),
        ("POST", "/api/bcql", b'{"query": "["}', 400),
        ("GET", "/api/sketch/x/dep_nsubj", b"", 400),
        ("GET", "/api/sketch/x/none", b"", 400),
        ("GET", "/api/semantic-field/compare?seeds=one", b"", 400),
        ("GET", "/api/semantic-field/explore-multi?seeds=one,two&nouns_per=3", b"", 400),
        ("GET", "/api/relations?x=" + "y" * 300, b"", 400),
    ],
)
def test_errors(service, method, target, body, code):
    with pytest.raises(Exception) as e:
        service.answer(method, target, body)
    assert status_of(e.value) == code
