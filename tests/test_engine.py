import json
import random

import pytest
from pyspark.sql import functions as F

from loomlex.functions import scoring
from loomlex.functions import text as T
from loomlex.operators import collocations as C
from loomlex.operators import concordance as K
from loomlex.operators import explore as E
from loomlex.operators import export as X
from loomlex.operators import radial
from loomlex.plans import bcql, catalogue, matching
from loomlex.sources import conllu, textprep
from loomlex.sources.corpus import Corpus, blocks_of, tokens_of
from loomlex.sources.grammar import GrammarError, english

SENTENCES = """# text = Good theories suggest new models .
1\tGood\tgood\tADJ\tJJ\t_\t2\tamod\t_\t_
2\ttheories\ttheory\tNOUN\tNNS\t_\t3\tnsubj\t_\t_
3\tsuggest\tsuggest\tVERB\tVBP\t_\t0\troot\t_\t_
4-5\tnewmodels\t_\t_\t_\t_\t_\t_\t_\t_
4\tnew\tnew\tADJ\tJJ\t_\t5\tamod\t_\t_
5\tmodels\tmodel\tNOUN\tNNS\t_\t3\tobj\t_\t_
5.1\tghost\t_\t_\t_\t_\t_\t_\t_\t_
6\t.\t.\tPUNCT\t.\t_\t3\tpunct\t_\t_

# text = The theory is good .
1\tThe\tthe\tDET\tDT\t_\t2\tdet\t_\t_
2\ttheory\ttheory\tNOUN\tNN\t_\t4\tnsubj\t_\t_
3\tis\tbe\tVERB\tVBZ\t_\t4\tcop\t_\t_
4\tgood\tgood\tADJ\tJJ\t_\t0\troot\t_\t_
5\this\the\tPRON\tPRP$\t_\t4\tdep\t_\t_


# text = Copyright by them
1\tNew\tnew\tADJ\tJJ\t_\t2\tamod\t_\t_
2\tTheory\tTheory\tNOUN\tNN\t_\t0\troot\t_\t_
broken line"""


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("conllu")
    (d / "a.conllu").write_text(SENTENCES)
    return Corpus.of(conllu.parse(conllu.read(spark, str(d))).persist())


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_files_of_one_name(spark, tmp_path):
    """Files are told apart by their paths, and one file's sentences are numbered in order though many tasks read it."""
    for k, name in enumerate("ab"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.conllu").write_text("\n\n".join(f"1\tw{k}_{n}\tw\tX\tX\t_\t0\troot\t_\t_" for n in range(300)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        records = conllu.read(spark, str(tmp_path / "*"))
        assert records.rdd.getNumPartitions() > 4
        rows = conllu.parse(records, sentences=100).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({r["doc_id"] for r in rows}) == 6 and len(rows) == 600
    whole = {}
    for r in rows:
        whole.setdefault(r["doc_id"] >> 20, []).append(((r["doc_id"] & 0xFFFFF) * 100 + r["sent_id"], r["word"]))
    assert sorted(sorted(x) for x in whole.values()) == [[(n, f"w{k}_{n}") for n in range(300)] for k in range(2)]


def test_heads_are_sought_first(spark):
    """Hits of given heads are those among all hits, also where heads' reaches leave gaps between them."""
    rng = random.Random(4)
    words = ["theory", "model", "good", "new", "is", "the", "of", ".", "quickly", "tests"]
    docs = spark.createDataFrame([(k, " ".join(rng.choice(words) for _ in range(80))) for k in range(20)], "doc_id long, text string")
    c = Corpus.of(tokens_of(docs).persist())
    patterns = {r.id: r.pattern for r in english().of_type("SURFACE")}
    every = matching.matches(c.tokens, patterns)
    some = matching.matches(c.tokens, patterns, heads=["Theory", "quickly"])
    columns = ("rel", "doc_id", "start", "end", "pos_1", "pos_2", "lemma_1")
    want = [x for x in got(every, *columns) if x[-1] in ("theory", "quickly")]
    assert want and got(some, *columns) == want


def test_conllu(spark, corpus, tmp_path):
    c = conllu.counters(corpus.tokens).first()
    assert (c["sentences"], c["tokens"]) == (3, 14)
    assert conllu.malformed(corpus.tokens).count() == 1 and corpus.frequency("THEORY") == 3 and corpus.frequency("none") == 0
    (tmp_path / "crlf.conllu").write_bytes(SENTENCES.replace("\n\n", "\n \n").replace("\n", "\r\n").encode())
    again = conllu.parse(conllu.read_whole(spark, str(tmp_path)))
    assert got(again, "pos", "sent_id", "word") == got(corpus.tokens, "pos", "sent_id", "word")
    assert conllu.parse(conllu.read(spark, str(tmp_path)).limit(0)).count() == 0
    assert conllu.parse(conllu.render(corpus.tokens)).count() == 14
    two = conllu.parse(conllu.read_whole(spark, str(tmp_path)), sentences=2)
    assert two.select("doc_id").distinct().count() == 2
    records = conllu.read_whole(spark, str(tmp_path))
    assert conllu.without_boilerplate(records, ("Copyright",)).count() == records.count() - 1
    assert "<s>" in conllu.marked(corpus.tokens).first()["value"]
    (tmp_path / "w").mkdir()
    (tmp_path / "w/t.txt").write_bytes(b"Old\tJJ\told\r\nman\tNN\tman\r\n\r\nruns\tVBZ\trun")
    tagged = conllu.parse_tagged(conllu.read_whole(spark, str(tmp_path / "w")))
    assert got(tagged, "word", "xpos", "lemma", "sent_id") == [("Old", "JJ", "old", 0), ("man", "NN", "man", 0), ("runs", "VBZ", "run", 1)]


def test_saved_corpus(spark, corpus, tmp_path):
    path = str(tmp_path / "index")
    assert corpus.save(path).frequency("theory") == 3
    assert corpus.append(corpus.tokens, path).frequency("theory") == 6
    Corpus.open(spark, path).views()
    assert spark.sql("SELECT count(*) AS n FROM tokens").first()["n"] == 28
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        Corpus.open(spark, str(tmp_path / "none"))


def test_scoring(spark):
    f = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    n = F.lit
    assert f(scoring.log_dice(n(100), n(100), n(100))) == 14.0
    assert f(scoring.log_dice(n(0), n(10), n(10))) == 0.0 == f(scoring.log_dice(n(-10), n(10), n(10)))
    assert f(scoring.log_dice(n(5), n(20), n(40))) == f(scoring.log_dice(n(5), n(40), n(20)))
    with pytest.raises(Exception, match="positive"):
        f(scoring.log_dice(n(1), n(0), n(1)))
    assert f(scoring.round2(n(1.005))) == 1.0 and f(scoring.round2(n(2.675))) == 2.68
    assert f(scoring.relative_frequency(n(1), n(0))) == 0.0 and f(scoring.coverage(n(1), n(4))) == 0.25
    assert f(scoring.log_dice_or_zero(n(1), n(3), n(None))) == 0.0


def test_collocates(corpus):
    g = english()
    rows = C.collocates(corpus, {"m": g["modifier"].pattern})
    assert got(rows, "head", "collocate", "freq", "pos") == [("model", "new", 1, "JJ"), ("theory", "good", 1, "JJ"), ("theory", "new", 1, "JJ")]
    assert got(C.by_dependency(corpus, "amod", ["theory"]), "collocate", "freq") == [("good", 1), ("new", 1)]
    assert got(C.by_dependency(corpus, "obj", head_tag="VB.*"), "head", "collocate") == [("suggest", "model")]
    assert got(C.following(corpus, '[xpos="PRP$"]'), "head", "collocate") == [("good", "he")]
    assert got(C.surface(corpus, g["predicate"].full_pattern("theory")), "collocate") == [("good",)]
    assert C.collocates(corpus, {"v": g["verb_nouns"].pattern}).count() == 0 and C.collocates(corpus, {"m": g["modifier"].pattern}, []).count() == 0
    for bad in ("x", "noun"):
        with pytest.raises(bcql.PatternError):
            C.following(corpus, bad)
    with pytest.raises(bcql.PatternError):
        C.sketch(corpus, g.of_type("DEP"), collocate_group="none")
    full = C.sketch(corpus, g.of_type("SURFACE"), ["theory"], collocate_group="adj")
    assert got(full, "rel", "collocate") == [("adj_nouns", "good"), ("adj_nouns", "new"), ("noun_adj_predicates", "good"), ("noun_modifiers", "good"), ("noun_modifiers", "new")]


def naive(tokens, forms):
    """Hits of a pattern's forms, token by token."""

    def holds(c, t):
        import re

        if isinstance(c, bcql.Attr):
            return re.fullmatch(c.regex, t[c.name], re.I) is not None
        if isinstance(c, bcql.Not):
            return not holds(c.part, t)
        return (all if isinstance(c, bcql.Both) else any)(holds(p, t) for p in c.parts)

    out = set()
    for doc in tokens.values():
        for at in range(len(doc)):
            for v in forms:
                if at + v.length <= len(doc) and all(holds(c, doc[at + d]) for d, c in v.places):
                    out.add((doc[at]["doc_id"], at, at + v.length, *(at + dict(v.labels)[k] if k in dict(v.labels) else None for k in "12")))
    return out


@pytest.mark.parametrize("text", ['1:[xpos="A"] []{0,2} 2:[xpos="B|C"]', '1:[lemma="x.*" & !(xpos="B")] 2:[xpos!="A"]?', '2:[xpos="C"] ~{-3,-1} 1:[lemma="y"]', '("x" | [xpos="B"] "y") 1:[]', '[xpos="A"]{2,3} 1:![xpos="A"]'])
def test_matching_equals_a_naive_matcher(spark, text):
    rng = random.Random(7)
    rows = [(d, p, p // 5, rng.choice(["x", "y", "xz"]), rng.choice("ABC")) for d in range(6) for p in range(rng.randint(1, 40))]
    docs = {}
    for d, p, s, lemma, tag in rows:
        docs.setdefault(d, []).append({"doc_id": d, "lemma": lemma, "xpos": tag})
    hits = matching.matches(spark.createDataFrame(rows, "doc_id long, pos int, sent_id int, lemma string, xpos string"), {"q": text})
    found = [tuple(r[c] for c in ("doc_id", "start", "end", "pos_1", "pos_2")) for r in hits.collect()]
    assert len(found) == len(set(found)) and set(found) == naive(docs, bcql.variants(bcql.parse(text)))


def test_exploration(spark):
    s = spark.createDataFrame([("theory", "important", 50, 9.0), ("theory", "recent", 20, 6.0), ("model", "important", 40, 8.0), ("model", "recent", 9, 5.0), ("hypothesis", "important", 7, 7.0), ("hypothesis", "large", 5, 4.0)], "seed string, collocate string, freq long, log_dice double")
    p = {r["collocate"]: r for r in E.profiles(s, 3).collect()}
    assert [p[c]["category"] for c in ("important", "recent", "large")] == ["fully_shared", "partially_shared", "specific"]
    assert [round(p[c]["distinctiveness"], 4) for c in ("important", "recent", "large")] == [0.8165, 2.5, 2.6667]
    assert p["important"]["commonality"] == 24 and p["important"]["strongest"] == "theory"
    m = E.multi_seed(s, 3, 2)
    assert got(m["common"], "collocate", "shared_by", "total_freq") == [("important", 3, 97), ("recent", 2, 29)]
    assert got(m["sources"], "seed", "shared_count") == [("hypothesis", 1), ("model", 2), ("theory", 2)]
    x = spark.createDataFrame([("important", "model", 8.5), ("important", "hypothesis", 6.0), ("novel", "model", 5.0)], "collocate string, noun string, log_dice double")
    seeds = spark.createDataFrame([("theory", "important", 5, 9.0), ("theory", "novel", 3, 7.0)], "seed string, collocate string, freq long, log_dice double")
    nouns = E.discovered_nouns(x, 1)
    assert got(nouns, "noun", "shared_count", "combined_score") == [("hypothesis", 1, 6.0), ("model", 2, 13.5)]
    assert got(E.core_collocates(x, nouns, seeds), "collocate", "shared_by", "seed_log_dice", "avg_log_dice") == [("important", 2, 9.0, 7.25)]
    assert E.exploration_edges(seeds, x, nouns).count() == 5 and E.seeds_of(" A, b,,a ") == ["a", "b"]
    assert E.specific_to(E.profiles(s, 3), "hypothesis").first()["collocate"] == "large"


def test_exploration_of_a_corpus(corpus):
    f = E.single_seed(corpus, english(), "modifier", "theory", min_shared=1, min_log_dice=0.0)
    assert got(f["seeds"], "collocate") == [("good",), ("new",)] and got(f["nouns"], "noun") == [("model",)]
    with pytest.raises(GrammarError):
        E.single_seed(corpus, english(), "wh_comp", "say")


def test_concordances(corpus):
    rows = K.concordance(corpus, '2:[xpos="JJ.*"] 1:[xpos="NN.*"]', 1, 1).collect()
    assert len(rows) == 1 and (rows[0]["match"], rows[0]["sentence"]) == ("new models", "Good theories suggest new models.")
    assert rows[0]["raw_xml"].startswith('<w lemma="good" upos="ADJ" xpos="JJ" deprel="amod">Good</w>')
    page = K.bcql_page(corpus, '"theory"', 2)
    assert (page["total"], page["page_size"]) == (3, 2) and K.bcql_page(corpus, '"theory"', 5, 9)["page_size"] == 5
    assert got(K.examples(corpus, english(), "theory", "good", "predicate"), "fallback") == [(False,)]
    assert got(K.examples(corpus, english(), "theory", "good", "none"), "fallback") == [(True,)]


def test_text_functions(spark):
    f = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    n = F.lit
    assert f(T.detokenize(n("a ( b ) , c ."))) == "a (b), c."
    assert f(T.trim_left(n("One . Two went"))) == "Two went" and f(T.trim_right(n("on . Then"))) == "on ."
    assert f(T.sentence(n("Old . The"), n("good theory"), n("holds . New"))) == "The good theory holds."
    xml = '<w lemma="a" xpos="DT">A</w><w lemma="b" xpos="NN">bs</w>'
    assert f(T.nth_lemma(n(xml), 1)) == "a" and f(T.nth_lemma(n(xml), 9)) == "b" and f(T.plain_text(n(xml))) == "A bs"
    assert f(T.part_of_speech(n(xml))) == "NN" and f(T.part_of_speech(n("x"))) == "unknown" and f(T.lemma_or_word(n("one Two"))) == "two"
    assert f(T.nth_token(n(" a b"), 2)) == "b" and f(T.csv_field(n('a"b,'))) == '"a""b,"' and f(T.xml_escape(n('<"&'))) == "&lt;&quot;&amp;"


def test_exports(spark, corpus, tmp_path):
    rows = C.collocates(corpus, {"noun_modifiers": english()["modifier"].pattern})
    text = X.document(X.sketch_csv(rows, 1), X.SKETCH_HEADER)
    assert text.splitlines()[0] == X.SKETCH_HEADER and len(text.splitlines()) == 3
    one = spark.createDataFrame([("a", 'x]]>y "q"')], "seed string, sentence string")
    assert X.document(X.xml_elements(one, "example", "sentence"), root="examples").count("CDATA") == 2
    assert X.examples_csv(one, "s", "c", "r").first()["value"] == 's,c,r,"x]]>y ""q"""'
    assert json.loads(X.page_json(total=1, rows=one))["rows"][0]["seed"] == "a"
    X.write_lines(X.as_json(one), str(tmp_path / "out"))
    assert X.format_of(None) == "json" and X.limit_of(" ", 5) == 5 and X.file_name("a/b c") == "a_b_c"
    for bad in (lambda: X.format_of("pdf"), lambda: X.limit_of("0", 1), lambda: radial.svg("x", one, 0, 1)):
        with pytest.raises(ValueError):
            bad()
    items = spark.createDataFrame([("a", 9.0), ("b<", -3.0)], "label string, score double")
    assert radial.svg("c", items, signed=True).count("<circle") == 2


def test_text_filters(spark, tmp_path):
    rows = spark.createDataFrame([("^Copyright x",), ("fine",), ("  ",), ("DOI: 1",)], "value string")
    assert got(textprep.filter_lines(rows, strip_caret=True), "value") == [("fine",)]
    assert tuple(textprep.filter_counts(rows).first()) == (2, 1)
    (tmp_path / "p").write_text("# note\n\nfine\n")
    assert textprep.load_prefixes(spark, str(tmp_path / "p")) == ("fine",)
    (tmp_path / "t").write_text("one\ntwo\n\nthree\n")
    assert got(textprep.read_paragraphs(spark, str(tmp_path / "t")), "value") == [("one two",), ("three",)]


def test_rule_tagger(spark):
    docs = spark.createDataFrame([(1, "The really good theory is formed. It 9 works"), (2, None), (3, "")], "doc_id long, text string")
    rows = {r["word"]: r for r in tokens_of(docs).collect()}
    assert [rows[w]["xpos"] for w in ("The", "really", "theory", "is", "formed", ".", "It", "works")] == ["DT", "RB", "NN", "VBZ", "VBD", ".", "PRP", "NNS"]
    assert rows["is"]["lemma"] == "be" and rows["It"]["sent_id"] == 1 and rows["theory"]["deprel"] == "nsubj" and rows["theory"]["head"] == "5"


def test_streaming(spark, tmp_path):
    from loomlex.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a").write_text(SENTENCES)
    q = ingest.into_corpus(ingest.records(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c1"))
    q.awaitTermination(120)
    assert Corpus.open(spark, str(tmp_path / "out")).frequency("theory") == 3
    q = ingest.running_frequencies(ingest.records(spark, str(tmp_path / "in")), str(tmp_path / "c2"), "running")
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT freq FROM running WHERE lemma_lc = 'theory'").first()["freq"] == 3


def test_entry_without_the_llm_folders():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert out.returncode == 0 and out.stdout.split() and min(map(int, out.stdout.split())) > 30, out.stderr


@pytest.mark.parametrize("pattern, hits", [('"a" "b"* "c"', 1), ('"b"+', 78), ('"b"{2,}', 66), ('"a" ("b" "b")+ "c"', 1), ('"a" []* "c" within <s/>', 1), ('"x"* "c"', 2)])
def test_open_repetition_is_not_cut(spark, pattern, hits):
    rows = [(1, k, 1, w, "X") for k, w in enumerate(["a", *["b"] * 12, "c"])] + [(2, k, 1, w, "X") for k, w in enumerate(["c", "a"])]
    tokens = spark.createDataFrame(rows, "doc_id long, pos int, sent_id int, lemma string, xpos string")
    assert matching.matches(tokens, {"q": pattern}).count() == hits


def test_open_repetition_over_the_bound_is_an_error(spark):
    tokens = spark.createDataFrame([(1, k, 1, "b", "X") for k in range(bcql.MAX_VARIANTS + 9)], "doc_id long, pos int, sent_id int, lemma string, xpos string")
    with pytest.raises(bcql.PatternError):
        matching.matches(tokens, {"q": '"b"*'})


def test_dependency_arrows(corpus):
    columns = ("start", "end", "lemma_1", "lemma_2")
    pairs = got(matching.dependency_pairs(corpus.tokens, "amod"), "lemma_1", "lemma_2")
    hits = matching.matches(corpus.tokens, {"q": "1:[] -amod-> 2:[]"})
    assert pairs and got(hits, "lemma_1", "lemma_2") == pairs
    assert got(matching.matches(corpus.tokens, {"q": "2:[] <amod 1:[]"}), *columns) == got(hits, *columns)
    assert got(matching.matches(corpus.tokens, {"q": '1:[lemma="suggest"] -obj-> 2:[]'}), *columns) == [(2, 5, "suggest", "model")]
    assert matching.matches(corpus.tokens, {"q": '[lemma="suggest"] -obj-> [lemma="theory"]'}).count() == 0
    both = matching.matches(corpus.tokens, {"q": '1:[lemma="suggest"] -obj-> _', "p": '1:[lemma="suggest"]'})
    assert got(both, "rel", "lemma_1") == [("p", "suggest"), ("q", "suggest")]
    assert K.count(corpus, "[] -amod-> []") == len(pairs)
    assert K.bcql_page(corpus, '1:[lemma="suggest"] -obj-> 2:[]')["total"] == 1
    with pytest.raises(bcql.PatternError):
        matching.matches(corpus.tokens, {"q": "[] -amod-> [] []"})


def test_two_places(spark):
    """As printf has them, also where a score ends in 5: the double's exact value decides, of ties the even digit."""
    scores = [8.125, 8.375, 8.005, 1.005, 2.675, 9.995, 13.235, 0.0, 14.0, 1234.565] + [k / 1e6 for k in range(5000, 14_000_000, 10_000 * 7)]
    rows = spark.createDataFrame([("r", f"h{k}", "c", 1, x) for k, x in enumerate(scores)], "rel string, head string, collocate string, freq long, log_dice double")
    lines = {r["line"] for r in X.sketch_lines(rows, 2).collect()}
    assert lines == {"r,h%d,c,1,%.2f" % (k, x) for k, x in enumerate(scores)}


def test_texts_are_not_shuffled(spark):
    """Hits in texts are made within their rows, and are those that a window over a table of tokens gives."""
    rng = random.Random(8)
    words = ["theory", "Model", "famous", "actual", "is", "the", "of", ".", "quickly", "tests", "?", "used", "and", "7", "it", "\u00c9t\u00e9s"]
    texts = [(k, " ".join(rng.choice(words) for _ in range(70))) for k in range(12)] + [(20, ""), (21, None), (22, "..."), (23, "theory")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    along = Corpus.of_texts(docs)
    beside = Corpus.of(along.tokens)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    patterns = {r.id: r.pattern for r in english().of_type("SURFACE")} | {r.id: r.pattern for r in english().of_type("DEP")}
    hits = matching.matches(along.tokens, patterns, docs=along.docs)
    assert "Exchange" not in plan(hits) and "Window" not in plan(hits)
    columns = hits.columns
    everything = sorted(got(hits, *columns), key=repr)
    assert everything == sorted(got(matching.matches(beside.tokens, patterns), *columns), key=repr) and len(everything) > 500
    chosen = english().of_type("SURFACE") + english().of_type("DEP")
    for more in ({}, {"heads": ["theory", "be"]}, {"scope": "sentence"}):
        a, b = (C.sketch(c, chosen, top=3, **more) for c in (along, beside))
        assert got(a, *a.columns) == got(b, *a.columns)


def test_seeds_are_found_once(spark):
    """The tables of a seed's field are made from rows that are kept, not from the corpus again for each."""
    docs = spark.createDataFrame([(0, "famous theory . famous model . actual theory . actual model . famous test . actual test .")], "doc_id long, text string")
    field = E.single_seed(Corpus.of_texts(docs), english(), "modifier", "theory", min_log_dice=0.0)
    assert field["seeds"].is_cached and field["expansion"].is_cached
    assert got(field["nouns"], "noun", "shared_count") == [("model", 2), ("test", 2)]
    assert got(field["core"], "collocate", "shared_by") == [("actual", 2), ("famous", 2)]


def test_blocks_equal_a_table_of_tokens(spark):
    """F8-F27: patterns along blocks find what a table of tokens gives, for words of all scripts; no token is shuffled."""
    rng = random.Random(9)
    words = ["theory", "Model", "famous", "actual", "is", "the", "of", ".", "quickly", "tests", "?", "used", "and", "7", "\u0663", "\u00c9t\u00e9s", "\u00e9t", "\u03a3\u039f\u03a6\u039f\u03a3", "\u0130s", "\U0001f600", "\U00010300\U00010301", "a-b", "\U0001f600x.y"]
    texts = [(k, " ".join(rng.choice(words) for _ in range(70))) for k in range(12)] + [(20, ""), (21, None), (22, "..."), (23, "theory")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    along, beside = Corpus.of_blocks(docs, blocks_of(docs, 150)), Corpus.of(tokens_of(docs).persist())
    assert along.blocks.count() > 3
    assert got(along.freq, "lemma_lc", "freq") == got(beside.freq, "lemma_lc", "freq")
    patterns = {"near": '1:[] ~{-1,1} 2:[xpos="JJ.*"]', "same": '1:[] [] 2:[] & 1.tag = 2.tag', "mixed": '1:[upos="NOUN" | word="is"] 2:[deprel!="_" & feats="_"]', "case": '1:[xpos="NN.*"] 2:[deprel="case"]'}
    for scope in ("doc", "sentence"):
        hits = matching.matches(along.tokens, patterns, scope, blocks=along.blocks)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan
        rows = [sorted((tuple(r[c] for c in hits.columns) for r in df.collect()), key=repr) for df in (hits, matching.matches(beside.tokens, patterns, scope))]
        assert rows[0] == rows[1] and len(rows[0]) > 100
    for tag in (None, "NN.*"):
        a, b = (matching.dependency_counts(c.tokens, "amod", tag, c.blocks) for c in (along, beside))
        assert got(a, *b.columns) == got(b, *b.columns) and len(a.take(1)) == 1


def test_conllu_along_blocks(spark):
    """records rendered along blocks are those of a table of tokens, and are parsed without a shuffle of tokens."""
    texts = ["The quick theory is sound. Models, an Übung und 東京 12 fail! ☃ Это она. 𝒜 a", "one", "", None, "... Great ideas quickly win", "tab\tand # mark 1-2 3.4 x"] * 4
    docs = spark.createDataFrame([(k if k else None, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    rows = lambda df: sorted((r["source"] or "", r["ord"], r["value"]) for r in df.collect())
    records, by_token = conllu.render_blocks(blocks_of(docs, 20)), conllu.render(tokens_of(docs))
    assert rows(records) == rows(by_token) and blocks_of(docs, 20).count() > 3
    found = conllu.counters_of(records)
    assert tuple(found.first()) == tuple(conllu.counters(conllu.parse(by_token.where("source is not null").unionByName(by_token.where("source is null").withColumn("source", F.lit("x"))))).first())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan and plan.count("Exchange") == 2
    assert tuple(conllu.counters_of(records.limit(0)).first()) == (0, 0, 0)
    odd = ["# text = x\n1-2\tab\n1\ta\tA\n\n2.1\tb\n  \n2\tb\tB\tX\tX\t_\t0\troot\t_\t_", "# no token", "", None, "word", "1\tonly", "İ\tx\tİ", "1\ta\ta"]
    odd = spark.createDataFrame([("f", k, v) for k, v in enumerate(odd)], "source string, ord bigint, value string")
    assert tuple(conllu.counters_of(odd).first()) == tuple(conllu.counters(conllu.parse(odd)).first())


def test_roundtrip_of_repeated_identifiers(spark, tmp_path):
    """rows of one identifier, or of none, are one document, as in the SQL."""
    docs = spark.createDataFrame([(1, "A b. C d"), (1, "E f. G. H i j k"), (2, "One. Two."), (None, "x. y"), (None, "z a b c")], "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalogue.ORACLES["conllu_roundtrip"]).fetchone()
    assert tuple(catalogue.QUERIES["conllu_roundtrip"](spark, str(tmp_path)).first()) == want
