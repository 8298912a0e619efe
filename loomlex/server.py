"""The query surface over HTTP, for one machine: sketches, exploration, concordances, patterns and the radial plot."""

from __future__ import annotations

import json
from functools import reduce
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlex.operators import collocations as C
from loomlex.operators import concordance as K
from loomlex.operators import explore as E
from loomlex.operators import export as X
from loomlex.operators import radial
from loomlex.plans.bcql import PatternError
from loomlex.sources.corpus import Corpus
from loomlex.sources.grammar import Grammar, GrammarError, validate_aliases

MAX_PARAMETER, MAX_BODY = 200, 64 << 10


class TooLarge(ValueError):
    pass


class WrongMethod(ValueError):
    pass


class Unavailable(RuntimeError):
    """An exploration that failed for no fault of the request."""


class Service:
    """Routes and what they answer: (content type, text)."""

    def __init__(self, corpus: Corpus, grammar: Grammar):
        validate_aliases(grammar)
        self.corpus, self.grammar, self.spark = corpus, grammar, corpus.tokens.sparkSession

    def answer(self, method: str, target: str, body: bytes = b"") -> tuple[str, str]:
        url = urlsplit(target)
        p = dict(parse_qsl(url.query, keep_blank_values=True))
        if any(len(v) > MAX_PARAMETER for v in p.values()):
            raise ValueError(f"parameters are at most {MAX_PARAMETER} characters")
        if len(body) > MAX_BODY:
            raise TooLarge("the body is too large")
        path = [unquote(x) for x in url.path.strip("/").split("/")]
        posts = path in (["api", "bcql"], ["api", "visual", "radial"])
        if method != ("POST" if posts else "GET"):
            raise WrongMethod(method)
        data = json.loads(body or b"{}") if posts else {}
        match path:
            case ["health"]:
                return "application/json", json.dumps({"status": "ok"})
            case ["api", "relations"]:
                return self._table(self.grammar.table(self.spark).where("type = 'surface'"), "relations")
            case ["api", "relations", "dep"]:
                return self._table(self.grammar.table(self.spark).where("type = 'dep'"), "relations")
            case ["api", "sketch", lemma]:
                return self._sketch(lemma, self.grammar.of_type("SURFACE"), C.SKETCH_TOP, p)
            case ["api", "sketch", lemma, "dep"]:
                return self._sketch(lemma, [r for r in self.grammar.of_type("DEP") if r.deprel], C.SKETCH_TOP, p)
            case ["api", "sketch", lemma, "dep", name]:
                return self._sketch(lemma, [self._typed(name, "DEP")], C.RELATION_TOP, {**p, "pos": "", "head_pos": ""})
            case ["api", "sketch", lemma, name]:
                return self._sketch(lemma, [self._typed(name, "SURFACE")], C.RELATION_TOP, {**p, "pos": "", "head_pos": ""})
            case ["api", "semantic-field", "explore" | "explore-multi" | "compare" as kind]:
                try:
                    return {"explore": self._explore, "explore-multi": self._multi, "compare": self._compare}[kind](p)
                except Exception as e:
                    if status_of(e) == 500:
                        raise Unavailable(str(e)) from e
                    raise
            case ["api", "semantic-field", "examples"]:
                rows = K.examples(self.corpus, self.grammar, self._need(p, "seed"), self._need(p, "collocate"), self._need(p, "relation"), X.limit_of(p.get("top"), 10))
                return self._out(p, rows, "examples", X.examples_csv(rows, p["seed"], p["collocate"], p["relation"]), X.EXAMPLES_HEADER, X.xml_elements(rows.select("doc_id", "start", "end", "sentence"), "example", "sentence"))
            case ["api", "concordance", "examples"]:
                rows = K.examples(self.corpus, self.grammar, self._need(p, "word1"), self._need(p, "word2"), p.get("relation") or "", X.limit_of(p.get("limit"), 10), distinct=False)
                return self._table(rows, "examples")
            case ["api", "bcql"]:
                page = K.bcql_page(self.corpus, str(data.get("query", "")), int(data.get("top", 20)), int(data.get("offset", 0)))
                return "application/json", X.page_json(**page)
            case ["api", "visual", "radial"]:
                items = [(str(i["label"]), float(i["score"])) for i in data.get("items", [])[: radial.MOST_REQUESTED]]
                rows = self.spark.createDataFrame(items, "label string, score double")
                return "image/svg+xml", radial.svg(str(data.get("center", "")), rows, int(data.get("width", 560)), int(data.get("height", 560)), data.get("mode") == "signed")
        raise LookupError(url.path)

    @staticmethod
    def _need(p: dict, name: str) -> str:
        if not p.get(name, "").strip():
            raise ValueError(f"{name} is needed")
        return p[name].strip()

    def _typed(self, name: str, kind: str):
        r = self.grammar[name]
        if r.type != kind:
            raise ValueError(f"{name} is of type {r.type.lower()}")
        return r

    @staticmethod
    def _table(rows, name: str) -> tuple[str, str]:
        return "application/json", X.page_json(**{name: rows})

    @staticmethod
    def _out(p: dict, rows, name: str, csv, header: str, xml) -> tuple[str, str]:
        kind = X.format_of(p.get("format"))
        if kind == "csv":
            return "text/csv", X.document(csv, header)
        if kind == "xml":
            return "application/xml", X.document(xml, root=name)
        return "application/json", X.page_json(**{name: rows})

    def _sketch(self, lemma: str, relations, top: int, p: dict) -> tuple[str, str]:
        limit = X.limit_of(p.get("limit"), top)
        rows, warnings = self._sketched(lemma, relations, top, p)
        if X.format_of(p.get("format")) == "json":
            rows = rows.orderBy("ord", "rank")
            found = {r["rel"] for r in rows.select("rel").distinct().collect()}
            empty = [r.id for r in relations if r.id not in found]
            return "application/json", X.page_json(status="ok", sketch=rows, empty=empty, partial=bool(warnings), warnings=warnings)
        rows = rows.orderBy("ord", "rank")
        flat = X.limited(rows, limit, "rel", "head").select("rel", "head", "collocate", "pos", "freq", "log_dice")
        return self._out(p, rows, "sketch", X.sketch_csv(rows, limit), X.SKETCH_HEADER, X.xml_elements(flat, "collocate"))

    def _sketched(self, lemma: str, relations, top: int, p: dict):
        """All relations at once; where that fails, one by one, so that one that can't be matched costs its own rows
        alone and is told of."""
        make = lambda some: C.sketch(self.corpus, some, [lemma], p.get("pos") or None, p.get("head_pos") or None, top=top)
        try:
            return make(relations), []
        except PatternError:
            if len(relations) < 2:
                raise
        parts, warnings = [], []
        for k, r in enumerate(relations):
            try:
                parts.append(make([r]).withColumn("ord", F.lit(k)))
            except PatternError as e:
                if "parts of speech" not in str(e):
                    warnings.append(f"{r.id}: {e}")
        if not parts:
            raise PatternError("no relation can be matched")
        return reduce(DataFrame.unionByName, parts), warnings

    def _options(self, p: dict) -> tuple[int, int, float]:
        return X.limit_of(p.get("top"), E.EXPLORE_TOP), X.limit_of(p.get("min_shared"), E.MIN_SHARED), float(p.get("min_logdice") or E.MIN_LOG_DICE)

    def _explore(self, p: dict) -> tuple[str, str]:
        top, shared, least = self._options(p)
        f = E.single_seed(self.corpus, self.grammar, p.get("relation") or "adj_predicate", self._need(p, "seed").lower(), top, shared, least, X.limit_of(p.get("nouns_per"), E.NOUNS_PER))
        if X.format_of(p.get("format")) == "csv":
            return "text/csv", X.document(X.explore_csv(f["seeds"], f["core"], X.limit_of(p.get("limit"), 50)), X.EXPLORE_HEADER)
        if X.format_of(p.get("format")) == "xml":
            return "application/xml", X.document(X.explore_xml(f["seeds"], f["core"], X.limit_of(p.get("limit"), 50)), root="exploration")
        edges = E.exploration_edges(f["seeds"], f["expansion"], f["nouns"])
        return "application/json", X.page_json(seeds=f["seeds"], nouns=f["nouns"].orderBy(F.desc("combined_score")), core=f["core"].orderBy(F.desc("shared_by"), F.desc("avg_log_dice")), edges=edges)

    def _seeded(self, p: dict, fallback: bool):
        seeds = E.seeds_of(self._need(p, "seeds"))
        if len(seeds) < 2:
            raise ValueError("at least two seeds are needed")
        top, shared, least = self._options(p)
        r = self.grammar[p.get("relation") or "adj_predicate"]
        return seeds, shared, E.seed_collocates(self.corpus, r, seeds, top, least, fallback)

    def _multi(self, p: dict) -> tuple[str, str]:
        if p.get("nouns_per"):
            raise ValueError("nouns_per is for one seed")
        seeds, shared, rows = self._seeded(p, False)
        found = E.multi_seed(rows, len(seeds), shared)
        return "application/json", X.page_json(seeds=seeds, collocates=rows, **found)

    def _compare(self, p: dict) -> tuple[str, str]:
        seeds, _, rows = self._seeded(p, True)
        compared = E.profiles(rows, len(seeds)).orderBy(F.desc("commonality"), "collocate")
        if X.format_of(p.get("format")) == "csv":
            return "text/csv", X.document(X.comparison_csv(compared, X.limit_of(p.get("limit"), 50)), X.COMPARISON_HEADER)
        if X.format_of(p.get("format")) == "xml":
            return "application/xml", X.document(X.comparison_xml(compared, X.limit_of(p.get("limit"), 50)), root="comparison")
        return "application/json", X.page_json(seeds=seeds, collocates=compared, summary=E.summary(compared), edges=E.comparison_edges(rows))


def status_of(e: Exception) -> int:
    for kinds, code in ((TooLarge, 413), (WrongMethod, 405), (LookupError, 404), (Unavailable, 503)):
        if isinstance(e, kinds):
            return code
    return 400 if isinstance(e, (PatternError, GrammarError, ValueError, TypeError)) else 500


def serve(corpus: Corpus, grammar: Grammar, port: int) -> None:
    service = Service(corpus, grammar)

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            try:
                n = int(self.headers.get("Content-Length") or 0)
                kind, text = service.answer(self.command, self.path, self.rfile.read(min(n, MAX_BODY + 1)))
                code = 200
            except Exception as e:  # noqa: BLE001  every failure is an answer
                code, kind, text = status_of(e), "application/json", json.dumps({"error": str(e).splitlines()[0] if str(e) else type(e).__name__})
            body = text.encode()
            self.send_response(code)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.send_header("Access-Control-Allow-Origin", "*")
            self.end_headers()
            self.wfile.write(body)

        do_GET = do_POST = do_PUT = do_DELETE = _do

    ThreadingHTTPServer(("127.0.0.1", port), Handler).serve_forever()
