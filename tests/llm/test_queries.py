import hashlib
import random
import zlib

import pytest

from loomlex.llm import queries

from .helpers import AWKWARD, table
from .test_operators import brute_components, lower, speech

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of tables, its documents' texts and sources."""
    folder, rng = tmp_path_factory.mktemp("tables"), random.Random(12)
    rows = [(k, speech(rng, lang), lang, rng.choice(["a", "b", None])) for k in range(100, 220) for lang in [rng.choice(["en", "de", "fr", "es"])]]
    rows += [(i, t, None, "b") for i, t in AWKWARD if i not in (None, 2)] + [(300, rows[0][1] + " end", "en", "a"), (301, "word " * 1100, "en", "a")]
    table(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, k % 2, int(k % 5 == 0)) for k in range(100, 220)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), {i: t or "" for i, t, _, _ in rows}, {i: s for i, _, _, s in rows}


def rows_by_id(spark, tables, name):
    found = queries.QUERIES[name](spark, tables[0]).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(tables[1])
    return {r["doc_id"]: r for r in found}


def test_held_out(spark, tables):
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    for name, held in (("op1_lm_scoring", 1), ("op6_language_id", 0), ("op4_quality", 0)):
        got = rows_by_id(spark, tables, name)
        assert all(r["held_out"] == (fold(i) == held) for i, r in got.items()), name
        if name == "op6_language_id":
            assert all(0 <= r["score"] <= 1 and (r["lang_pred"] == "und") == (not any(map(str.isalpha, tables[1][i]))) for i, r in got.items())


def test_tokens(spark, tables):
    import tiktoken
    from tokenizers import Tokenizer

    from loomlex.llm.byte_bpe import read_ranks

    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for i, r in rows_by_id(spark, tables, "op3_token_counts").items():
        n = len(whole.encode(tables[1][i], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["over_limit"], r["n_bytes"]) == (n, n > 1024, len(tables[1][i].encode()))
    for i, r in rows_by_id(spark, tables, "op10_byte_bpe").items():
        ids = enc.encode_ordinary(tables[1][i])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tables[1][i].encode()).hexdigest())


def test_copies(spark, tables):
    best = {}
    for i, t in tables[1].items():
        best[lower(t)] = max(best.get(lower(t), i), i)
    assert all((r["keep_id"], r["kept"]) == (best[lower(tables[1][i])], i == best[lower(tables[1][i])]) for i, r in rows_by_id(spark, tables, "op7_exact_dedup").items())
    want = {i: (n, c, i == c) for i, n, c in brute_components(list(tables[1].items()), 4, 80)}
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in rows_by_id(spark, tables, "op9_minhash").items()} == want


def test_mixture_licenses_and_media(spark, tables):
    size = {}
    for i, t in tables[1].items():
        size[tables[2][i]] = size.get(tables[2][i], 0) + len(t.encode().split())
    for i, r in rows_by_id(spark, tables, "op5_source_mixing").items():
        assert (r["size"], r["source_size"]) == (len(tables[1][i].encode().split()), size[tables[2][i]]) and 0 <= r["taken"] <= 3 * r["size"]
    assert all(r["n_base"] == 0 and r["base_labels"] == "" and 0 <= r["score"] <= 1 for r in rows_by_id(spark, tables, "op2_license_scan").values())
    assert all(r["n_bytes"] == len(tables[1][i].encode()) and r["payload_bytes"] % 64 == 0 for i, r in rows_by_id(spark, tables, "op8_matroska").items())
