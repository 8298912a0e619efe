import hashlib

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from loomlex.llm import langid, mixing, near_dups

from .helpers import AWKWARD, table
from .test_operators import brute_components, lower


def test_stages(spark, tmp_path):
    """Each stage against brute force on its own input; what it keeps goes on."""
    rows = [(i, t, "en" if t else None, "ab"[k % 2]) for k, (i, t) in enumerate(AWKWARD)]
    rows += [(100 + k, f"some words of document {k} " + " ".join(f"v{(k * 31 + j) % 97}" for j in range(40)), "en", "a") for k in range(20)]
    rows += [(200, rows[-1][1] + " more", "en", "b"), (201, "le eau ment que de la", "fr", "b")]
    docs, before = table(spark, rows), None
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        before = docs.collect()
        docs = stage(spark, docs, str(tmp_path))
        after = docs.collect()
        if name != "tokens":
            assert docs.columns == columns
        if name == "language":
            assert sorted(str(r["doc_id"]) for r in after) == sorted(str(r["doc_id"]) for r in before if langid.has_letter(r["text"]))
        elif name == "exact_copies":
            groups = {}
            for r in before:
                groups.setdefault(lower(r["text"]), []).append(r["doc_id"])
            assert sorted(r["doc_id"] for r in after) == sorted(min(i for i in ids if i is not None) for ids in groups.values())
        elif name == "near_copies":
            found = brute_components([(r["doc_id"], r["text"]) for r in before], 5, 80)
            assert sorted(r["doc_id"] for r in after) == sorted(i for i, n, c in found if not n or i == c)
        elif name == "mixture":
            size = lambda rs: sum(len(lower(r["text"]).split()) for r in rs)
            assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before} and 0.5 * size(before) <= size(after) <= 1.5 * size(before)
        else:
            assert sorted((r["doc_id"], r["decoded_sha256"]) for r in after) == sorted((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in before)


def test_imports_are_direct():
    assert corpus_pipeline.STAGES and len(corpus_pipeline.STAGES) == 5 and mixing and near_dups


def test_near_copies_keeps_one_of_each_component(spark, tmp_path):
    """Unrelated texts without an identifier, and unlike texts of one identifier, are components of their own."""
    text = lambda k: " ".join(f"{'abcdefgh'[k]}{j}" for j in range(40))
    rows = [(None, text(0)), (None, text(1)), (None, text(1) + " more"), (7, text(2)), (7, text(3)), (7, text(3) + " more"), (None, text(4)), (9, text(4) + " more"), (8, text(4))]
    table(spark, rows).write.parquet(str(tmp_path / "docs"))
    after = corpus_pipeline.near_copies(spark, spark.read.parquet(str(tmp_path / "docs")), str(tmp_path)).collect()
    assert sorted(r["text"][0] for r in after) == ["a", "b", "c", "d", "e"]
    assert [(r["doc_id"], r["text"]) for r in after if r["text"][0] == "e"] == [(8, text(4))]


@pytest.mark.parametrize("stage", ["exact_copies", "near_copies", "mixture"])
def test_decisions_hold_when_files_are_divided_anew(spark, tmp_path, stage):
    """Between a stage's decisions and its last scan the files may be dealt to other tasks."""
    text = lambda k: " ".join(f"{'abcdefghij'[k]}{j}" for j in range(30))
    for k in range(10):
        table(spark, [(k, text(k), "en", "a"), (100 + k, text(k), "en", "a")]).coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    docs, run = spark.read.parquet(str(tmp_path / "docs")), dict(corpus_pipeline.STAGES)[stage]
    want = sorted(r["doc_id"] for r in run(spark, docs, str(tmp_path)).collect())
    assert stage == "mixture" or want == list(range(10))
    names = ("spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    try:
        spark.conf.set(names[0], "0")
        spark.conf.set(names[1], "1")
        later = run(spark, docs, str(tmp_path))
        spark.conf.set(names[0], str(1 << 30))
        assert sorted(r["doc_id"] for r in later.collect()) == want
    finally:
        for name in names:
            spark.conf.unset(name)


def test_stages_of_awkward_tables(spark, tmp_path):
    """Empty tables, and rows of nulls only, beside columns of the names that stages would use."""
    rows = table(spark, [(None, None), (None, None), (1, None), (2, "")])
    for k, docs in enumerate((rows.limit(0), rows)):
        docs.withColumn("loomlex_row", F.lit(5)).withColumn("LOOMLEX_ROW_", F.lit("x")).write.parquet(str(tmp_path / f"docs{k}"))
        docs = spark.read.parquet(str(tmp_path / f"docs{k}"))
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, str(tmp_path))
            n = {"language": 0, "exact_copies": 1, "near_copies": 4, "tokens": 4}.get(name)
            found = after.collect()
            assert len(found) == n * k if n is not None else len(found) <= 3 * 4 * k
            if name != "tokens":
                assert after.columns == docs.columns and all(r["loomlex_row"] == 5 for r in found)
