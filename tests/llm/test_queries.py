"""Queries against their SQL, and the pipeline against a plain version of its stages."""

import glob
import os
import random

import duckdb
import pytest

import corpus_pipeline
from gridwright.llm.queries import ORACLES, QUERIES, table

from . import brute
from .test_operators_text import edited

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def prose(seed, n):
    rng = random.Random(seed)
    return "\n".join(" ".join(f"w{rng.randrange(3000)}" for _ in range(min(12, n - i))) for i in range(0, n, 12))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, FOLDER)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(str([r[c] for c in names]) for r in df.collect()) == sorted(str(list(r)) for r in cursor.fetchall())


def test_token_counts_of_missing_and_repeated_ids(spark, tmp_path):
    rows = [(1, "a b"), (1, "a b"), (None, "a b"), (None, "c-d e"), (None, "c-d e"), (3, "f"), (None, None), (4, "")]
    docs = spark.createDataFrame([(*r, "s", "en") for r in rows], "doc_id bigint, text string, source string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cursor = con.execute(ORACLES["op4_token_counts"])
    names = [d[0] for d in cursor.description]
    got = QUERIES["op4_token_counts"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(cursor.fetchall())
    assert sorted(tuple(r)[2:] for r in got) == [("space_words@1", 3, 3), ("words@2", 1, 3)]


def test_all_operators_and_the_pipeline_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= names


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = [prose(i, 150) for i in range(12)]
    texts = base + [edited(base[2], 1, 60), base[3], "too short", None, "", " ".join(["again"] * 90), "&&& ".join(prose(77, 90).split())]
    texts += [prose(40, 80) + "\n" + base[5].split("\n", 1)[0] + "\n" + prose(41, 80), prose(42, 60) + " " + " ".join(base[0].split()[5:25])]
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("tables"))
    extra = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, extra).selectExpr("*", "'x' AS kept", "1 AS row", "2 AS node").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in (*range(14), 19, 20)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(base[0].split()[:40])), (2, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline_stage_by_stage(spark, folder):
    docs = table(spark, folder, "documents")
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)
    out = steps["quality rules"](spark, docs, folder).persist()
    assert out.columns == columns
    good = {r.doc_id for r in out.collect()}
    assert set(range(12)) <= good and not good & {14, 15, 16, 17, 18}
    kept = {i: t for i, t in kept.items() if i in good}

    out = steps["line dedup"](spark, out, folder).persist()
    assert out.columns == columns
    gone = brute.removed_lines(list(kept.items()))
    lines = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in kept.items()}
    kept = {i: t for i, t in lines.items() if t.split() or not gone[i]}
    assert {r.doc_id: r.text for r in out.collect()} == kept
    assert all(r.n_chars == len(r.text) for r in out.collect())

    out = steps["n-gram Jaccard join"](spark, out, folder).persist()
    assert out.columns == columns
    groups = brute.groups(list(kept.items()))
    kept = {i: t for i, t in kept.items() if groups[i][1] == i}
    assert {r.doc_id: r.text for r in out.collect()} == kept

    out = steps["benchmark decontamination"](spark, out, folder).persist()
    assert out.columns == columns
    items = [(r.item_id, r.text) for r in table(spark, folder, "benchmark").collect()]
    kept = {i: t for i, t in kept.items() if not brute.passage_hits(t, items)[1]}
    assert {r.doc_id: r.text for r in out.collect()} == kept and 0 not in kept

    pieces = steps["packing"](spark, out, folder).collect()
    assert {p.doc_id for p in pieces} == set(kept)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((p.doc_id, p.start, p.ids_crc32) for p in whole if p.start % 1024 == 0) == sorted((p.doc_id, p.start, p.ids_crc32) for p in pieces if p.start % 1024 == 0)
    assert {p.doc_id: p.doc_tokens for p in whole} == {p.doc_id: p.doc_tokens for p in pieces}


def test_short_lines_are_deduplicated(spark, tmp_path):
    rows = [(1, "Home\nfirst text"), (2, "Home\nAbout us"), (3, "about us\nhome\nlast text")]
    spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "length(text) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in QUERIES["op7_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: (2, 0), 2: (2, 1), 3: (3, 2)}
    docs = corpus_pipeline.line_stage(spark, table(spark, str(tmp_path), "documents"), str(tmp_path))
    assert {r.doc_id: r.text for r in docs.collect()} == {1: rows[0][1], 2: "About us", 3: "last text"}


def test_stages_on_empty_documents(spark, folder):
    docs = table(spark, folder, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.collect() == []
        assert name == "packing" or out.columns == docs.columns
