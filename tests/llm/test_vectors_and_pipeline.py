"""Near-duplicate vectors, the registered queries and the pipeline."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from tidemark.llm import embedding_dedup, queries

TABLES = "documents embeddings pages benchmark labels conversations".split()


def vectors(n, seed, groups=12, size=15, d=24):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for g in range(groups):
        x[g * size : (g + 1) * size] = x[g * size] + 0.12 * rng.normal(size=(size, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def plain(x, ids, least=0.95):
    s = x @ x.T >= least
    np.fill_diagonal(s, False)
    comp = np.array(ids)
    while True:
        new = np.array([min([comp[i], *comp[s[i]]]) for i in range(len(ids))])
        if (new == comp).all():
            return {i: (int(s[k].sum()), int(comp[k])) for k, i in enumerate(ids)}
        comp = new


def test_links_equal_brute_force(spark):
    x = vectors(1500, 1)
    rows = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(rows).collect()}
    assert got == plain(x, list(range(1500)))


def test_graph_recall(monkeypatch):
    x = vectors(4000, 2, groups=40, size=30, d=32)
    graph = embedding_dedup.Graph(x)
    assert len(graph.layers) > 1
    ids, _ = graph.search(x[:300].astype(np.float32), 48)
    truth = np.argsort(-(x[:300] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids.tolist(), truth.tolist(), strict=True)]) >= 0.9
    q, n = graph.linked(x[:300], 0.95)
    found, want = set(zip(q.tolist(), n.tolist(), strict=True)), set(zip(*np.nonzero(x[:300] @ x.T >= 0.95), strict=True))
    assert len(want & found) >= 0.9 * len(want)


def test_very_long_vectors_and_a_settled_beam(spark):
    x = vectors(120, 5, groups=6, size=5, d=6000)
    rows = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    assert {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(rows).collect()} == plain(x, list(range(120)))
    graph = embedding_dedup.Graph(vectors(6000, 6, groups=60, size=40, d=32))
    graph.linked(graph.x[:8].astype(float), 0.95)
    assert embedding_dedup.BEAM <= graph.beam <= graph.n


def test_awkward_vectors(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(1, one), (2, [2.0, 0.0, 0.0]), (3, [1.0, 0.01, 0.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 0.0]), (8, [float("nan"), 0.0, 0.0]), (9, [float("inf"), 0.0, 0.0]), (10, [1.0, 0.0]), (None, one), (3, one)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, key string, rep int")
    got = {}
    for r in embedding_dedup.near_vectors(df).collect():
        got.setdefault(r.vec_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert {got[i][0].component_id for i in (1, 2, 3)} == {1} and got[1][0].n_links == 3
    assert all(got[i][0].n_links == 0 and got[i][0].kept for i in (4, 5, 6, 7, 8, 9, 10)) and got[None][0].component_id is None
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = queries.QUERIES[name](spark, small)
    got = df.collect()
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    order = [df.columns.index(c) for c in columns]
    assert sorted((tuple(r[i] for i in order) for r in got), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_reads_whole_tables(spark, small, name):
    got = queries.QUERIES[name](spark, small)
    table = "embeddings" if name.startswith("op3") else "documents"
    if name.split("_")[0] in ("op2", "op3", "op4", "op5", "op6", "op7", "op8"):
        assert got.count() == spark.read.parquet(f"{small}/{table}.parquet").count()
    assert name in __spark_entry__.queries()


def test_pipeline_stages_keep_columns_and_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet").first()
    planted = [(90_001, benchmark.text, "en", "src0", 0), (90_002, docs.where("length(text) > 600").orderBy("doc_id").first().text, "en", "src0", 0)]
    now = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    counts = [now.count()]
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, small).cache()
        counts.append(now.count())
        if name != "bpe":
            assert now.columns == docs.columns
    left = {r.doc_id for r in now.collect()}
    assert 90_001 not in left and 90_002 not in left and counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    assert now.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "bpe"] and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_of_awkward_tables(spark, small):
    """Null, empty, repeated and clashing rows and columns go through every filtering stage; so does an empty table."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    long = docs.where("length(text) > 600").orderBy("doc_id").first().text
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet").first().text
    rows = [(80_001, None, "k"), (80_002, "", "k"), (None, long, "k"), (None, benchmark, "k"), (80_003, "a short clean text", "k"), (80_003, "a short clean text", "k"), (80_003, "another clean text", "k"), (80_004, " \n", "k"), (80_005, "w" * 200_000, "k")]
    schema = "doc_id long, text string, node string, key string, row string, id string, a long, _spans string"
    odd = spark.createDataFrame([(i, t, "n", k, "r", "i", 1, "s") for i, t, k in rows], schema)
    now, none = odd, odd.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now, none = stage(spark, now, small), stage(spark, none, small)
        assert now.columns == none.columns == odd.columns and none.count() == 0
        now = now.cache()
    left = sorted((r.doc_id or 0, (r.text or "")[:12]) for r in now.collect())
    # of equal rows one is left, with or without an id; a row without an id that holds a benchmark item goes; wordless rows stay
    assert left == sorted([(80_001, ""), (80_002, ""), (0, long[:12]), (80_003, "a short clea"), (80_003, "another clea"), (80_004, " \n"), (80_005, "w" * 12)])
    last = corpus_pipeline.STAGES[-1][1](spark, now, small)
    assert last.count() == len(left) and corpus_pipeline.STAGES[-1][1](spark, none, small).count() == 0
