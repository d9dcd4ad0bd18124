import os

import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def stages(spark, sf):
    import corpus_pipeline

    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf).cache()
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_keep_columns_and_take_effect(stages, spark, sf):
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert all(after.columns == columns for _, _, after in stages[:-1])
    counts = [before.count() for _, before, _ in stages] + [stages[-1][2].count()]
    assert counts[0] >= counts[1] > counts[2] > counts[3] and counts[4] == counts[5]


def test_each_stage_against_brute_force(stages, spark, sf):
    from .test_text_operators import brute_components, brute_contamination

    _, before, after = stages[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    groups = {c if n else ("empty", d) for d, n, c in brute_components(rows)}
    assert after.count() == len(groups) and {r.doc_id for r in after.collect()} == {g for g in groups if not isinstance(g, tuple)} | {g[1] for g in groups if isinstance(g, tuple)}
    _, before, after = stages[2]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {r.doc_id for r in after.collect()} == {r[0] for r in brute_contamination(rows, items) if not r[5]}


def test_toxic_and_junk_labels_go(stages, spark, sf):
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    _, before, after = stages[0]
    kept = {r.doc_id for r in after.collect()}
    good = [d for d, l in labels.items() if l == (1, 0)]
    assert sum(d in kept for d in good) > 0.9 * len(good)


def test_registered_queries():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", ["op5_poisson_mixing", "op7_winnowing"])
def test_sql_of_operators(name, spark, sf):
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(sf):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{t}'")
    want = c.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, sf).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    w, g = (x[columns].sort_values(columns).reset_index(drop=True) for x in (want, got))
    assert w.equals(g)


def test_stages_of_empty_tables_and_nulls(spark, tmp_path):
    """Every stage takes a table without rows, and one with nulls in every column."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    for rows in ([], [(None, None, None, None, None), (7, "", None, None, 0), (8, None, "en", "web", None)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, docs, sf)
            assert out.count() <= max(len(rows), 1) * 20, name


def test_workers_give_memory_back(spark, tmp_path, monkeypatch):
    import duochron.llm.common as C
    from duochron.llm.quality import select_good
    from duochron.llm.secrets import scan_secrets

    rows = [[1], [2]]
    given = []
    monkeypatch.setattr(C, "give_back", lambda: given.append(1))
    assert list(C.lean(lambda batches: (b * 2 for b in batches))(iter(rows))) == [[1, 1], [2, 2]] and given == [1]
    cut = C.lean(lambda batches: (b for b in batches))(iter(rows))
    next(cut)
    cut.close()
    assert given == [1, 1]
    # What the stages run in workers, all of it.
    met, kind = [], type(spark.range(1))
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **b: met.append(f) or real(self, f, *a, **b))
    docs = spark.createDataFrame([(1, "some words " * 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    select_good(docs, labels)
    scan_secrets(docs)
    assert len(met) == 3 and all(hasattr(f, "__wrapped__") for f in met)
