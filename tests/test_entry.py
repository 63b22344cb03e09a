import importlib


def test_entry_and_registry(spark):
    m = importlib.import_module("__spark_entry__")
    df = m.entry(spark)
    assert df.columns == ["activity_new", "churn_pct", "n_companies"]
    assert 0 < df.count() <= 20
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) > 80


def test_oracle_sql_runs_in_duckdb():
    import duckdb
    from conftest import SF001
    m = importlib.import_module("__spark_entry__")
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "part", "events", "documents", "benchmark", "conversations", "labels", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    for name, sql in m.oracle_sql().items():
        con.execute(sql).fetchall()
