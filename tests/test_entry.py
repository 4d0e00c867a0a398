"""The driver contract: entry() runs; a few registered queries equal their DuckDB oracle at sf0.001."""

import duckdb

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
KEYS = ["rule_email", "violations", "duplicate_reason", "report_order", "progress_snapshots", "import_summary",
        "job_transitions", "csv_scan"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(["line_number", "field", "value", "message"]).issubset(df.columns)


def test_keys_match_oracle(spark):
    con = duckdb.connect()
    for t in ["orders", "customer", "events", "pages", "documents", "conversations"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    for key in KEYS:
        df = qs[key](spark, SF)
        cols = sorted(df.columns)
        got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
        rel = con.execute(sqls[key])
        names = [d[0] for d in rel.description]
        exp = sorted(tuple(str(row[names.index(c)]) for c in cols) for row in rel.fetchall())
        assert got == exp, key
