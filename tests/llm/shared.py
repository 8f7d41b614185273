"""Fixtures of this folder's tests."""
import duckdb
import pytest

#: Columns beside the contract's, some named like an operator's own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row long, key string"


@pytest.fixture(scope="session")
def docs(spark):
    """Rows (doc_id, text, source) to a documents table with extra columns."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, 2, 3, "k") for r in rows]
        return spark.createDataFrame(full, SCHEMA)
    return make


@pytest.fixture(scope="session")
def duck():
    def run(sql, **tables):
        con = duckdb.connect()
        for name, df in tables.items():
            con.register(name, df.toPandas())
        res = con.execute(sql)
        return [d[0] for d in res.description], res.fetchall()
    return run
