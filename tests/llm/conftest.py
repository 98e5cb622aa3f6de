import duckdb
import pytest

SCHEMA = "doc_id long, text string, lang string, n_tokens long, score double, fp long, row string"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (id, text) as documents with columns whose names operators use themselves."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", 1, 0.5, 7, "x") for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, repeated rows and ties."""
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
    return [(1, "Some words, here and there."), (2, None), (3, ""), (4, " \t\n"), (None, "no id"),
            (None, None), (5, long), (6, "twice"), (6, "twice"), (6, "another"), (7, "<|endoftext|>"),
            (8, "漢字 text ẞ İ naïve café"), (9, "x" * 5000)]


@pytest.fixture(scope="session")
def duck():
    """DuckDB over small given tables."""
    def run(sql, **frames):
        con = duckdb.connect()
        for name, frame in frames.items():
            con.register(name, frame)
        return con.execute(sql).df()

    return run
