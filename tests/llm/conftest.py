import duckdb
import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents from (doc_id, text[, lang[, source]]) tuples, with columns whose names clash."""

    def build(rows):
        full = [(*row, *[None] * (4 - len(row)), 1, "x", True) for row in rows]
        schema = "doc_id long, text string, lang string, source string, n long, score string, kept boolean"
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sql(small):
    connection = duckdb.connect()
    for name in ("documents", "pages", "conversations", "embeddings"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")

    def run(query):
        result = connection.execute(query)
        names = [column[0] for column in result.description]
        return names, result.fetchall()

    return run
