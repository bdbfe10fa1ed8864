import pytest

NO_PUBLICATIONS = (
    "record_id string, title string, authors string, publication_year int, doi string, origin string, "
    "ingested_at timestamp_ntz, pos int, a string, class string, value string"
)


@pytest.fixture
def records(spark):
    """Rows of master_records with a few further columns whose names operators use inside."""

    def make(*rows):
        full = [
            (
                r.get("record_id"), r.get("title"), r.get("authors"), r.get("year"), r.get("doi"), r.get("origin"),
                None, 1, "a", "class", "value",
            )
            for r in rows
        ]
        return spark.createDataFrame(full, NO_PUBLICATIONS)

    return make
