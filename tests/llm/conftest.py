import pytest


@pytest.fixture(scope="session")
def messy(spark):
    """Null ids and texts, blank and long texts, ties, repeated rows, clashing column names."""
    long = "word " * 30_000 + "end\n" * 50
    rows = [
        (1, "one two three four five six seven eight nine ten"),
        (2, None),
        (3, ""),
        (4, " \n\t\r\n"),
        (5, long),
        (6, long),
        (7, "one two three four five six seven eight nine ten"),
        (7, "one two three four five six seven eight nine ten"),
        (7, "another text of the same id"),
        (None, "one two three four five six seven eight nine ten"),
        (None, None),
        (None, "only here, with 'quotes' and \x00 and é中\U0001f642"),
    ]
    names = ("_row", "_text", "_key", "_copy", "_id", "fp", "kept", "score", "n_words", "component_id", "tile", "shard", "runs")
    return spark.createDataFrame([(*r, *(["x"] * len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)
