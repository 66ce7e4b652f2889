import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts, or from (doc_id, text) or (doc_id, text, source) rows."""

    def build(rows, partitions=3):
        full = []
        for i, r in enumerate(rows):
            r = (i, r) if r is None or isinstance(r, str) else tuple(r)
            key, text, source = (*r, f"s{i % 3}")[:3] if len(r) == 2 else r
            full.append((key, text, "en", source, None if text is None else len(text)))
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return build


#: Texts that every operator must stand: null, empty, blank, marks, non-ASCII white space, repeats, long.
ODD = [None, "", "  \n\t ", "\n\n", "!!", "a", "A", "a b　c", "é É ß", "one two three four five", "one two three four five", "x" * 50_000, "word " * 20_000, "l1\nl2\r\nl3", "<|endoftext|> tail"]


@pytest.fixture(scope="session")
def odd(make):
    return make([*ODD, (None, "a row without a key here", None), (9, "one two three four five", None)])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clash():
    """Adds columns whose names an operator might use itself."""
    from pyspark.sql import functions as F

    names = ["id", "u", "v", "n", "row", "key", "line", "bucket", "band", "component", "token", "h", "pos", "seed", "digest", "shard", "slot", "score", "_key", "_label", "_drop", "n_lines", "size", "label", "features"]
    return lambda df: df.withColumns({c: F.lit("clash") for c in names})
