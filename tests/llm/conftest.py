import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    part = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "ñö", "ü", "st"]
    return " ".join("".join(r.choice(part) for _ in range(r.randint(1, 4))) + r.choice(["", "", "", ",", ".", ".\n"]) for _ in range(words))


def edge_rows():
    long = prose(1, 9000)
    near = prose(2, 120)
    secret = 'api_key = "9f8e7d6c5b4a39281706f5e4d3c2b1a0"'
    rows = [
        (1, long, "en", "a", 0), (2, prose(3, 80), "en", "a", 0), (3, prose(3, 80), None, None, None), (4, near, "de", "a", 0),
        (5, near.replace("th", "xx", 1), "de", "a", 0), (6, None, "en", "b", None), (7, "", "en", "b", 0), (8, " \n\t ", "en", "b", 3),
        (9, "one", "en", "b", 3), (10, "one", "en", "b", 3), (11, "ONE  two\nthree four", "en", "b", 0), (12, "one two three four", "en", "b", 0),
        (13, prose(4, 30) + " " + long[2000:2600] + prose(5, 30), "en", "c", 0), (13, prose(4, 30) + " " + long[2000:2600] + prose(5, 30), "en", "c", 0),
        (14, prose(6, 20), "en", "c", 0), (14, prose(7, 20), "en", "c", 0), (None, prose(3, 80), "en", "c", 0), (None, None, None, None, None),
        (15, "aaaa" * 500, "en", "c", 0), (16, "aaaa" * 300, "en", "c", 0), (17, secret + " mail me a.b@c.example.org +1 (017) 555-7713 4111 1111 1111 1111 10.0.0.256 10.0.0.255", "en", "c", 0),
        (18, "x" * 49, "en", "c", 0), (19, "x" * 50, "en", "c", 0), (20, "x" * 51, "en", "c", 0), (-5, prose(8, 60), "en", "c", 0), (2**40, prose(8, 60) + " end", "en", "c", 0),
        (21, "日本語 😀 " * 40, "ja", "c", 0),
    ]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, edge):
    """The same rows with columns that operators might want for themselves."""
    from pyspark.sql import functions as F

    names = ["score", "base", "spans", "tokens", "found", "row", "n", "lo", "hi", "tag", "bucket", "block", "key", "sig", "whole", "windows", "_row", "_t", "_tag", "_new", "component_id", "length", "part", "rank", "t", "o", "at", "decoded_", "kind"]
    return edge.select("*", *[F.lit(f"own {n}").alias(n) for n in names])


@pytest.fixture
def table_dir(tmp_path):
    """A folder with given DataFrames as tables."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
