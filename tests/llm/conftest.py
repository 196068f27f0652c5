import pytest
from pyspark.sql import functions as F

from soundpairs.llm.common import reachable

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def llm_spark(spark):
    reachable(spark)
    return spark


@pytest.fixture(scope="session")
def docs(llm_spark):
    return llm_spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(llm_spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and columns with clashing names."""
    rows = [(None, "a text without an id " * 20, None, None), (None, "a text without an id " * 20, None, None),
            (1, None, "en", "s"), (2, "", "de", None), (3, "x", None, "s"), (3, "y", "en", "s"),
            (4, "same words here for all of us " * 30, "en", "s"), (5, "same words here for all of us " * 30, "en", "s"),
            (5, "same words here for all of us " * 30, "en", "s"), (6, "längeres Wort " * 20_000, "de", "s"),
            (7, "\n\n\t  \n", "fr", "s"), (8, "漢字かな交じり文🙂" * 50, "ja", "s"), (9, "<|endoftext|> 12 345", "en", "s")]
    df = llm_spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumns(
        {c: F.lit("clash") for c in ("score", "kept", "body", "bucket", "shard", "n", "key", "_text")})


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)
