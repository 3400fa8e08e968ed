import pytest
from pyspark.sql import functions as F

from buylens.llm.shared import prepared

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def llm(spark):
    return prepared(spark)


@pytest.fixture(scope="session")
def docs(llm):
    return llm.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(llm):
    """Nulls, empty and white-space texts, ties, repeated rows, columns with clashing names, a long text and one without white space."""
    words = [f"w{i}" for i in range(60)]
    base = " ".join(words)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two three"), (5, "one two three"), (6, base), (6, base), (7, base + " tail"), (None, base),
            (8, " ".join(words[::-1])), (9, "x" * 50_000), (10, " ".join(f"q{i % 977}" for i in range(30_000))), (None, None), (11, "naïve Straße ΣΑΣ 'tis <|endoftext|> 12³ é\r\nend")]
    df = llm.createDataFrame(rows, "doc_id bigint, text string")
    return df.withColumns({"spans": F.lit("clash"), "kept": F.lit(1), "KEY": F.lit(2), "n_words": F.lit("x"), "secrets": F.lit(0.5)})
