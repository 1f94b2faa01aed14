import pytest
from pyspark.sql import functions as F

from vacancia.llm.common import ARROW_ROWS

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))


def awkward_rows():
    """Nulls in every column, empty, blank and very long texts, copies, a repeated row, a repeated id, odd characters."""
    passage = " ".join(f"p{i}" for i in range(60))
    return [
        (1, "The quick brown fox\tjumps  over the lazy dog", "en", "a", 10),
        (2, "The quick brown fox jumps over the lazy dog", "en", "a", 10),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \n\t ", "en", "b", 4),
        (6, LONG, "en", "c", len(LONG)),
        (7, LONG, "en", "c", len(LONG)),
        (8, passage + " and more", "en", "a", 1),
        (9, "Before " + passage, "en", None, 1),
        (10, "Été ÀÉ ß straße 中文字   x y <|endoftext|> 🙂 can't", "fr", "d", 1),
        (10, "same id, other text", "fr", "d", 1),
        (11, "twice the same row", "de", "e", 1),
        (11, "twice the same row", "de", "e", 1),
        (None, "no id at all here", "en", "a", 1),
        (None, None, None, None, None),
        (12, "z " * 40, "en", "z", 80),
    ]


@pytest.fixture(scope="session", autouse=True)
def small_batches(spark):
    spark.conf.set(ARROW_ROWS, "500")


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), COLUMNS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def clashing(awkward):
    """The same rows with columns named like those the operators make."""
    names = "score keep_id kept size taken target start n_words fp row doc key term hits _key _norm _digest _id _times place ids words anchor page_id digest n_tokens"
    return awkward.select("*", *[F.lit("mine").alias(n) for n in names.split()])


def rows_of(df, *columns):
    got = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(got, key=repr)
