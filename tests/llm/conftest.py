import pytest
from pyspark.sql import SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark: SparkSession):
    """Nulls in every column, empty, blank and very long texts, copies, repeated rows, clashing extra columns."""
    long_text = " ".join(f"word{i % 977} wörter{i % 13},\n" for i in range(40_000))
    plain = "The house of the old man is on the hill, and the road to it is long. It was built by hand, stone by stone, for years."
    passage = "Every morning, before the sun is up, the baker walks down to the mill. He takes the flour, counts the bags, and pays. Nobody ever asks why."
    texts = [
        plain, plain, plain.replace("stone by stone", "brick by brick"), "", None, " \t\n ", long_text, "a", "a" * 5_000, "日本語 テスト。\x00 \x1c é",
        f"{plain}\n{passage}\nAnd so on.", f"Something else, quite.\n{passage}\nThe end of it.", "<|endoftext|> it's (ok). <s>", passage + "\n" + passage,
    ]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "a", "b", None][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, plain, None, None, None), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, DOCS)
    # Names that the operators use themselves.
    extra = ["row", "words", "m", "fp", "shard", "size", "mark", "cuts", "ids", "features", "score", "hash", "labelled_id", "n_words", "group", "a.b"]
    return frame.selectExpr("*", *[f"cast(doc_id as int) as `{name}`" for name in extra])


@pytest.fixture(scope="session")
def empty(spark: SparkSession):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def no_labels(spark: SparkSession):
    return spark.createDataFrame([], LABELS)
