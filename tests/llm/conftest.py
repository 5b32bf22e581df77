import pytest

from booklog.llm.shared import ship_package

CLASHING = (
    "row text key_1 key_2 digest class band bands filter part gram spans doc start windows place tie words "
    "component_id n kept root node label_2 tokens block"
).split()


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture
def documents(spark):
    """Rows of documents from (doc_id, text), with further columns whose names operators use."""

    def make(rows):
        more = [name for name in CLASHING if name != "text"]
        schema = "doc_id long, text string, n_chars long, " + ", ".join(f"`{x}` string" for x in more)
        return spark.createDataFrame([(a, b, None if b is None else len(b), *more) for a, b in rows], schema)

    return make
