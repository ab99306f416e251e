import pytest

from steward.llm.common import prepare


@pytest.fixture(scope="session")
def llm(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return prepare(spark)


@pytest.fixture(scope="session")
def documents(llm):
    """Rows as a `documents` table with an extra column whose name an operator uses itself."""

    def make(rows):
        full = [(i, text, "en", source, None if text is None else len(text), 7) for i, text, source in rows]
        return llm.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, kept int").repartition(3)

    return make
