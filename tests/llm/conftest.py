import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """documents from (doc_id, text)."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], COLUMNS).repartition(3)

    return make


@pytest.fixture
def sf_dir(spark, tmp_path, docs):
    """A folder with tables of one's own."""

    def make(rows, labels=()):
        docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return make


#: Nulls, empty and blank texts, one word, repeats, ties, and a very long text.
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, "word"), (6, "a b c d"), (7, "A b  c\nd"), (7, "A b  c\nd"), (None, "a b c d"), (8, "x" * 100_000), (9, "lorem ipsum dolor " * 20_000), (10, "é 日本 \x00 𝕏 don't 12 ")]
