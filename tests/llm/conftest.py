import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def documents(spark):
    """A documents table of (doc_id, text) or (doc_id, text, source) rows."""

    def make(rows, **more):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        out = spark.createDataFrame(full, SCHEMA)
        for name, value in more.items():
            from pyspark.sql import functions as F

            out = out.withColumn(name, F.lit(value))
        return out

    return make


#: Nulls, empty and blank texts, equal texts under several ids, equal rows, a long text, other scripts.
ODD = [(None, "alone without id"), (0, None), (1, ""), (2, " \n\t"), (3, "the same words here again"), (4, "the same words here again"), (5, "x"), (5, "x"), (6, "日本語 ñandú ΑΣ İ 'll <|endoftext|> +1 (555) 123-4567"), (7, "long words " * 9000), (8, "z" * 50_000)]


@pytest.fixture
def odd(documents):
    return documents(ODD)
