from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, target string, n int, label int, keys string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Texts (or rows of id and text) as a documents table with extra columns whose names clash with inner ones."""

    def make(rows, partitions=3):
        full = []
        for i, r in enumerate(rows):
            doc_id, text = r if isinstance(r, tuple) else (i, r)
            full.append((doc_id, text, "en", f"src{i % 3}" if i % 4 else None, len(text or ""), "t", i, 1, "k"))
        df = spark.createDataFrame(full, DOCS)
        return df.repartition(partitions) if partitions else df

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls, blanks, repeats, one very long text, null and repeated ids."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return docs_of([None, "", " \n\t", "one", "one", long, (None, "no id here"), (None, None), (5, "same id"), "a b c d e f g h i j k l m n", "a b c d e f g h i j k l m n", "x" * 50_000, "\u00e9\u00e8 \u4e2d\u6587 \u0430\u0431"])
