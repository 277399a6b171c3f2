from __future__ import annotations

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with an extra column whose name operators use inside."""

    def build(rows, extra=False):
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(full, DOC)
        return df.selectExpr("*", "doc_id as id", "1 as chunk", "'x' as row", "2 as n_words", "3 as n_lines") if extra else df

    return build
