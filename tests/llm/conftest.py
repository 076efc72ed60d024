import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

LONG = "the cat sat on the mat and " * 30_000


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra
    columns with names that the operators use themselves."""
    text = "A quite ordinary sentence stands here. Another one follows it, of some length.\nAnd a last line without end"
    rows = [
        (1, None, "en", "a", None), (None, text, None, None, 5), (2, "", "en", "a", 0), (3, " \n\t", "fr", "b", 3),
        (4, LONG, "en", "a", len(LONG)), (4, LONG, "en", "a", len(LONG)), (5, text, "en", None, len(text)),
        (6, "¿Qué tal? 日本語 👍 ñ", "es", "b", 18), (None, None, None, None, None), (7, text, "en", "b", len(text)),
    ]
    clash = ["_row", "_hash", "_times", "_copy", "_cut", "k", "t", "fp", "hash", "size", "w", "score", "gone", "border",
             "key", "n", "mark", "root", "node", "first", "part", "_id", "_key", "_own", "_doc", "keys", "low", "copies", "item_id", "rank", "slices"]
    rows = [(*r, *range(len(clash))) for r in rows]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} bigint" for c in clash))
