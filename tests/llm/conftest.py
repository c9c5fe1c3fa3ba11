import pytest

LONG = "Eine lange Zeile. " * 9000
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "One short line."), (5, LONG), (6, "One short line."), (7, "12 34 !!"), (7, "12 34 !!"), (None, "No id here."),
       (9, "Ünïcode \U0001f642 λόγος 日本 <|endoftext|> é."), (10, "a b c d e f g"), (11, "the same words\nof two lines"), (12, "the same words\nof two lines")]
CLASH = "sequence_id long, offset int, shard int, slot string, size string, score double, fp string, piece string, n long, _n int, a string, bucket string"


@pytest.fixture
def odd(spark):
    """Null ids and texts, empty and very long texts, repeated rows, ties, and columns named like results."""
    extra = (None, 1, 2, "x", "y", 0.5, "z", "p", 3, 4, "q", "r")
    return spark.createDataFrame([(i, t, "xx", "src", 1, *extra) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, " + CLASH)


@pytest.fixture
def none(odd):
    return odd.where("false")
