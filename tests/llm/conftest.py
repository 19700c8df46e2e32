import pytest


@pytest.fixture
def docs(spark):
    """Rows of (doc_id, text, lang, source) as a table of documents, with further columns of clashing names."""

    def make(rows, clash=True):
        frame = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        if clash:
            for name in ("key", "label", "group", "score", "n", "mark", "token", "line"):
                frame = frame.selectExpr("*", f"'x' AS `{name}`")
        return frame

    return make


#: Texts that every operator takes: null, empty, blank, one word, very long, ties and repeats.
EDGES = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "Word"),
    (5, "one two three four five six seven eight nine ten " * 3),
    (6, "one two three four five six seven eight nine ten " * 3),
    (6, "one two three four five six seven eight nine ten " * 3),
    (None, "a text without an id that is not short at all"),
    (7, "long " * 60_000),
    (8, "été ÀÉ straße 漢字 \x0b\x0c\r\n line"),
]
