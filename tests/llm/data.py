"""Rows that every text operator must bear."""

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score double, vertex long"
ENGLISH = "the quick brown fox jumps over the lazy dog and then walks home through the quiet forest while rain falls"
ODD = [
    (None, "a row without an id", "en", "s", 0, 0.5, 1),
    (1, None, "en", None, None, None, None),
    (2, "", None, "s", 0, 0.1, 2),
    (3, " \t\n ", "en", "s", 4, 0.1, 2),
    (4, ENGLISH, "en", "s", 9, 0.1, 2),
    (5, ENGLISH, "en", "t", 9, 0.1, 2),
    (5, ENGLISH, "en", "t", 9, 0.1, 2),  # a repeated row
    (6, "1234 !!! 5678", "en", "s", 9, 0.1, 2),
    (7, "x" * 200_000, "en", "s", 9, 0.1, 2),
    (8, "word " * 40_000, "en", "s", 9, 0.1, 2),
    (9, "été \U0001f600 naïve 漢字 don't 12'll", "fr", "u", 9, 0.1, 2),
]


def documents(spark, rows=ODD):
    return spark.createDataFrame(rows, DOCUMENTS)
