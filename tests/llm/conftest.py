import pytest

#: Extra columns whose names the operators use inside.
EXTRA = "digest string, fp long, n long, keep_id long, label int, held_out boolean, row long, group long, length long, root long, component_id long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def rows_of(pairs):
    return [(i, t, "en", "s", len(t or ""), "x", 1, 2, 3, 4, True, 5, 6, 7, 8, 9) for i, t in pairs]


ODD = [
    (1, "alpha beta gamma delta epsilon"), (2, "alpha\tbeta \n gamma delta epsilon"), (3, None), (4, ""), (5, " "), (6, "\t\n"), (None, "no id here at all"),
    (None, "alpha beta gamma delta epsilon"), (7, "seven times seven"), (7, "seven times seven"), (8, "word " * 30_000 + "end"), (9, "x" * 200_000),
    (10, "Été ½ 日本 　 ok\x1cok"), (11, "| *** ###"), (12, "a"), (13, "<|endoftext|> it's 's"), (14, "a  b \n c"),
    (15, "a <|endoftext|> b<|startoftext|>c <|"), (16, "One line.\nTwo lines,\nthree: it's\n\nnot"),
]


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(pairs):
        return spark.createDataFrame(rows_of(pairs), SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(ODD)
