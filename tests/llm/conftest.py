import pytest

#: Names that the operators use inside.
CLASHING = "size row key_file key_row print label name hash tie target source_size start terms node stats fold w h l t".split()


@pytest.fixture(scope="session")
def make(spark):
    def make(rows):
        """Documents with extra columns of clashing names; rows: (doc_id, text, lang, source)."""
        extra = ", ".join(f"`{name}` long" for name in CLASHING)
        return spark.createDataFrame([(*r, len(r[1] or ""), *[i] * len(CLASHING)) for i, r in enumerate(rows)], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")

    return make


ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, "One two three four", "en", "a"), (3, "One two three four", "en", "a"),
    (4, "ONE TWO three FOUR", None, "b"), (None, "one two three four", "de", "b"), (5, "É é ß 漢字", "fr", None), (6, " \t\n", "fr", "c"),
    (7, "word " * 30000, "en", "a"), (8, "x" * 30000, "en", "c"), (9, "x" * 30000 + "y", "en", "c"),
]


@pytest.fixture(params=["odd", "empty"])
def docs(make, request):
    return make(ODD if request.param == "odd" else [])
