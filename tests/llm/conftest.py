import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, found string, spans string, fp string, start string"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns with names that operators use."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog. " * 40, "en", "a"), (2, "The quick brown fox jumps over the lazy dog. " * 40, "en", "a"), (2, "The quick brown fox jumps over the lazy dog. " * 40, "en", "a"),
        (3, None, None, None), (4, "", "en", None), (5, " \n\t ", None, "a"), (6, "12 34 ++", "de", "b"), (7, "Der schnelle braune Fuchs springt. " * 3000, "de", "b"), (8, "solo", None, "b"),
        (None, "Ein Text ohne Nummer, mail an a.b@c.de bitte.", "de", "b"), (9, "IP 10.0.0.255, card 4111 1111 1111 1111, call +1 (614) 555-8001 now; DE89 3704 0044 0532 0130 00 end", "en", "c"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "x", "y", "z", "s") for r in rows], DOCUMENTS)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)
