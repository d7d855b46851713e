"""Small frames with the hard cases: NULLs, empty and long texts, ties, repeated rows, clashing columns."""

import pytest

EXTRA = "node long, sig string, score double, size long, t string, word string, chunk long, source_size long"


@pytest.fixture(scope="session")
def hard_docs(spark):
    long = " ".join(f"word{i % 97} thing{i % 89}" for i in range(6000))
    rows = [
        (1, "the cat sat on the mat and the dog ran away from it", "en", "a"),
        (1, "the cat sat on the mat and the dog ran away from it", "en", "a"),
        (2, None, "en", None),
        (3, "", None, "b"),
        (4, " \n\t ", "fr", "b"),
        (None, "no id here but some words anyway", "en", "a"),
        (5, long, "en", "a"),
        (6, long, "en", "c"),
        (7, "1234 5678 !!! ???", None, "c"),
        (8, "été çà où le la les des du un une", "fr", "b"),
        (9, "one", "en", "a"),
        (10, "write to anna.b@mail.example.org or +1 (499) 555-6503 now", "en", "a"),
    ]
    rows = [(*r, len(r[1] or ""), 7, "x", 0.5, 3, "t", "w", 9, 4) for r in rows]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


@pytest.fixture(scope="session")
def no_docs(spark, hard_docs):
    return hard_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
