"""Small documents with everything that goes wrong in real tables."""

import re

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, norm string, score double, "
          "shard int, slot long, position long, lang_pred string, block long, row string, key string, n long")
LONG = "Lorem ipsum dolor sit amet. " * 40_000


def odd_docs(spark):
    clash = ("x", 9.9, 9, 9, 9, "x", 9, "x", "x", 9)
    rows = [
        (1, "The cat sat on the mat, and it was fine.", "en", "a", 10),
        (2, "The cat  sat\ton the mat, and it was fine.", "en", "a", 10),
        (2, "The cat  sat\ton the mat, and it was fine.", "en", "a", 10),
        (3, "", "en", "b", 0),
        (4, None, None, None, None),
        (5, "   \n ", "de", None, 4),
        (6, "12 34 !!", "de", "b", 8),
        (None, "Der Hund ist im Haus und die Katze auch.", "de", "b", 8),
        (7, "Der Hund ist im Haus und die Katze auch.", "de", None, 8),
        (8, LONG, "la", "c", len(LONG)),
        (9, "one", None, "c", 3),
    ]
    return spark.createDataFrame([r + clash for r in rows], SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def spaced_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


@pytest.fixture(autouse=True)
def shipped(spark):
    """Workers know the package; test modules import this fixture."""
    from cohortscope.llm.common import prepare

    prepare(spark)
