import random

import pytest

WORDS = [f"w{k}" for k in range(900)]


def sentence(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Documents with nulls, empty, blank and very long texts, exact copies, near copies,
    repeated rows and texts without letters."""
    texts = {
        1: sentence(1, 60), 2: sentence(1, 60), 3: sentence(1, 60) + " extra words", 4: None, 5: "", 6: " \n\t ", 7: "one two", 8: "ONE two",
        9: "é漢🎉 ▁  x", 10: sentence(2, 30), 11: sentence(2, 15) + " " + sentence(3, 15), 12: "x" * 3000, 13: sentence(4, 4000), 14: "1234 5678 !!!",
        15: "a\x00b", 16: sentence(5, 40).replace(" ", "\n"), 17: sentence(4, 3990), 18: "  two  blanks ",
    }
    return [(k, t) for k, t in texts.items()]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with a repeated row, a null id and columns whose names clash with results."""
    rows = [(k, t, None if k % 5 == 0 else "en", None, len(t or ""), 1.5, "c") for k, t in corpus]
    rows += [rows[0], (None, "no id at all here", "en", "s", 0, 0.0, "c")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
