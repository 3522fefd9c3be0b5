import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(7)
    parts = ["ba", "den", "ro", "the", "ing", "ör", "é", "tion", "s", "ly"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(400)]


@pytest.fixture(scope="session")
def odd_texts(words):
    """Null, empty, blank, tiny, very long, repeated and badly spaced texts."""
    rng = random.Random(11)
    long = " ".join(rng.choice(words) for _ in range(30000)) + "."
    plain = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 120))) + "." for _ in range(12)]
    return [
        None, "", " \t\n\r\x0b\x0c ", "a", "one two.", long, "x" * 50000, plain[0], plain[0], *plain,
        "a  b c \n\n d　 e", "line one two three four five.\n\nline one two three four five.\n",
        "<|endoftext|> is text  here, isn't it?  It's 12 o'clock\t!\n", "é" * 300, " lead and tail ",
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 2}" if i % 5 else None, len(t or "")) for i, t in enumerate(odd_texts)]
    rows += [rows[9], (None, "a document without an id.", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
