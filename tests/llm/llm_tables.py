"""Tables for the tests of the training-data operators."""

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "size long, _row long, key string, count long, words string, score double, u long, part string"
)


def frame(spark, rows):
    """A table of (doc_id, text[, source]) rows, with columns that clash with the operators' own names."""
    filled = [
        (r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 7, None, "k", 1, None, 0.5, 3, "p") for r in rows
    ]
    return spark.createDataFrame(filled, SCHEMA)


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    pool = random.Random(1)
    words = ["".join(pool.choice("abcdeéñ") for _ in range(pool.randint(2, 8))) for _ in range(vocabulary)]
    return " ".join(rng.choice(words) for _ in range(n))
