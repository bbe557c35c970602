"""Small documents with the awkward cases that every operator must take."""

import random

WORDS = "the of a Ab ab cd ef é日本 x1 22 !! | ## to in".split()


def awkward(n: int = 60, seed: int = 5) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): nulls, empties, ties, repeats."""
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 80))) for _ in range(n // 2)]
    rows = []
    for i in range(n):
        text = rng.choice(base)
        if rng.random() < 0.3:
            words = text.split(" ")
            words[rng.randrange(len(words))] = rng.choice(WORDS)
            text = " ".join(words)
        if rng.random() < 0.2:
            text += "\n" + rng.choice(base) + "\r\n\t " + text[:20]
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None]), len(text)))
    rows += [(n, None, "en", "s1", None), (n + 1, "", None, None, 0), (n + 2, " \n\t", "en", "s1", 3), (n + 3, "a" * 5000, "en", "s1", 5000)]
    rows += [(n + 4, "word " * 3000, "en", "s1", None), (n + 5, "one", "en", "s1", 3), (n + 6, "one", "en", "s1", 3)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
