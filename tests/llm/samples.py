"""Small document tables for the text operators: invented words, and the rows that break things."""

from __future__ import annotations

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          # names that the operators use for columns of their own
          "id string, row int, key int, size string, n_words int, base int, score string, cell string")
EXTRA = ("x", 7, 7, "y", 7, 7, "z", "w")


def words(seed: int, n: int, letters: str = "abcdefghij") -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choices(letters, k=r.randint(2, 8))) for _ in range(n)]


def prose(seed: int, n: int, letters: str = "abcdefghij") -> str:
    return " ".join(words(seed, n, letters))


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, a long one, ties and repeated rows."""
    return [(900, None, "en", "s"), (901, "", "en", "s"), (902, " \t\n\x0b ", None, None),
            (None, "a null id with some words", "en", "s"), (903, None, None, None),
            (904, prose(9, 5000), "en", "s"), (905, "Twice the same.", "en", "s"),
            (905, "Twice the same.", "en", "s"), (906, "😀 é ß", "de", "s"), (907, "***", "en", None)]


def table(spark, rows):
    full = [(*r, len(r[1] or ""), *EXTRA) for r in rows]
    return spark.createDataFrame(full, SCHEMA)
