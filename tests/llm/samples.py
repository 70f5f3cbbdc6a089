"""Small tables for tests: words, copies, junk and odd rows."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, fp long, place string, label int"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("aeiounrtsl") for _ in range(rng.randint(1, 7))) for _ in range(n)]


def documents(n: int = 60, seed: int = 3) -> list[tuple]:
    """n documents: every third is an exact or near copy of an earlier one."""
    rng, texts = random.Random(seed), []
    for i in range(n):
        if i % 3 == 2:
            copy = rng.choice(texts).split(" ")
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
        else:
            texts.append(" ".join(words(rng, rng.choice([3, 40, 300]))))
    return [(i, t, "en", f"src{i % 3}", 0, "x", 1) for i, t in enumerate(texts)]


ODD = [
    (1, None, None, None, None, None, None),
    (2, "", "", "", 1, "", 0),
    (None, "no id at all", "en", "a", 2, "p", 1),
    (3, " \t\n\v\f\r ", "xx", "a", 3, "p", 1),
    (4, "twice the same", "en", "a", 4, "p", 1),
    (4, "twice the same", "en", "a", 4, "p", 1),
    (5, "don't 'sing le.'s İΣ ́e   ▁ ▁▁x <|endoftext|> 😀 123 ½", "fr", "b", 5, "q", 0),
    (6, "long " * 9000, "de", "b", 6, "q", 1),
    (7, "y" * 5000, "es", None, 7, "q", 1),
    (-8, "One line\nOne line\nOne line\n#$% & <b>", None, "c", 8, "r", 1),
]
