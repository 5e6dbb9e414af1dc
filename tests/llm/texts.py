"""Texts of made-up words."""

VOCABULARY = [a + b for a in ("ba", "ko", "tri", "mel", "sha", "un") for b in ("ra", "ti", "lo", "né", "x1")]


def prose(rnd, n, words=VOCABULARY):
    return " ".join(rnd.choice(words) for _ in range(n))
