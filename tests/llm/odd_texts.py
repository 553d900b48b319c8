"""Texts and ids that every operator must accept."""

LONG = "word " * 60_000 + "x" * 200_000
ODD_TEXTS = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b "),
    (None, "a text without an id"),
    (None, None),
    (4, LONG),
    (5, "the same text twice"),
    (5, "the same text twice"),
    (5, "and another under the same id"),
    (6, "Ünï çødé \U0001f600 " * 30),
]


def look_alikes(letters):
    """Two different words that a polynomial hash modulo a power of two cannot tell apart."""
    one, two = "a", "b"
    while len(one) < letters:
        one, two = one + two, two + one
    return one, two
