"""Small documents with the awkward cases."""

from __future__ import annotations

import random

#: Extra columns with names that operators might use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, size string, shard string, score string"


def documents() -> list[tuple]:
    random.seed(11)
    words = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "😀", "müller"]
    texts = [
        None, "", "   ", " \n\t", "a", "a", "A", "a b", "a  b", "a\tb", "one two three", "one two three four", "ONE two three four",
        "x" * 9000, "x" * 9000, "x" * 9001, "x" * 4096, "x" * 8192, "naïve 😀 text", "naïve 😀\ntext", "tail ", "tail",
    ]
    for _ in range(25):
        base = [random.choice(words) for _ in range(random.choice([5, 40, 300]))]
        texts.append(" ".join(base))
        copy = list(base)
        copy[-1] = random.choice(words)
        texts.append(" ".join(copy))
    texts.append(" ".join(random.choice(words) for _ in range(20_000)))
    rows = [(i * 3, t, "en" if i % 2 else None, [None, "s1", "s2", "é"][i % 4], None if t is None else len(t), "n", "z", "q", None) for i, t in enumerate(texts)]
    rows += [(None, "one two three", "en", "s1", 13, None, None, None, None), (None, "no id", None, None, 5, None, None, None, None)]
    rows += [rows[10], rows[10], (rows[10][0], "another text", "en", "s1", 12, None, None, None, None)]
    return [r + (None,) * (9 - len(r)) for r in rows]
