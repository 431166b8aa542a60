"""Small documents with the cases that every operator must bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls, empty, blank, no final word, ties, copies, characters outside ASCII, a special token.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", "b", 4),
    (4, "one", "en", "a", 3),
    (5, "One two  three\nfour five", "en", None, 23),
    (6, "one two three four five", "fr", "c", 23),
    (7, "naïve café – déjà vu 北京 🙂 é  x y", "fr", "b", 20),
    (8, "foo <|endoftext|>bar <|startoftext|> it's we'll 123 4 5!?", "en", "a", 40),
    (9, "a\u0085b\x1fc\x0b d  \n\n  e ", "en", "a", 12),
]


def prose(n, seed=0, words=60):
    draw = random.Random(seed)
    bank = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 9))) for _ in range(400)]
    return [" ".join(draw.choice(bank) for _ in range(draw.randint(1, words))) for _ in range(n)]


def documents(spark, extra=(), rows=None):
    return spark.createDataFrame(list(ODD if rows is None else rows) + list(extra), SCHEMA)


def fuller(n=80, seed=0):
    """ODD and n more, with near and exact copies and one very long text."""
    draw = random.Random(seed)
    texts = prose(n, seed)
    rows = []
    for i, t in enumerate(texts):
        if i % 7 == 3:
            t = texts[i - 1]
        elif i % 7 == 5:
            w = (texts[i - 2] + " " + texts[i - 3]).split()
            w[draw.randrange(len(w))] = "changed"
            t = " ".join(w)
            rows.append((1000 + i, " ".join(w[:-1]), "en", "near", len(t)))
        rows.append((10 + i, t, "en", f"s{i % 3}" if i % 2 else "hot", len(t)))
    rows.append((5000, "long " * 30000 + "end", "en", "hot", 150003))
    return ODD + rows
