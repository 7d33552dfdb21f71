"""Small tables with the awkward cases, and plain restatements."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, digest string, row_id long, `a.b` string, `at``x` string"
LONG = "lorem ipsum dolor sit amet " * 20_000


def awkward(spark, *more):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with names of results."""
    base = "one two three four five six seven eight nine ten eleven twelve"
    texts = [(1, base), (2, base), (2, base), (3, None), (4, ""), (None, base), (5, " \t\n"), (6, LONG), (7, "Ünïcödé 日本語 \U0001f600 x"), (7, "another text under one id"), (None, None), *more]
    rows = [(i, t, None if n % 3 == 0 else "en", None if n % 4 == 0 else f"s{n % 2}", None, "x", "y", 0, "z", None) for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def thue_morse(n):
    """A word and its complement, which no polynomial modulo a power of two tells apart from some length on."""
    word = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return [word, word.translate(str.maketrans("ab", "ba"))]


HARD = [w for n in (1024, 4096) for w in thue_morse(n)]
