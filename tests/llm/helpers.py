"""Brute-force versions and small tables for the operator tests."""

import re

WORD = re.compile("[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.001"

#: Null id, null and empty texts, white space only, repeated rows, a null source.
EDGE_DOCS = [
    (1, "the cat sat on the mat and then it ran away\nsecond line here", "en", "a", 10),
    (1, "the cat sat on the mat and then it ran away\nsecond line here", "en", "a", 10),
    (2, None, "en", "a", 0),
    (3, "", None, "b", 0),
    (4, " \t\n ", "fr", None, 4),
    (None, "one two", "de", "b", 7),
    (None, None, None, None, None),
    (7, "12 34 !?", "en", "b", 8),
    (8, "x" * 30_000, "en", "c", 30_000),
    (9, "word " * 5_000, "fr", "c", 25_000),
    (10, "The Cat sat on the mat and then it ran away second line here", "en", None, 10),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def edge_docs(spark):
    return spark.createDataFrame(EDGE_DOCS, DOCS)


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k=5):
    w = words(lower(text))
    return {tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def least_reachable(ids, linked):
    """Least id reachable; ``linked(i, j)`` for positions i < j."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(j, i):
                root[find(i)] = find(j)
    group = {}
    for i, v in enumerate(ids):
        group.setdefault(find(i), []).append(v)
    return [min(group[find(i)]) for i in range(len(ids))]
