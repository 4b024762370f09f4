"""Brute-force versions and small tables for the corpus operators' tests."""

import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    ]
)
#: Names the operators use inside; a table may have columns of these names.
CLASHES = ("id", "key", "size", "bucket", "s", "n", "fp", "rid", "lines", "d", "p", "h", "taken", "score", "rank", "__row", "__t", "__label", "component_id")


def documents(spark, rows):
    """Documents of (doc_id, text, source) with null languages and columns whose names clash with the operators' own."""
    df = spark.createDataFrame([(i, t, None, s, None if t is None else len(t)) for i, t, s in rows], DOCS)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in CLASHES})


ODD = [
    (1, None, "a"), (2, "", "a"), (3, "  \n\t ", "b"), (4, "one", None), (4, "one", None), (None, "no id at all here", "b"), (None, None, None),
    (5, "same words here for all of us to read", "a"), (6, "same words here for all of us to read", "a"), (7, "SAME words here for all of us to READ", "b"),
    (8, "ä ö 漢字 \U0001f600 mixed", "c"), (9, "long " * 60_000, "c"), (10, "x" * 200_000, "c"), (11, "tail\x0bword\x0cend\r\nline", "c"),
]


def shingles(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < n else frozenset(zip(*[w[i:] for i in range(n)], strict=False))


def components(rows, n, percent=80):
    """{id: (set size, smallest id reachable)} by comparing all with all."""
    sets = {i: shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}
