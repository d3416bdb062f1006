"""Small tables that the tests of this folder share."""

import random

FOLDER = "/root/testdata/sf0.001"

BASE = "The quick brown fox jumps over the lazy dog while seven wizards brew potions in the old stone tower by the sea"


def awkward(spark, **more):
    """Null and empty texts, a null id, repeated rows, ties, a very long text, and columns whose names clash with working and result columns."""
    rows = [
        (1, BASE),
        (2, BASE.upper()),
        (3, None),
        (4, ""),
        (5, " \t\n\x0b\x0c\r "),
        (6, "é É ß ﬁ naïve"),
        (7, "É é ß ﬁ naïve"),
        (8, BASE),
        (8, BASE),
        (None, BASE),
        (None, None),
        (9, "word " * 40_000),
        (10, "one"),
        (11, "One"),
        (12, BASE + " " + BASE + " " + BASE),
    ]
    names = "shard slot kept keep_id group_size _h _t _piece _lead _salt _place score position copy _g _block _low fp root key verdict coverage item_id".split()
    schema = "doc_id bigint, text string, source string, " + ", ".join(f"{name} string" for name in names)
    return spark.createDataFrame([(i, t, None if (i or 0) % 5 == 0 else f"s{(i or 0) % 2}", *names) for i, t in rows], schema)


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, source string")


def invented(n, seed=0, words=300, vocabulary=2000):
    """Texts of made-up words, some copies and near copies among them."""
    pick = random.Random(seed)
    texts = []
    for i in range(n):
        if texts and i % 7 == 3:
            old = pick.choice(texts).split(" ")
            old[pick.randrange(len(old))] = f"new{i}"
            texts.append(" ".join(old))
        elif texts and i % 11 == 5:
            texts.append(pick.choice(texts))
        else:
            texts.append(" ".join(f"w{pick.randrange(vocabulary)}" for _ in range(pick.randrange(1, words))))
    return texts


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
