from __future__ import annotations

import random

import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, mark int, row string, node int, score string, _id int"


def table(spark, rows):
    """A table of documents with further columns whose names the operators use themselves."""
    full = [(i, t, "en", "src", None if t is None else len(t), "x", 1, "y", 2, "z", 3) for i, t in rows]
    return spark.createDataFrame(full, COLUMNS)


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda rows: table(spark, rows)


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, copies, near copies, shared passages, a very long text, repeated rows."""
    base, passage = prose(1, 120), prose(2, 40)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    rows = [
        (5, base), (3, base), (9, f"  {base}\n"), (7, near), (8, f"{prose(3, 30)} {passage} {prose(4, 30)}"),
        (2, f"{prose(5, 20)} {passage}\n{prose(6, 9)}"), (10, None), (11, ""), (12, " \t\n"), (13, "one"), (14, "one two"),
        (15, "One TWO"), (16, "a" * 300), (17, "a" * 200 + "b"), (18, "é" * 60 + " naïve 日本 " + "é" * 60),
        (19, "é" * 60), (20, prose(7, 12_000, 9_000)), (21, prose(7, 12_000, 9_000)[3:]), (None, base), (None, None),
        (22, base), (22, base), (22, prose(8, 50)), (-4, passage), (30, f"{passage} {passage}"),
    ]
    for k in range(10, 20):  # small sets that differ by one shingle
        rows.append((100 + k, prose(50 + k, k)))
        rows.append((200 + k, prose(50 + k, k) + " more"))
    return rows
