import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def prose(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" if r.random() < 0.9 else r.choice(["The,", "OF", "éa", "x-1"]) for _ in range(n))


def corpus():
    """Null ids and texts, empty and one-word texts, copies, near copies, shared passages and lines, repeated rows, a long text."""
    r = random.Random(7)
    rows = [(None, prose(r, 60)), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ONE"), (6, "two words"), (7, "Two\x0bWords")]
    base = prose(r, 300)
    w = base.split(" ")
    rows += [(10, base), (11, base), (11, base), (12, base.upper()), (13, base.replace(" ", "\n"))]
    for i in range(14, 40):
        v = list(w)
        for _ in range(i % 9):
            v[r.randrange(len(v))] = f"edit{r.randrange(10**6)}"
        rows.append((i, " ".join(v)))
    passage = prose(r, 50)
    rows += [(i, f"{prose(r, 40)} {passage} {prose(r, 40)}") for i in range(40, 60)]
    rows += [(i, f"{prose(r, 12)}\nA line that MANY hold \n{prose(r, 9)}\na line that many hold\n") for i in range(60, 75)]
    rows += [(80, "De " * 200), (81, "De " * 90), (82, "a b c d e " * 60), (83, prose(r, 20_000, 50_000)), (84, f"{passage} {passage}")]
    small = prose(r, 11)
    rows += [(90, small), (91, small + " z"), (92, small + " z y")]
    rows += [(100, "\n".join(["Tied line of text"] * 3)), (101, "tied LINE of text\r\nother"), (101, "tied line of text")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Extra columns bear names that the operators use themselves."""
    clash = [(i, t, "en", k, "x", "y", 1.5, "z") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(clash, "doc_id long, text string, lang string, node int, key string, spans string, score double, kept string").repartition(5)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
