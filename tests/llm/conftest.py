import random

import pytest

_PARTS = "the ing er th on an re ha nd ou ti es st en at ed or it is of and lich ung ción que été".split()


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with every odd case: null, empty, blank, short, copies, near copies, a very long text."""
    rng = random.Random(7)

    def word():
        return "".join(rng.choice(_PARTS) for _ in range(rng.randint(1, 4)))

    def text(n):
        return " ".join(word() for _ in range(n))

    rows = [None, "", " \n\t ", "one", "one two three", "One  two\nthree", "a b c d e", text(6_000)]
    base = text(200)
    rows += [base, base.upper(), base.replace(" ", "\n", 5), base + " "]
    for _ in range(40):
        words = base.split(" ")
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(len(words))] = word()
        rows.append(" ".join(words))
    rows += [text(rng.randint(1, 120)) for _ in range(60)]
    rows += ["same words here again and again"] * 5
    return list(enumerate(rows))


@pytest.fixture
def docs(spark, corpus):
    from tidemark.shipping import ship_package

    ship_package(spark)
    # Columns whose names clash with those of results.
    return spark.createDataFrame([(i, t, "x", i % 3, True) for i, t in corpus], "doc_id long, text string, keep_id string, start int, kept boolean").repartition(5)


@pytest.fixture
def nothing(docs):
    return docs.where("doc_id < 0")
