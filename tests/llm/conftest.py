import random

import pytest

CLASH = "doc_id long, text string, score double, key string, row int, place string, `_group` int, n_hit string, kept_sha256 string, predicted string, `_text` int"


def random_word(r):
    return "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 6)))


def make_texts(seed=3, n=40):
    """Texts with exact and near copies, shared lines and passages, junk, and every odd case of empty and null."""
    r = random.Random(seed)
    words = [random_word(r) for _ in range(120)]
    prose = lambda k: " ".join(r.choice(words) for _ in range(k))
    shared = prose(60)
    texts = [prose(r.randrange(5, 120)) for _ in range(n)]
    texts[3] = texts[2]
    texts[5] = texts[4].replace(" ", "\n", 3)
    texts[6] = f"{prose(10)} {shared} {prose(10)}"
    texts[7] = f"{shared} {prose(30)}\n{shared}"
    texts[8] = "aa " * 400
    texts[9] = "\n".join(["  A repeated LINE of text \t", prose(5), "a repeated line of text", "short", ""])
    texts[10] = "\n".join([prose(4), "A Repeated line of text", "short"])
    near = prose(200).split()
    texts[11], texts[12] = " ".join(near), " ".join(near[:-2] + ["odd"])
    texts[13] = "Ünï é ß Ærø — 日本語 test space İI \U0001f600 mail me@x-y.co.uk now"
    texts[14] = "one"
    texts[15] = "One two"
    return [(i, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (102, " \n\t "), (None, "null id text " + shared), (2, texts[2]), (2, texts[2]), (103, "x" * 50_000 + " " + shared)]


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts beside columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, 0.5, "k", 1, "p", 7, "h", "s", "q", 9) for i, t in texts], CLASH)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], CLASH)
