import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, node long, band long, items array<long>, row string, b string, key long, shard long, _n long, kept boolean"
WORDS = "the of and to in is that it for was with as be by on tion enter hated shore ingle ther thing".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) + rng.choice(["", "", ".", ",\n"]) for _ in range(n))


def texts(seed=0, n=30):
    """Ordinary, copied, nearly copied, repeated, junk, empty, null and odd texts."""
    rng = random.Random(seed)
    out = [prose(rng, rng.randint(1, 400)) for _ in range(n)]
    base = prose(rng, 300)
    words = base.split(" ")
    shared = prose(rng, 40)
    out += [base, base, " ".join(words[:150] + ["odd"] + words[151:]), " ".join(words[:100]), prose(rng, 50) + "\n" + shared + "\n" + prose(rng, 30), shared + prose(rng, 60)]
    out += ["", None, " \n\t ", "x", "a b c d", "ab " * 300, "line one\nline one\n\nline one", "é😀 naïve 日本語 İ <|endoftext|> it's 12½", "### $$$ %%%% !!! " * 30, "a" * 350, "ab" * 300]
    return out


def rows(given):
    return [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None, "S0"][i % 4], None if t is None else len(t), 5, 1.5, 7, 8, [9], "r", "b", 1, 2, 3, True) for i, t in enumerate(given)]


@pytest.fixture(scope="session")
def corpus(spark):
    """The odd texts under clashing extra columns, in a few partitions."""
    return spark.createDataFrame(rows(texts()), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def repeated(spark):
    """Rows repeated under one doc_id, and a null doc_id."""
    some = rows(texts(1, 12))
    return spark.createDataFrame(some + some[:9] + [(None, *some[3][1:])], SCHEMA).repartition(2).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def by_id(corpus):
    return {r.doc_id: r.text for r in corpus.collect()}
