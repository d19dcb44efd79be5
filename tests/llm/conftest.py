from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, kept string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns that clash with results."""
    rng = random.Random(5)
    say = lambda n, words: " ".join(rng.choice(words) for _ in range(n))
    en, de = "the of and to in that it was for with ther ing".split(), "der die und ich nicht ein zu das sch ung über".split()
    rows = [(i, say(40 + i, en if i % 2 else de), "en" if i % 2 else "de", f"s{i % 3}") for i in range(60)]
    base = say(200, [f"w{i}" for i in range(500)])
    rows += [(100, base, "en", "s0"), (101, base, "en", "s1"), (102, base.replace("w1 ", "w2 ", 1) + " tail", None, "s0"), (103, base.upper(), "en", None)]
    rows += [(104, None, "en", "s0"), (105, "", "de", "s1"), (106, " \n\t ", None, None), (107, "one two", "en", "s0"), (108, "one two", "en", "s0")]
    rows += [(109, "123 456 !!", "en", "s0"), (110, say(30_000, en), "en", "s2"), (111, "x" * 40_000, "de", "s2"), (None, "no id here at all", "en", "s0")]
    rows += [rows[0], rows[0], rows[-4]]
    return spark.createDataFrame([(*r, None, 1.0, "mine", "mine") for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
