"""Patterns answered from stored trigrams, against patterns run over all texts."""

import random
import re
import uuid

import pytest

from lumenfold.operators import search as se
from lumenfold.operators import trigrams as tg
from lumenfold.sources.store import work_dir


def held(text):
    low = text.translate(str.maketrans(tg.UPPER, tg.LOWER))
    return {low[i : i + 3] for i in range(len(low) - 2)}


@pytest.mark.parametrize(
    ("pattern", "grams"),
    [
        ("hello", {"hel", "ell", "llo"}),
        ("abc.*xyz", {"abc", "xyz"}),
        ("ab", set()),
        ("(abc|xyz)d", {"abc", "bcd", "xyz", "yzd"}),
        ("(abc|.)", set()),
        ("(?:abcd)?", set()),
        ("a[bB]c+d", {"abc"}),
        ("ab{3}a", {"abb", "bbb", "bba"}),
        (r"\bdef\s+main\b", {"def", "mai", "ain"}),
        ("(?=.*abc)def", {"abc", "def"}),
        ("(?!abc)def", {"def"}),
        (r"\Qa.b\E", set()),
        ("[abc&&[b]]xyz", set()),
        ("(", set()),
        (r"\p{L}abc", set()),
        ("", set()),
    ],
)
def test_what_a_pattern_needs(pattern, grams):
    assert tg.needed(pattern).grams() == grams


def test_alternatives_are_a_disjunction():
    need = tg.needed("foo(bar|quux).*end")
    assert need.holds(held("a foobar at the END")) and need.holds(held("fooquux, end"))
    assert not need.holds(held("foobar")) and not need.holds(held("foo bar end"))


def test_every_match_meets_what_is_needed():
    rng = random.Random(5)

    def part(depth):
        kind = rng.randrange(9 if depth else 3)
        if kind < 3:
            return "".join(rng.choice("abcC") for _ in range(rng.randrange(1, 5)))
        if kind == 3:
            return f"({part(depth - 1)}|{part(depth - 1)})"
        if kind == 4:
            return f"(?:{part(depth - 1)}){rng.choice(['?', '*', '+', '{2}', '{1,3}', '{5}', '+?', '*?'])}"
        if kind == 5:
            return rng.choice(["[ab]", "[^a]", ".", r"\w", "[a-c]", "^", r"\b", "$"])
        if kind == 6:
            return f"(?={part(depth - 1)})"
        if kind == 7:
            return f"(?!{part(depth - 1)})"
        return part(depth - 1) + part(depth - 1)

    texts = ["".join(rng.choice("abcC") for _ in range(rng.randrange(0, 30))) for _ in range(150)]
    hits = pruned = 0
    for _ in range(600):
        pattern = part(3)
        need = tg.needed(pattern)
        for text in texts:
            if re.search(pattern, text, re.IGNORECASE):
                hits += 1
                assert need.holds(held(text)), (pattern, text)
            else:
                pruned += not need.holds(held(text))
    assert hits > 5000 and pruned > 5000


DOCS = [(1, "Alpha beta\ngamma delta"), (2, "alphabet soup\nalpha\nALPHA"), (3, None), (4, ""), (5, "ab"), (6, "Gamma ray\ndelta wing"), (7, "x" * 200_000 + "\nalpha"), (8, "alpha\u2028beta İK")]


def test_search_and_grep_find_what_all_texts_hold(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("gram", tg.F.lit("clash")).withColumn("b", tg.F.lit(0))
    index = tg.TrigramIndex(spark, f"{work_dir(spark)}/tri-{uuid.uuid4().hex}").build(docs)
    for pattern in ("alpha", "ALPHA$", "gam+a", "(soup|wing)", "a.c", "zzz", "(", "alp.*et", ""):
        for insensitive in (True, False):
            want = se.regex_search(docs, pattern, 100, insensitive).collect()
            assert index.search(docs, pattern, 100, insensitive).collect() == want, pattern
        want = sorted(map(tuple, se.grep(docs, pattern).collect()))
        assert sorted(map(tuple, index.grep(docs, pattern).collect())) == want, pattern
    assert sorted(map(tuple, index.grep(docs, "alpha", invert=True).collect())) == sorted(map(tuple, se.grep(docs, "alpha", invert=True).collect()))
    assert {r.doc_id for r in index.texts(docs, "alpha").collect()} == {1, 2, 7, 8}


def test_index_follows_added_replaced_and_removed_texts(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = tg.TrigramIndex(spark, f"{work_dir(spark)}/tri-{uuid.uuid4().hex}")
    index.add(make(DOCS))
    index.add(make([(9, "an alpha more")]))
    assert {r.doc_id for r in index.candidates("alpha").collect()} == {1, 2, 7, 8, 9}
    index.add(make([(1, "nothing of it")]))
    index.remove(make([(2, None)]))
    assert {r.doc_id for r in index.candidates("alpha").collect()} == {7, 8, 9}
    assert {r.doc_id for r in index.candidates("nothing").collect()} == {1}


def test_index_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    index = tg.TrigramIndex(spark, f"{work_dir(spark)}/tri-{uuid.uuid4().hex}").build(docs)
    assert index.search(docs, "alpha", 5).collect() == []
    index.add(spark.createDataFrame(DOCS, "doc_id long, text string"))
    assert {r.doc_id for r in index.candidates("alpha").collect()} == {1, 2, 7, 8}
    index.remove(docs.sparkSession.createDataFrame(DOCS, "doc_id long, text string"))
    assert index.candidates("alpha").collect() == []
