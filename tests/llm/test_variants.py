"""Spelling variants against a comparison of all words with all."""

import random
import re
import zlib
from collections import Counter

import pytest

from tests.llm import plain
from tests.llm.test_operators import frame, rows_of
from tillmart.llm import queries, variants


def some_words(rng, count, letters, longest):
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))): rng.randint(1, 30) for _ in range(count)}
    for word in list(words)[: count // 3]:
        place = rng.randrange(len(word))
        words.setdefault(word[:place] + word[place + 1 :] or "z", rng.randint(1, 90))
        words.setdefault(word[:place] + rng.choice(letters) + word[place:], rng.randint(1, 90))
    return words


def grouped(spark, words, **options):
    rows = spark.createDataFrame(list(words.items()), "word string, n long").selectExpr("*", "1 AS path", "'x' AS node", "2 AS form")
    got = variants.group_variants(rows, **options).collect()
    assert len(got) == len(words)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


@pytest.mark.parametrize("levels", [7, 4, 0])
def test_variants(spark, levels):
    """With all words in the trie, with the longer ones compared by hashes, and with all of those."""
    rng = random.Random(levels)
    words = some_words(rng, 150, "ab", 6) | some_words(rng, 80, "aéÿ\U0001f600", 5) | {"a" * n: 3 * n for n in (1, 2, 3, 4, 5, 6, 7)}
    assert grouped(spark, words, levels=levels) == plain.variants(words)


def test_a_very_long_word(spark):
    long = "ab" * 3000
    words = {long: 9, long[:-1]: 4, long[1:]: 20, long.replace("abab", "abxb", 1): 3, long[:2999] + long[3000:]: 50, "x" * 6: 3, "x" * 5: 9, "x" * 4: 30}
    assert grouped(spark, words, levels=5) == plain.variants(words)


def test_no_words(spark):
    assert grouped(spark, {"word": 3}) == {"word": (None, "word", 3, 0, None)}
    nothing = spark.createDataFrame([], "word string, n long")
    assert variants.group_variants(nothing).count() == 0 and variants.group_variants(nothing).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_a_chain_of_forms(spark):
    """Each word's form has a form of its own, six steps long."""
    words = {"abcdef"[:n] + "zzzzzz"[n:]: 2**n for n in range(7)}
    assert grouped(spark, words) == plain.variants(words)
    assert {root for _, root, *_ in plain.variants(words).values()} == {"abcdef"}


def test_misspelt_words(spark):
    rows = rows_of(count=80)
    rows += [(None, "Ärger ärger ÄRGER naïve×naïve straße", "de", "s", 1), (7, "x" * 9000 + " " + "X" * 9000 + " " + "x" * 9000, "en", "s", 1)]
    want = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(plain._LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run
            want[run] += len(run) >= 5
    docs = frame(spark, rows)
    got = {r.word: r.n for r in queries.misspelt_words(docs).collect()}
    assert got == {word: n for word, n in want.items() if n >= 3}
    assert queries.misspelt_words(docs.where("false")).count() == 0
