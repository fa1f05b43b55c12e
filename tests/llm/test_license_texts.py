"""Real licence files, whose directories hand their licence down."""

import math
from collections import Counter

from tillmart.llm import licenses


def test_license_files_are_inherited_from(spark):
    full = {name: texts[0] for name, texts in licenses.full_texts().items()}
    abridged = full["MIT"][: full["MIT"].index("THE SOFTWARE IS PROVIDED")]
    given = [(n, f"{name}/LICENSE", f"Copyright 2024 Somebody Else\n\n{text}") for n, (name, text) in enumerate(full.items())]
    given += [(100 + n, f"{name}/src/deep/code.py", "code only") for n, name in enumerate(full)]
    given += [(200, "gpl/COPYING", licenses.HEADERS["GPL-3.0"]), (201, "gpl/a/b.c", "int main"), (202, "mit/LICENSE", abridged), (203, "mit/b.c", "int main")]
    given += [(300, "none/README", "the license of the code and the terms of the work " * 40), (301, "none/b.c", None)]
    given += [(400 + n, f"other/{n}.txt", f"a story of the sea and the ships in it, number {n}, for you or for any other person") for n in range(60)]
    files = spark.createDataFrame(given, "file long, path string, text string")
    got = {r.file: (r.own_license, r.own_line, r.license, r.inherited_from) for r in licenses.scan_licenses(files, "file", "path", "text").collect()}
    for n, name in enumerate(full):
        assert got[n] == (name, -1, name, None) and got[100 + n] == (None, None, name, name)
    assert got[200] == ("GPL-3.0", -1, "GPL-3.0", None) and got[201] == (None, None, "GPL-3.0", "gpl")
    assert got[202][:2] == ("MIT", -1) and got[203] == (None, None, "MIT", "mit")
    assert all(got[n][2] is None for n in [300, 301, *range(400, 460)])


def test_filter_of_full_texts_is_exact(spark):
    """Every file that reaches the threshold by the plain formula passes the filter, and scores agree."""
    texts = {"A": ["red green blue grey " + " ".join(f"w{n}" for n in range(30))], "B": ["one two two three three three " + " ".join(f"v{n}" for n in range(10))]}
    given = [(n, f"d{n}/x", " ".join([*words_some(texts, n), *["zz"] * (n % 7)])) for n in range(80)]
    found = Counter(word for _, _, text in given for word in set(licenses.words_of(text)))
    plain = {name: some[0] for name, some in texts.items()}
    rare, vectors = licenses.weigh(plain, len(given), found, lambda n: 1 + math.log(n))
    want = {}
    for n, _, text in given:
        weights = {word: (1 + math.log(k)) * rare.get(word, licenses.rarity(len(given), 0)) for word, k in Counter(licenses.words_of(text)).items()}
        length = math.sqrt(sum(weight**2 for weight in weights.values()))
        score, name = max((sum(weight * vectors[name].get(word, 0) for word, weight in weights.items()) / length, name) for name in vectors)
        want[n] = (name, round(score, 6)) if score >= 0.6 else None
    files = spark.createDataFrame(given, "file long, path string, text string")
    rows = licenses.scan_licenses(files, "file", "path", "text", templates={"none": "qqq"}, texts=texts).collect()
    assert {r.file: r.own_license and (r.own_license, round(r.own_score, 6)) for r in rows} == want
    assert 5 < sum(score is not None for score in want.values()) < 70


def words_some(texts, n):
    words = texts["AB"[n % 2]][0].split()
    return words[n % 5 : n % 5 + 2 + n * len(words) // 100]
