"""Each corpus operator against a plain version, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_DIR
from tests.llm import plain
from tillmart.llm import bpe, decontamination, exact_dedup, language, licenses, line_dedup, quality, queries, sharding, simhash, url_filter

CLASHING = "row name level h block parts pos gone doc text_key kept_text data bits fixed key id score size part shard slot n found lang_pred words unit path2".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta Epsilon zeta Éta theta iota kappa".split()


def some_text(rng, count):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\n", "\t ", ".\n"]) for _ in range(count))


def rows_of(seed=1, count=60):
    rng = random.Random(seed)
    texts = [some_text(rng, rng.randint(0, 40)) for _ in range(count)]
    texts += [None, None, "", "", " ", "\n", "\n\n", "a", "A", "ß", "x" * 9000, some_text(rng, 30_000), "Same line\nother", "same LINE \nmore"]
    texts += [texts[3]] * 12 + [texts[5].replace(" ", "\n")] * 3
    rows = [(n, text, rng.choice(["en", "de", None]), "src0", None) for n, text in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[7], None, None, 3), (None, None, None, None, None), (None, "only here", "en", "s", 1), (2, "same id, other text", "en", "s", 1)]
    return rows


def frame(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return docs.select("*", *(F.lit("clash").alias(name) for name in CLASHING))


@pytest.fixture(scope="module")
def rows():
    return rows_of()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def test_exact_dedup(docs, nothing, rows):
    want = plain.exact([row[:2] for row in rows])
    for options in ({}, {"block_bytes": 4}, {"block_bytes": 7, "route": lambda block: F.octet_length(block).cast("bigint")}):
        some = rows if options.get("block_bytes") is None else [row for row in rows if row[1] is None or len(row[1]) < 10_000]
        given = docs if some is rows else docs.where("text IS NULL OR length(text) < 10000")
        want = plain.exact([row[:2] for row in some])
        got = exact_dedup.exact_duplicates(given, **options)
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()) == want
    assert exact_dedup.exact_duplicates(nothing).count() == 0


def test_line_dedup(docs, nothing, rows):
    for least, chars in ((10, 1), (2, 5), (1, 0)):
        want = Counter((row[0], *found) for row, found in zip(rows, plain.line_dedup([row[1] for row in rows], least, chars)))
        got = line_dedup.drop_frequent_lines(docs, min_documents=least, min_chars=chars)
        assert Counter((r.doc.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == want
    assert line_dedup.drop_frequent_lines(nothing).count() == 0


def test_native_plans_have_no_python(docs):
    from pyspark.sql import DataFrame

    def plan(rows: DataFrame) -> str:
        return rows._jdf.queryExecution().executedPlan().toString()

    files = docs.select("doc_id", "source", "text")
    for made in (line_dedup.drop_frequent_lines(docs), exact_dedup.exact_duplicates(docs), licenses.scan_licenses(files, "doc_id", "source", "text")):
        assert not any(word in plan(made) for word in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def test_decontamination(spark, docs, nothing, rows):
    rng = random.Random(5)
    text = rows[10][1] + " alpha beta gamma delta epsilon zeta éta theta iota kappa alpha"
    items = [(n, some_text(rng, rng.choice([0, 1, 2, 4, 9, 10, 11, 14]))) for n in range(30)] + [(40, text), (41, None), (42, ""), (None, "other text"), (3, "same id")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("data", F.lit(1))
    short = [row for row in rows if row[1] is None or len(row[1]) < 8000]
    given = docs.where("text IS NULL OR length(text) < 8000")
    want = Counter()
    for row in short:
        count, hit, names = plain.contamination(row[1], items)
        want[row[0], count, hit, tuple(names)] += 1
    for options in ({}, {"block_words": 40}, {"shingle_words": 2}):
        got = decontamination.contaminated_spans(given, benchmark, **options).collect()
        assert Counter((r.doc_id, r.n_words, sum(s.behind - s.first for s in r.spans), tuple(r.item_ids)) for r in got) == want
        assert all(a.behind < b.first for r in got for a, b in zip(r.spans, r.spans[1:]))
    assert decontamination.contaminated_spans(nothing, benchmark).count() == 0
    clean = decontamination.contaminated_spans(docs, benchmark.where("false")).collect()
    assert len(clean) == len(rows) and not any(r.spans or r.item_ids for r in clean)


def test_words_of_a_long_text_are_not_cut(monkeypatch):
    monkeypatch.setattr(decontamination, "CHUNK_BYTES", 7)
    text = some_text(random.Random(2), 300)
    assert [word.decode() for some in decontamination.words_of(text.encode()) for word in some] == plain.words(text)


def near_texts(seed=3):
    rng = random.Random(seed)
    base = [rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(150)]
    texts = []
    for _ in range(160):
        changed = list(base)
        for _ in range(rng.randint(0, 2)):
            changed[rng.randrange(len(changed))] = rng.choice(WORDS)
        texts.append(" ".join(changed))
    return texts


def test_simhash(spark, docs, nothing, rows):
    near = frame(spark, [(1000 + n, text, "en", "s", 1) for n, text in enumerate(near_texts())])
    given = [(row[0], row[1]) for row in rows] + [(1000 + n, text) for n, text in enumerate(near_texts())]
    bits = [plain.fingerprint(text) for _, text in given]
    roots = plain.components(bits)
    least = defaultdict(list)
    for root, (doc_id, _) in zip(roots, given):
        least[root] += [doc_id] if doc_id is not None else []
    want = Counter((doc_id, f"{value:016x}", min(least[root], default=None)) for (doc_id, _), value, root in zip(given, bits, roots))
    for group in (64, 2):
        got = simhash.near_duplicates(docs.unionByName(near), group=group)
        assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()) == want
    assert simhash.near_duplicates(nothing).count() == 0


def test_close_pairs_of_a_crowd(spark):
    rng = random.Random(8)
    base = rng.getrandbits(64)
    crowd = {base ^ sum(1 << bit for bit in rng.sample(range(64), rng.randint(0, 3))) for _ in range(400)} | {base ^ n for n in range(300)}
    signed = [value - 2**64 if value >= 2**63 else value for value in crowd]
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    for group in (4, 64):
        got = simhash.close_pairs(spark.createDataFrame([(v,) for v in signed], "bits long"), group=group)
        assert {(r.a, r.b) for r in got.collect()} == want


def test_fingerprint_of_a_text_in_runs(monkeypatch):
    text = some_text(random.Random(2), 400)
    assert simhash.fingerprint(text.encode()) == plain.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    long = " ".join([text] * 600)
    assert simhash.fingerprint(long.encode()) == plain.fingerprint(long)


def test_jump_hash():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    for shards in (1, 2, 24, 25, 1000):
        assert sharding.jump_shards(keys, shards).tolist() == [plain.jump(int(key), shards) for key in keys]
    before, after = sharding.jump_shards(keys, 24), sharding.jump_shards(keys, 25)
    moved = before != after
    assert set(after[moved]) == {24} and 0 < moved.mean() < 0.08
    with pytest.raises(ValueError):
        sharding.jump_shards(keys, 0)


def test_shards_of_all_rows(docs, rows):
    """The hash of an id is Spark's, that of a null its seed; each row's shard against the plain jump."""
    import struct

    import xxhash

    def key(doc_id):
        return 42 if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)

    got = Counter((r.doc_id, r.shard, r.grown_shard) for r in sharding.shard_rows(docs, "doc_id", "text", 24).collect())
    assert got == Counter((row[0], plain.jump(key(row[0]), 24), plain.jump(key(row[0]), 25)) for row in rows)


def test_sharding(docs, nothing, rows):
    got = sharding.shard_rows(docs, "doc_id", "text", 5).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(found) == list(range(len(found))) for found in slots.values())
    want = Counter((row[0], len((row[1] or "").encode()) + 8, zlib.crc32((row[1] or "").encode())) for row in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert all(len({(r.shard, r.grown_shard) for r in got if r.doc_id == doc_id}) == 1 for doc_id in {r.doc_id for r in got})
    assert all(r.grown_shard in (r.shard, 5) and 0 <= r.shard < 5 and r.law == "key" for r in got)
    assert sharding.shard_rows(nothing, "doc_id", "text", 5).count() == 0


def test_bpe(docs, nothing, rows):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    tokenizer = Tokenizer.from_file(path)
    want = Counter()
    for row in rows:
        ids = tokenizer.encode(row[1] or "", add_special_tokens=False).ids
        want[row[0], len(ids), np.array(ids, "<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False)] += 1
    got = bpe.encode_decode(docs, path).collect()
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in got) == want
    assert bpe.encode_decode(nothing, path).count() == 0


def test_bpe_of_odd_texts(monkeypatch):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    tokenizer, words = Tokenizer.from_file(path), bpe.Vocabulary(path)
    rng = random.Random(4)
    letters = [*" \n\t\r\x85\u3000ab'sdt12é.,", "<|endoftext|>", "'ll", "'re", "  ", "\U0001f600", "\u00a0", "\u0301"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(chr(c) for c in range(lo, lo + 200) if not 0xD800 <= c < 0xE000) for lo in range(0, 0x30000, 200)]
    texts += ["ab" * 3000, "=" * 5000, "the" * 40, " " * 3000]
    want = [np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() for text in texts]
    assert words.encode(texts) == want
    assert [words.decode(np.frombuffer(ids, "<u4")) for ids in want] == texts
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 11)
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    monkeypatch.setattr(bpe, "REMEMBERED_CHARS", 3)
    monkeypatch.setattr(bpe, "TREE_CELLS", 256)
    monkeypatch.setattr(bpe, "SIDE_BY_SIDE", 8)
    assert words.encode(texts) == want
    assert len(words.known) <= 20 and max(map(len, bpe.Vocabulary(path).known | dict.fromkeys(words.known, b""))) <= 48


def test_licenses(spark, nothing):
    apache, mit = licenses.TEMPLATES["Apache-2.0"], licenses.TEMPLATES["MIT"]
    given = [
        (1, "a/LICENSE", apache), (2, "a/b/c.py", "code\n" + "# " + mit + "\nmore code"), (3, "a/b/d.py", "code only"), (4, "a/b/e/f.py", None),
        (5, "x/y.py", ""), (6, "a//b/LICENSE", mit.upper()), (7, None, "nothing"), (8, "a/b/c.py", "code"), (9, "a/z.py", "license the code of public work"),
        (10, "q/COPYING", mit), (11, "q/LICENSE", mit), (12, "q/r/s/t.py", "x " * 50_000), (13, "ab/c.py", "none"), (13, "ab/c.py", "none"),
    ]
    files = spark.createDataFrame(given, "file long, path string, text string").withColumns({name: F.lit(0) for name in ("row", "pos", "word", "directory", "own_license")})
    got = {r.file: r for r in licenses.scan_licenses(files, "file", "path", "text").collect()}
    assert {n: (r.own_license, r.own_line, r.license, r.inherited_from) for n, r in got.items()} == {
        1: ("Apache-2.0", -1, "Apache-2.0", None), 2: ("MIT", 1, "MIT", None), 3: (None, None, "MIT", "a/b"), 4: (None, None, "MIT", "a/b"),
        5: (None, None, None, None), 6: ("MIT", -1, "MIT", None), 7: (None, None, None, None), 8: (None, None, "MIT", "a/b"), 9: (None, None, "Apache-2.0", "a"),
        10: ("MIT", -1, "MIT", None), 11: ("MIT", -1, "MIT", None), 12: (None, None, "MIT", "q"), 13: (None, None, None, None),
    }
    assert licenses.scan_licenses(files, "file", "path", "text").count() == len(given)
    assert licenses.scan_licenses(files.where("false"), "file", "path", "text").count() == 0


def test_license_scores_by_hand(spark):
    rng = random.Random(6)
    pool = sorted({word for text in licenses.TEMPLATES.values() for word in licenses.words_of(text)}) + ["foo", "bar"] * 6
    given = [(n, f"d/{n}", "\n".join(" ".join(rng.choices(pool, k=rng.randint(0, 12))) for _ in range(rng.randint(1, 4)))) for n in range(150)]
    given += [(200 + n, f"d/{200 + n}", f"Foo bar\n{text} bar") for n, text in enumerate(licenses.TEMPLATES.values())]
    found = Counter(word for _, _, text in given for word in set(licenses.words_of(text)))
    rare, vectors = licenses.weigh(licenses.TEMPLATES, len(given), found)
    want = {}
    for n, _, text in given:
        best = None
        lines = text.split("\n")
        for pos, size, unit in [(-1, 0, text), *plain.line_runs(lines, lambda line: not rare.keys().isdisjoint(licenses.words_of(line)))]:
            weights = {word: times * rare.get(word, licenses.rarity(len(given), 0)) for word, times in Counter(licenses.words_of(unit)).items()}
            length = sum(weight**2 for weight in weights.values()) ** 0.5
            for rank, name in enumerate(sorted(vectors)):
                score = round(sum(weight * vectors[name].get(word, 0) for word, weight in weights.items()) / length, 9) if length else 0
                if score >= 0.4:
                    best = max(best or (0,), (score, -pos, -size, -rank, name))
        want[n] = best and (best[4], best[0], -best[1])
    files = spark.createDataFrame(given, "file long, path string, text string")
    got = {r.file: r.own_license and (r.own_license, r.own_score, r.own_line) for r in licenses.scan_licenses(files, "file", "path", "text", threshold=0.4).collect()}
    assert got.keys() == want.keys() and sum(found is not None for found in want.values()) > 10
    for n, found in want.items():
        assert (got[n] is None) == (found is None) and (found is None or (got[n][0], got[n][2]) == (found[0], found[2]) and abs(got[n][1] - found[1]) < 1e-6)


def test_wrapped_notices_and_names(spark):
    """A notice over several lines of a long file is one unit; only a file of such a name hands its licence down, and each row has findings of its own."""
    wrapped = "int main;\n" * 60 + "// Released under\n// the MIT\n// License.\n" + "return 1;\n" * 60
    reworded = "x = 1\n" * 9 + "# This work is licensed under the terms of\n# the GNU General Public License version 3" + "\ny" * 90
    given = [
        (1, "w/a.c", wrapped), (2, "w/b.py", reworded), (3, "p/1.txt", licenses.TEMPLATES["MIT"]), (4, "p/q/2.txt", "poem"), (None, "p/same", licenses.TEMPLATES["MIT"]), (None, "p/same", "poem"),
        (5, "n/Copying.lesser", licenses.TEMPLATES["MIT"]), (6, "n/2.txt", "poem"), (7, "m/LICENSE", "All rights belong to nobody"), (8, "m/3", "poem"), (9, "k/license_of_mine.md", licenses.TEMPLATES["MIT"]), (10, "k/4", ""),
    ]
    files = spark.createDataFrame(given, "file long, path string, text string")
    got = Counter((r.file, r.own_license, r.license, r.inherited_from) for r in licenses.scan_licenses(files, "file", "path", "text").collect())
    assert got == Counter([
        (1, "MIT", "MIT", None), (2, "GPL-3.0", "GPL-3.0", None), (3, "MIT", "MIT", None), (4, None, None, None), (None, "MIT", "MIT", None), (None, None, None, None),
        (5, "MIT", "MIT", None), (6, None, "MIT", "n"), (7, None, None, None), (8, None, None, None), (9, "MIT", "MIT", None), (10, None, "MIT", "k"),
    ])
    lines = {r.file: r.own_line for r in licenses.scan_licenses(files, "file", "path", "text").collect()}
    assert lines[1] == 60 and lines[2] in (9, 10)


RULES = queries.URL_RULES


def test_rules(spark, nothing):
    given = [
        (1, "https://EXAMPLE.com/en/1", "block", "example.com/en/"), (2, "http://www.example.com/en/x?q", "allow", "www.example.com/en/"),
        (3, "http://a.b.com/#t", "allow", "com/"), (4, "http://com/", "allow", "com/"), (5, "http://notexample.com", None, None), (6, "http://q.net/es/1", "block", "net/es/"),
        (7, "http://q.net/es", None, None), (8, None, None, None), (9, "q.net/es/", None, None), (10, "x://?a/b", None, None), (11, "http://r.net/fr/://a.com/", "block", "net/fr/"),
        (12, "http://Éa.COM/é", "allow", "com/"), (13, "", None, None),
    ]
    pages = spark.createDataFrame([(n, url, None) for n, url, _, _ in given], "page_id long, url string, html string")
    pages = pages.withColumns({name: F.lit("x") for name in ("host", "path", "rule", "kind", "mass", "src", "dst")})
    got = {r.page_id: r for r in url_filter.judge_pages(pages, RULES).collect()}
    assert {n: got[n].rule for n, *_ in given} == {n: rule for n, _, _, rule in given}
    assert all(got[n].verdict == verdict for n, _, verdict, _ in given if verdict)
    assert (got[1].host, got[1].path, got[3].path, got[5].path, got[8].host, got[8].path, got[10].host, got[12].host) == ("example.com", "/en/1", "/", "", "", "", "", "Éa.com")
    assert got[8].verdict == got[9].verdict == "allow"
    assert url_filter.judge_pages(pages.where("false"), RULES).count() == 0


def test_propagation(spark):
    rng = random.Random(2)
    hosts = [f"h{n}.org" for n in range(12)] + ["good.com", "bad.net"]
    links = [(rng.choice(hosts), rng.choice(hosts)) for _ in range(60)]
    pages = [(n, f"http://{src}/p", f'<a class=x HREF = "https://{dst}/q">l</a> <a href="/local">m</a> <a href=mailto:x@y>') for n, (src, dst) in enumerate(links)]
    pages += [(200 + n, f"http://bad.net/fr/{n}", "<a href=//h1.org>") for n in range(30)]
    pages += [(100, "http://good.com/a", None), (101, "http://bad.net/es/1", "<a href='//h1.org'>"), (102, "http://good.com/b", ""), (103, "http://lonely.org/", "")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.host: (r.trust, r.distrust, r.verdict) for r in url_filter.judge_pages(frame, RULES).collect() if r.rule is None}
    edges = Counter((src, dst) for src, dst in links if src != dst) + Counter({("bad.net", "h1.org"): 31})
    trusted, distrusted = {"good.com": 2 + sum(src == "good.com" for src, _ in links)}, {"bad.net": 31}
    unruled = Counter(src for src, _ in links if src != "good.com") + Counter(["lonely.org"])

    def rank(seeds, edges):
        total, mass = sum(seeds.values()), Counter()
        out = Counter()
        for (src, _), n in edges.items():
            out[src] += n
        mass = {host: n / total for host, n in seeds.items()}
        for _ in range(300):
            moved = Counter()
            for (src, dst), n in edges.items():
                moved[dst] += mass.get(src, 0) * n / out[src]
            back = 1 - 0.85 * sum(moved.values())
            mass = {host: 0.85 * moved[host] + back * seeds.get(host, 0) / total for host in set(moved) | set(seeds)}
        return mass

    trust, distrust = rank(trusted, edges), rank(distrusted, Counter({(dst, src): n for (src, dst), n in edges.items()}))
    for host, (good, bad, verdict) in got.items():
        assert abs(good - trust.get(host, 0)) < 1e-4 and abs(bad - distrust.get(host, 0)) < 1e-4
        good, bad = trust.get(host, 0) * trusted["good.com"], distrust.get(host, 0) * distrusted["bad.net"]  # in pages
        assert verdict == ("block" if bad > 0.5 * (good + bad + unruled[host]) else "allow")
    assert {verdict for *_, verdict in got.values()} == {"allow", "block"} and got["lonely.org"] == (0, 0, "allow")


def test_quality_gradients():
    rng = np.random.default_rng(3)
    shapes = [(6, 4), (4,), (4, 3), (4, 3), (3,), (4,), (1,)]
    values = [rng.normal(0, 0.5, shape) for shape in shapes]
    x, owner, y = rng.normal(0, 1, (9, 6)), np.array([0, 0, 0, 1, 1, 2, 2, 2, 2]), np.array([1.0, 0.0, 1.0])

    def loss(values):
        model = quality.Model(*values)
        hidden, power = model.weighed(x)
        sums, weights = np.zeros((3, 4)), np.zeros(3)
        np.add.at(sums, owner, hidden * power[:, None])
        np.add.at(weights, owner, power)
        p = model.score(sums, weights)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for n, gradient in enumerate(quality._gradients(values, x, owner, y)):
        for place in np.ndindex(*shapes[n]):
            moved = [value.copy() for value in values]
            moved[n][place] += 1e-6
            assert abs((loss(moved) - loss(values)) / 1e-6 - gradient[place]) < 1e-4


def test_passages():
    texts = [b"one two three four five", b"", b"  six\nseven ", b"x", b"\n"]
    features, bag = quality.passages(texts, 2)
    assert bag.tolist() == [0, 0, 0, 2, 3, 4]
    alone = [quality.passages([text], 2)[0] for text in texts if text]
    assert np.allclose(features, np.concatenate(alone))
    assert quality.passages([b"", b""])[0].shape[0] == 0


def test_quality(spark, docs, nothing, rows):
    sf = SF_DIR.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.quality_scores(spark, sf)
    held = got.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert held > 0.95 and got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert got.agg(F.count("*"), F.countDistinct("doc_id")).first() == (1000, 1000)
    model = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    found = quality.scores(docs, model).collect()
    assert Counter(r.doc.doc_id for r in found) == Counter(row[0] for row in rows)
    assert len({r.score for r in found if r.doc.text == rows[3][1]}) == 1 and len({r.score for r in found if not r.doc.text}) == 1
    assert quality.scores(nothing, model).count() == 0
    none = spark.createDataFrame([(1, None), (2, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    assert quality.fit(docs, none) == 0.5 and quality.fit(nothing, labels) == pytest.approx(0.86, abs=0.1)
    ones = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id long, quality int")
    assert quality.fit(docs, ones) == 1.0
    assert {r.score for r in quality.scores(docs, 1.0).collect()} == {1.0}


def odd_texts():
    rng = random.Random(2)
    texts = [some_text(rng, rng.randint(1, 900)).encode() for _ in range(12)]
    texts += [None, b"", b" ", b"\n" * 300, b"x", b"y" * 700, b"a " * 400, b" " * 500 + b"word", texts[0], b"w" * 130 + b" " + b"v" * 64, "é".encode() * 90]
    return texts


@pytest.mark.parametrize("size", [16, 500, 5000])
def test_portions_change_nothing(monkeypatch, size):
    """Counts and features of a text are the same, to the last bit, alone and beside others, and whatever a portion holds."""
    import pyarrow as pa

    from tillmart.llm import grams

    texts = odd_texts()
    model = quality.train(np.random.default_rng(1).normal(0, 1, (60, quality.KINDS + quality.GRAMS)), np.repeat(np.arange(30), 2), np.arange(30) % 2, 0.5)

    def found(some):
        column = pa.array(some, pa.binary())
        packed, parts = [b""] * len(some), [np.zeros(quality.HIDDEN)] * len(some)
        for row, features in quality.bags(column, 7):
            packed[row] += features.tobytes()
            parts[row] = parts[row] + model.weighed(features)[0].sum(0)
        counts = dict(language.bucket_counts(column))
        return [(packed[n], counts[n].tobytes() if n in counts else None) for n in range(len(some))], [part.tobytes() for part in parts]

    whole, _ = found(texts)
    alone = [quality.passages([text], 7)[0].tobytes() if text else b"" for text in texts]
    assert [features for features, _ in whole] == alone and whole[3][0] and not whole[0][0] == whole[1][0]
    monkeypatch.setattr(grams, "PORTION_BYTES", size)
    assert found(texts)[0] == whole
    order = random.Random(size).sample(range(len(texts)), len(texts))
    (there, sums), (here, own) = found([texts[n] for n in order]), found(texts)
    assert there == [here[n] for n in order] and sums == [own[n] for n in order]


def test_answers_do_not_depend_on_neighbours(spark):
    """Equal models and equal answers, bit for bit, in other orders, partitions and batches."""
    sf = SF_DIR
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.limit(3).withColumn("text", F.concat("text", F.lit("\nmore")))).where("text IS NOT NULL")  # ids that repeat with other texts
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    answers = []
    try:
        for records, given in (("10000", docs.coalesce(1)), ("7", docs.repartition(5).orderBy(F.desc("doc_id"), F.desc("text")))):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
            model, names = quality.fit(given, labels), language.fit(given)
            scores = Counter((r.doc_id, r.score, r.n_passages) for r in quality.score_ids(given, model).collect())
            answers.append((scores, Counter((r.doc_id, r.lang_pred, r.score, r.rejected) for r in language.predict(given, names).collect())))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert answers[0] == answers[1]


def test_rare_languages_are_learned(spark):
    """A language of a few texts among thousands, and one of copies alone, are in the sample; copies count once in it."""
    rng = random.Random(1)
    letters = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    text = lambda lang: " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(20))
    copy = text("bb")
    rows = [(n, text("aa"), "aa") for n in range(900)] + [(1000 + n, copy, "bb") for n in range(900)] + [(3000 + n, text("cc"), "cc") for n in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, sample_rows=60)
    assert model.languages == ["aa", "bb", "cc"]
    got = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("lang <> lang_pred").count() < 20


def test_language(spark, docs, nothing, rows):
    sf = SF_DIR.replace("0.001", "0.01")
    texts = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.language_predictions(spark, sf).join(texts.select("doc_id", "lang"), "doc_id")
    right = F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))
    assert got.where("held_out").agg(right).first()[0] > 0.97
    assert got.where("held_out AND NOT rejected").agg(right).first()[0] > 0.98
    model = language.fit(texts)
    found = language.predict(docs, model).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    bare = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "a"), (5, "\u6f22"), (5, "\u6f22")], "doc_id long, text string")
    names = {r.doc_id: r.lang_pred for r in language.predict(bare, model).collect()}
    assert names[1] == names[2] == names[3] == "und" and names[4] in model.languages and names[5] in model.languages
    assert language.predict(nothing, model).count() == 0
    assert language.fit(nothing) is None and {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}


def test_held_out_rows_are_not_learned_from(spark):
    sf = SF_DIR
    texts, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    swapped = texts.withColumn("text", F.when(language.held_out(F.col("doc_id")), "zzz").otherwise(F.col("text")))
    assert np.allclose(language.fit(texts).scores, language.fit(swapped).scores)
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.allclose(quality.fit(texts, labels).e_layer, quality.fit(texts, turned).e_layer)
    assert zlib.crc32(b"17") % 3 == texts.select(F.expr("crc32(cast('17' as binary)) % 3")).first()[0]


def test_line_dedup_of_a_text_with_very_many_lines(spark):
    """Dropping half of a text's lines takes time in proportion to their number, not to its square."""
    common = [f"common {n}" for n in range(20_000)]
    long = "\n".join(line for n, shared in enumerate(common) for line in (shared, f"own {n}"))
    texts = [long, "\n".join(common)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = line_dedup.drop_frequent_lines(docs, min_documents=2)
    want = Counter((n, *found) for n, found in enumerate(plain.line_dedup(texts, 2, 1)))
    assert Counter((r.doc.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == want


def test_one_blocked_page_does_not_block_a_large_host(spark):
    urls = ["http://large.net/es/1"] + [f"http://large.net/p{n}" for n in range(20)]  # a third of all pages, one of them blocked
    urls += [f"http://spam.net/fr/{n}" for n in range(30)] + ["http://spam.net/p"] + ["http://even.net/es/1", "http://even.net/p"]
    pages = [(n, url, None) for n, url in enumerate(urls)] + [(100, "http://far.org/p", "<a href='http://large.net/p1'>"), (101, "http://farm.org/p", "<a href='http://spam.net/p'>")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = Counter((r.host, r.verdict) for r in url_filter.judge_pages(frame, RULES).collect() if r.rule is None)
    assert got == Counter({("large.net", "allow"): 20, ("spam.net", "block"): 1, ("even.net", "allow"): 1, ("far.org", "allow"): 1, ("farm.org", "block"): 1})


def test_propagation_does_not_stop_short_in_silence(spark):
    seeds = spark.createDataFrame([("allow", "n0", 1)], "kind string, host string, weight long")
    links = spark.createDataFrame([("allow", f"n{n}", f"n{n + 1}", 1) for n in range(9)], "kind string, src string, dst string, n long")
    with pytest.raises(RuntimeError):
        url_filter.propagate(seeds, links, rounds=2)
    got = {r.host: r.mass for r in url_filter.propagate(seeds, links, damping=0.3).collect()}
    total = sum(0.3**n for n in range(10))
    assert len(got) == 10 and all(abs(got[f"n{n}"] - 0.3**n / total) < 1e-5 for n in range(10))
