"""The registered queries against their statements, and the pipeline against a plain version."""

import math
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import actual, duck, expected
from tests.conftest import SF_DIR
from tests.llm import plain
from tests.llm.test_operators import CLASHING, frame, rows_of
from tillmart.llm import licenses, quality, queries


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_statement(spark, name):
    assert actual(queries.QUERIES[name](spark, SF_DIR)) == expected(duck(SF_DIR), queries.ORACLE[name])


def test_simhash_query(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()
    bits = [plain.fingerprint(row.text) for row in docs]
    want = {row.doc_id: (f"{value:016x}", docs[root].doc_id) for row, value, root in zip(docs, bits, plain.components(bits))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.simhash_components(spark, SF_DIR).collect()} == want


def test_bpe_query(spark):
    from hashlib import sha256

    from tokenizers import Tokenizer

    tokenizer, want = Tokenizer.from_file(queries.vocabulary_path()), {}
    for row in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        ids = tokenizer.encode(row.text, add_special_tokens=False).ids
        want[row.doc_id] = (len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), plain.sha(tokenizer.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.bpe_digests(spark, SF_DIR).collect()} == want


def test_license_query(spark):
    """Every row's finding against cosines computed plainly over the whole table."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    found = Counter(word for row in docs for word in set(licenses.words_of(row.text or "")))
    unknown = licenses.rarity(len(docs), 0)

    def cosines(text, rare, vectors, times):
        weights = {word: times(n) * rare.get(word, unknown) for word, n in Counter(licenses.words_of(text)).items()}
        length = sum(weight**2 for weight in weights.values()) ** 0.5
        return {name: round(sum(weight * vector.get(word, 0) for word, weight in weights.items()) / length, 9) if length else 0 for name, vector in vectors.items()}

    long = {f"{name}\0{n}": text for name, some in sorted(licenses.full_texts().items()) for n, text in enumerate(some)}
    short = (*licenses.weigh(licenses.TEMPLATES, len(docs), found), float)
    full = (*licenses.weigh(long, len(docs), found, lambda n: 1 + math.log(n)), lambda n: 1 + math.log(n))
    want = {}
    for row in docs:
        lines = (row.text or "").split("\n")
        units = [(-1, 0, row.text or ""), *plain.line_runs(lines, lambda line: not short[0].keys().isdisjoint(licenses.words_of(line)))]
        fits = [(score, -pos, -size, -rank, name) for pos, size, unit in units for rank, (name, score) in enumerate(sorted(cosines(unit, *short).items())) if score >= 0.6]
        fits += [(score, 1, 0, -rank - len(licenses.TEMPLATES), name.partition("\0")[0]) for rank, (name, score) in enumerate(sorted(cosines(row.text or "", *full).items())) if score >= 0.6]
        best = max(fits, default=None)
        want[row.doc_id] = best and (best[4], -best[1], best[0])
    got = queries.license_scan(spark, SF_DIR).collect()
    assert len(got) == len(docs) and sum(best is not None for best in want.values()) >= 3
    for r in got:
        best = want[r.doc_id]
        assert r.inherited_from is None and r.license == r.own_license and (r.own_license is None) == (best is None)
        assert best is None or ((r.own_license, r.own_line) == best[:2] and abs(r.own_score - best[2]) < 1e-6)


def test_license_query_inherits(spark, tmp_path):
    """A document that is a notice as a whole licenses the bare documents of its source and language, and of no other."""
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"]
    long = "\n".join(["words of no licence at all"] * 40 + [gpl])
    given = [(1, "a", "en", f"Ab.\n{mit}"), (2, "a", "en", "prose"), (3, "a", "en", None), (4, "a", "de", "prose"), (5, "b", "en", long), (6, "b", "en", "prose")]
    given += [(7, "a", "en", long), (8, "b", "en", "prose on licensing"), (None, "a", "en", "prose"), (9, None, None, mit), (10, None, None, "prose")]
    spark.createDataFrame(given, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r.doc_id, r.own_license, r.license, r.inherited_from) for r in queries.license_scan(spark, str(tmp_path)).collect())
    assert got == Counter([
        (1, "MIT", "MIT", None), (2, None, "MIT", "a/en"), (3, None, "MIT", "a/en"), (4, None, None, None), (5, "GPL-3.0", "GPL-3.0", None),
        (6, None, None, None), (7, "GPL-3.0", "GPL-3.0", None), (8, None, None, None), (None, None, "MIT", "a/en"),
        (9, "MIT", "MIT", None), (10, None, None, None),
    ])


def test_sharding_query(spark):
    rows = queries.jump_shards(spark, SF_DIR).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    keys = {doc_id: xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42) for doc_id in texts}
    want = {doc_id: (len(data) + 8, zlib.crc32(data), plain.jump(keys[doc_id], 24), plain.jump(keys[doc_id], 25)) for doc_id, data in texts.items()}
    assert {r.doc_id: (r["size"], r.text_crc32, r.shard, r.grown_shard) for r in rows} == want
    assert len(rows) == 200 and {r.shard for r in rows} <= set(range(24)) and all(r.grown_shard in (r.shard, 24) for r in rows)
    assert all(sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows))) for shard in range(24))


def test_url_query(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    rows = queries.url_verdicts(spark, SF_DIR).collect()
    assert {r.page_id for r in rows} == set(pages) and {r.verdict for r in rows} == {"allow", "block"}
    for r in rows:
        after = pages[r.page_id].split("://", 1)[1]
        host = after.split("/")[0].split("?")[0].split("#")[0]
        path = after[len(host) :].split("?")[0].split("#")[0]
        fits = [rule for rule in queries.URL_RULES if (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path)]
        best = max(fits, key=lambda rule: len(rule.host + rule.path), default=None)
        assert (r.host, r.path, r.rule) == (host, path, best and best.host + best.path) and (best is None or r.verdict == best.verdict)


def test_pipeline(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary_path())
    good = {r.doc_id for r in queries.quality_scores(spark, SF_DIR).where("predicted = 1").collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect() if r.doc_id in good]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    docs = [(doc_id, found[2]) for (doc_id, _), found in zip(docs, plain.line_dedup([text for _, text in docs]))]
    roots = plain.components([plain.fingerprint(text) for _, text in docs])
    docs = [row for n, row in enumerate(docs) if roots[n] == n]
    windows = {(len(w), tuple(w)) for _, text in items for parts in [plain.words(text)] for n in range(max(1, len(parts) - 9)) for w in [parts[n : n + 10]]}
    sizes = {size for size, _ in windows}

    def leaks(text):
        parts = plain.words(text)
        return any((size, tuple(parts[n : n + size])) in windows for size in sizes for n in range(len(parts) - size + 1))

    want = Counter((doc_id, len(tokenizer.encode(text, add_special_tokens=False).ids), plain.sha(text)) for doc_id, text in docs if not leaks(text))
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF_DIR).collect()) == want


def test_stages_take_anything(spark, tmp_path):
    rows = rows_of(count=20)
    docs = frame(spark, rows)
    clash = {name: F.lit(1) for name in ("stays", "leak", "component_id", "repeated", "spans", "kept")}
    docs = docs.withColumns(clash)
    for name, apply in corpus_pipeline.STAGES:
        out = apply(spark, docs, SF_DIR)
        assert apply(spark, docs.where("false"), SF_DIR).count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            left = Counter((r.doc_id, r.text) for r in out.collect())
            if "line" in name:
                assert sum(left.values()) == len(rows)
            elif "simhash" in name:
                bits = [plain.fingerprint(row[1]) for row in rows]
                roots = plain.components(bits)
                of = {(row[0], row[1]): root for row, root in zip(rows, roots)}
                assert sorted(of[key] for key in left.elements()) == sorted(set(roots))  # one row of each component
            else:
                assert not left - Counter((row[0], row[1]) for row in rows)
        else:
            assert out.count() == len(rows)
    assert len(corpus_pipeline.STAGES) == 5 and set(CLASHING) < set(docs.columns)


def test_quality_stage_keeps_what_it_does_not_reject(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    kept = corpus_pipeline.keep_good(spark, docs, SF_DIR)
    want = quality.score_ids(docs, quality.fit(docs, labels)).where("score >= 0.5").select("doc_id")
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in want.collect()}


def test_near_copies_leave_one_row_per_component(spark):
    """Ids that repeat or are null do not stand for one document."""
    far = [" ".join(f"{word}{n}" for n in range(40)) for word in ("red", "green", "blue", "grey", "pink")]
    given = [(None, far[0]), (None, far[1]), (None, far[1]), (1, far[2]), (1, far[3]), (None, far[3]), (2, far[4]), (1, far[4]), (3, None), (None, "")]
    docs = frame(spark, [(doc_id, text, "en", "s", 1) for doc_id, text in given])
    out = corpus_pipeline.keep_one_of_near_copies(spark, docs, SF_DIR)
    want = [(None, far[0]), (None, far[1]), (1, far[2]), (1, far[3]), (1, far[4]), (3, None)]
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(want)


def test_leaks_take_no_row_with_the_same_id(spark):
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").where("length(text) > 100").first().text
    given = [(None, item), (None, "clean text"), (None, None), (1, f"so {item}"), (1, "other clean text"), (2, item)]
    docs = frame(spark, [(doc_id, text, "en", "s", 1) for doc_id, text in given])
    out = corpus_pipeline.drop_leaks(spark, docs, SF_DIR)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([given[1], given[2], given[4]])
