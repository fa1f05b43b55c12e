"""The Merkle manifest against trees built plainly."""

import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.llm import plain
from tests.llm.test_operators import frame, rows_of
from tillmart.llm import manifest
from tillmart.operators.staging import shared_folder


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    values = [doc_id, source, lang, n_chars, text]
    return plain.sha("".join("-" if value is None else f"{len(str(value).encode())}:{value}" for value in values))


def wanted(rows, fan=3):
    groups = defaultdict(list)
    for row in rows:
        groups[row[3]].append(row)
    roots, paths = [], []
    order = sorted(groups, key=lambda source: (source is not None, (source or "").encode()))
    for source in order:
        members = sorted(groups[source], key=lambda row: (row[0] is not None, row[0] or 0, leaf(row, row[1])))
        root, found = plain.merkle([leaf(row, row[1]) for row in members], fan)
        roots.append(root)
        paths.append(list(zip(members, found)))
    top, above = plain.merkle(roots, fan)
    out = Counter()
    for subroot, upper, members in zip(roots, above, paths):
        for row, lower in members:
            changed = zlib.crc32(b"" if row[0] is None else str(row[0]).encode()) % 2 == 0 and row[1] is not None
            now = leaf(row, row[1].replace("\n", "") if changed else row[1])
            for left, right in lower + upper:
                now = plain.sha(left + now + right)
            proof = plain.sha("".join(left + right for left, right in lower + upper))
            out[row[0], leaf(row, row[1]), subroot, top, proof, now, now == top] += 1
    return out


def many_rows():
    rows = rows_of(count=30)
    rows += [(1000 + n, f"line\n{n}", None, ["big", "", "ß", "src10", None][n % 5 if n > 90 else 0], n) for n in range(110)]
    return rows + [(5000, "alone\n", "en", "zz", None), (None, "a\nb", None, "big", None), (None, "a\nb", None, "big", None)]


@pytest.mark.parametrize("block_runs", [1024, 1])
def test_manifest(spark, monkeypatch, block_runs):
    monkeypatch.setattr(manifest, "BLOCK_RUNS", block_runs)
    rows = many_rows()
    docs = frame(spark, rows).withColumns({name: F.lit("x") for name in ("g", "size", "digest", "left", "right", "path", "subroot", "root", "group", "other")})
    got = manifest.document_manifest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = Counter(tuple(r) for r in got.collect())
    assert found == wanted(rows) and {row[-1] for row in found} == {True, False}


@pytest.mark.parametrize("count", [1, 4])
def test_small_trees(spark, count):
    rows = [(n, "t\n", "en", "s", 1) for n in range(count)]
    assert Counter(tuple(r) for r in manifest.document_manifest(frame(spark, rows)).collect()) == wanted(rows)
    apart = [(n, "t\n", "en", f"s{n}", 1) for n in range(count)]
    assert Counter(tuple(r) for r in manifest.document_manifest(frame(spark, apart)).collect()) == wanted(apart)


def test_other_fan_outs(spark):
    digests = [plain.sha(str(n)) for n in range(29)]
    leaves = spark.createDataFrame([("s", n, bytearray.fromhex(digest)) for n, digest in enumerate(digests)], "source string, id long, digest binary")
    for fan in (2, 5):
        root, paths = plain.merkle(digests, fan)
        for r in manifest.manifest(leaves, "source", "id", fan=fan).collect():
            assert bytes(r.root).hex() == bytes(r.subroot).hex() == root
            assert [(bytes(step.left).hex(), bytes(step.right).hex()) for step in r.path] == paths[r.id]


def test_empty_manifest(spark):
    nothing = frame(spark, rows_of(count=3)).where("false")
    assert manifest.document_manifest(nothing).count() == 0


def test_levels_do_not_stay(spark):
    rows = [(n, "t", "en", "s", 1) for n in range(30)]
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    assert manifest.document_manifest(frame(spark, rows)).count() == 30
    assert {path.name.split("-")[1] for path in set(folder.iterdir()) - before} == {"digests", "leaves", "paths"}
