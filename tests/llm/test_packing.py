"""Best-fit packing: pieces, plan and placement against plain versions."""

import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest

from tests.conftest import SF_DIR
from tests.llm import plain
from tests.llm.test_operators import frame, rows_of
from tillmart.llm import packing, queries
from tillmart.operators.staging import stage


@lru_cache(1)
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary_path())


def ids_of(text):
    return library().encode(text or "", add_special_tokens=False).ids + [0]


def check(got, docs, capacity, ids=None):
    """got: placed pieces as rows; docs: [(doc_id, token ids)]. Returns the number of sequences."""
    want = Counter()
    for doc_id, tokens in docs:
        edges = [0, *range(len(tokens) % capacity or capacity, len(tokens) + 1, capacity)]
        for piece, (start, behind) in enumerate(zip(edges, edges[1:])):
            want[doc_id, piece, start, behind - start, zlib.crc32(np.array(tokens[start:behind], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [offset for offset, _ in parts] == [sum(length for _, length in parts[:n]) for n in range(len(parts))]
        assert sum(length for _, length in parts) <= capacity
    return len(sequences)


def test_library_and_ranks_agree():
    tokenizer, words = library(), packing.encoder(queries.vocabulary_path())
    rng = random.Random(9)
    letters = [*" \n\t\r\x85　ab'sdt12é.,", "<|endoftext|>", "'ll", "'re", "  ", "\U0001f600", " ", "́"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    texts += ["".join(chr(c) for c in range(lo, lo + 200) if not 0xD800 <= c < 0xE000) for lo in range(0, 0x30000, 200)]
    for text in texts:
        assert words.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_long_texts_are_encoded_in_runs(monkeypatch):
    text = " ".join(f"word{n}  \n<|endoftext|>" for n in range(200))
    words = packing.encoder(queries.vocabulary_path())
    monkeypatch.setattr(packing, "CHUNK_CHARS", 5)
    assert words.ids(text).tolist() + [0] == ids_of(text)


@pytest.mark.parametrize("capacity", [2048, 7])
def test_packing(spark, capacity):
    rows = [row for row in rows_of(count=40) if row[1] is None or len(row[1]) < 20_000 or capacity > 7]
    docs = frame(spark, rows)
    given = [(row[0], ids_of(row[1])) for row in rows]
    packed = stage(packing.pack_documents(docs, queries.vocabulary_path(), capacity, with_ids=True), "packed")
    got = packed.collect()
    made = check(got, given, capacity)
    lengths = [r.length for r in got]
    assert -(-sum(lengths) // capacity) <= made <= plain.best_fit_sequences(lengths, capacity) + 1
    whole = packing.filled_sequences(packed).collect()
    assert len(whole) == made and sum(r.n_tokens for r in whole) == sum(lengths)
    assert sum(zlib.crc32(bytes(r.ids)) for r in whole) > 0 and all(len(r.ids) == 4 * r.n_tokens for r in whole)
    tokens = Counter(token for _, found in given for token in found)
    assert Counter(token for r in whole for token in np.frombuffer(bytes(r.ids), "<u4").tolist()) == tokens


def test_nothing_to_pack(spark):
    nothing = frame(spark, rows_of(count=3)).where("false")
    assert packing.pack_documents(nothing, queries.vocabulary_path()).count() == 0
    assert packing.plan_packing(np.zeros(9, int), 8).sequences == 0


def test_plan_holds_every_piece_once():
    rng = np.random.default_rng(3)
    for capacity, count in ((8, 1), (8, 300), (50, 2000), (50, 7), (333, 5000)):
        lengths = np.minimum(rng.geometric(4 / capacity, count), capacity)
        lengths[: count // 3] = lengths[0]  # a third of one length
        plan = packing.plan_packing(np.bincount(lengths, minlength=capacity + 1), capacity)
        length = np.sort(lengths)
        sequence, offset = plan.place(np.arange(count))
        order = np.lexsort((offset, sequence))
        sequence, offset, length = sequence[order], offset[order], length[order]
        fresh = np.append(True, sequence[1:] != sequence[:-1])
        assert (offset[fresh] == 0).all() and (offset[1:][~fresh[1:]] == (offset + length)[:-1][~fresh[1:]]).all()
        assert (offset + length).max() <= capacity and sequence.max() + 1 == plan.sequences == len(set(sequence.tolist()))
        assert plan.sequences <= plain.best_fit_sequences(lengths.tolist(), capacity) + 1


def test_best_fit_is_plain_best_fit():
    rng = np.random.default_rng(4)
    for _ in range(40):
        capacity = int(rng.integers(1, 40))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(0, 200)))
        made = packing.best_fit(np.bincount(lengths, minlength=capacity + 1), capacity)
        assert sum(count for count, _ in made) == plain.best_fit_sequences(lengths.tolist(), capacity)
        held = Counter()
        for count, parts in made:
            for length, each in parts:
                held[length] += count * each
        assert held == Counter(lengths.tolist())


def test_patterns_fill_the_capacity():
    present = np.array([1, 3, 4, 5, 6, 12])
    got = {tuple(row) for row in packing.patterns(present, 12).tolist()}
    want = {(a, b, c) for a in present for b in present for c in [0, *present] if a >= b >= c and a + b + c == 12}
    assert got == want


def test_fit_is_a_non_negative_least_squares_fit():
    rng = np.random.default_rng(5)
    histogram = rng.integers(0, 50, 25)
    shapes = packing.patterns(np.flatnonzero(histogram), 24)
    weight = (np.arange(25) / 24) ** 2

    def error(repeats):
        used = np.bincount(shapes.ravel(), np.repeat(repeats, 3), 25)
        return (weight * (used - histogram) ** 2)[1:].sum()

    fitted = packing.fit_repeats(shapes, histogram)
    assert (fitted >= 0).all()
    plainly = np.zeros(len(shapes))  # projected gradient, in small steps and for long
    for _ in range(20_000):
        used = np.bincount(shapes.ravel(), np.repeat(plainly, 3), 25)
        slope = weight * (used - histogram)
        slope[0] = 0
        plainly = np.maximum(plainly - 0.01 * slope[shapes].sum(1), 0)
    nothing = (weight * histogram.astype(float) ** 2).sum()
    assert error(fitted) - error(plainly) < 0.01 * nothing
    rounded = packing.whole_repeats(shapes, fitted, histogram)
    assert (np.bincount(shapes.ravel(), np.repeat(rounded, 3), 25)[1:] <= histogram[1:]).all() and rounded.sum() > 0.5 * fitted.sum()


def test_packing_query(spark):
    docs = [(r.doc_id, ids_of(r.text)) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = queries.packed_documents(spark, SF_DIR).collect()
    made = check(got, docs, 2048)
    assert made <= plain.best_fit_sequences([r.length for r in got], 2048)
