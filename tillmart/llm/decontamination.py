"""Benchmark decontamination by a prefix-filtered set join with exact verification.

Benchmark items are cut into windows of consecutive words, each seen as a set of shingles. The
shingles are ordered by the number of documents that hold them, rarest first. A window that a
document contains shares all its shingles, so the necessary prefix is one shingle, the rarest:
documents are joined on it alone. A match at some word fixes where the window must begin; the
positional and length bounds drop windows that would begin before the text or end behind it,
and the rest are compared word by word, so every reported word is an exact match.

The benchmark is a stated set of queries: its windows are handled in blocks of bounded size,
and the documents are read against each block. Only windows travel to the workers.
"""

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmart.llm.common import ready_workers
from tillmart.operators.staging import stage

WINDOW_WORDS = 10
SHINGLE_WORDS = 5
#: Benchmark words sent to the workers at once; a longer benchmark is read against the documents block by block.
BLOCK_WORDS = 200_000
#: Bytes of a text cut into words at a time.
CHUNK_BYTES = 1 << 20

#: On UTF-8 bytes with A-Z lowered this is `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, letters, all that is not ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_EDGE = re.compile(rb"[^0-9a-z\x80-\xff]")


def words_of(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, some megabytes of text at a time, cut between words."""
    start, length = 0, len(data)
    while start < length:
        edge = _EDGE.search(data, start + CHUNK_BYTES) if start + CHUNK_BYTES < length else None
        end = edge.start() if edge else length
        yield _WORD.findall(data[start:end].lower())
        start = end


def _word_ids(data: bytes, ids: dict[bytes, int]) -> np.ndarray:
    """The benchmark's number of each word; 0 for a word it does not have."""
    parts = [np.fromiter(map(lambda word: ids.get(word, 0), words), np.int64, len(words)) for words in words_of(data)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _rolled(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` words, 0 where a word is unknown. It only routes; equality is checked on words."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(count, size, np.uint64)
    known = np.ones(count, bool)
    for n in range(size):
        part = words[n : n + count]
        known &= part > 0
        out = (out ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out[out == 0] = 1
    return np.where(known, out, np.uint64(0))


class Windows(NamedTuple):
    """A block of the benchmark, ready for the workers."""

    ids: dict[bytes, int]
    words: list[np.ndarray]  # of each distinct window
    items: list[tuple[str, ...]]  # the item ids that have it


def _windows(items: list[tuple[str, bytes]], size: int) -> Windows:
    ids: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[str]] = {}
    for item, data in items:
        words = [ids.setdefault(word, len(ids) + 1) for some in words_of(data) for word in some]
        for start in range(max(1, len(words) - size + 1) if words else 0):
            found.setdefault(tuple(words[start : start + size]), set()).add(item)
    return Windows(ids, [np.array(words, np.int64) for words in found], [tuple(sorted(names)) for names in found.values()])


def _lookup(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys are found: their positions, and their places among sorted_keys."""
    if not len(sorted_keys) or not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    hit = np.flatnonzero((sorted_keys[place] == keys) & (keys != 0))
    return hit, place[hit]


def _shingle_sizes(windows: Windows, shingle: int) -> list[int]:
    return sorted({min(shingle, len(words)) for words in windows.words})


def _documents_with(texts: DataFrame, windows: Windows, shingle: int) -> dict[tuple[int, int], int]:
    """The number of documents that hold each shingle of the benchmark, over all documents; bounded by the block."""
    keys = {
        size: np.unique(np.concatenate([_rolled(words, size) for words in windows.words if min(shingle, len(words)) == size]))
        for size in _shingle_sizes(windows, shingle)
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {size: np.zeros(len(known), np.int64) for size, known in keys.items()}
        for batch in batches:
            for entry in batch.column(0):
                words = _word_ids(entry.as_py() or b"", windows.ids)
                for size, known in keys.items():
                    counts[size][np.unique(_lookup(known, _rolled(words, size))[1])] += 1
        for size, count in counts.items():
            met = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array([size] * len(met), pa.int32()), pa.array(met, pa.int64()), pa.array(count[met], pa.int64())], ["size", "place", "n"]
            )

    rows = texts.select("data").mapInArrow(run, "size int, place long, n long").groupBy("size", "place").agg(F.sum("n").alias("n"))
    return {(row.size_, int(keys[row.size_][row.place])): row.n for row in rows.withColumnRenamed("size", "size_").toLocalIterator()}


class Prefixes(NamedTuple):
    """The rarest shingle of each window: per shingle size the sorted hashes, and for each the windows with the shingle's place in them."""

    hashes: dict[int, np.ndarray]
    windows: dict[int, list[list[tuple[int, int]]]]


def _prefixes(windows: Windows, shingle: int, frequency: dict[tuple[int, int], int]) -> Prefixes:
    chosen: dict[int, dict[int, list[tuple[int, int]]]] = {}
    for n, words in enumerate(windows.words):
        size = min(shingle, len(words))
        hashes = _rolled(words, size).tolist()
        place = min(range(len(hashes)), key=lambda p: (frequency.get((size, hashes[p]), 0), hashes[p], p))
        chosen.setdefault(size, {}).setdefault(hashes[place], []).append((n, place))
    ordered = {size: sorted(found.items()) for size, found in chosen.items()}
    return Prefixes(
        {size: np.array([key for key, _ in found], np.uint64) for size, found in ordered.items()},
        {size: [places for _, places in found] for size, found in ordered.items()},
    )


def _occurrences(words: np.ndarray, windows: Windows, prefixes: Prefixes) -> Iterator[tuple[int, int]]:
    """Each window and start at which the words are exactly the window's."""
    for size, hashes in prefixes.hashes.items():
        for position, found in zip(*_lookup(hashes, _rolled(words, size))):
            for window, place in prefixes.windows[size][found]:
                start, wanted = position - place, windows.words[window]
                if start >= 0 and start + len(wanted) <= len(words) and np.array_equal(words[start : start + len(wanted)], wanted):
                    yield window, start


def _hits(data: bytes, windows: Windows, prefixes: Prefixes) -> tuple[int, list[tuple[int, int]], set[str]]:
    """The number of words, the runs of words inside occurrences (start, end; joined, in order), the items met."""
    words = _word_ids(data, windows.ids)
    spans, items = [], set()
    for window, start in _occurrences(words, windows, prefixes):
        spans.append((start, start + len(windows.words[window])))
        items.update(windows.items[window])
    joined: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if joined and start <= joined[-1][1]:
            joined[-1] = joined[-1][0], max(joined[-1][1], end)
        else:
            joined.append((start, end))
    return len(words), joined, items


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of about block_words words; one item may be longer and is a block of its own."""
    items, held = [], 0
    columns = benchmark.select(F.col(id_col).cast("string").alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("data"))
    for row in columns.toLocalIterator():
        items.append((row.id or "", bytes(row.data)))
        held += len(items[-1][1]) // 4 + 1
        if held >= block_words:
            yield items
            items, held = [], 0
    yield items


def contaminated_spans(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    window_words: int = WINDOW_WORDS, shingle_words: int = SHINGLE_WORDS, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per row of docs: row, id, n_words, spans (first word, word behind), item_ids, both sorted.

    A window is window_words consecutive words of an item; an item of fewer, but not none, is one
    window. Null and empty texts have no words and no window; an empty benchmark or table gives
    no spans or no rows. Rows that share an id are judged each by itself, items that share an id
    count as one, and a null item id as ''. Other columns play no part.
    """
    ready_workers(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("data"))
    result = None
    for items in _blocks(benchmark, item_id_col, item_text_col, block_words):
        windows = _windows(items, window_words)
        prefixes = _prefixes(windows, shingle_words, _documents_with(texts, windows, shingle_words) if windows.words else {})
        if result is None:
            result = stage(_found(texts, windows, prefixes, False), "spans")
        elif windows.words:
            # What a further block finds depends on the text alone, so it is joined on the text's digest.
            more = stage(_found(texts, windows, prefixes, True).drop("id", "n_words").dropDuplicates(["text_key"]), "more-spans")
            result = result.join(more.toDF("text_key", "more_spans", "more_items"), "text_key", "left").select(
                "id", "text_key", "n_words", _union(F.col("spans"), F.col("more_spans")).alias("spans"),
                F.when(F.col("more_items").isNull(), F.col("item_ids")).otherwise(F.array_sort(F.array_union("item_ids", "more_items"))).alias("item_ids"),
            )
    return result.select(F.col("id").alias(id_col), "n_words", "spans", "item_ids")


def _union(left: Column, right: Column) -> Column:
    """Runs of two lists, joined where they meet."""
    def add(done: Column, run: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["first"].alias("first"), F.greatest(last["behind"], run["behind"]).alias("behind"))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))
        return F.when(F.size(done) == 0, F.array(run)).when(run["first"] <= last["behind"], joined).otherwise(F.concat(done, F.array(run)))

    none = F.array().cast("array<struct<first:long,behind:long>>")
    return F.when(right.isNull(), left).otherwise(F.aggregate(F.array_sort(F.concat(left, right)), none, add))


def _found(texts: DataFrame, windows: Windows, prefixes: Prefixes, hits_only: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("first", pa.int64()), ("behind", pa.int64())]))
        for batch in batches:
            kept, keys, counts, spans, items = [], [], [], [], []
            for n, entry in enumerate(batch.column(1)):
                data = entry.as_py()
                count, joined, names = _hits(data, windows, prefixes)
                if hits_only and not joined:
                    continue
                kept.append(n)
                keys.append(hashlib.md5(data).digest())
                counts.append(count)
                spans.append([{"first": int(first), "behind": int(behind)} for first, behind in joined])
                items.append(sorted(names))
            columns = [
                batch.column(0).take(pa.array(kept, pa.int64())), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(spans, span),
                pa.array(items, pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text_key", "n_words", "spans", "item_ids"])

    id_type = texts.schema["id"].dataType.simpleString()
    kinds = "text_key binary, n_words long, spans array<struct<first:long,behind:long>>, item_ids array<string>"
    return texts.mapInArrow(run, f"id {id_type}, {kinds}")
