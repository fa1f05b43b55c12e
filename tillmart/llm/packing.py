"""Best-fit packing of tokenised documents into sequences, by patterns of few lengths fitted to the length histogram.

A pattern is two or three piece lengths that fill a sequence exactly. How often each pattern is
repeated is a non-negative least-squares fit of the patterns to the histogram of lengths; the fit
is rounded to whole repeats that the histogram can pay for, and the pieces left over are packed
best fit, longest first, into sequences of any number of pieces.

Patterns, fit and left-over packing see the histogram alone, one number per length, so their cost
depends on the capacity and not on the corpus. The corpus is tokenised once; pieces are numbered
within their length by the parts they lie in, so a length that a third of all pieces share is never
gathered, and the number names the sequence and the place in it.
"""

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillmart.llm import bpe
from tillmart.llm.common import ready_workers
from tillmart.operators.staging import stage

CAPACITY = 2048
END_OF_DOCUMENT = 0
#: The fit ends when a step lowers the squared error by less than this share, or after so many steps.
TOLERANCE, STEPS = 1e-5, 400
#: Texts of a worker's batch are encoded one by one, in runs of this many characters cut before white space.
CHUNK_CHARS = 1 << 18
#: Pieces handed back to Spark at a time.
BATCH_PIECES = 1000


class Encoder:
    """Token ids of a byte-level vocabulary file, by a library that merges by rank.

    Ranks are the file's ids, so the file must number its tokens in the order of its merges.
    """

    def __init__(self, path: str):
        import tiktoken

        words = bpe.vocabulary(path)
        plain = {number: token for number, token in words.bytes_of.items() if number not in words.special.values()}
        if sorted(words.merged.tolist()) != words.merged.tolist() or len(plain) != 256 + len(words.merged):
            raise ValueError(f"{path}: ids do not follow the order of merges")
        with open(path, encoding="utf-8") as file:
            if (json.load(file).get("normalizer") or {}) != {}:
                raise ValueError(f"{path}: a normalizer is not supported")
        #: Fixed value: the split pattern of byte-level vocabularies.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={token: number for number, token in plain.items()}, special_tokens=words.special)

    def ids(self, text: str) -> np.ndarray:
        parts = [self.library.encode_to_numpy(chunk, allowed_special="all") for chunk in bpe.chunks(text, CHUNK_CHARS)]
        return np.concatenate(parts) if len(parts) != 1 else parts[0]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(
    docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, end: int = END_OF_DOCUMENT, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, and ids (little-endian unsigned 32-bit integers) if asked for.

    A document is its ids and then `end`; a null or empty text is `end` alone. One of more than
    `capacity` ids is cut so that its first piece may be shorter and the others are full.
    """
    ready_workers(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The pieces of a batch, some megabytes of ids or one document at a time."""
        words = encoder(vocabulary_path)
        owners, held = [], []

        def filled() -> pa.RecordBatch:
            columns = list(zip(*held))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: len(columns)]
            arrays = [batch.column(0).take(pa.array(owners, pa.int64())), *(pa.array(column, kind) for column, kind in zip(columns, kinds))]
            return pa.RecordBatch.from_arrays(arrays, ["id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

        for n, text in enumerate(batch.column(1)):
            ids = np.append(words.ids(text.as_py() or ""), end).astype("<u4")
            edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
            for piece, (start, behind) in enumerate(zip(edges, edges[1:])):
                data = ids[start:behind].tobytes()
                owners.append(n)
                held.append((piece, start, behind - start, zlib.crc32(data), *([data] if with_ids else [])))
            if len(held) >= BATCH_PIECES:
                yield filled()
                owners, held = [], []
        if held:
            yield filled()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from cut(batch)

    return rows.mapInArrow(run, f"id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """All twos and threes of present lengths that fill the capacity, longest first; a two has 0 in the third place."""
    has = np.zeros(capacity + 1, bool)
    has[present[(present > 0) & (present < capacity)]] = True
    known = np.flatnonzero(has)
    found = [np.zeros((0, 3), np.int64)]
    for first in known[::-1]:
        second = known[(known <= first) & (2 * known >= capacity - first) & (known <= capacity - first)]
        third = capacity - first - second
        fits = (third == 0) | has[third]
        found.append(np.stack([np.full(fits.sum(), first), second[fits], third[fits]], axis=1))
    return np.concatenate(found)


def fit_repeats(shapes: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Non-negative repeats of the patterns with least squared error to the histogram, each length's error weighed by the length.

    Multiplicative steps: a factor's numerator and denominator are the two halves of the
    gradient, so repeats stay non-negative and the error never grows.
    """
    if not len(shapes):
        return np.zeros(0)
    lengths = np.arange(len(histogram), dtype=np.float64)
    weight = (lengths / lengths[-1]) ** 2  # what is left over should be short
    wanted = histogram.astype(np.float64)
    flat = shapes.ravel()

    def pull(values: np.ndarray) -> np.ndarray:
        return (weight * values)[shapes].sum(1)

    def used(repeats: np.ndarray) -> np.ndarray:
        out = np.bincount(flat, np.repeat(repeats, 3), len(histogram))
        out[0] = 0
        return out

    aim = pull(wanted)
    repeats = aim / np.maximum(pull(used(np.ones(len(shapes)))), 1e-300)
    error = np.inf
    for _ in range(STEPS):
        taken = used(repeats)
        now = (weight * (taken - wanted) ** 2).sum()
        if error - now <= TOLERANCE * now:
            break
        error = now
        repeats = repeats * aim / np.maximum(pull(taken), 1e-300)
    return repeats


def whole_repeats(shapes: np.ndarray, repeats: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """The repeats rounded so that their running sum stays within one of the fit's, and cut to what the histogram holds."""
    rounded = np.diff(np.floor(np.concatenate([[0.0], np.cumsum(repeats)]) + 1e-9)).astype(np.int64)
    left = histogram.astype(np.int64).tolist()
    for n in np.flatnonzero(rounded):
        first, second, third = shapes[n].tolist()
        need: dict[int, int] = {}
        for length in (first, second, third):
            if length:
                need[length] = need.get(length, 0) + 1
        times = min(int(rounded[n]), *(left[length] // times for length, times in need.items()))
        rounded[n] = times
        for length, each in need.items():
            left[length] -= each * times
    return rounded


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit, longest first, of all pieces at once: (sequences, [(length, pieces of it in each)]).

    Equal sequences are one entry with a count, and equal lengths are placed together, so the work
    depends on the number of different lengths alone.
    """
    groups: list[list[tuple[int, tuple | None]]] = [[] for _ in range(capacity + 1)]  # by space left: (sequences, what is in them)
    open_ = np.zeros(capacity + 1, bool)

    def put(space: int, count: int, inside: tuple | None) -> None:
        if count:
            groups[space].append((count, inside))
            open_[space] = True

    for length in np.flatnonzero(histogram)[::-1].tolist():
        left = int(histogram[length])
        while left:
            above = np.flatnonzero(open_[length:])
            if len(above):
                space = length + int(above[0])
                count, inside = groups[space].pop()
                open_[space] = bool(groups[space])
            else:
                space, count, inside = capacity, left, None
            each = space // length
            full = min(count, left // each)
            put(space - each * length, full, (inside, length, each))
            left -= full * each
            if full < count and left:  # fewer than one sequence's fill remain
                put(space - left * length, 1, (inside, length, left))
                full, left = full + 1, 0
            if inside is not None or space < capacity:
                put(space, count - full, inside)
    out = []
    for found in groups:
        for count, inside in found:
            parts = []
            while inside is not None:
                inside, length, each = inside
                parts.append((length, each))
            out.append((count, parts[::-1]))
    return out


class Plan(NamedTuple):
    """Where the n-th piece goes, pieces being numbered by length. Segments are runs of pieces that one pattern takes."""

    first_of_length: np.ndarray
    first: np.ndarray  # piece number with which a segment begins
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    length: np.ndarray
    sequences: int

    def place(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        segment = np.searchsorted(self.first, number, "right") - 1
        inside = number - self.first[segment]
        each = self.each[segment].astype(np.int64)
        return self.sequence[segment] + inside // each, self.offset[segment] + inside % each * self.length[segment]


def plan_packing(histogram: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """The whole plan from the number of pieces of each length, 0 to capacity."""
    histogram = np.asarray(histogram, np.int64)
    shapes = patterns(np.flatnonzero(histogram), capacity)
    repeats = whole_repeats(shapes, fit_repeats(shapes, histogram), histogram)
    shapes, repeats = shapes[repeats > 0], repeats[repeats > 0]
    left = histogram - np.bincount(shapes.ravel(), np.repeat(repeats, 3), capacity + 1).astype(np.int64)
    left[0] = 0
    begins = np.cumsum(repeats) - repeats
    total = int(repeats.sum())
    columns = [
        np.stack([shapes[:, n], begins, np.ones_like(begins), shapes[:, :n].sum(1), repeats], axis=1)[shapes[:, n] > 0] for n in range(3)
    ]
    rest = []
    for count, parts in best_fit(left, capacity):
        offset = 0
        for length, each in parts:
            rest.append((length, total, each, offset, count))
            offset += length * each
        total += count
    columns.append(np.array(rest, np.int64).reshape(-1, 5))
    table = np.concatenate(columns)
    table = table[np.argsort(table[:, 0], kind="stable")]
    pieces = table[:, 2] * table[:, 4]
    if not np.array_equal(np.bincount(table[:, 0], pieces, capacity + 1).astype(np.int64)[1:], histogram[1:]):
        raise AssertionError("the plan does not hold every piece once")
    first_of_length = np.cumsum(histogram) - histogram
    return Plan(first_of_length, np.cumsum(pieces) - pieces, table[:, 1].copy(), table[:, 2].astype(np.int32), table[:, 3].astype(np.int32), table[:, 0].astype(np.int32), total)


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with a `length` of 1 to capacity, and their sequence_id and offset.

    `pieces` must be a staged table with `part` and `row`, the part in which each row was written
    and a number that orders rows in it. Sequences count from 0; every one is filled without gaps
    from its start. An empty table gives an empty result.
    """
    counts = stage(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row per length
        histogram[row.length] = row.n
    plan = pieces.sparkSession.sparkContext.broadcast(plan_packing(histogram, capacity))  # segments: three a pattern at most
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy("row")) - 1
    numbered = pieces.withColumn("inside", inside).join(starts, ["length", "part"])
    kept = [name for name in pieces.columns if name not in ("part", "row")]
    numbered = numbered.select(*kept, (F.col("before") + F.col("inside")).alias("number"))
    length_at = kept.index("length")
    types = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in numbered.schema if field.name != "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(length_at).to_numpy()
            sequence, offset = plan.value.place(plan.value.first_of_length[lengths] + batch.column(len(kept)).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*kept, "sequence_id", "offset"])

    return numbered.mapInArrow(run, f"{types}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per piece of every row of docs: id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for.

    Repeated rows and null ids are documents of their own. Null and empty texts are one id, the
    end of the document. An empty table gives an empty result. Other columns play no part.
    """
    pieces = token_pieces(docs, vocabulary_path, capacity, END_OF_DOCUMENT, id_col, text_col, with_ids)
    pieces = stage(pieces.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "pieces")
    return place_pieces(pieces, capacity).withColumnRenamed("id", id_col)


def filled_sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The sequences of pack_documents(with_ids=True): sequence_id, n_tokens, ids, and the ids of their documents in order.

    A group holds `capacity` ids at most, so none grows with the corpus.
    """
    part = F.struct("offset", F.col(id_col).alias("id"), "ids")
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(part)).alias("parts"))
    joined = F.unhex(F.array_join(F.transform("parts", lambda one: F.hex(one["ids"])), ""))
    return rows.select("sequence_id", "n_tokens", joined.alias("ids"), F.transform("parts", lambda one: one["id"]).alias("documents"))
