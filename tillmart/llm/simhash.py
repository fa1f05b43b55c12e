"""Near-duplicates by SimHash: fingerprints, pigeonhole blocks, Hamming check, components.

A fingerprint of 64 bits is split into blocks. Two fingerprints that differ in at most d bits
agree on all but d of the blocks, so with d + 2 blocks every close pair agrees on at least two:
each choice of two blocks is a join key. Equal fingerprints are one row before the join.

A key that many fingerprints share is not joined with itself. Its rows are dealt out again by
the pigeonhole rule on the bits that the key leaves free, which are again split into d + 2
blocks, until the rest is small enough or so few bits are free that a key has few fingerprints
by their number alone. This is exact at every depth: a close pair agrees on some choice of
blocks at each, and both its rows meet under it.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillmart.llm.common import ready_workers, sha256_hex
from tillmart.operators.staging import remove_path, stage

SHINGLE_WORDS = 3
MAX_DISTANCE = 2
#: Fingerprints under one key that are compared with each other; more are dealt out by further bits.
GROUP = 64
#: Shingles hashed at a time.
CHUNK = 1 << 16
_SEED = 42


def _words(data: bytes, size: int) -> Iterator[list[bytes]]:
    """White-space words in runs that overlap by size - 1 words, so that each shingle lies in one run."""
    start, length, carried = 0, len(data), []
    while start < length:
        end = min(length, start + (1 << 20))
        while end < length and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = carried + data[start:end].lower().split()
        start = end
        if len(words) >= size or start >= length:
            yield words
            carried = words[len(words) - size + 1 :] if size > 1 else []
        else:
            carried = words


def fingerprint(data: bytes, size: int = SHINGLE_WORDS) -> int:
    """Of UTF-8 text with A-Z lowered; repeated shingles count again; no word gives 0."""
    ones, total = np.zeros(64, np.int64), 0
    for words in _words(data, size):
        if not words:
            continue
        if len(words) < size:
            if total:
                continue  # what the last run carried over; its shingles are counted
            shingles = [b" ".join(words)]
        else:
            shingles = [b" ".join(run) for run in zip(*(words[n:] for n in range(size)))]
        for start in range(0, len(shingles), CHUNK):
            some = shingles[start : start + CHUNK]
            hashes = np.fromiter((xxhash.xxh64_intdigest(shingle, _SEED) for shingle in some), "<u8", len(some))
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            total += len(some)
    return sum(1 << bit for bit in np.flatnonzero(2 * ones > total).tolist()) if total else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of docs: id, bits (the fingerprint as a signed long)."""
    ready_workers(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(entry.as_py(), shingle_words) for entry in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.int64())], ["id", "bits"])

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, bits long")


def _masks(free: list[int], distance: int) -> list[list[int]]:
    """The choices of blocks of the free bits that a close pair must agree on one of; each choice as its bits."""
    count = distance + 2
    blocks = [free[n * len(free) // count : (n + 1) * len(free) // count] for n in range(count)]
    return [[bit for block in chosen for bit in block] for chosen in combinations(blocks, count - distance)]


def _signed(bits: list[int]) -> int:
    value = sum(1 << bit for bit in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def close_pairs(distinct: DataFrame, distance: int = MAX_DISTANCE, group: int = GROUP) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column bits) that differ in at most `distance` bits; a pair may repeat.

    `fixed` is the mask of bits that a key holds, and the key the fingerprint under it, so rows
    meet only under the same choice at every depth.
    """
    rows = distinct.select("bits", F.lit(0).cast("bigint").alias("fixed"))
    masks = [list(range(64))]  # the free bits of each `fixed` met at this depth
    pairs = None
    while masks:
        wider = {}
        deal = F.lit(None).cast("array<bigint>")
        for free in masks:
            fixed = [bit for bit in range(64) if bit not in set(free)]
            choices = [sorted(fixed + chosen) for chosen in _masks(free, distance)]
            wider |= {tuple(choice): [bit for bit in range(64) if bit not in set(choice)] for choice in choices}
            deal = F.when(F.col("fixed") == _signed(fixed), F.array(*(F.lit(_signed(choice)).cast("bigint") for choice in choices))).otherwise(deal)
        rows = rows.select("bits", F.explode(deal).alias("fixed")).withColumn("key", F.col("bits").bitwiseAND(F.col("fixed")))
        rows = stage(rows.distinct(), "keys")
        sizes = rows.groupBy("fixed", "key").count()
        # The rest of 2^free fingerprints is a bound by itself: so few free bits need no further dealing.
        last = all(2 ** len(free) <= 4 * group for free in wider.values()) or any(len(free) < distance + 2 for free in wider.values())
        full = sizes.where(F.lit(not last) & (F.col("count") > group)).select("fixed", "key")
        few = sizes.where((F.col("count") > 1) & (F.lit(last) | (F.col("count") <= group))).select("fixed", "key")
        met = rows.join(few, ["fixed", "key"]).select("fixed", "key", "bits")
        other = met.select("fixed", "key", F.col("bits").alias("b"))
        close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
        found = met.withColumnRenamed("bits", "a").join(other, ["fixed", "key"]).where((F.col("a") < F.col("b")) & close).select("a", "b")
        pairs = stage(found, "pairs") if pairs is None else pairs.unionByName(stage(found, "pairs"))
        if last:
            break
        rows = stage(rows.join(full, ["fixed", "key"], "left_semi").select("bits", "fixed"), "crowded")
        present = {row.fixed for row in rows.select("fixed").distinct().collect()}  # at most the choices of this depth
        masks = [free for choice, free in wider.items() if _signed(list(choice)) in present]
    return pairs


def components(pairs: DataFrame) -> DataFrame:
    """Each node of the pairs (a, b) with the least node it can reach: node, root. Alternates two star steps until nothing moves.

    Every round is written to the shared folder. A node's neighbours are never gathered: it
    needs their minimum, an aggregate with a map-side combine, and then one row per neighbour.
    """
    spark = pairs.sparkSession
    links = stage(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        small = stage(small.where("u <> v").distinct(), "small-star")
        change = links.withColumn("side", F.lit(1)).unionByName(small.withColumn("side", F.lit(-1)))
        same = change.groupBy("u", "v").agg(F.sum("side").alias("side")).where("side <> 0").isEmpty()
        for done in (links, large):
            _forget(spark, done)
        links = small
        if same:
            break
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _forget(spark: SparkSession, staged: DataFrame) -> None:
    """A round's table goes as soon as the next one is written."""
    for path in {file.rsplit("/", 1)[0] for file in staged.inputFiles()}:
        remove_path(spark, path)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE, group: int = GROUP
) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (the least id in reach).

    Null and empty texts have fingerprint 0 and are linked like any other. Rows that share an id
    share its component if their fingerprints are linked. A null id counts only where a component
    has no other. An empty table gives an empty result; other columns play no part.
    """
    rows = stage(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    classes = stage(rows.groupBy("bits").agg(F.min("id").alias("least")), "classes")
    classes = _with_roots(classes, distance, group)
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(least, "root").select("bits", "component_id")
    return rows.join(classes, "bits").select(F.col("id").alias(id_col), _hex(F.col("bits")).alias("fingerprint"), "component_id")


def text_key(text: Column) -> Column:
    """Equal for equal texts only; a null text has a key of its own."""
    return F.coalesce(sha256_hex(text), F.lit(""))


def representatives(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE, group: int = GROUP
) -> DataFrame:
    """One row per component of near_duplicates: first_id, first_key (text_key) and n, the number of its rows with this id and text.

    The first row of a component has the least id, a null id coming last, and then the least key.
    """
    named = F.struct(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"))
    rows = stage(fingerprints(docs.select(named.alias("id"), F.col(text_col).alias("text")), "id", "text", shingle_words), "fingerprints")
    rows = rows.groupBy("bits", "id").agg(F.count(F.lit(1)).alias("n"))
    first = F.struct(F.col("id.id").isNull().alias("none"), F.col("id.id").alias("id"), F.col("id.key").alias("key"), "n")
    classes = stage(rows.groupBy("bits").agg(F.min(first).alias("first")), "classes")
    found = _with_roots(classes, distance, group).groupBy("root").agg(F.min("first").alias("first"))
    return found.select(F.col("first.id").alias("first_id"), F.col("first.key").alias("first_key"), F.col("first.n").alias("n"))


def _with_roots(classes: DataFrame, distance: int, group: int) -> DataFrame:
    """Adds to each distinct fingerprint the least one of its component."""
    nodes = components(close_pairs(classes.select("bits"), distance, group))
    return classes.join(nodes.withColumnRenamed("node", "bits"), "bits", "left").withColumn("root", F.coalesce("root", "bits"))


def _hex(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))
