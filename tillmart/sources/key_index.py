"""Which commits may hold a key: a Bloom filter for each commit and key column.

A filter is cut into blocks of 4 KB, as many as its number of keys asks for, and all marks of a key lie in
one block, so a probe reads one row of the index whatever the size of the commit. Filters of any size are
exact on one side: a commit that holds the key is always named, others rarely.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits in one block: what bitmap_construct_agg fills.
BLOCK_BITS = 1 << 15
#: With three marks per key, one commit in some 200 is named without holding the key.
BITS_PER_KEY = 16
MARKS = 3

COMMIT = "commit_key"
FILTERS = f"{COMMIT} string, check int, blocks bigint, block bigint, bits binary"


def key_hash(key: Column) -> Column:
    return F.xxhash64(key)


def _marks(key: Column) -> Column:
    return F.transform(
        F.array(*[F.lit(15 * number) for number in range(MARKS)]),
        lambda shift: F.call_function("shiftrightunsigned", F.xxhash64(key, F.lit(1)), shift).bitwiseAND(F.lit(BLOCK_BITS - 1)),
    )


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(key_hash(key), blocks)


def build_filters(keys: DataFrame, bits_per_key: float = BITS_PER_KEY, few_commits: bool = True) -> DataFrame:
    """FILTERS rows from distinct (commit_key, check, key).

    ``few_commits``: the caller knows that the commits are few enough to broadcast one row for each.
    The marks are gathered by block before they are set: set in the tasks that read the keys, each
    task would hand on nearly every block of a large commit.
    """
    blocks = F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(F.count(F.lit(1)) * F.lit(bits_per_key / BLOCK_BITS))))).cast("bigint")
    sizes = keys.groupBy(COMMIT, "check").agg(blocks.alias("blocks"))
    sized = keys.join(F.broadcast(sizes) if few_commits else sizes, [COMMIT, "check"])
    key = F.col("key")
    placed = sized.select(COMMIT, "check", "blocks", _block(key, F.col("blocks")).alias("block"), _marks(key).alias("marks"))
    marks = placed.repartition(COMMIT, "check", "block").select(COMMIT, "check", "blocks", "block", F.explode("marks").alias("mark"))
    return marks.groupBy(COMMIT, "check", "blocks", "block").agg(F.bitmap_construct_agg("mark").alias("bits"))


def commits_for(filters: DataFrame, keys: DataFrame) -> DataFrame:
    """(commit_key, check, hash) of every commit that may hold one of the (check, key) rows.

    Hashes of the keys are broadcast, with one row per size of filter: the caller bounds the number of keys.
    """
    key = F.col("key")
    sizes = filters.select("check", "blocks").distinct()
    probes = keys.join(F.broadcast(sizes), "check").select(
        "check", "blocks", _block(key, F.col("blocks")).alias("block"), _marks(key).alias("marks"), key_hash(key).alias("hash")
    )

    def is_set(mark: Column) -> Column:
        byte = F.conv(F.hex(F.call_function("substring", F.col("bits"), F.floor(mark / 8).cast("int") + 1, F.lit(1))), 16, 10)
        return F.getbit(byte.cast("bigint"), (mark % 8).cast("int")) == 1

    hits = filters.join(F.broadcast(probes), ["check", "blocks", "block"])
    return hits.where(F.forall("marks", is_set)).select(COMMIT, "check", "hash").distinct()
