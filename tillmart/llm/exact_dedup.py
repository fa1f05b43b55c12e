"""Exact deduplication by deterministic block naming.

A normalised text is cut into blocks of a fixed number of bytes. Equal blocks get the same
integer: distinct blocks are dealt out by a hash, sorted inside each part and numbered. Then
adjacent names are paired, distinct pairs are named the same way, and so on until one name is
left of each text. Texts are equal exactly when their number of levels and last names agree;
a hash only routes blocks, and blocks whose hashes collide are told apart by their bytes.

Skew: distinct blocks and pairs are formed with a map-side combine, and names return through
joins with nothing above them that needs their partitioning, so Spark can split a hot name.
No task holds more than one text. The text is shuffled once; all later rows are a few numbers.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmart.llm.common import sha256_hex
from tillmart.operators.staging import stage

BLOCK_BYTES = 4096
#: Stands for the missing right half of a pair; names are never negative but for ties, which end at -1 - 2^62.
_NOTHING = -(2**63)


def normalise(text: Column) -> Column:
    """Null counts as empty; each run of white space becomes one space. Single spaces need no replacing."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _blocks(text: Column, size: int) -> Column:
    """The text's bytes in pieces; an empty text is one empty piece. Slices of bytes need no scan from the start."""
    # The bytes are named once, as the argument of a lambda: inside the inner one they would be encoded anew for each block.
    count = F.greatest(F.lit(1), F.ceil(F.octet_length(text) / F.lit(size))).cast("int")
    cut = F.transform(
        F.array(F.encode(text, "UTF-8")),
        lambda data: F.transform(F.sequence(F.lit(0), count - 1), lambda n: F.substring(data, n * F.lit(size) + 1, F.lit(size))),
    )
    return F.get(cut, F.lit(0))


def _numbered(distinct: DataFrame, *order: str) -> DataFrame:
    """Sorted inside each part and numbered: a recomputed part gives the same numbers."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def _named_blocks(texts: DataFrame, size: int, route) -> tuple[DataFrame, DataFrame | None]:
    """Names by routing hash, and by hash and bytes for the hashes that distinct blocks share."""
    cut = texts.select(F.explode(_blocks(F.col("text"), size)).alias("block"))
    distinct = cut.select(route(F.col("block")).alias("h"), "block").distinct()
    names = stage(_numbered(distinct, "h", "block").select("h", "name"), "block-names")
    shared = stage(names.groupBy("h").count().where("count > 1").select("h"), "shared-hashes")
    if shared.isEmpty():
        return names, None
    ties = _numbered(distinct.join(shared, "h", "left_semi").distinct(), "h", "block")
    ties = stage(ties.withColumn("name", -1 - F.col("name")), "tied-names")
    return names.join(shared, "h", "left_anti"), ties


def block_identity(docs: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES, route=F.xxhash64) -> DataFrame:
    """One row per row of docs: all its columns but the text under `doc`, text_sha256, row, level, name.

    Two rows hold equal normalised texts exactly when level and name agree. Any number of
    repeated rows is kept apart by `row`.
    """
    texts = docs.select(normalise(F.col(text_col)).alias("text"))
    names, ties = _named_blocks(texts, block_bytes, route)

    kept = [name for name in docs.columns if name != text_col]
    rows = docs.select(F.struct(*kept).alias("doc"), normalise(F.col(text_col)).alias("text"))
    rows = rows.withColumn("blocks", _blocks(F.col("text"), block_bytes))
    rows = rows.select(
        "doc", F.monotonically_increasing_id().alias("row"), sha256_hex(F.col("text")).alias("text_sha256"),
        F.transform("blocks", lambda block: F.struct(route(block).alias("h"), *([block.alias("block")] if ties is not None else []))).alias("parts"),
    )
    rows = stage(rows, "routed-texts")

    parts = rows.select("row", F.posexplode("parts").alias("pos", "part")).select("row", "pos", "part.*")
    found = parts.join(names, "h").select("row", "pos", "name")
    if ties is not None:
        found = found.unionByName(parts.join(ties, ["h", "block"]).select("row", "pos", "name"))
    parts = stage(found, "level-0")

    done, level = [], 0
    while True:
        last = parts.agg(F.max("pos")).first()[0]
        if not last:
            done.append(parts.select("row", F.lit(level).alias("level"), "name"))
            break
        # A text leaves at the level that its length alone decides: when one name is left.
        half = F.col("pos") % 2 == 0
        pairs = parts.groupBy("row", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(half, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~half, F.col("name"))), F.lit(_NOTHING)).alias("b")
        )
        pairs = stage(pairs, f"pairs-{level + 1}")
        ended = (F.col("pos") == 0) & (F.col("b") == _NOTHING)
        single = pairs.where(ended)
        # Position 0 alone may also be the first pair of a longer text whose right half exists; only a lone name has no right half.
        done.append(single.select("row", F.lit(level).alias("level"), F.col("a").alias("name")))
        pairs = pairs.where(~ended)
        level += 1
        named = _numbered(pairs.select("a", "b").distinct(), "a", "b")
        parts = stage(pairs.join(named, ["a", "b"]).select("row", "pos", "name"), f"level-{level}")
    identities = done[0]
    for more in done[1:]:
        identities = identities.unionByName(more)
    return rows.select("doc", "row", "text_sha256").join(identities, "row")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, route=F.xxhash64) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest id stays; a null id comes last, and of rows that
    share id and text exactly one stays. A null text equals an empty one. An empty table gives an
    empty result. Further columns of docs, whatever their names, play no part.
    """
    rows = stage(block_identity(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", block_bytes, route), "identities")
    rows = rows.select(F.col("doc.id").alias("id"), "row", "text_sha256", "level", "name")
    groups = rows.groupBy("level", "name").agg(
        F.count(F.lit(1)).alias("group_size"), F.min(F.struct(F.col("id").isNull(), F.col("id").alias("id"), F.col("row").alias("row"))).alias("first")
    )
    # Written before the join, so that the join's own shuffle of a group with very many rows can be split.
    groups = stage(groups.select("level", "name", "group_size", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row")), "groups")
    return rows.join(groups, ["level", "name"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )
