"""Merkle manifest of a dataset: one tree per group of rows, one tree over the groups' roots, a proof for every row.

Each level is one pass of lag and lead windows: the nodes beside a node, at fixed offsets and masked
by its slot in the run and the run's length, are its siblings, and the first row of a run hashes all
of them into the parent. Levels shrink by the fan-out, so all of them together cost half as much again
as the first. Runs never cross a block of positions, so windows are cut by block and a group of any
size, a third of all rows included, spreads over all tasks. On the way down each node receives
its parent's path by a join on the parent's position, which no more rows share than the fan-out.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillmart.llm.common import crc32_of_id
from tillmart.operators.staging import stage, staging_scope

FAN = 3
#: Runs in a block, within which windows look left and right.
BLOCK_RUNS = 1024
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_POSITION_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition here


def hex_of(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def digest_of(text: Column) -> Column:
    """SHA-256 as 32 bytes; digests are hashed as hex text."""
    return F.unhex(F.sha2(text, 256))


def leaf_digest(values: list[Column]) -> Column:
    """Of all values in order, each `-` if null, else its UTF-8 byte count, `:` and itself."""
    shown = [value.cast("string") for value in values]
    return digest_of(F.concat(*(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")) for value in shown)))


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Adds pos, from 0 in each group in the given order (nulls first), and size, the group's rows; rows that tie on all of it in any order.

    Rows are dealt by ranges of group and order, so a large group lies in many parts; only its rows per part are summed in order.
    """
    spread = rows.withColumn("_tie", F.monotonically_increasing_id())
    spread = spread.repartitionByRange(group, *order, "_tie").sortWithinPartitions(group, *order, "_tie").drop("_tie")
    staged = stage(spread.withColumn("_seq", F.monotonically_increasing_id()), "ranked").withColumn("_part", F.shiftright("_seq", _POSITION_BITS))
    parts = staged.groupBy(group, "_part").agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(group)
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    parts = parts.select(group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("size"))
    return staged.join(parts, [group, "_part"]).withColumn("pos", F.col("_seq") + F.col("_shift")).drop("_seq", "_part", "_shift")


def with_siblings(nodes: DataFrame, fan: int) -> DataFrame:
    """Nodes (g, pos, size, digest) with left and right, the digests beside each in its run, and in a run's first row its parent."""
    order = Window.partitionBy("g", F.floor(F.col("pos") / (fan * BLOCK_RUNS))).orderBy("pos")
    slot = F.col("pos") % fan
    run = F.least(F.lit(fan).cast("bigint"), F.col("size") - F.col("pos") + slot)
    none = F.unhex(F.lit(""))
    left = [F.when(slot >= step, F.lag("digest", step).over(order)).otherwise(none) for step in range(fan - 1, 0, -1)]
    right = [F.when(slot + step < run, F.lead("digest", step).over(order)).otherwise(none) for step in range(1, fan)]
    nodes = nodes.withColumns({"left": F.concat(*left), "right": F.concat(*right)})
    return nodes.withColumn("parent", F.when(slot == 0, digest_of(hex_of(F.concat("digest", "right")))))


def climb(leaves: DataFrame, fan: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels of every group's tree, each with siblings, and the root (g, height, digest) of each group."""
    largest = leaves.agg(F.max("size")).first()[0] or 0
    roots = leaves.where("size = 1").select("g", F.lit(0).alias("height"), "digest")
    levels, nodes = [], leaves.where("size > 1")
    while largest > 1:
        level = stage(with_siblings(nodes, fan), f"level-{len(levels)}")
        levels.append(level)
        up = level.where(F.col("parent").isNotNull()).select(
            "g", F.floor(F.col("pos") / fan).alias("pos"), F.ceil(F.col("size") / fan).alias("size"), F.col("parent").alias("digest")
        )
        roots = roots.unionByName(up.where("size = 1").select("g", F.lit(len(levels)).alias("height"), "digest"))
        nodes, largest = up.where("size > 1"), -(-largest // fan)
    return levels, stage(roots, "roots")


def descend(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, fan: int) -> DataFrame:
    """Every leaf with its path to the top, [(left, right)] from its own level upwards, and what `tops` (g, height, path, subroot) adds to its group."""
    above = None
    for height in range(len(levels), 0, -1):
        parents = tops.where(F.col("height") == height).select("g", F.lit(0).cast("bigint").alias("pos"), "path", "subroot")
        parents = parents if above is None else parents.unionByName(above.select("g", "pos", "path", "subroot"))
        parents = parents.select(F.col("g").alias("_g"), F.col("pos").alias("_pos"), F.col("path").alias("_above"), "subroot")
        rows = levels[height - 1].join(parents, (F.col("g") == F.col("_g")) & (F.floor(F.col("pos") / fan) == F.col("_pos")))
        rows = rows.withColumn("path", F.concat(F.array(F.struct("left", "right")), "_above")).drop("_g", "_pos", "_above", "left", "right", "parent")
        above = stage(rows, f"paths-{height}") if height > 1 else rows
    single = leaves.where("size = 1").join(tops.where("height = 0").select("g", "path", "subroot"), "g")
    return single if above is None else above.unionByName(single)


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest, as hex text, and the siblings on its path."""
    return F.aggregate(path, start, lambda digest, step: F.sha2(F.concat(hex_of(step["left"]), digest, hex_of(step["right"])), 256))


def manifest(leaves: DataFrame, group_col: str, *order: str, fan: int = FAN) -> DataFrame:
    """Every row of leaves with subroot, root and path.

    `leaves` has a binary digest, and none of the names g, pos, size, left, right, parent, path,
    subroot and root. In each group, rows ascend by `order` and then by digest, nulls first, so repeated
    rows are leaves of their own and ties do not change a digest. Null is a group of its own, the
    first; groups follow each other by their UTF-8 bytes. A lone node is its own root and its run's
    parent has one child. An empty table gives an empty result.
    """
    spark = leaves.sparkSession
    with staging_scope(spark):
        group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))  # null before all texts
        rows = stage(ranked(leaves.withColumn("g", group), "g", *order, "digest"), "leaves", outlive=True)
        levels, roots = climb(rows, fan)
        groups = ranked(roots.select(F.lit("").alias("g"), F.col("g").alias("of"), "height", "digest"), "g", "of")
        groups = stage(groups, "groups")
        tops, top = climb(groups, fan)
        found = top.first()
        path_type = "array<struct<left: binary, right: binary>>"
        top = top.select("g", "height", F.array().cast(path_type).alias("path"), F.col("digest").alias("subroot"))
        beside = descend(groups, tops, top, fan).select(F.col("of").alias("g"), "height", "path", F.col("digest").alias("subroot"))
        # Written before the scope ends: the levels below it go.
        out = stage(descend(rows, levels, stage(beside, "subroots"), fan), "paths", outlive=True)
    return out.withColumn("root", F.lit(bytes(found.digest) if found else None).cast("binary")).drop("g", "pos", "size")


def document_manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text") -> DataFrame:
    """The manifest of docs with proofs checked against tampered texts; see tampered() for which.

    One row per row of docs: id, leaf, subroot, root, proof_sha256, folded_root, verified. All five
    columns of a row make its leaf; a null id sorts first and counts as empty text in the tamper rule.
    """
    own = leaf_digest([F.col(name) for name in columns])
    other = leaf_digest([tampered(F.col(name)) if name == text_col else F.col(name) for name in columns])
    changed = crc32_of_id(F.col(id_col)) % 2 == 0
    rows = docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), own.alias("digest"), F.when(changed, other).alias("other"))
    rows = manifest(stage(rows, "digests"), "group", "id")
    joined = F.array_join(F.transform("path", lambda step: F.concat(hex_of(step["left"]), hex_of(step["right"]))), "")
    rows = rows.withColumn("folded", fold(hex_of(F.coalesce("other", "digest")), F.col("path")))
    return rows.select(
        F.col("id").alias(id_col), hex_of(F.col("digest")).alias("leaf"), hex_of(F.col("subroot")).alias("subroot"), hex_of(F.col("root")).alias("root"),
        F.sha2(joined, 256).alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == hex_of(F.col("root"))).alias("verified"),
    )


def tampered(text: Column) -> Column:
    """The text without its line breaks; null stays null."""
    return F.translate(text, "\n", "")
