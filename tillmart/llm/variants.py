"""Spelling variants: words one edit apart, found by walking a trie relationally, level by level.

The trie is a table of edges (depth, node, char), a node being the prefix that leads to it. The
frontier is a table of states (word, position, node, edits). Each round joins the states with the
edges of one depth: a state moves along its word's next character, spends its edit on a sibling of
that character, or leaves out its character and moves along the one behind. A state that spent its
edit and stands on a word's end with its own word used up has found a neighbour.

An insertion is the other word's deletion, and a replacement is found by the word with the smaller
character, so each pair is found once and turned round afterwards. Every word is in the trie twice,
forwards under `>` and backwards under `<`: an edit in the second half is looked for forwards, one in
the first half backwards, and the walk starts where the half does. The root and its neighbours, which
all words share, are thus never joined, and a state has few siblings.

Words longer than the deepest level are compared by hashes of what an edit leaves, see long_pairs().
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmart.llm.common import lower_ascii, ready_workers
from tillmart.operators.staging import stage, staging_scope

#: Fixed value: the characters of words, A-Z being lower-cased.
RUN = r"[a-zÀ-ÿ]+"
#: Code points of the longest words that the trie holds; a round of joins for each of its levels.
LEVELS = 40
#: A word's form is at least so many times as frequent.
TIMES = 2


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, run) per maximal run of letters in every text, A-Z lower-cased. A null text has none."""
    lines = docs.select(F.col(id_col).alias("id"), F.explode(F.split(F.col(text_col), "\n")).alias("line"))  # so that only a line's runs are held at once
    return lines.select("id", F.explode(F.regexp_extract_all(lower_ascii(F.col("line")), F.lit(f"({RUN})"), F.lit(1))).alias("run"))


def without(text: Column, place: Column) -> Column:
    """The text without its code point at the place, from 0."""
    return F.concat(F.substring(text, F.lit(1), place), F.substring(text, place + 2, F.char_length(text)))


def _char(text: str, place: str) -> Column:
    """The code point at the place, from 0; empty beyond the end."""
    return F.substring(F.col(text), F.col(place) + 1, F.lit(1))


def _spelled(words: DataFrame) -> DataFrame:
    """Each word's two entries in the trie: path, n, and the depth at which its walk starts.

    Forwards, edits from the half on are looked for, backwards those before it; a word of up to
    three code points has all of them in the forward half. `join` is the least depth at which a
    word's edges can be met: that of its own length's walk or of a walk one code point longer.
    """
    size = F.char_length("word")

    def half(length: Column) -> Column:
        return F.when(length < 4, 0).otherwise(F.floor(length / 2)).cast("int")

    ahead = lambda length: 1 + half(length)
    back = lambda length: 1 + length - half(length)
    both = [
        F.struct(F.concat(F.lit(mark), spelled).alias("path"), start(size).alias("start"), F.least(start(size), start(size + 1)).alias("join"))
        for mark, spelled, start in ((">", F.col("word"), ahead), ("<", F.reverse("word"), back))
    ]
    return words.select("n", F.explode(F.array(*both)).alias("entry")).select("n", "entry.*")


def trie_edges(spelled: DataFrame) -> DataFrame:
    """(depth, node, char, ends, siblings): the node's edge by char, the n of the word that ends there, and the edges by greater chars."""
    places = spelled.where(F.col("join") < F.char_length("path")).select("path", "n", F.explode(F.sequence("join", F.char_length("path") - 1)).alias("depth"))
    last = F.col("depth") == F.char_length("path") - 1
    edges = places.groupBy("depth", F.substring("path", F.lit(1), F.col("depth")).alias("node"), _char("path", "depth").alias("char"))
    edges = edges.agg(F.max(F.when(last, F.col("n"))).alias("ends"))
    edges = edges.groupBy("depth", "node").agg(F.collect_list(F.struct("char", "ends")).alias("all"))  # no more than the alphabet
    edges = edges.select("depth", "node", F.explode("all").alias("own"), "all")
    greater = F.filter("all", lambda one: one["char"] > F.col("own")["char"])
    return edges.select("depth", "node", F.col("own")["char"].alias("char"), F.col("own")["ends"].alias("ends"), greater.alias("siblings"))


def _probes(states: DataFrame) -> DataFrame:
    """What each state looks for at its node: the next char, and for an unspent one also the char behind, its own being left out.

    Of equal chars in a row, only the last as the word is read forwards is left out.
    """
    forwards = F.col("path").startswith(">")
    behind = F.col("pos") + 1
    own, after, before = _char("path", "pos"), F.substring(F.col("path"), behind + 1, F.lit(1)), F.substring(F.col("path"), F.col("pos"), F.lit(1))
    step = F.struct(own.alias("char"), behind.alias("to"), F.col("edits").alias("spent"))
    skip = F.struct(after.alias("char"), (behind + 1).alias("to"), F.lit(1).alias("spent"))
    skips = (F.col("edits") == 0) & (behind < F.char_length("path")) & F.when(forwards, own != after).otherwise(own != before)
    steps = F.when(skips, F.array(step, skip)).otherwise(F.array(step))
    return states.select("path", "n", "node", "edits", F.explode(steps).alias("probe")).select("path", "n", "node", "edits", "probe.*")


def _advance(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states after one level: those that found their char, and for an unspent one its siblings too."""
    rows = _probes(states).join(edges.drop("depth"), ["node", "char"])
    kind = "array<struct<char: string, ends: bigint, spent: int>>"
    along = F.array(F.struct("char", "ends", "spent")).cast(kind)
    aside = F.transform("siblings", lambda one: F.struct(one["char"].alias("char"), one["ends"].alias("ends"), F.lit(1).alias("spent"))).cast(kind)
    moves = F.when(F.col("spent") == 0, F.concat(along, aside)).otherwise(along)
    rows = rows.select("path", "n", "node", F.col("to").alias("pos"), F.explode(moves).alias("move"))
    return rows.select("path", "n", "pos", F.concat("node", "move.char").alias("node"), F.col("move.spent").alias("edits"), F.col("move.ends").alias("ends"))


def _found(states: DataFrame) -> DataFrame:
    """Neighbours among the states: (word, n, near, near_n)."""
    last = F.col("pos") == F.char_length("path") - 1
    run_goes_on = F.col("path").startswith("<") & (_char("path", "pos") == F.substring(F.col("path"), F.col("pos"), F.lit(1)))
    ended = (F.col("edits") == 1) & (F.col("pos") == F.char_length("path"))
    cut = (F.col("edits") == 0) & last & ~run_goes_on  # its last char is left out

    def word(path: str) -> Column:
        letters = F.substring(F.col(path), F.lit(2), F.char_length(path))
        return F.when(F.col(path).startswith(">"), letters).otherwise(F.reverse(letters))

    rows = states.where(F.col("ends").isNotNull() & (ended | cut))
    return rows.select(word("path").alias("word"), "n", word("node").alias("near"), F.col("ends").alias("near_n"))


def near_pairs(words: DataFrame, levels: int = LEVELS) -> DataFrame:
    """All pairs of rows of words (word, n) that are exactly one edit apart, each once: (word, n, near, near_n). Words are distinct and not empty."""
    with staging_scope(words.sparkSession):
        short = words.where(F.char_length("word") <= levels)
        spelled = stage(_spelled(short), "spelled")
        edges = stage(trie_edges(spelled).sortWithinPartitions("depth"), "edges")
        bounds = spelled.agg(F.min("start").alias("first"), F.max(F.char_length("path")).alias("behind")).first()
        longest = words.agg(F.max(F.char_length("word"))).first()[0] or 0
        found, states = [], None
        for depth in range(bounds.first or 0, bounds.behind or 0):
            fresh = spelled.where((F.col("start") == depth) & (F.char_length("path") > depth))
            fresh = fresh.select("path", "n", F.lit(depth).alias("pos"), F.substring("path", 1, depth).alias("node"), F.lit(0).alias("edits"), F.lit(None).cast("long").alias("ends"))
            open_ = fresh if states is None else fresh.unionByName(states.where(F.col("pos") < F.char_length("path")))
            states = stage(_advance(open_, edges.where(F.col("depth") == depth)), f"frontier-{depth}")
            found.append(_found(states))
        if longest > levels:
            found.append(long_pairs(words, levels))
        pairs = words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).where("false")
        for some in found:
            pairs = pairs.unionByName(some)
        return stage(pairs, "near-pairs", outlive=True)


def _left_hashes(word: str) -> list[tuple[int, int, int, bool]]:
    """What is left of a word by each edit, as (length, place, hash, own): its own hash, and with a place blanked or left out.

    The hash is a polynomial modulo 2^64 in an odd base, so each takes constant time.
    """
    base = 0x9E3779B97F4A7C15
    points = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64)
    size = len(points)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, base, np.uint64)]), dtype=np.uint64)
    before = np.concatenate([[np.uint64(0)], np.cumsum(points * powers[:size], dtype=np.uint64)])
    whole = before[-1]
    blanked = whole - points * powers[:size]
    left_out = before[:-1] + (whole - before[1:]) * np.uint64(pow(base, -1, 1 << 64))
    last = np.append(points[1:] != points[:-1], True)  # of equal code points in a row, the last is left out
    signed = lambda values: values.view(np.int64).tolist()
    rows = [(size, -1, *signed(np.array([whole])), True)]
    rows += [(size, n, h, False) for n, h in enumerate(signed(blanked))]
    rows += [(size - 1, -1, h, False) for h, ends in zip(signed(left_out), last) if ends]
    return rows


def long_pairs(words: DataFrame, levels: int) -> DataFrame:
    """As near_pairs, of words with more than `levels` code points, and of those with the ones one shorter. Work grows with their code points.

    Words that differ in one place are equal with that place blanked; a word without one of its
    code points is the shorter word. Both are joined by hash, and each pair is then verified.
    """
    ready_workers(words.sparkSession)
    some = stage(words.where(F.char_length("word") >= levels).select("word", "n", F.monotonically_increasing_id().alias("id")), "long-words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
        for batch in batches:
            for number, word in zip(batch.column(0), batch.column(1)):
                columns = list(zip(*_left_hashes(word.as_py())))
                arrays = [pa.array([number.as_py()] * len(columns[0]), pa.int64()), *(pa.array(column, kind) for column, kind in zip(columns, kinds))]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "size", "place", "hash", "own"])

    keys = stage(some.select("id", "word").mapInArrow(run, "id long, size int, place int, hash long, own boolean"), "long-keys")
    left, right = keys.where("NOT own").alias("a"), keys.alias("b")
    same = (F.col("a.size") == F.col("b.size")) & (F.col("a.place") == F.col("b.place")) & (F.col("a.hash") == F.col("b.hash"))
    kind = (F.col("b.own") & (F.col("a.place") == -1)) | (~F.col("b.own") & (F.col("a.place") >= 0) & (F.col("a.id") < F.col("b.id")))
    pairs = left.join(right, same & kind).select(F.col("a.id").alias("id"), F.col("b.id").alias("near_id")).distinct()
    pairs = pairs.join(some, "id").join(some.select(F.col("id").alias("near_id"), F.col("word").alias("near"), F.col("n").alias("near_n")), "near_id")
    beyond = (F.char_length("word") > levels) | (F.char_length("near") > levels)
    return pairs.where(beyond & (F.levenshtein("word", "near", 1) == 1)).select("word", "n", "near", "near_n")


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) for every row (word, form): the last word when forms are followed. Each round doubles the steps taken."""
    links = stage(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "links")
    while not links.where("moved").isEmpty():
        further = links.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        links = links.join(further, F.col("root") == F.col("_word"), "left")
        links = stage(links.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "links")
    return links.select("word", "root")


def group_variants(words: DataFrame, levels: int = LEVELS, times: int = TIMES) -> DataFrame:
    """One row per row of words (word, n): word, form, root, n, n_near, form_n.

    Words are distinct, not null and not empty. A word's form is its most frequent neighbour, of
    equals the first in code-point order, if that is `times` as frequent as the word; else null.
    Frequencies grow along forms, so following them ends, at the root. Other columns play no part,
    and an empty table gives an empty result.
    """
    words = words.select("word", F.col("n").cast("long").alias("n"))
    with staging_scope(words.sparkSession):
        pairs = near_pairs(words, levels)
        both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
        best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
        rows = words.join(best, "word", "left")
        has = -F.col("best.less") >= F.col("n") * times
        rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n"))
        rows = stage(rows, "forms")
        rows = rows.join(roots_of(rows.where("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word"))
        return stage(rows.select("word", "form", "root", "n", "n_near", "form_n"), "variants", outlive=True)
