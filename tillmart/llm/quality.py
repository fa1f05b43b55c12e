"""Quality classifier: attention-based multiple-instance learning over a document's passages.

A document is a bag of passages of some words each; only the document is labelled. Every passage
is encoded (shares of byte kinds and hashed byte trigrams, then a learned layer), gated attention
weighs the passages, and the weighted passage representation is scored. Attention logits are
bounded by their last layer, so their exponentials are summed block by block and a text of
any length needs bounded memory beside its bytes. Blocks are cut in each text by itself, at passages,
so a text's features and score are the same, to the last bit, whatever rows lie beside it.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillmart.llm import grams
from tillmart.llm.common import crc32_of_id, ready_workers
from tillmart.llm.grams import gram_buckets, gram_counts_of, joined, portions

PASSAGE_WORDS = 50
#: Labelled documents per class that training may use, and the longest of them in bytes; longer ones are only scored.
SAMPLE_ROWS, SAMPLE_BYTES = 1000, 1 << 16
GRAMS, KINDS, HIDDEN, ATTENTION = 128, 16, 32, 16
EPOCHS, BATCH, RATE = 30, 32, 0.01


def _kinds() -> np.ndarray:
    """What kind of byte each is: white space, digit, capital, small, the usual marks, other ASCII, lead and trail bytes of UTF-8."""
    kind = np.full(256, 15, np.uint8)
    kind[0x80:0xC0], kind[0xC0:] = 13, 14
    kind[ord("0") : ord("9") + 1], kind[ord("A") : ord("Z") + 1], kind[ord("a") : ord("z") + 1] = 1, 2, 3
    for number, marks in enumerate((b" \t\r\x0b\x0c", b"\n", b".", b",;:", b"!", b"?", b"|", b"#$%&*@", b"<>{}[]()/\\=+_~^`", b"\"'-")):
        for byte in marks:
            kind[byte] = 0 if number == 0 else number + 3
    return kind


_KIND = _kinds()
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True


def passages(texts: list[bytes], words: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the text it belongs to. A text without words has one passage."""
    data, owner = joined(texts)
    white = _SPACE[data]
    first = np.ones(len(data), bool)
    first[1:] = owner[1:] != owner[:-1]
    begins = ~white
    begins[1:] &= white[:-1] | first[1:]
    word = np.cumsum(begins)
    base = np.zeros(len(texts), np.int64)
    starts = np.flatnonzero(first)
    base[owner[starts]] = word[starts] - begins[starts]
    number = np.maximum(word - base[owner] - 1, 0) // words
    fresh = first.copy()
    fresh[1:] |= number[1:] != number[:-1]
    passage = np.cumsum(fresh) - 1
    count = int(passage[-1]) + 1 if len(data) else 0
    bag = owner[np.flatnonzero(fresh)]
    kinds = np.bincount(passage * KINDS + _KIND[data], minlength=count * KINDS).reshape(count, KINDS)
    bucket, who = gram_buckets(data, passage, 3, GRAMS)
    counts = np.bincount(who * GRAMS + bucket, minlength=count * GRAMS).reshape(count, GRAMS)
    return _features(kinds, counts), bag


def _features(kinds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    sizes = np.maximum(kinds.sum(1, keepdims=True), 1)
    return np.concatenate([np.sqrt(kinds / sizes) * 2, np.sqrt(counts / sizes) * 2], axis=1).astype(np.float32)


def passage_starts(text: bytes, words: int = PASSAGE_WORDS) -> list[int]:
    """Where a text's passages begin, found some bytes at a time."""
    data, found, starts, after_space = np.frombuffer(text, np.uint8), 0, [0], True
    for at in range(0, len(data), grams.PORTION_BYTES):
        white = _SPACE[data[at : at + grams.PORTION_BYTES]]
        begins = np.flatnonzero(~white & np.append(after_space, white[:-1]))
        number = found + np.arange(len(begins))
        starts += (begins[(number > 0) & (number % words == 0)] + at).tolist()
        found, after_space = found + len(begins), bool(white[-1])
    return starts


def bags(column: pa.Array, words: int = PASSAGE_WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(row, features of its passages in order) of a column of texts; a text longer than a portion comes in several blocks of passages."""
    for rows, texts in portions(column):
        if len(texts[0]) <= grams.PORTION_BYTES:
            features, bag = passages(texts, words)
            edges = np.searchsorted(bag, np.arange(len(texts) + 1))
            yield from ((row, features[a:b]) for row, a, b in zip(rows, edges, edges[1:]))
            continue
        text, first = texts[0], 0
        starts = [*passage_starts(text, words), len(text)]
        for n, (start, behind) in enumerate(zip(starts, starts[1:])):
            if behind - starts[first] > grams.PORTION_BYTES and n > first:
                yield rows[0], passages([text[starts[first] : start]], words)[0]
                first = n
            if behind - start > grams.PORTION_BYTES:  # one passage, such as a very long word
                data = np.frombuffer(text, np.uint8, behind - start, start)
                parts = (data[at : at + grams.PORTION_BYTES] for at in range(0, len(data), grams.PORTION_BYTES))
                kinds = sum(np.bincount(_KIND[part], minlength=KINDS) for part in parts)
                yield rows[0], _features(kinds[None, :], gram_counts_of(data, 3, GRAMS)[None, :])
                first = n + 1
        if first < len(starts) - 1:
            yield rows[0], passages([text[starts[first] :]], words)[0]


class Model(NamedTuple):
    """h = tanh(x E + e); weight ~ exp(w . (tanh(h V) * sigmoid(h U))); score = sigmoid(c . (weighted h) + b)."""

    e_layer: np.ndarray
    e_bias: np.ndarray
    v_layer: np.ndarray
    u_layer: np.ndarray
    w_layer: np.ndarray
    c_layer: np.ndarray
    c_bias: np.ndarray

    def weighed(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each passage's representation and unnormalised attention."""
        hidden = np.tanh(features @ self.e_layer + self.e_bias)
        return hidden, np.exp((np.tanh(hidden @ self.v_layer) * _sigmoid(hidden @ self.u_layer)) @ self.w_layer)

    def score(self, sums: np.ndarray, weights: np.ndarray) -> np.ndarray:
        means = sums / np.maximum(weights, 1e-30)[:, None]
        return _sigmoid((means * self.c_layer).sum(1) + self.c_bias[0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def train(features: np.ndarray, bag: np.ndarray, labels: np.ndarray, prior: float, seed: int = 11) -> Model:
    """Adam on the logistic loss of whole documents; the bias is then moved from the sample's share of ones to `prior`."""
    random = np.random.default_rng(seed)
    shapes = [(features.shape[1], HIDDEN), (HIDDEN,), (HIDDEN, ATTENTION), (HIDDEN, ATTENTION), (ATTENTION,), (HIDDEN,), (1,)]
    values = [random.normal(0, 1 / np.sqrt(shape[0]), shape) if len(shape) == 2 else np.zeros(shape) for shape in shapes]
    values[4] = random.normal(0, 0.1, shapes[4])
    values[5] = random.normal(0, 0.1, shapes[5])
    moments, squares, step = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0
    edges = np.searchsorted(bag, np.arange(len(labels) + 1))
    for _ in range(EPOCHS):
        order = random.permutation(len(labels))
        for start in range(0, len(order), BATCH):
            docs = order[start : start + BATCH]
            rows = np.concatenate([np.arange(edges[d], edges[d + 1]) for d in docs])
            lengths = edges[docs + 1] - edges[docs]
            owner = np.repeat(np.arange(len(docs)), lengths)
            gradients = _gradients(values, features[rows], owner, labels[docs])
            step += 1
            for n, gradient in enumerate(gradients):
                gradient = gradient + 1e-4 * values[n]
                moments[n] = 0.9 * moments[n] + 0.1 * gradient
                squares[n] = 0.999 * squares[n] + 0.001 * gradient**2
                values[n] = values[n] - RATE * (moments[n] / (1 - 0.9**step)) / (np.sqrt(squares[n] / (1 - 0.999**step)) + 1e-8)
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    prior = float(np.clip(prior, 1e-3, 1 - 1e-3))
    values[6] = values[6] + np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return Model(*values)


def _gradients(values: list[np.ndarray], x: np.ndarray, owner: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    e_layer, e_bias, v_layer, u_layer, w_layer, c_layer, c_bias = values
    count = len(y)
    h = np.tanh(x @ e_layer + e_bias)
    t, g = np.tanh(h @ v_layer), _sigmoid(h @ u_layer)
    power = np.exp((t * g) @ w_layer)
    a = power / np.bincount(owner, power, count)[owner]
    z = np.zeros((count, h.shape[1]))
    np.add.at(z, owner, a[:, None] * h)
    d_logit = (_sigmoid(z @ c_layer + c_bias[0]) - y) / count
    d_z = d_logit[:, None] * c_layer
    d_a = (d_z[owner] * h).sum(1)
    d_s = a * (d_a - np.bincount(owner, a * d_a, count)[owner])
    d_t, d_g = d_s[:, None] * (w_layer * g) * (1 - t**2), d_s[:, None] * (w_layer * t) * g * (1 - g)
    d_h = (a[:, None] * d_z[owner] + d_t @ v_layer.T + d_g @ u_layer.T) * (1 - h**2)
    return [x.T @ d_h, d_h.sum(0), h.T @ d_t, h.T @ d_g, (t * g).T @ d_s, z.T @ d_logit, np.array([d_logit.sum()])]


def held_out(doc_id: Column) -> Column:
    return crc32_of_id(doc_id) % 3 == 1


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES,
) -> Model | float:
    """Learns from at most sample_rows documents of each label, drawn by a hash of the id among all that may be learned from.

    Ids with contradicting labels are left out; of texts that share an id the one of the least hash is learned from. With one label only, or none, the result is the
    share of ones (0.5 without labels), which is then every text's score.
    """
    ready_workers(docs.sparkSession)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id"))
    known = known.agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("top")).where("label = top").drop("top")
    totals = {row.label: row["count"] for row in known.groupBy("label").count().collect()}
    prior = totals.get(1, 0) / sum(totals.values()) if totals else 0.5
    if len(totals) < 2:
        return prior
    some = [known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(sample_rows) for label in (0, 1)]
    drawn = F.broadcast(some[0].unionByName(some[1]))  # 2 * sample_rows ids at most
    texts = docs.select(F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("data"))
    texts = texts.where(F.octet_length("data").between(1, sample_bytes)).join(drawn, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [b""] * batch.num_rows
            for row, features in bags(batch.column(1)):
                packed[row] += features.astype("<f4").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(packed, pa.binary())], ["id", "label", "draw", "features"])

    id_type = texts.schema["id"].dataType.simpleString()
    texts = texts.select("id", "data", "label", F.xxhash64("data").alias("draw"))
    rows = texts.mapInArrow(run, f"id {id_type}, label int, draw long, features binary")
    rows = rows.groupBy("id").agg(F.min(F.struct("draw", "features", "label")).alias("one")).select("id", "one.*").orderBy("id").collect()
    if len({row.label for row in rows}) < 2:
        return prior
    learned = [np.frombuffer(row.features, "<f4").reshape(-1, KINDS + GRAMS) for row in rows]
    owner = np.repeat(np.arange(len(learned)), [len(bag) for bag in learned])
    return train(np.concatenate(learned), owner, np.array([row.label for row in rows], np.float64), prior)


def scores(docs: DataFrame, model: Model | float, text_col: str = "text") -> DataFrame:
    """Every row of docs under `doc`, with score and n_passages.

    Null and empty texts have one empty passage. Repeated rows get equal scores, an empty table
    gives an empty result, and the columns of docs stay inside `doc`, so no name can clash.
    """
    return _scored(docs.select(F.struct("*").alias("doc")), "doc", model, docs.columns.index(text_col))


def _scored(rows: DataFrame, carried: str, model: Model | float, field: int | None = None) -> DataFrame:
    """The carried column passes through the workers untouched; the text is its given field, or the column `data`."""
    ready_workers(rows.sparkSession)
    result_type = T.StructType([T.StructField(carried, rows.schema[carried].dataType), T.StructField("score", T.DoubleType()), T.StructField("n_passages", T.LongType())])
    empty = np.zeros((1, KINDS + GRAMS), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = batch.num_rows
            number = np.zeros(count, np.int64)
            if isinstance(model, float):
                result = np.full(count, model)
            else:
                sums, weights = np.zeros((count, HIDDEN)), np.zeros(count)
                texts = batch.column(1) if field is None else pc.struct_field(batch.column(0), field)
                for row, features in bags(texts.cast(pa.binary())):  # each text by itself: a product's last bits depend on its shape
                    hidden, power = model.weighed(features)
                    sums[row] += power @ hidden
                    weights[row] += power.sum()
                    number[row] += len(features)
                bare = weights == 0
                hidden, power = model.weighed(empty)
                sums[bare], weights[bare] = hidden * power[:, None], power
                result = model.score(sums, weights)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(result, pa.float64()), pa.array(np.maximum(number, 1), pa.int64())], [carried, "score", "n_passages"]
            )

    return rows.mapInArrow(run, result_type)


def score_ids(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As scores, with the id alone in the place of the whole row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("data"))
    return _scored(rows, "id", model).withColumnRenamed("id", id_col)
