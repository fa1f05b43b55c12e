"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its byte 2-, 3- and 4-grams, hashed into buckets;
a linear layer and a softmax name the language. Both are learned by stochastic gradient descent
on a bounded sample, as many texts of each language as there are, up to the same number; the bias
is then moved to the languages' true shares. As the average and the layer are linear, each bucket's
embedding and the layer fold into one row of scores per bucket once training is done. A text's
bucket counts are whole numbers and its scores a product of its own, so an answer is the same, to
the last bit, whatever rows lie beside the text.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillmart.llm import grams
from tillmart.llm.common import crc32_of_id, ready_workers
from tillmart.llm.grams import gram_buckets, gram_counts_of, joined, portions

SAMPLE_ROWS = 3000  # texts that training may use, shared out evenly among the languages
BUCKETS, WIDTH, SIZES = 4096, 16, (2, 3, 4)
EPOCHS, BATCH, RATE = 30, 64, 4.0
#: Share of right answers that accepted texts had in calibration.
ACCEPTED_PRECISION = 0.99
UNKNOWN = "und"

#: Bytes as the grams see them: A-Z lowered, a-z and non-ASCII kept, the rest one separator.
_SEEN = np.full(256, 0x20, np.uint8)
_SEEN[0x80:] = np.arange(0x80, 0x100)
_SEEN[ord("a") : ord("z") + 1] = _SEEN[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def held_out(doc_id: Column) -> Column:
    return crc32_of_id(doc_id) % 4 == 2


def _seen(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which bytes stay: a separator after a separator of the same text goes. `first` marks the first byte of each text."""
    stays = np.ones(len(data), bool)
    stays[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20) | first[1:]
    return stays


def gram_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of the buckets per text."""
    data, owner = joined(texts)
    data = _SEEN[data]
    first = np.ones(len(data), bool)
    first[1:] = owner[1:] != owner[:-1]
    stays = _seen(data, first)
    data, owner = data[stays], owner[stays]
    counts = np.zeros(len(texts) * BUCKETS, np.int64)
    for size in SIZES:
        bucket, who = gram_buckets(data, owner, size, BUCKETS)
        counts += np.bincount(who * BUCKETS + bucket, minlength=len(counts))
    return counts.reshape(len(texts), BUCKETS)


def bucket_counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, counts of the buckets) of a column of texts; null and empty texts are left out."""
    for rows, texts in portions(column):
        if len(texts[0]) <= grams.PORTION_BYTES:
            yield from zip(rows, gram_counts(texts))
            continue
        data = _SEEN[np.frombuffer(texts[0], np.uint8)]
        first = np.zeros(len(data), bool)
        first[0] = True
        data = data[_seen(data, first)]
        yield rows[0], sum(gram_counts_of(data, size, BUCKETS) for size in SIZES)


class Model(NamedTuple):
    languages: list[str]
    scores: np.ndarray  # of each bucket and language
    bias: np.ndarray
    temperature: float
    least: float  # confidence below which an answer is rejected

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        """Of one text, from its bucket counts."""
        found = np.flatnonzero(counts)
        means = counts[found].astype(np.float64) @ self.scores[found] / max(int(counts.sum()), 1)
        return _softmax(((means + self.bias) / self.temperature)[None, :])[0]


def _softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(1, keepdims=True))
    return powers / powers.sum(1, keepdims=True)


def train(features: np.ndarray, labels: list[str], shares: dict[str, float] | None = None, seed: int = 7) -> Model | None:
    """Features are bucket shares per text. A fifth of the texts sets the temperature and the rejection; None without texts.

    `shares` are the languages' shares among all texts; without them the sample's own.
    """
    languages = sorted(set(labels))
    if not languages:
        return None
    target = np.array([languages.index(label) for label in labels])
    random = np.random.default_rng(seed)
    order = random.permutation(len(labels))
    aside = order[: len(order) // 5] if len(order) >= 20 else order
    fitted = order[len(order) // 5 :] if len(order) >= 20 else order
    embedding = random.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    layer += random.normal(0, 0.5, layer.shape)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        random.shuffle(fitted)
        for start in range(0, len(fitted), BATCH):
            rows = fitted[start : start + BATCH]
            some = features[rows]
            hidden = some @ embedding
            gradient = _softmax(hidden @ layer + bias)
            gradient[np.arange(len(rows)), target[rows]] -= 1
            gradient /= len(rows)
            down = gradient @ layer.T
            layer -= rate * (hidden.T @ gradient)
            bias -= rate * 0.1 * gradient.sum(0)
            embedding -= rate * 10 * (some.T @ down)
    sampled = np.bincount(target, minlength=len(languages)) / len(target)
    weight = np.array([(shares or {}).get(name, share) for name, share in zip(languages, sampled)]) / sampled
    scores = (embedding @ layer).astype(np.float64)
    logits = features[aside] @ scores + bias
    truth = target[aside]

    def loss(temperature: float) -> float:
        chances = _softmax(logits / temperature + np.log(weight))[np.arange(len(truth)), truth]
        return np.average(-np.log(np.maximum(chances, 1e-12)), weights=weight[truth])

    temperature = min(np.geomspace(0.1, 10, 41).tolist(), key=loss)
    chances = _softmax(logits / temperature + np.log(weight))
    right, sure = chances.argmax(1) == truth, chances.max(1)
    falling = np.argsort(-sure)
    counted = weight[truth][falling]
    precise = np.flatnonzero(np.cumsum(right[falling] * counted) / np.cumsum(counted) >= ACCEPTED_PRECISION)
    least = float(sure[falling][precise[-1]]) if len(precise) else 1.0
    return Model(languages, scores, bias + temperature * np.log(weight), temperature, least)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Learns from at most sample_rows different texts (one of each language at least), those of the least hashes in each language.

    Copies count once in the sample and as often as they occur in the languages' shares.
    """
    ready_workers(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.col(text_col) != "") & ~held_out(F.col(id_col)))
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(text_col)).alias("draw"), F.encode(F.col(text_col), "UTF-8").alias("data"))
    totals = {row.lang: row["count"] for row in known.groupBy("lang").count().collect()}  # a row per language
    if not totals:
        return None
    # The draw is decided on hashes alone; the texts follow in a second pass. The limit is applied before rows are shuffled, too.
    each = max(1, sample_rows // len(totals))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    drawn = known.select("lang", "draw").distinct().withColumn("place", place).where(F.col("place") <= each).select("lang", "draw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, buckets, shares = [], [], []
            for row, total in bucket_counts(batch.column(2)):
                if total.any():
                    found = np.flatnonzero(total)
                    kept.append(row)
                    buckets.append(found.astype("<u2").tobytes())
                    shares.append((total[found] / total.sum()).astype("<f4").tobytes())
            some = [batch.column(n).take(pa.array(kept, pa.int64())) for n in (0, 1)]
            yield pa.RecordBatch.from_arrays([*some, pa.array(buckets, pa.binary()), pa.array(shares, pa.binary())], ["lang", "draw", "buckets", "shares"])

    sample = known.join(F.broadcast(drawn), ["lang", "draw"])  # sample_rows hashes, or one a language
    sample = sample.groupBy("lang", "draw").agg(F.min("data").alias("data"))
    rows = sample.mapInArrow(run, "lang string, draw long, buckets binary, shares binary").collect()
    rows.sort(key=lambda row: (row.lang, row.draw))  # training must not depend on arrival
    features = np.zeros((len(rows), BUCKETS), np.float32)
    for n, row in enumerate(rows):
        features[n, np.frombuffer(row.buckets, "<u2")] = np.frombuffer(row.shares, "<f4")
    learned = sum(totals[lang] for lang in {row.lang for row in rows})
    return train(features, [row.lang for row in rows], {lang: n / learned for lang, n in totals.items()})


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, lang_pred, score (calibrated, 0 to 1), rejected.

    A null text and one without letters is `und` with score 0, and so is every text if nothing
    could be learned. `rejected` marks answers less sure than calibration asks for. Repeated rows
    get equal answers, an empty table an empty result; other columns play no part.
    """
    ready_workers(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.encode(text, "UTF-8").alias("data"), text.rlike(r"\p{L}").alias("letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sure = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            readable = batch.column(2).to_numpy(zero_copy_only=False)
            for row, counts in bucket_counts(batch.column(1)) if model else ():
                if readable[row]:
                    chances = model.probabilities(counts)
                    names[row], sure[row] = model.languages[int(chances.argmax())], float(chances.max())
            least = model.least if model else 1.0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(sure, pa.float64()), pa.array([bool(x < least) for x in sure], pa.bool_())],
                ["id", "lang_pred", "score", "rejected"],
            )

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("id", id_col)
