"""Quality classifier: supervised subword embeddings, trained with numpy.

A text is the mean of learned vectors of its hashed words (a word like the one before it is hashed as a repeat besides) and
of the hashed runs of 3 and 4 characters inside its words; a softmax over two classes reads that mean. Stochastic gradient
descent trains vectors and output together on a bounded sample of labelled rows, whole texts of them, in a fixed order from
a fixed seed, inside one task: the driver gets the model alone. To score, each bucket's vector is reduced to what it adds
to the difference of the two outputs, which gives the same result.

Null and empty texts have no features and get the output's bias alone. Texts of any length are read whole, in learning and
in scoring; a task holds the features of a slice of them. A null label is not learned from; without labelled rows every
score is 0.5. A score that equals the threshold is predicted 1. An empty table gives no rows. Only the named columns are
read; labels, languages, sources and ids are no features. Repeated rows give a row each, and are learned once for each
row with a label; ties in the sample's order are taken by text.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlyr.llm.common import slices, small_batches, table
from outlyr.llm.shingles import mixed, word_hashes

_U = np.uint64
_BLANK = (32, *range(9, 14))
RUNS = (3, 4)
REPEAT = 7
#: Bytes of text whose features a task holds at once.
SLICE = 1 << 18


@dataclass(frozen=True)
class Options:
    """sample: labelled rows to learn from at most, those with the smallest hash of their id; other names as usual."""

    sample: int = 4000
    bits: int = 17
    dim: int = 16
    steps: int = 20_000  #: at least; whole rounds over the sample
    rate: float = 0.5
    seed: int = 5
    threshold: float = 0.7


def features(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all features of all texts, text by text, and the number of features of each text."""
    keep, owners = _U(64 - bits), np.arange(len(texts))
    words, counts = word_hashes(texts)
    buckets, owner = [mixed(words + _U(1)) >> keep], [np.repeat(owners, counts)]
    own = np.repeat(owners, counts)
    again = (words[1:] == words[:-1]) & (own[1:] == own[:-1])
    buckets.append(np.full(int(again.sum()), mixed(np.zeros(1, _U) + _U(REPEAT))[0] >> keep))
    owner.append(own[1:][again])
    chars = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(owners, [len(t) + 1 for t in texts])
    is_blank = np.isin(chars, _BLANK)
    blank = np.cumsum(is_blank, dtype=np.int64)
    wide = chars.astype(_U)
    for n in RUNS:
        if len(chars) < n:
            continue
        code = np.zeros(len(chars) - n + 1, _U)
        for k in range(n):
            code = code * _U(0x9E3779B97F4A7C15) + wide[k : k + len(code)] + _U(1)
        inner = (blank[n - 1 :] == blank[: len(code)]) & ~is_blank[: len(code)]
        buckets.append(mixed(code[inner] + _U(n)) >> keep)
        owner.append(of[: len(code)][inner])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owner)


@dataclass(frozen=True)
class Model:
    """adds: what a feature of each bucket adds to the log-odds of class 1, times the number of features."""

    adds: np.ndarray
    bias: float
    bits: int

    def scores(self, texts: list[str]) -> np.ndarray:
        buckets, owner = features(texts, self.bits)
        sums = np.bincount(owner, self.adds[buckets], len(texts))
        return 1 / (1 + np.exp(-(sums / np.maximum(np.bincount(owner, minlength=len(texts)), 1) + self.bias)))


def weighed(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and the share of its features that each has."""
    with np.errstate(over="ignore"):
        found, times = np.unique(features([text], bits)[0], return_counts=True)
    return found.astype(np.int32), (times / max(1, times.sum())).astype(np.float32)


def gradient(part: np.ndarray, rows: np.ndarray, output: np.ndarray, bias: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Of one text's loss, -log softmax: by its rows of vectors, by the output, by the bias; and the loss."""
    mean = part @ rows if len(part) else np.zeros(output.shape[1], output.dtype)
    z = output @ mean + bias
    p = np.exp(z - z.max())
    p /= p.sum()
    loss = -float(np.log(p[label]))
    p[label] -= 1
    return part[:, None] * (p @ output), p[:, None] * mean, p, loss


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], options: Options) -> Model:
    """Mean of vectors, linear layer, softmax; a step for each text of rows (see weighed), with a rate that falls to zero."""
    size, rng = 1 << options.bits, np.random.default_rng(options.seed)
    vectors = rng.uniform(-1, 1, (size, options.dim)).astype(np.float32) / options.dim
    output, bias = np.zeros((2, options.dim), np.float32), np.zeros(2, np.float32)
    rounds = -(-options.steps // max(1, len(rows)))
    steps, step = rounds * len(rows), 0
    for _ in range(rounds if rows else 0):
        for i in rng.permutation(len(rows)):
            rate = np.float32(options.rate * (1 - step / steps))
            step += 1
            found, part = rows[i]
            by_vectors, by_output, by_bias, _ = gradient(part, vectors[found], output, bias, labels[i])
            output -= rate * by_output
            bias -= rate * np.float32(0.1) * by_bias
            vectors[found] -= rate * by_vectors
    return Model((vectors @ (output[1] - output[0])).astype(np.float64), float(bias[1] - bias[0]), options.bits)


def held_out(doc_id: Column) -> Column:
    """The rows whose labels are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label_col="quality", options: Options = Options()) -> DataFrame:
    """text, label of the labelled rows that are learned from, in their order: at most options.sample of those not held out."""
    labelled = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    order = [place, F.col("doc_id"), F.col("label")]
    # A threshold on the hash leaves about twice the sample before anything is sorted.
    n = labelled.count()
    if n > 2 * options.sample:
        labelled = labelled.filter(place / float(1 << 63) * n < 2 * options.sample)
    # At most options.sample rows: the bound of what is broadcast and of what the training task gets.
    chosen = F.broadcast(labelled.orderBy(*order).limit(options.sample))
    rows = docs.select("doc_id", "text").filter("text is not null").join(chosen, "doc_id")
    return rows.orderBy(*order, "text").limit(options.sample).select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, label_col="quality", options: Options = Options()) -> Model:
    """The model of a bounded sample of labelled rows. One task gets the sample and keeps each text's features alone."""
    small_batches(docs.sparkSession)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, said = [], []
        for batch in batches:
            rows += [weighed(t, options.bits) for t in batch.column("text").to_pylist()]
            said += batch.column("label").to_pylist()
        model = train(rows, said, options)
        yield pa.RecordBatch.from_arrays([pa.array([model.adds.tobytes()], pa.binary()), pa.array([model.bias])], ["adds", "bias"])

    made = sample(docs, labels, label_col, options).coalesce(1).mapInArrow(learn, "adds binary, bias double").first()
    # Without rows there may be no partition, and so no model.
    return Model(np.frombuffer(bytes(made.adds)), made.bias, options.bits) if made else train([], [], options)


def _shared(docs: DataFrame, model: Model):
    """A function from an Arrow array of texts to scores; plain arrays travel to the executors, which need no copy of this package."""
    small_batches(docs.sparkSession)
    plain = docs.sparkSession.sparkContext.broadcast((model.adds, model.bias, model.bits))
    return lambda texts: _scores(Model(*plain.value), texts)


def scored(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """id_col, score of each row, from its whole text."""
    score = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), score(batch.column(1))], [id_col, "score"])

    return docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("_text")).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")


def _scores(model: Model, texts: pa.Array) -> pa.Array:
    """The scores of a batch's texts; features are held for a slice of it at a time."""
    with np.errstate(over="ignore"):
        parts = [model.scores([t or "" for t in part.to_pylist()]) for part in slices(texts, most=SLICE)]
    return pa.array(np.concatenate(parts) if parts else np.zeros(0))


def judged(docs: DataFrame, labels: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    scores = scored(docs, fit(docs, labels, options=options))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= options.threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, options: Options = Options()) -> DataFrame:
    """The rows of docs that the model of docs and labels predicts to be good, with all their columns."""
    scores = _shared(docs, fit(docs, labels, options=options))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield scores(texts)

    return docs.filter(score("text") >= options.threshold)


def query(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
