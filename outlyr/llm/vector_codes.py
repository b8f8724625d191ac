"""Product codes of vectors: learned codebooks of each part, and each part's nearest entry, exact to the last bit.

Components are whole numbers, floor(scale * x). A float32 matrix product screens all entries of a codebook at once: for a part x
and an entry c, |c|^2 - 2 x.c decides, and the rounding error of the product is at most gamma * |x| * |c|, with gamma = m u / (1 - m u)
for m roundings of relative size u each, in whatever order they are summed. Every entry whose interval overlaps the least
upper end is evaluated again in int64, and the lower index wins a tie; equal entries are screened once, as the first wins.

The vectors stay where Spark reads them. A round is one pass: each task adds up whole numbers for its parts, Spark sums these by
cell of the codebooks, and the driver holds nothing but codebooks, whose size is entries * components. Sums of whole numbers
have no order, so reruns and lost executors change nothing.

Rows whose vector is null or holds a null or a component that is not finite are dropped. Vectors of unlike lengths are
continued by zeros to the longest, and that to a multiple of the parts; empty vectors have distance 0 to everything. Components
beyond what lets squared distances fit 64 bits (131,072 for 64 components) count as that bound. Fewer vectors than entries
make so many entries. Ties: rows of one id start codebooks in the order of their vectors; null ids come last. Repeated rows are
coded each. An empty table, or one without a kept row, gives no rows. Only the three named columns are read.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlyr.llm.common import table, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows that a task screens at once, and numbers that it evaluates again at once.
ROWS, AGAIN = 1024, 1 << 20
#: Relative size of one rounding: float32, and float64 with room for the few that the intervals themselves take.
U32, U64 = 2.0**-24, 2.0**-50


@dataclass(frozen=True)
class Shape:
    """parts of width components each; scale makes them whole."""

    parts: int
    width: int
    scale: int

    @property
    def most(self) -> int:
        """Components are held to this, so that the squared distances of all parts add up below 2^63."""
        return 1 << (58 - max(0, self.width - 1).bit_length()) // 2

    def whole(self, vectors: pa.Array) -> np.ndarray:
        """The vectors' parts as whole numbers: rows, parts, width."""
        lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
        values = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * self.scale)
        values = np.clip(values, -self.most, self.most).astype(np.int64)
        n = self.parts * self.width
        if (lengths != n).any():
            at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            out = np.zeros((len(lengths), n), np.int64)
            out[np.repeat(np.arange(len(lengths)), lengths), at] = values
            values = out
        return values.reshape(len(lengths), self.parts, self.width)


def screened(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which entries of c may be nearest to each row of x: those whose interval overlaps the best one's."""
    m = (x.shape[1] + 2) * U32
    gamma = m / (1 - m)
    dots = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    squares = (c * c).sum(1).astype(np.float64)
    lengths = np.sqrt((x * x).sum(1).astype(np.float64))[:, None] * np.sqrt(squares) * (1 + U64)
    value = squares - 2 * dots
    reach = 2 * gamma * lengths + U64 * (squares + 2 * lengths)
    return value - reach <= (value + reach).min(1, keepdims=True)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row of x, the lower index at a tie, and its squared distance."""
    n, width = x.shape
    if not width or not n:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    own = np.sort(np.unique(book, axis=0, return_index=True)[1])
    c = book[own]
    rows, cols = np.nonzero(screened(x, c))
    distance = np.empty(len(rows), np.int64)
    step = max(1, AGAIN // width)
    for at in range(0, len(rows), step):
        gap = x[rows[at : at + step]] - c[cols[at : at + step]]
        distance[at : at + step] = (gap * gap).sum(1)
    least = np.minimum.reduceat(distance, np.searchsorted(rows, np.arange(n)))
    hits = np.flatnonzero(distance == least[rows])
    first = hits[np.searchsorted(rows[hits], np.arange(n))]
    return own[cols[first]], least


def assigned(whole: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry of each part of each row, and its squared distance: rows, parts."""
    n, parts, _ = whole.shape
    codes, errors = np.zeros((n, parts), np.int64), np.zeros((n, parts), np.int64)
    for at in range(0, n, ROWS):
        for p in range(parts):
            codes[at : at + ROWS, p], errors[at : at + ROWS, p] = nearest(whole[at : at + ROWS, p], books[p])
    return codes, errors


def kept(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """The rows whose vector is there, with finite components alone."""
    v = F.col(f"`{vector_col}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(v.isNotNull() & F.coalesce(finite, F.lit(False)))


def learn(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[Shape, np.ndarray]:
    """The shape and the codebooks (parts, entries, width) of kept rows of id and v: the smallest ids' parts, moved to means."""
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    shape = Shape(parts, -(-longest // parts), scale)
    start = [r.v for r in rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    if not start:
        return shape, np.zeros((parts, 0, shape.width), np.int64)
    books = np.ascontiguousarray(shape.whole(pa.array(start, pa.list_(pa.float64()))).swapaxes(0, 1))
    for _ in range(rounds):
        books = moved(rows, shape, books)
    return shape, books


def moved(rows: DataFrame, shape: Shape, books: np.ndarray) -> np.ndarray:
    """Codebooks whose used entries are the componentwise floor of the mean of their parts."""
    parts, n, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last number of an entry is its count.
        total = np.zeros((parts, n, width + 1), np.int64)
        for batch in batches:
            whole = shape.whole(batch.column("v"))
            codes, _ = assigned(whole, shared.value)
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                at = codes[order, p]
                edges = np.flatnonzero(np.diff(at, prepend=-1))
                if len(edges):
                    total[p, at[edges], :width] += np.add.reduceat(whole[order, p], edges, axis=0)
                    total[p, at[edges], width] += np.diff(edges, append=len(at))
        flat = total.ravel()
        used = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(flat[used])], ["cell", "total"])

    # As many sums as the codebooks have numbers, whatever the number of rows.
    sums = rows.select("v").mapInArrow(added, "cell long, total long").groupBy("cell").agg(F.sum("total").alias("total")).toPandas()
    shared.destroy()
    flat = np.zeros(parts * n * (width + 1), np.int64)
    flat[sums["cell"].to_numpy(np.int64)] = sums["total"].to_numpy(np.int64)
    total = flat.reshape(parts, n, width + 1)
    count = total[:, :, width:]
    return np.where(count > 0, total[:, :, :width] // np.maximum(count, 1), books)


def digest(books: np.ndarray) -> str:
    """The SHA-256 of all components in decimals, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(rows: DataFrame, shape: Shape, books: np.ndarray) -> DataFrame:
    """id, label, code (two hex digits for each part), error of each kept row."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    digits = np.array([f"{i:02x}" for i in range(max(1, books.shape[1]))])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = assigned(shape.whole(batch.column("v")), shared.value)
            text = ["".join(row) for row in digits[codes].tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(text, pa.string()), pa.array(errors.sum(1))], ["id", "label", "code", "error"])

    kind = lambda c: rows.schema[c].dataType.simpleString()
    return rows.mapInArrow(code, f"id {kind('id')}, label {kind('label')}, code string, error long")


def _apart(label: Column) -> Column:
    """A label as text in which null is told apart, hidden from Spark's view of how sums by label are dealt: then a hot label's rows can be split."""
    return F.concat(F.when(label.isNull(), "").otherwise(F.concat(F.lit("="), label.cast("string"))), F.lit(""))


def compressed(vectors: DataFrame, id_col="vec_id", vector_col="embedding", label_col="label", **options) -> tuple[DataFrame, np.ndarray]:
    """id, label, code, error, label_error (errors summed over equal labels, nulls together) of each kept row, and the codebooks."""
    rows = kept(vectors, vector_col).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("v"))
    shape, books = learn(rows, **options)
    codes = written(coded(rows, shape, books), "codes")
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("_label"), "label_error")
    return codes.join(sums, _apart(F.col("label")) == _apart(F.col("_label"))).drop("_label"), books


def query(spark, sf_dir: str) -> DataFrame:
    found, books = compressed(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The rounds one after another; squared distances as whole numbers, ties to the lower index."""
    steps = [
        f"""d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
     WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rid, part, v[part * len(v) // {PARTS} + 1:(part + 1) * len(v) // {PARTS}] AS v FROM d, (SELECT unnest(range({PARTS})) AS part)),
b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, v FROM p WHERE rid <= {ENTRIES})"""
    ]
    for k in range(ROUNDS + 1):
        # list_dot_product takes doubles, in which such sums are exact.
        far = "(list_dot_product(p.v::DOUBLE[], p.v::DOUBLE[]) - 2 * list_dot_product(p.v::DOUBLE[], b.v::DOUBLE[]) + list_dot_product(b.v::DOUBLE[], b.v::DOUBLE[]))::BIGINT"
        steps.append(f"a{k} AS MATERIALIZED (SELECT p.rid, p.part, min({{'far': {far}, 'entry': b.entry}}) AS best, any_value(p.v) AS v FROM p JOIN b{k} b USING (part) GROUP BY p.rid, p.part)")
        if k < ROUNDS:
            steps.append(f"""m{k} AS MATERIALIZED (SELECT part, entry, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM (SELECT part, best.entry AS entry, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{k}) GROUP BY part, entry, i),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.v, b.v) AS v FROM b{k} b LEFT JOIN (SELECT part, entry, list(x ORDER BY i) AS v FROM m{k} GROUP BY part, entry) n USING (part, entry))""")
    steps.append(f"""c AS (SELECT rid, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.far)::BIGINT AS error FROM a{ROUNDS} GROUP BY rid),
s AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})""")
    return f"WITH {', '.join(steps)}\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN d USING (rid), s"


ORACLE = _oracle()
