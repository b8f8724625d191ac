"""Language ID by compression: the language whose dictionary makes a text smallest.

A bounded sample of whole texts of each language makes a raw-content zstandard dictionary: of the pieces (lines, long ones
cut) that texts of no other language of the sample hold, one copy each, those with the smallest hashes, up to a bound in
bytes. A piece may come from anywhere in its text. A language whose pieces are all shared takes them as they are, so
every language that is present can be predicted. A text is cut into segments, so that a long one cannot learn its language
from itself, and (in lower case) all of its segments are compressed with each dictionary. The smallest sum wins; where the
margin to the second is narrow, the decision is rejected: the column rejected says so, and the score is low.

A null text, or one without a letter, is 'und' with score 0, as is every text where no language is known. Texts of any
length are compressed whole. Sums that tie go to the language with more rows, then to the first by name. Repeated rows
give a row each and are sampled as rows; an empty table teaches nothing and gives no rows. Only the named columns are
read; a row's language, source and id are no part of its prediction.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlyr.llm.common import discard, small_batches, table, written

#: Texts of each language that are learned from, at most; they are read whole.
SAMPLE_TEXTS = 512
#: Languages whose counts are broadcast at most.
BROADCAST_LANGUAGES = 1 << 16
#: Bytes of one dictionary and of all together, at most: what the driver gets and each task holds.
DICTIONARY_BYTES, ALL_BYTES = 1 << 18, 1 << 26
#: Characters of a piece.
PIECE = 512
SEGMENT = 2048
LEVEL = 9
#: Of the smallest sum, how much more the second must take.
MARGIN = 0.01
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """The rows that nothing is learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sampled(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """lang, count (of its rows), text, written: of rows with a language and some text that are not held out, those with the smallest hashes.

    A threshold on the hash, from the language's count, leaves about twice as many as are wanted before anything is
    shuffled, however many rows there are.
    """
    i, text, lang = F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")
    rows = docs.filter(~held_out(i) & lang.isNotNull() & (text != "")).select(lang.alias("lang"), F.shiftrightunsigned(F.xxhash64(i), 1).alias("order"), text.alias("text"))
    known = written(rows.groupBy("lang").count(), "counts")
    # Counts are broadcast where they are known to be few; else a join finds the same rows.
    few = F.broadcast(known) if known.count() <= BROADCAST_LANGUAGES else known
    near = rows.join(few, "lang").filter(F.col("order") / float(1 << 63) * F.col("count") < 2 * SAMPLE_TEXTS + 64)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "text"))
    taken = written(near.withColumn("rank", rank).filter(F.col("rank") <= SAMPLE_TEXTS).select("lang", "count", "text"), "languages")
    discard(known)
    return taken


def learn(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> dict[str, bytes]:
    """The dictionary of each language that is present, the most frequent first."""
    # Many languages share ALL_BYTES, so each learns from a piece of what it would have alone.
    taken = sampled(docs, id_col, text_col, lang_col)
    line = F.explode(F.split(F.lower("text"), "\n"))
    pieces = taken.select("lang", "count", line.alias("line")).filter(F.btrim("line") != "")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.char_length("line") - 1) / PIECE).cast("int")), lambda k: F.substring("line", k * PIECE + 1, F.lit(PIECE)))
    pieces = pieces.select("lang", "count", F.explode(cut).alias("piece"))
    # One row for each piece and language, and whether one language alone has it: sums that combine before a shuffle.
    own = pieces.groupBy("piece").agg(F.min("lang").alias("low"), F.max("lang").alias("high"))
    kept = pieces.distinct().join(own, "piece").withColumn("own", F.col("low") == F.col("high"))
    any_own = F.max("own").over(Window.partitionBy("lang"))
    kept = kept.withColumn("_any", any_own).filter(F.col("own") | ~F.col("_any"))
    most = max(1 << 12, min(DICTIONARY_BYTES, ALL_BYTES // max(1, taken.select("lang").distinct().count())))
    upto = F.sum(F.octet_length("piece") + 1).over(Window.partitionBy("lang").orderBy(F.xxhash64("piece"), "piece").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = kept.withColumn("_upto", upto).filter(F.col("_upto") <= most)
    # All of a language's pieces are bounded by most.
    made = kept.groupBy("lang", "count").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_upto", "piece"))), lambda x: x["piece"]), "\n").cast("binary").alias("text"))
    out = {r.lang: bytes(r.text) for r in made.orderBy(F.desc("count"), "lang").collect()}
    discard(taken)
    return out


class Judge:
    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard

        self.names = list(dictionaries)
        self._compress = []
        for name in self.names:
            content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self._compress.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def sizes(self, text: str) -> list[int]:
        data = text.lower().encode()
        parts = [data[k : k + SEGMENT] for k in range(0, len(data), SEGMENT)]
        return [sum(len(c(p)) for p in parts) for c in self._compress]

    def judge(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score from 0 to 1, margin, rejected."""
        if not self.names or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0, True
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        best, second = sizes[order[0]], sizes[order[1]] if len(order) > 1 else 2 * sizes[order[0]]
        margin = second / best - 1
        return self.names[order[0]], 1 - float(np.exp(-margin / (2 * MARGIN))), margin, margin < MARGIN


def identified(docs: DataFrame, dictionaries: dict[str, bytes], id_col="doc_id", text_col="text") -> DataFrame:
    """id_col, lang_pred, score, margin, rejected of each row, from its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(dictionaries).judge
        for batch in batches:
            said = [judge(t) for t in batch.column(1).to_pylist()]
            columns = list(zip(*said, strict=True)) or [(), (), (), ()]
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [id_col, "lang_pred", "score", "margin", "rejected"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, margin double, rejected boolean")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identified(docs, learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")
