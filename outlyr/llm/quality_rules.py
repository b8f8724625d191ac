"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

A null text counts as an empty one, which has no words and fails the base; a text of any length is counted whole. A value at
a threshold passes. Repeated rows and null ids give a row each, an empty table none. Only the id and the text are read, so
other columns may have any names, and keep_good() keeps them.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlyr.llm.common import BLANKS, WORD, words

# Characters counted as symbols, and frequent words of English, French, German and Spanish.
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "by", "this",
    "le", "la", "les", "de", "des", "et", "en", "un", "une", "est", "que", "dans", "pour", "du", "au",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "ein", "eine", "nicht", "auf", "des",
    "el", "los", "las", "del", "y", "se", "una", "con", "por", "para", "no",
)


@dataclass(frozen=True)
class Rule:
    """A text passes if low <= value <= high; value is SQL over the counts that count() makes."""

    name: str
    value: str
    low: float | None = None
    high: float | None = None

    def fails(self) -> Column:
        value = F.expr(self.value)
        tests = [value < self.low] if self.low is not None else []
        tests += [value > self.high] if self.high is not None else []
        failed = F.lit(False)
        for test in tests:
            failed = failed | F.coalesce(test, F.lit(False))
        return failed


#: What every text must pass. 100 * n_repeat_words > 50 * n_words fails, and a text without words fails by its length.
BASE = (Rule("too_few_words", "n_words", low=50), Rule("repeated_words", "100 * n_repeat_words - 50 * n_words", high=0))
#: The method's own thresholds: length, symbol, stop-word and line ratios. A ratio over nothing is null and passes.
THRESHOLDS = (
    Rule("too_many_words", "n_words", high=1_000_000),
    Rule("word_length", "try_divide(word_chars, n_words)", low=2, high=15),
    Rule("symbol_ratio", "try_divide(n_symbols, n_words)", high=0.3),
    Rule("stop_word_ratio", "try_divide(n_stop_words, n_words)", low=0.02),
    Rule("duplicate_line_ratio", "try_divide(n_dup_lines, n_lines)", high=0.5),
)


def _length_without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def _repeated(w: Column, window: int) -> Column:
    """Words inside windows that occur twice or more: windows sorted with their places, equal neighbours kept."""
    last = F.size(w) - window
    grams = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.concat_ws(" ", *[F.get(w, i + k) for k in range(window)]).alias("gram"), i.alias("at")))
    return F.when(last >= 1, F.sort_array(grams)).alias("_sorted")


def count(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words of each row, all long.

    Null texts count as empty; repeated rows and null ids give a row each. Only id_col and text_col are read, so other
    columns may have any names.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    at = lambda s, j: F.get(s, j)["gram"]
    twice = lambda s: F.filter(F.transform(s, lambda x, j: F.when((x["gram"] == at(s, j - 1)) | (x["gram"] == at(s, j + 1)), x["at"])), lambda x: x.isNotNull())
    return (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .select("_id", "_text", words(F.col("_text")).alias("_w"), lines.alias("_l"))
        .select(
            "_id",
            F.size("_w").cast("long").alias("n_words"),
            _length_without(text, BLANKS).cast("long").alias("word_chars"),
            (F.char_length(text) - _length_without(text, SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
            F.size("_l").cast("long").alias("n_lines"),
            F.size(F.filter("_w", lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
            _repeated(F.col("_w"), window),
        )
        .withColumn("_at", twice(F.col("_sorted")))
        .select(
            F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines",
            F.coalesce(F.size(F.array_distinct(F.flatten(F.transform("_at", lambda i: F.sequence(i, i + (window - 1)))))), F.lit(0)).cast("long").alias("n_repeat_words"),
            "n_lines", "n_stop_words",
        )
    )


def judge(counted: DataFrame, base: tuple[Rule, ...] = BASE, thresholds: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """counted with base_failed, kept and failed: the names of the rules that a text breaks, joined by commas."""
    named = [F.when(r.fails(), F.lit(r.name)) for r in (*base, *thresholds)]
    broken = F.lit(False)
    for r in base:
        broken = broken | r.fails()
    failed = F.concat_ws(",", *named)
    # The second half holds always; being tied to its place, it keeps a filter on kept from being moved below the counts,
    # where each of their uses would count anew.
    kept = (failed == "") & (F.monotonically_increasing_id() >= 0)
    return counted.select("*", broken.alias("base_failed"), kept.alias("kept"), failed.alias("failed"))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text breaks no rule, with all their columns."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    judged = judge(count(packed.select("row", F.col(f"row.`{text_col}`").alias("text")), "row", "text"))
    return judged.filter("kept").select("row.*")


QUERY_COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words", "failed")


def _oracle() -> str:
    sized = [f"CASE WHEN {' OR '.join(t)} THEN '{r.name}' END" for r in (*BASE, *THRESHOLDS) for t in [[f"{v} < {r.low}"] * (r.low is not None) + [f"{v} > {r.high}"] * (r.high is not None) for v in [r.value.replace("try_divide(", "ratio(")]]]
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    failed = f"concat_ws(',', {', '.join(sized)})"
    import re

    failed = re.sub(r"ratio\((\w+), (\w+)\)", r"(\1 / nullif(\2, 0))", failed)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
     w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
     g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
     t AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
     r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM t) GROUP BY rid),
     c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{BLANK_SQL}', '', 'g'))::BIGINT AS word_chars,
                  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
                  coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
                  len(list_filter(w, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words
           FROM w LEFT JOIN r USING (rid)),
     f AS (SELECT *, {failed} AS failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failed = '' AS kept, n_lines, n_stop_words, failed FROM f"""


BLANK_SQL = r"[\x20\x09-\x0D]"
ORACLE = _oracle()


def query(spark, sf_dir: str) -> DataFrame:
    from outlyr.llm.common import table

    return judge(count(table(spark, sf_dir, "documents"))).select(*QUERY_COLUMNS)
