"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and its reply as the only text under the
loss mask. Turns after the last reply, or a conversation without one, are kept by an example without a trainable part.

    <|turn|>role<|says|>text<|end|>

Control strings inside roles and texts get a tilde before their last character (one more if they have some), which
unescape() takes away again; the strings of another common template are treated alike, so no text can close a turn there.

Nulls: a null role or text is empty; rows with a null conv_id form one conversation, and a null turn comes first. Ties:
turns with one number are ordered by role and text; repeated rows stay. Texts of any length are formatted whole. An empty
table gives no examples. Only the four named columns are read. A conversation is one example's context, so a task holds a
whole conversation at a time, never several at once.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlyr.llm.common import table

# The marks of the template, and the strings that texts must not hold.
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
ESCAPE = r"(<)(~*\|)|(</?s)(~*>)|(\[/?INST)(~*\])"
UNESCAPE = r"(<)~(~*\|)|(</?s)~(~*>)|(\[/?INST)~(~*\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, "$1$3$5~$2$4$6")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$3$5$2$4$6")


def examples(turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", trained_role: str = "assistant") -> DataFrame:
    """conv_id, example, formatted, loss_start, loss_length (code points, 0 for an example without a trainable part)."""
    text = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    said = F.struct(F.col(f"`{turn_col}`").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    convs = turns.select(F.col(f"`{conv_col}`").alias("conv_id"), said.alias("said")).groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    opened = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(SAYS))
    whole = lambda t: F.concat(opened(t), escape(t["text"]), F.lit(END))
    convs = convs.select("conv_id", "said", F.transform("said", whole).alias("turns"))
    picks = F.filter(F.sequence(F.lit(1), F.size("said")), lambda i: (F.element_at("said", i)["role"] == trained_role) | (i == F.size("said")))
    rows = convs.select("conv_id", "said", "turns", F.posexplode(picks).alias("example", "at"))
    last = F.element_at("said", F.col("at"))
    trained = last["role"] == trained_role
    context = F.array_join(F.slice("turns", F.lit(1), F.col("at") - 1), "")
    return rows.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.concat(context, F.element_at("turns", F.col("at"))).alias("formatted"),
        F.when(trained, F.char_length(context) + F.char_length(opened(last))).otherwise(0).cast("long").alias("loss_start"),
        F.when(trained, F.char_length(escape(last["text"]))).otherwise(0).cast("long").alias("loss_length"),
    )


def parsed(formatted: Column) -> Column:
    """The turns of a formatted text: an array of role and text, as they were before escaping."""
    turns = F.filter(F.split(formatted, r"<\|turn\|>"), lambda t: t != "")
    body = lambda t: F.substring_index(t, END, 1)
    return F.transform(turns, lambda t: F.struct(unescape(F.substring_index(body(t), SAYS, 1)).alias("role"), unescape(F.substring_index(body(t), SAYS, -1)).alias("text")))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples, as the examples alone tell them."""
    masked = F.expr("substring(formatted, cast(loss_start as int) + 1, cast(loss_length as int))")
    rows = formatted.select("conv_id", "example", "formatted", F.char_length("formatted").alias("chars"), unescape(masked).alias("loss"))
    per = rows.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum("chars").cast("long").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    per = per.select("conv_id", parsed(F.col("longest")).alias("turns"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"), "formatted_chars", "n_examples")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )


PROBE = "</s>[INST] ok [/INST]"
_LENGTH = len(TURN + SAYS + END)
_escaped = lambda c: rf"regexp_replace({c}, '{ESCAPE}', '\1\3\5~\2\4\6', 'g')"
ORACLE = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')),
     n AS (SELECT *, {_LENGTH} + length({_escaped("role")}) + length({_escaped("text")}) AS chars,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM c),
     p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY pos) AS upto, max(pos) OVER (PARTITION BY conv_id) AS final FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (role = 'assistant' OR pos = final)::BIGINT AS formatted_chars,
       count(*) FILTER (role = 'assistant' OR pos = final) AS n_examples
FROM p GROUP BY conv_id"""


def query(spark, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return read_back(examples(turns))
