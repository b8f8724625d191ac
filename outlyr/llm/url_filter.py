"""URL filters: a bit-parallel automaton that runs all glob rules over each canonical URL at once.

Rules become globs over '.' + host + path, where * matches a run without '/', ** any run, and every other character
itself. Each glob of m characters takes m + 1 bits (how many of them are matched) of multiword masks; one character of a
URL moves all globs: states = ((states << 1) & step[c]) | (states & stay[c]). A batch of URLs is a matrix of words, so
numpy moves all URLs of a batch together.

A null URL, or one without '://', has an empty host and path and gets the default verdict, as does one that no rule fits.
A URL of any length is run whole; a batch's URLs are run in blocks of like length. Repeated rows give a row each, an empty
table none. Of rules of one length the first wins. Only the id and the URL column are read.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlyr.llm.common import table

# The rules of the query, as verdict, host and path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: URLs are taken in blocks of at most so many bytes, padded, so that a long one does not widen the others.
BLOCK_BYTES = 1 << 21


@dataclass(frozen=True)
class Automaton:
    step: np.ndarray  #: [256, words]: states that a byte leads to
    stay: np.ndarray  #: [256, words]: states that a byte leaves as they are
    start: np.ndarray  #: [words]
    ends: tuple[int, ...]  #: the last state of each glob


def compile_globs(globs: list[str]) -> Automaton:
    """The masks of all globs, end to end."""
    steps, stays, starts, ends, bit = [], [], [], [], 0
    for glob in globs:
        starts.append(bit)
        data, i = glob.encode(), 0
        while i < len(data):
            if data[i] == ord("*"):
                far = data[i : i + 2] == b"**"
                stays.append((bit, far))
                i += 2 if far else 1
            else:
                bit += 1
                steps.append((bit, data[i]))
                i += 1
        ends.append(bit)
        bit += 1
    width = max(1, -(-bit // 64))
    step, stay, start = np.zeros((256, width), np.uint64), np.zeros((256, width), np.uint64), np.zeros(width, np.uint64)
    mask = lambda b: np.uint64(1 << b % 64)
    for b, c in steps:
        step[c, b // 64] |= mask(b)
    for b, far in stays:
        loops = np.array([far or c != ord("/") for c in range(256)])
        stay[loops, b // 64] |= mask(b)
    for b in starts:
        start[b // 64] |= mask(b)
    return Automaton(step, stay, start, tuple(ends))


def run(auto: Automaton, urls: list[bytes]) -> np.ndarray:
    """[urls, globs] booleans: which globs match which URLs whole."""
    matched = np.zeros((len(urls), len(auto.ends)), bool)
    lengths = np.array([len(u) for u in urls], np.int64)
    order, at = np.argsort(-lengths, kind="stable"), 0
    while at < len(order):
        longest = max(1, int(lengths[order[at]]))
        block = order[at : at + max(1, BLOCK_BYTES // longest)]
        at += len(block)
        own = lengths[block]
        chars = np.zeros((len(block), longest), np.uint8)
        chars[np.arange(longest)[None, :] < own[:, None]] = np.frombuffer(b"".join(urls[i] for i in block), np.uint8)
        states = np.repeat(auto.start[None, :], len(block), 0)
        live = np.searchsorted(-own, -np.arange(longest), side="left")  # URLs of the block that have a character there
        for k in range(longest):
            now, c = states[: live[k]], chars[: live[k], k]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            states[: live[k]] = (moved & auto.step[c]) | (now & auto.stay[c])
        for r, b in enumerate(auto.ends):
            matched[block, r] = (states[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1) > 0
    return matched


def host_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; then up to '?', '#' or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.char_length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def judge(pages: DataFrame, id_col="page_id", url_col="url", rules=RULES, default: str = "allow") -> DataFrame:
    """id_col, host, path, rule, verdict of each row; rule is host + path of the longest rule that fits, or null."""
    host, path = host_path(F.col(f"`{url_col}`"))
    auto = compile_globs([f"*.{h}{p}**" for _, h, p in rules])
    names = [h + p for _, h, p in rules]
    by_length = sorted(range(len(rules)), key=lambda r: (len(names[r]), -r))

    @F.pandas_udf("int")
    def longest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for urls in batches:
            matched = run(auto, [u.encode() for u in urls])
            best = np.full(len(urls), -1, np.int32)
            for r in by_length:
                best[matched[:, r]] = r
            yield pd.Series(best)

    said = pages.select(F.col(f"`{id_col}`").alias(id_col), host.alias("host"), path.alias("path"))
    said = said.withColumn("_rule", longest(F.concat(F.lit("."), "host", "path")))
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.when(F.col("_rule") >= 0, F.col("_rule")))
    if not rules:
        return said.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return said.select(id_col, "host", "path", pick(names).alias("rule"), F.coalesce(pick([v for v, *_ in rules]), F.lit(default)).alias("verdict"))


_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
ORACLE = f"""
WITH r(verdict, rhost, rpath) AS (VALUES {_VALUES}),
     u AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
     h AS (SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
     m AS (SELECT rid, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
           FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (rid)"""


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
