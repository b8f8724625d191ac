"""Token counts by offset-mapped attribution.

A whole document is encoded once. Tokens and sections are intervals of its characters; a sorted interval join finds the
sections of each token. A token inside one section counts there. One that crosses a boundary is allocated by a rule:

    start     the section of its first character
    majority  the section with most of its characters, the earlier of equals
    share     every section it touches, by characters

A token that holds part of a character's bytes spans the whole character. Characters outside all sections count nowhere.

A null or empty text is one empty section without tokens; texts of any length are encoded whole, and a task holds the spans
of one text and the sections of a slice of texts. Of equal parts the earlier section wins. Only the named columns are read;
repeated rows give their sections again, and an empty table gives none.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlyr.llm.bpe import Codec, read_ranks
from outlyr.llm.common import slices, small_batches, table

RULES = ("start", "majority", "share")


def spans(text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and the one after the last of each token, from the tokens' lengths in bytes."""
    lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
    begun = np.concatenate(([0], np.cumsum(lead)))
    ends = np.cumsum(lengths)
    return begun[ends - lengths + 1] - 1, begun[ends]


def lines(text: str) -> np.ndarray:
    """[lines, 2]: the characters of each line, its line feed included; an empty text is one empty line."""
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10) + 1
    if not len(ends) or ends[-1] < len(text):
        ends = np.append(ends, len(text))
    return np.stack([np.concatenate(([0], ends[:-1])), ends], 1)


def allocate(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and tokens that cross a boundary there. sections: sorted, without overlaps."""
    counts, crossing = np.zeros(len(sections)), np.zeros(len(sections), np.int64)
    first = np.searchsorted(sections[:, 1], starts, "right")
    last = np.searchsorted(sections[:, 0], ends, "left") - 1
    whole = (first == last) & (sections[np.minimum(first, len(sections) - 1), 0] <= starts) & (sections[np.minimum(first, len(sections) - 1), 1] >= ends)
    np.add.at(counts, first[whole], 1)
    # A row for each token that crosses and each section that it touches, tokens and sections in order.
    over = np.flatnonzero(~whole & (first <= last))
    n = last[over] - first[over] + 1
    token = np.repeat(over, n)
    touched = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n) + first[token]
    part = np.minimum(sections[touched, 1], ends[token]) - np.maximum(sections[touched, 0], starts[token])
    token, touched, part = token[part > 0], touched[part > 0], part[part > 0]
    np.add.at(crossing, touched, 1)
    if rule == "share":
        np.add.at(counts, touched, part / (ends[token] - starts[token]))
    elif rule == "majority":
        order = np.lexsort((touched, -part, token))
        chosen = order[np.diff(token[order], prepend=-1) > 0]
        np.add.at(counts, touched[chosen], 1)
    else:
        holds = sections[touched, 0] <= starts[token]
        np.add.at(counts, touched[holds], 1)
    return counts, crossing


def counted(docs: DataFrame, vocabulary: str, pattern: str, id_col="doc_id", text_col="text", sections: Callable[[str], np.ndarray] = lines, rule: str = "majority") -> DataFrame:
    """id_col, section (from 0), first_char, n_chars, tokens (double), crossing, doc_tokens of each section of each row."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}, not {rule!r}")
    small_batches(docs.sparkSession)
    tokens = read_ranks(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, lengths = Codec(tokens, pattern), np.array([len(t) for t in tokens], np.int64)
        names = [id_col, "section", "first_char", "n_chars", "tokens", "crossing", "doc_tokens"]
        for batch in batches:
            for few in slices(batch, "_text"):
                parts = []
                for text in few.column(1).to_pylist():
                    text = text or ""
                    ids, where = np.frombuffer(codec.encode(text), "<u4"), sections(text)
                    counts, crossing = allocate(*spans(text, lengths[ids]), where, rule) if len(ids) else (np.zeros(len(where)), np.zeros(len(where), np.int64))
                    parts.append((where, counts, crossing, len(ids)))
                sizes = [len(p[0]) for p in parts]
                number = np.concatenate([np.arange(n) for n in sizes])
                where, counts, crossing = (np.concatenate([p[k] for p in parts]) for k in range(3))
                columns = [number, where[:, 0], where[:, 1] - where[:, 0], counts, crossing, np.repeat([p[3] for p in parts], sizes)]
                ids = few.column(0).take(pa.array(np.repeat(np.arange(len(parts)), sizes)))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c.astype(np.float64 if k == 3 else np.int64)) for k, c in enumerate(columns)]], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, section long, first_char long, n_chars long, tokens double, crossing long, doc_tokens long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return counted(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
