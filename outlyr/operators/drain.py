"""Log templates by an online fixed-depth prefix tree over tokens.

A message joins the most similar template among those with its number of tokens and its first tokens, if enough of their
tokens agree; tokens that differ become wildcards. State is bounded by the number of templates; the one used longest ago
goes first.

Messages of unlike lengths or first tokens never share a template, and meet only where the bound drops one. So templates()
follows a key's messages in one task, while templates_by_lead() deals them by length and first tokens as well, numbers the
templates by their first messages afterwards, and leaves to templates() the keys that have more than the bound.
"""

import json
import re
from collections import OrderedDict
from dataclasses import dataclass, field
from operator import eq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlyr.operators.encoders import ranked
from outlyr.operators.sequential import by_key, by_key_in_blocks
from outlyr.session import scratch

WILD = "<*>"
DIGIT = re.compile(r"\d").search
#: A key's lengths and first tokens are dealt into so many parts; a part's are followed one after another.
PARTS = 1024


def lead_of(tokens: list[str], depth: int) -> tuple[int, tuple[str, ...]]:
    """The number of tokens and the first of them, those with digits as wildcards."""
    return len(tokens), tuple([WILD if DIGIT(t) else t for t in tokens[: max(1, depth - 3)]])


def lead(text: Column, depth: int) -> Column:
    """lead_of a text as one text; NULL for a blank one. Spark's patterns take many times as long for the spaces of all scripts."""

    @F.pandas_udf("string")
    def look(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            n, first = lead_of(t.split(), depth) if isinstance(t, str) else (0, ())
            out.append(" ".join([str(n), *first]) if n else None)
        return pd.Series(out, dtype=object)

    return look(text)


@dataclass
class Miner:
    """depth counts the root, the token-count layer and the leaf; what is above them is layers of leading tokens."""

    similarity: float = 0.4
    most: int = 200
    depth: int = 4
    clusters: OrderedDict = field(default_factory=OrderedDict)  #: id -> tokens, the one used last at the end
    index: dict = field(default_factory=dict)  #: (count, leading tokens) -> ids
    made: int = 0
    lead: str | None = None  #: where messages come lead by lead, the present one

    def forget(self, lead: str | None) -> None:
        """Drops all templates, before the messages of another lead; their numbers are not used again."""
        self.lead = lead
        self.clusters.clear()
        self.index.clear()

    def _lead(self, tokens: list[str]) -> tuple:
        return lead_of(tokens, self.depth)

    def _best(self, tokens: list[str], lead: tuple) -> int | None:
        """The id of the template that tokens join."""
        best, most, fewest, n = None, self.similarity, 0, max(1, len(tokens))
        for i in self.index.get(lead, ()):
            template = self.clusters[i]
            alike = sum(map(eq, template, tokens)) / n
            if alike >= most:
                wild = template.count(WILD)
                if alike > most or best is None or wild > fewest:
                    best, most, fewest = i, alike, wild
        return best

    def match(self, message: str) -> tuple[int, list[str]] | None:
        """Id and tokens of the template that the message joins, without learning."""
        tokens = message.split()
        best = self._best(tokens, self._lead(tokens))
        return None if best is None else (best, self.clusters[best])

    def learn(self, message: str) -> int:
        return self.learn_tokens(message.split())

    def learn_tokens(self, tokens: list[str]) -> int:
        lead = self._lead(tokens)
        i = self._best(tokens, lead)
        if i is None:
            self.made += 1
            i = self.made
            self.clusters[i] = tokens
            self.index.setdefault(lead, []).append(i)
            if len(self.clusters) > self.most:
                old, gone = self.clusters.popitem(last=False)
                left = self.index[self._lead(gone)]
                left.remove(old)
                if not left:
                    del self.index[self._lead(gone)]
            return i
        template = self.clusters[i]
        if template != tokens:
            self.clusters[i] = [a if a == b else WILD for a, b in zip(template, tokens, strict=True)]
        self.clusters.move_to_end(i)
        return i

    def saved(self) -> bytes:
        return json.dumps({"made": self.made, "clusters": list(self.clusters.items())}).encode()

    def restored(self, data: bytes) -> "Miner":
        """This miner, which has learned nothing yet, with a saved one's templates."""
        held = json.loads(data)
        self.made, self.clusters = held["made"], OrderedDict((i, tokens) for i, tokens in held["clusters"])
        for i in sorted(self.clusters):
            self.index.setdefault(self._lead(self.clusters[i]), []).append(i)
        return self

    def variables(self, message: str, template: list[str]) -> list[str]:
        return taken(message.split(), template)


def taken(tokens: list[str], template: list[str]) -> list[str]:
    """The tokens at a template's wildcards."""
    return [t for t, own in zip(tokens, template, strict=True) if own == WILD] if WILD in template else []


def templates(df: DataFrame, keys: list[str], order: list[str], text: str, id_col: str, learns: str = "true", keep: list[str] = (), before: DataFrame | None = None, finish: bool = False, in_blocks: bool = False, **params) -> DataFrame:
    """keys, id_col, keep, template_id, template, variables of each row, in order; NULLs for a blank text.

    Rows where the condition learns is false are matched with the templates of their moment, or with none. before: keys and
    state of miners that have learned already; finish: states are handed on (see sequential.by_key). in_blocks: a key's rows are
    followed by stretches of the order, whose first column is a number or a time (see sequential.by_key_in_blocks).
    """
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (*keys, id_col, *keep))
    schema = f"{kinds}, template_id long, template string, variables array<string>"
    step = _step([*keys, id_col, *keep], text)
    df = df.withColumn("_learns", F.expr(learns))
    if before is None and not finish and in_blocks:
        size = F.coalesce(F.octet_length(text), F.lit(0)) + 64
        return by_key_in_blocks(df, keys, order, lambda: Miner(**params), step, schema, lambda data: Miner(**params).restored(data), Miner.saved, size)
    return by_key(df, keys, order, lambda: Miner(**params), step, schema, before, lambda data: Miner(**params).restored(data), Miner.saved if finish else None)


def templates_by_lead(df: DataFrame, keys: list[str], order: list[str], text: str, id_col: str, learns: str = "true", keep: list[str] = (), block: Column | None = None, bound_leads: bool = False, **params) -> DataFrame:
    """The rows of templates(), with as many tasks for a key as its messages have lengths and first tokens.

    order must tell the rows of a key apart. The rows are written once; what is joined to them is a number for each template.
    Keys with more templates than the bound are followed as templates() does, as what is dropped depends on all messages before.
    bound_leads: the bound is of the templates of one length and first tokens instead, and no key is followed as a whole.
    block: a value of the order columns that never falls along them, by which the templates of a key are numbered where they
    may be more than a task should hold (see encoders.ranked).
    """
    miner = Miner(**params)
    at = dict.fromkeys([*keys, id_col, *keep, *order])
    rows = df.withColumns({"_learns": F.expr(learns), "_lead": lead(F.col(text), miner.depth)})
    # Blank messages have no template and no lead.
    rows = rows.withColumn("_part", F.when(F.col("_lead").isNull(), F.pmod(F.xxhash64(*order), F.lit(PARTS)).cast("int")).otherwise(F.pmod(F.xxhash64("_lead"), F.lit(PARTS)).cast("int")))
    shown = [c for c in at if c not in keys]
    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (*keys, "_part", *shown)), "_own long, template string, variables array<string>, _new boolean"])
    step = _step([*keys, "_part", *shown], text, "_own", True)
    path = scratch(df.sparkSession, "templates")
    by_key(rows, [*keys, "_part"], ["_lead", *order], lambda: Miner(**params), step, schema).write.parquet(path)
    found = df.sparkSession.read.parquet(path)

    # Full keys are told by a count and not numbered here.
    new = found.filter("_new").select(*[F.col(k).alias(f"_k_{k}") for k in (*keys, "_part", "_own")], F.struct(*order).alias("_at"), (F.lit(0) if block is None else block).alias("_block"))
    key = [f"_k_{k}" for k in keys]
    same = lambda a, b, names: [a[k].eqNullSafe(b[f"_k_{k}"]) for k in names]
    full = new.groupBy(*key).agg(F.count("*").alias("_n")).filter(F.col("_n") > miner.most).drop("_n")
    out = [*dict.fromkeys([*keys, id_col, *keep]), "template_id", "template", "variables"]
    again = not bound_leads and not full.isEmpty()
    if again and not keys:
        return templates(df, keys, order, text, id_col, learns, keep, **params).select(*out)
    if again:
        path = scratch(df.sparkSession, "full")
        full.write.parquet(path)
        full = df.sparkSession.read.parquet(path)
        found = found.join(full, same(found, full, keys), "left_anti")
        new = new.join(full.select(*[F.col(k).alias(f"_f{k}") for k in key]), [F.col(k).eqNullSafe(F.col(f"_f{k}")) for k in key], "left_anti")
    ids = ranked(new, key, "_at", None if block is None else "_block", "template_id").withColumn("template_id", F.col("template_id").cast("long"))
    named = found.join(ids, same(found, ids, [*keys, "_part", "_own"]), "left")
    named = named.select(*out)
    if not again:
        return named
    rest = df.join(full, same(df, full, keys), "left_semi")
    return named.unionByName(templates(rest, keys, order, text, id_col, learns, keep, **params).select(*out))


def _step(shown: list[str], text: str, name: str = "template_id", marks: bool = False):
    """A step of sequential.by_key: the columns shown, name, template, variables; with marks, whether the row made the template.

    Marked rows are sorted by lead, so what a miner holds of one is dropped when the next begins; numbers go on.
    """

    def step(miner: Miner, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        leads = rows["_lead"] if marks else [None] * len(rows)
        for message, learn, now in zip(rows[text], rows["_learns"], leads, strict=True):
            if marks and now != miner.lead:
                miner.forget(now)
            if not isinstance(message, str) or not message.strip():
                out.append((None, None, None, False))
                continue
            # Learning looks for the template itself.
            found = None if learn else miner.match(message)
            if found is None and not learn:
                out.append((None, None, None, False))
                continue
            made, tokens = miner.made, message.split()
            i = miner.learn_tokens(tokens) if learn else found[0]
            template = miner.clusters[i]
            out.append((i, " ".join(template), taken(tokens, template), miner.made > made))
        found = pd.DataFrame(out, columns=[name, "template", "variables", "_new"], index=rows.index)
        found[name] = found[name].astype("Int64")
        return pd.concat([rows[shown], found if marks else found.drop(columns="_new")], axis=1)

    return step
