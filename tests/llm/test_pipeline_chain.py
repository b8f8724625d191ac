"""The pipeline's rows against a plain recomputation of each stage from the one before it."""

import base64
import hashlib
import os
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_native import WORD, counts
from test_ngram_join import brute

import corpus_pipeline
from outlyr.llm import quality_rules

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def keeps_rules(text):
    n, chars, symbols, twice, repeated = counts(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    stops = sum(w.lower() in quality_rules.STOP_WORDS for w in WORD.findall(text))
    if n < 50 or 100 * repeated > 50 * n:
        return False
    return 2 <= chars / n <= 15 and symbols / n <= 0.3 and stops / n >= 0.02 and not (lines and twice / len(lines) > 0.5)


def mixed(docs):
    """Each document as often and as far as the mix takes it, by filling sources in their shuffled order."""
    sized = [(i, s, len(WORD.findall(t)), t) for i, t, s in docs]
    own = Counter()
    for _, s, n, _ in sized:
        own[s] += n
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(own))}
    target, left, open_ = {}, 1.5 * sum(own.values()), set(own)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * own[s]}
        for s in full or open_:
            target[s] = 2 * own[s] if full else level * weight[s]
            left -= target[s]
        open_ -= full or open_
    out = []
    for s in own:
        mine = sorted((hashlib.md5(f"17:{i}".encode()).hexdigest(), n, i, t) for i, source, n, t in sized if source == s)
        at, goal = 0, int(target[s])
        for _ in range(2):
            for _, n, i, t in mine:
                taken = min(n, goal - at)
                if taken > 0:
                    out.append((i, s, t if taken == n else " ".join(WORD.findall(t)[:taken])))
                at += max(0, taken)
    return out


def test_rows_of_the_whole_chain(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    # The classifier's decisions are taken as they are; everything after them is worked out anew.
    good = [(r.doc_id, r.text or "", r.source) for r in corpus_pipeline.quality(spark, docs, DATA).collect()]
    assert len(good) > 50
    ruled = [d for d in good if keeps_rules(d[1])]
    first = {c for _, _, c in brute([d[:2] for d in ruled], 5, 80)}
    alone = [d for d in ruled if d[0] in first]
    assert len(alone) < len(ruled) < len(good)
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = defaultdict(int)
    for i, source, text in mixed(alone):
        ids = np.array(codec.encode_ordinary(text), "<u4")
        want[i, source, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.source, r.n_tokens, hashlib.sha256(bytes(r.ids)).hexdigest(), r.decoded_sha256) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == want and re.fullmatch("[0-9a-f]{64}", next(iter(got))[3])
