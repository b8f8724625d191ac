import base64
import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from outlyr.llm import bpe, language_id, media, quality_classifier, shingles, token_counts, url_filter

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(codec, reference):
    @settings(max_examples=300, deadline=None)
    @given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
    def check(text):
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()

    check()
    for text in ("", "a" * 20_000, " " * 5000 + "\n" * 300, "it's we'll  x\t\x1c\x85　"):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_bpe_edges(edge, empty, reference):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest(edge, RANKS, public_tokenizers.PATTERN).collect()}
    want = set()
    for r in edge.collect():
        ids = np.array(reference.encode_ordinary(r.text or ""), "<u4")
        want.add((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == want and bpe.digest(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def spans_by_hand(codec, text):
    """Characters whose bytes each token holds, one token at a time."""
    owner = [i for i, c in enumerate(text) for _ in c.encode()]
    at, out = 0, []
    for i in np.frombuffer(codec.encode(text), "<u4").tolist():
        n = len(codec.tokens[i])
        out.append((owner[at], owner[at + n - 1] + 1))
        at += n
    return out


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(codec, rule):
    rng = random.Random(3)
    lengths = np.array([len(t) for t in codec.tokens])
    for _ in range(150):
        text = "".join(rng.choice("ab é🦊\n\n .") for _ in range(rng.randint(1, 40)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text), rng.randint(1, 5))))
        sections = np.array(list(zip([0, *cuts], [*cuts, len(text)])))
        sections = sections[sections[:, 0] < sections[:, 1]]
        starts, ends = token_counts.spans(text, lengths[np.frombuffer(codec.encode(text), "<u4")])
        assert list(zip(starts.tolist(), ends.tolist())) == spans_by_hand(codec, text)
        got, _ = token_counts.allocate(starts, ends, sections, rule)
        want = np.zeros(len(sections))
        for a, b in spans_by_hand(codec, text):
            part = [max(0, min(b, y) - max(a, x)) for x, y in sections.tolist()]
            if rule == "share":
                want += np.array(part) / (b - a)
            else:
                want[part.index(max(part)) if rule == "majority" else next(k for k, p in enumerate(part) if p)] += 1
        assert got == pytest.approx(want)
    got, crossing = token_counts.allocate(np.array([0, 2, 8]), np.array([2, 8, 9]), np.array([[1, 4], [6, 8]]), rule)
    assert crossing.tolist() == [2, 1] and got.sum() <= 2


def test_token_count_rows(edge, empty):
    rows = token_counts.counted(edge, RANKS, public_tokenizers.PATTERN).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert [(r.section, r.n_chars, r.tokens) for r in by[2]] == [(0, 0, 0)] and [(r.section, r.tokens) for r in by[3]] == [(0, 0)]
    assert all(sum(r.tokens for r in v) == v[0].doc_tokens * (2 if k == 1 else 1) for k, v in by.items())
    assert token_counts.counted(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        token_counts.counted(edge, RANKS, public_tokenizers.PATTERN, rule="x")


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    import re

    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


def test_url_rules(spark):
    rng = random.Random(5)
    hosts = ["com", "net", "example.com", "EXAMPLE.com", "www.example.com", "a.www.example.com", "xexample.com", "m.example.net", "x.org", "", "com.", "é.com", "net:80", "u@b.com"]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en', '/en/', '/en/x', '/es/1', '/fr/', '/EN/', '/a.com/en/', '//en/'])}{rng.choice(['', '?q=http://x.com/', '#/en/', '?'])}" for _ in range(600)]
    urls += [None, "", "no scheme", "http:/x.com/", "://example.com/en/", "http://" + "a" * 50_000 + ".com/", "http://x.com/\n/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got == {i: plain_verdict(u) for i, u in enumerate(urls)}
    assert url_filter.judge(df.limit(0)).count() == 0 and url_filter.judge(df, rules=()).filter("rule is null").count() == len(urls)


def test_globs():
    import re

    rng = random.Random(8)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**", "."]) for _ in range(rng.randint(1, 24))) for _ in range(60)]
    globs = [g.replace("***", "**").replace("***", "**") for g in globs]
    patterns = [re.compile("(?s)" + re.sub(r"\*\*|\*|.", lambda m: {"**": ".*", "*": "[^/]*"}.get(m[0], re.escape(m[0])), g)) for g in globs]
    urls = [b"", *["".join(rng.choice("ab/.") for _ in range(rng.randint(0, 30))).encode() for _ in range(300)]]
    got = url_filter.run(url_filter.compile_globs(globs), urls)
    assert got.shape == (301, 60) and got.tolist() == [[bool(p.fullmatch(u.decode())) for p in patterns] for u in urls]


def test_media_round_trip(edge, empty):
    @settings(max_examples=60, deadline=None)
    @given(st.binary(max_size=2500))
    def check(data):
        whole = media.payload(data)
        assert len(whole) % 576 == 0 and whole[: len(data)] == data and set(whole[len(data) :]) <= {255} and len(whole) - len(data) <= 576
        assert media.decode(media.encode(whole)).tobytes() == whole

    check()
    rows = {r.doc_id: r for r in media.read_back(media.stored(edge)).collect()}
    for r in edge.collect():
        data = media.payload((r.text or "").encode())
        got = rows[r.doc_id]
        assert (got.n_bytes, got.payload_bytes, got.payload_sha256, got.tail_crc32) == (len((r.text or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
    assert rows[2].media_sha256 == rows[3].media_sha256 and rows[2].hash == rows[3].hash and media.read_back(media.stored(empty)).count() == 0


def test_media_filters_and_damage():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (9, 12), dtype=np.uint8)
    kinds = np.array([4, 1, 2, 3, 0, 4, 3, 2, 1], np.uint8)
    lines = np.zeros((9, 13), np.uint8)
    for y in range(9):
        for x in range(12):
            a = int(image[y, x - 1]) if x else 0
            b = int(image[y - 1, x]) if y else 0
            c = int(image[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            lines[y, x + 1] = (int(image[y, x]) - [0, a, b, (a + b) // 2, paeth][kinds[y]]) % 256
    lines[:, 0] = kinds
    assert (media.unfilter(lines) == image).all()
    lines[:, 0] = [0, 2, 2, 1, 2, 0, 0, 2, 2]
    by_hand = lines[:, 1:].copy()
    by_hand[3] = np.cumsum(by_hand[3], dtype=np.uint8)
    for y in (1, 2, 4, 7, 8):
        by_hand[y] += by_hand[y - 1]
    assert (media.unfilter(lines) == by_hand).all()
    good = media.encode(media.payload(b"some text"))
    for at in (0, 20, 45, len(good) - 3):
        with pytest.raises(media.Damaged):
            media.decode(good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :])
    with pytest.raises(media.Damaged):
        media.decode(good[:-12])


def test_media_blocks_and_frequencies():
    """Images of several blocks come back, and the hash is that of a plain cosine transform."""
    rng = np.random.default_rng(7)
    for n in (1, 3, media.BLOCK, 2 * media.BLOCK + 5):
        image = (rng.integers(0, 256, (n, media.WIDTH)) // (1 + np.arange(n) % 3)[:, None]).astype(np.uint8)
        assert (media.decode(media.encode(image.tobytes())) == image).all()
    image = rng.integers(0, 256, (media.BLOCK + 9, media.WIDTH), dtype=np.uint8)
    h, w = image.shape
    wave = lambda u, n: [np.cos(np.pi * u * (2 * x + 1) / (2 * n)) for x in range(n)]
    plain = np.array([[(image * np.outer(wave(u, h), wave(v, w))).sum() / (h * w) for v in range(8)] for u in range(8)]).round(6).ravel()
    assert media.frequency_hash(image) == np.packbits(plain > np.median(plain[1:])).tobytes()
    lighter = np.clip(image.astype(int) + 1, 0, 255).astype(np.uint8)
    far = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(media.frequency_hash(a), media.frequency_hash(b)))
    assert far(image, lighter) < 8 < far(image, rng.integers(0, 256, image.shape, dtype=np.uint8))


def test_media_is_made_once_for_each_row(edge):
    plan = media.read_back(media.stored(edge))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("ArrowEvalPython") == 1 and "to_media" in plan.split("MapInArrow")[1]


def languages(spark, n=240):
    rng = random.Random(2)
    words = {"en": ["the", "house", "thing", "with", "other", "which"], "de": ["der", "haus", "ding", "mit", "anders", "welche"], "fr": ["le", "maison", "chose", "avec", "autre", "quelle"]}
    rows = [(i, " ".join(rng.choice(words[k]) + rng.choice(["", "s", "e"]) for _ in range(60)), k) for i in range(n) for k in [["en", "en", "de", "fr"][i % 4]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_is_right_on_held_out_rows(spark, edge, empty):
    docs = languages(spark)
    known = language_id.learn(docs)
    assert list(known) == ["en", "de", "fr"] or set(known) == {"en", "de", "fr"} and list(known)[0] == "en"
    out = language_id.identified(docs, known).join(docs, "doc_id").collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in out)
    for r in out[:12]:
        # The sizes are those of compressing each segment by itself.
        data, sizes = r.text.lower().encode(), {}
        for name, content in known.items():
            each = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes[name] = sum(len(each.compress(data[k : k + language_id.SEGMENT])) for k in range(0, len(data), language_id.SEGMENT))
        least, second = sorted(sizes.values())[:2]
        assert sizes[r.lang_pred] == least and r.margin == pytest.approx(second / least - 1) and r.rejected == (r.margin < language_id.MARGIN)
    # Labels of held-out rows change nothing.
    other = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    assert language_id.learn(other) == known
    odd = {r.doc_id: r for r in language_id.identified(edge, known).collect()}
    assert odd[2].lang_pred == odd[3].lang_pred == odd[5].lang_pred == "und" and odd[6].lang_pred in known and len(odd) == 8
    assert language_id.identified(empty, known).count() == 0 and language_id.learn(empty) == {}
    assert {r.lang_pred for r in language_id.identified(edge, {}).collect()} == {"und"}


def test_every_language_is_learned_from_whole_texts(spark):
    """A language of copies alone, one whose lines all occur in others, many languages, and words at the end of long texts."""
    long = "\n".join(f"common {i} line" for i in range(400))
    rows = [(i, "ein satz\nnoch einer", "de") for i in range(30)] + [(100 + i, "shared words", ["aa", "bb"][i % 2]) for i in range(30)]
    rows += [(200 + i, f"{long}\nonly at the end {i}", "en") for i in range(9)] + [(1000 + i, f"text {i} of its own", f"l{i // 3}") for i in range(900)]
    known = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(known) == {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1} and len(known) > 280
    assert known["de"].count(b"ein satz") == 1 and known["aa"] == known["bb"] == b"shared words" and b"only at the end" in known["en"]
    assert max(map(len, known.values())) <= language_id.ALL_BYTES // len(known) and list(known)[0] == "de"


def test_classifier(spark, edge, empty):
    rng = random.Random(4)
    good, bad = ["plain", "words", "in", "order", "of", "reading"], ["BUY!!", "NOW!!", "$$$", "***", "click&&"]
    rows = [(i, " ".join(rng.choice(bad if i % 5 == 0 else good) for _ in range(50)), int(i % 5 != 0)) for i in range(400)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    options = quality_classifier.Options(steps=3000)
    out = quality_classifier.judged(docs, labels, options).collect()
    truth = {i: q for i, _, q in rows}
    assert all(r.predicted == truth[r.doc_id] and 0 <= r.score <= 1 for r in out) and {r.held_out for r in out} == {True, False}
    flipped = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert [r.score for r in quality_classifier.judged(docs, flipped, options).orderBy("doc_id").collect()] == [r.score for r in quality_classifier.judged(docs, labels, options).orderBy("doc_id").collect()]
    odd = quality_classifier.judged(edge, labels, options).collect()
    assert len(odd) == 9 and len({r.score for r in odd if r.doc_id in (2, 3)}) == 1
    assert quality_classifier.judged(empty, labels, options).count() == 0
    none = quality_classifier.judged(docs, labels.limit(0), options).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {0}
    kept = quality_classifier.keep_good(docs.withColumn("score", F.lit("x")), labels, options)
    assert {r.doc_id for r in kept.collect()} == {i for i, q in truth.items() if q} and kept.columns == ["doc_id", "text", "score"]


def test_training_gradient():
    """The gradient is that of finite differences, and training follows it."""
    rng = np.random.default_rng(3)
    part, rows, output, bias = rng.random(5), rng.standard_normal((5, 4)), rng.standard_normal((2, 4)), rng.standard_normal(2)
    part /= part.sum()
    for label in (0, 1):
        found = quality_classifier.gradient(part, rows, output, bias, label)
        for at, x in enumerate((rows, output, bias)):
            for i in np.ndindex(x.shape):
                kept, x[i] = x[i], x[i] + 1e-6
                up = quality_classifier.gradient(part, rows, output, bias, label)[3]
                x[i] = kept
                assert (up - found[3]) / 1e-6 == pytest.approx(found[at][i], abs=1e-4)
    texts, labels = ["good plain words", "bad bad noise"], [1, 0]
    rows = [quality_classifier.weighed(t, 17) for t in texts]
    early = quality_classifier.train(rows, labels, quality_classifier.Options(steps=2, rate=0.01))
    late = quality_classifier.train(rows, labels, quality_classifier.Options(steps=600, rate=0.5))
    loss = lambda m: -np.log(m.scores(texts[:1])[0]) - np.log(1 - m.scores(texts[1:])[0])
    assert loss(late) < 0.2 < loss(early)


def test_classifier_features_are_words_repeats_and_character_runs():
    """As many as a plain count gives, and a score is the mean of what they add."""
    with np.errstate(over="ignore"):
        for text in ("", "a", "ab abc  abcd", "x x x", "né 日本語本 🦊🦊🦊🦊\u2003z"):
            words = [w for w in re.split("[ \t-\r]+", text) if w]
            n = len(words) + sum(a == b for a, b in zip(words, words[1:])) + sum(max(0, len(w) - k + 1) for w in words for k in (3, 4))
            buckets, owner = quality_classifier.features(["other", text], 17)
            mine = buckets[owner == 1]
            assert len(mine) == n and (quality_classifier.features([text], 17)[0] == mine).all()
            model = quality_classifier.Model(np.random.default_rng(1).standard_normal(1 << 17), 0.25, 17)
            assert model.scores([text])[0] == pytest.approx(1 / (1 + np.exp(-0.25 - (model.adds[mine].mean() if n else 0))))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_held_out_accuracy_on_the_tables(spark):
    """Of language ID and of the classifier, on rows that nothing was learned from."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    said = language_id.query(spark, "/root/testdata/sf0.01").filter("held_out").join(docs.select("doc_id", "lang", "text"), "doc_id").filter("lang is not null and text rlike '[a-zA-Z]'")
    right, n = said.agg(F.count_if(F.expr("lang = lang_pred")), F.count("*")).first()
    assert n > 100 and right >= 0.97 * n
    said = quality_classifier.query(spark, "/root/testdata/sf0.01").filter("held_out").join(labels, "doc_id")
    right, n = said.agg(F.count_if(F.expr("quality = predicted")), F.count("*")).first()
    assert n > 50 and right >= 0.97 * n


def test_word_hashes_depend_on_words_alone():
    with np.errstate(over="ignore"):
        a, n = shingles.word_hashes(["The cat\tsat", "", "cat", " \n", "é cat "])
        assert n.tolist() == [3, 0, 1, 0, 2] and a[1] == a[3] == a[5] and len(set(a.tolist())) == 4
        low, _ = shingles.word_hashes(["THE É"], lower=True)
        assert low[0] == shingles.word_hashes(["the"])[0][0] and low[1] == shingles.word_hashes(["É"])[0][0]
