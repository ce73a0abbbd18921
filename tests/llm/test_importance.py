"""Composed CRCs against those of the strings; the draw against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import importance
from tessella.llm.importance import Features, Shifts, op12_crc_importance, resample

UPPER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, n=2):
    words = WORD.findall((text or "").translate(UPPER))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, n=2, buckets=10_000, percent=25, least=20, seed=7):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    own, aim = Counter(), Counter()
    for _, t in docs:
        own.update(map(bucket, grams(t, n)[1]))
    for t in target:
        aim.update(map(bucket, grams(t, n)[1]))
    s_all, t_all = sum(own.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (s_all + buckets) / ((own[b] + 1) * (t_all + buckets))))
    rows, enough = [], []
    for i, t in docs:
        words, features = grams(t, n)
        weight = sum(gain(bucket(g)) for g in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(features), weight, score, None])
        if len(words) >= least:
            enough.append(rows[-1])
    enough.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(enough[: percent * len(enough) // 100], 1):
        r[4] = k
    return sorted(map(tuple, rows), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_shifts_append_bytes():
    rng = random.Random(1)
    pairs = [(rng.randbytes(rng.randrange(20)), rng.randbytes(m)) for m in [*range(60), 255, 256, 1000, 65_537, 300_000]]
    crcs = np.array([zlib.crc32(a) for a, _ in pairs], np.uint32)
    shifted = Shifts()(crcs, np.array([len(b) for _, b in pairs], np.int64))
    assert [int(x) ^ zlib.crc32(b) for x, (_, b) in zip(shifted, pairs, strict=True)] == [zlib.crc32(a + b) for a, b in pairs]


@pytest.mark.parametrize("n", [1, 2, 4])
def test_composed_crcs(n, monkeypatch):
    monkeypatch.setattr(importance, "KNOWN_WORDS", 30)
    rng, features = random.Random(n), Features(n)
    for _ in range(3):
        texts = [" ".join(rng.choice(["a", "Zwölf", "日本", "x" * 300, "7up", f"w{rng.random()}"]) for _ in range(rng.randrange(12))).lower() for _ in range(20)] + ["", "-", "one"]
        crcs, owners, words = features.of(texts)
        want = Counter((i, zlib.crc32(g.encode())) for i, t in enumerate(texts) for g in grams(t, n)[1])
        assert Counter(zip(owners.tolist(), crcs.tolist(), strict=True)) == want
        assert words.tolist() == [len(grams(t)[0]) for t in texts]
        assert len(features.known) <= 30 or not len(features.crcs)


@pytest.mark.parametrize(("n", "buckets", "percent", "least"), [(2, 10_000, 25, 20), (3, 50, 60, 1)])
def test_equals_brute_force(spark, edge_dir, n, buckets, percent, least):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{edge_dir}/documents.parquet").collect()]
    target = ["the of and to in that it was for on are with", None, "", "we can OUT other 7 were"]
    got = resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=buckets, percent=percent, least_words=least)
    assert found(got) == brute(docs, target, n, buckets, percent, least)


def test_ties_and_repeated_rows(spark):
    docs = [(5, "same words " * 15)] * 40 + [(None, "same words " * 15)] * 3
    got = found(resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "text string"), percent=100))
    assert sorted(r[4] for r in got) == list(range(1, 44))
    assert [r[:4] for r in got] == [r[:4] for r in brute(docs, [], percent=100)]


def test_empty_tables(spark, empty_dir):
    nothing = spark.read.parquet(f"{empty_dir}/documents.parquet")
    assert resample(nothing, nothing).collect() == []


def test_other_columns_may_clash(spark, clashing):
    docs = clashing.withColumns({c: F.lit("own") for c in ("rank", "weight", "n_features", "bucket")})
    out = resample(docs, docs.limit(1))
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"] and out.count() == docs.count()


def test_query_on_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert found(op12_crc_importance(spark, sf)) == brute(docs, target)
