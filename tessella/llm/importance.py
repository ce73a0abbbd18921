"""Importance resampling toward a target corpus, on word n-grams whose CRC-32 is put together from those of the words."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import documents, ship, stash
from tessella.llm.words import Numbers, parts
from tessella.operators.ordered import ranks

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BUCKETS = 10_000
#: Words whose CRC a task keeps for later batches, and bytes of these.
KNOWN_WORDS, KNOWN_BYTES = 200_000, 8 << 20

# CRC-32 is linear over GF(2): crc(a + b) = shift(crc(a), len(b)) ^ crc(b), where shift
# multiplies by the 32 x 32 bit matrix of one zero byte, once for every byte of b.

POLYNOMIAL = 0xEDB88320


def _applied(matrix: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The matrix, as its 32 columns, times each vector of bits."""
    out = np.zeros_like(vectors)
    for i in range(32):
        out ^= np.where((vectors >> np.uint32(i)) & np.uint32(1), matrix[i], np.uint32(0))
    return out


def _byte_matrix() -> np.ndarray:
    bit = np.array([POLYNOMIAL, *[1 << i for i in range(31)]], np.uint32)
    for _ in range(3):  # one bit, two, four, eight
        bit = _applied(bit, bit)
    return bit


def _tables(matrix: np.ndarray) -> np.ndarray:
    """What the matrix makes of each value of each of the four bytes."""
    values = np.arange(256, dtype=np.uint32)
    return np.stack([_applied(matrix, values << np.uint32(8 * j)) for j in range(4)])


def _looked_up(tables: np.ndarray, which: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    low = np.uint32(255)
    return (
        tables[which, 0, crcs & low]
        ^ tables[which, 1, (crcs >> np.uint32(8)) & low]
        ^ tables[which, 2, (crcs >> np.uint32(16)) & low]
        ^ tables[which, 3, crcs >> np.uint32(24)]
    )


class Shifts:
    """shift(crcs, lengths): short lengths by one table each, others by the powers of two that they are made of."""

    SHORT = 48

    def __init__(self) -> None:
        powers = [_byte_matrix()]
        for _ in range(40):
            powers.append(_applied(powers[-1], powers[-1]))
        each = [np.array([1 << i for i in range(32)], np.uint32)]  # a shift by nothing
        for _ in range(self.SHORT):
            each.append(_applied(powers[0], each[-1]))
        self.short = np.stack([_tables(m) for m in each])
        self.powers = np.stack([_tables(m) for m in powers])

    def __call__(self, crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = _looked_up(self.short, np.minimum(lengths, self.SHORT), crcs)
        if (far := np.flatnonzero(lengths > self.SHORT)).size:
            own, left = crcs[far], lengths[far]
            for k in range(len(self.powers)):
                if (at := np.flatnonzero((left >> k) & 1)).size:
                    own[at] = _looked_up(self.powers, np.full(at.size, k), own[at])
            out[far] = own
        return out


class Features:
    """CRCs of the n-grams of texts. A word's CRC is taken once for all its places, and kept for later batches."""

    def __init__(self, n: int) -> None:
        self.n, self.shift = n, Shifts()
        self.known, self.crcs, self.lengths = Numbers(), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(CRCs of all n-grams of up to n words, the text of each, words of each text), in no order that matters."""
        ids, words = self.known.of(texts, TERM)
        if len(self.known) > len(self.crcs):
            fresh = [w.encode() for w in list(self.known)[len(self.crcs) :]]
            self.crcs = np.concatenate([self.crcs, np.array([zlib.crc32(w) for w in fresh], np.uint32)])
            self.lengths = np.concatenate([self.lengths, np.array([len(w) for w in fresh], np.int64)])
        crcs, lengths = self.crcs[ids], self.lengths[ids]
        text = np.repeat(np.arange(len(texts)), words)
        space = np.full(len(crcs), zlib.crc32(b" "), np.uint32)
        spaced = self.shift(space, lengths) ^ crcs  # of " " and the word
        found, owners, grams = [crcs], [text], crcs
        for k in range(1, self.n):
            within = text[:-k] == text[k:] if len(text) > k else np.zeros(0, bool)
            grams = (self.shift(grams[: max(0, len(text) - k)], lengths[k:] + 1) ^ spaced[k:])
            found.append(grams[within])
            owners.append(text[: len(within)][within])
        if len(self.known) > KNOWN_WORDS or self.lengths.sum() > KNOWN_BYTES:
            self.known, self.crcs, self.lengths = Numbers(), self.crcs[:0], self.lengths[:0]
        return np.concatenate(found), np.concatenate(owners), words


def bucket_counts(df: DataFrame, text: str, n: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall to each bucket: one vector a task, summed up by Spark."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(n), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in parts(batch, 0):
                total += np.bincount(features.of(texts)[0] % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    ship(df.sparkSession)
    sums = df.select(text).mapInArrow(of, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():  # at most `buckets` rows
        out[r.bucket] = r.n
    return out


def log_ratios(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain: 1000 times the logarithm of its smoothed share of the target over that of the corpus, rounded down."""
    buckets, s_all, t_all = len(own), float(own.sum()), float(target.sum())
    each = zip(own.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)))) for s, t in each], np.int64)


def gumbel(seed: int, key: object) -> int:
    """1000 times a Gumbel variate drawn from the key's hash, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, key: str, text: str, n: int, seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(gains)  # a number a bucket

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, gain = Features(n), sent.value
        for batch in batches:
            for part, texts in parts(batch, 1):
                crcs, owners, words = features.of(texts)
                counts = np.bincount(owners, minlength=len(texts))
                order = np.argsort(owners, kind="stable")
                upto = np.concatenate([[0], np.cumsum(gain[crcs[order] % np.uint32(len(gain))])])
                ends = np.cumsum(counts)
                weights = (upto[ends] - upto[ends - counts]) // np.maximum(counts, 1)
                noise = np.array([gumbel(seed, "null" if k is None else k) for k in part.column(0).to_pylist()], np.int64)
                columns = [part.column(0), *map(pa.array, (words, counts.astype(np.int64), weights, weights + noise))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight", "score"])

    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(of, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", n: int = 2, buckets: int = BUCKETS, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): a draw without replacement, in proportion to how alike a document is to the target.

    A feature is a run of 1 to `n` words, and stands for the bucket of its CRC-32. A
    bucket's gain compares its share of all features of `target` and of `docs`; a
    document's weight is the mean of its features' gains, rounded down, 0 without any. The
    score adds Gumbel noise of the id, so that the highest scores are such a draw. Of the
    documents of at least `least_words` words, `percent` in a hundred are drawn and ranked
    by score, then id; the others' rank is null.

    Null texts have no words; null ids draw one number among them and come first among
    ties; repeated rows are documents of their own. An empty target gives gains against
    nothing; an empty table gives none. Other columns are left out. Only counts by bucket
    reach the driver; texts are read twice and never shuffled.
    """
    gains = log_ratios(bucket_counts(docs, text, n, buckets), bucket_counts(target, target_text, n, buckets))
    rows = stash(scored(docs, gains, key, text, n, seed), "importance")
    enough = F.col("n_words") >= least_words
    drawn = percent * rows.where(enough).count() // 100
    ranked = ranks(rows.where(enough), [], ["score desc", "doc_id"], {"rank": "row_number"})
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def op12_crc_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of all documents, drawn toward the texts of `benchmark`."""
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resample(documents(spark, sf_dir), target)
