"""Language identification: multinomial naive Bayes over hashed character n-grams.

The log-probability matrix (buckets x languages, a few MB) is broadcast. The n-grams of a
batch of texts are made together, as the rows of one sparse matrix, and scored by one
gather from the broadcast matrix and one sum by rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import documents, ship, slices, stash

UNDETERMINED = "und"
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Characters whose n-grams are made at once; longer texts are worked through in stretches.
CHUNK = 1 << 18
#: Languages of one block of the matrix, which is 128 KB a language.
LANGUAGES = 500
#: Numbers taken from the matrix at once, and languages whose counts a task holds at once.
GATHERED, HELD = 1 << 21, 200
#: N-grams of one text overlap and are far from independent: the evidence of a long text counts as that of so many.
EVIDENCE = 300


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Rows and pieces of a batch's texts, some CHUNK characters at a time; long texts come in stretches that share n - 1 characters with the one before."""
    back = max(ORDERS) - 1
    rows, pieces, held = [], [], 0
    for row, text in enumerate(texts):
        for k in range(0, len(text or ""), CHUNK):
            pieces.append(f" {text[max(0, k - back) : k + CHUNK].lower()} ")
            rows.append(row)
            held += len(pieces[-1])
            if held >= CHUNK:
                yield rows, pieces
                rows, pieces, held = [], [], 0
    if pieces:
        yield rows, pieces


def _grams(pieces: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the buckets of the pieces' n-grams, piece by piece, and how many each has.

    Lower case, anything but letters as one space. No n-gram reaches from one piece into the next.
    """
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    codes = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(_letters()[codes], codes, 32)
    owner = np.repeat(np.arange(len(pieces)), sizes)
    blank = codes == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[np.cumsum(sizes) - sizes] = True
    codes, owner = codes[keep].astype(np.uint32), owner[keep]
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(1)
        if n in ORDERS:
            own = owner[: len(h)]
            inside = own == owner[n - 1 :]
            mixed = (h[inside] ^ (h[inside] >> np.uint32(15))) * np.uint32(0x9E3779B1 + 2 * n)
            yield mixed >> np.uint32(32 - BUCKETS.bit_length() + 1), np.bincount(own[inside], minlength=len(pieces))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Block:
    """Some languages' part of the matrix."""

    languages: list[str]
    log_p: np.ndarray  # buckets x languages
    log_prior: np.ndarray

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """texts x languages: prior and evidence of a batch, its n-grams taken together as one sparse matrix by rows."""
        total, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        step = max(1, GATHERED // max(1, len(self.languages)))
        for rows, pieces in _pieces(texts):
            rows = np.array(rows)
            for grams, counts in _grams(pieces):
                np.add.at(n, rows, counts)
                bounds = np.concatenate(([0], np.cumsum(counts)))
                for k in range(0, len(grams), step):  # so many rows of the matrix at once
                    end = min(k + step, len(grams))
                    first, last = np.searchsorted(bounds, k, "right") - 1, np.searchsorted(bounds, end, "left")
                    own = np.flatnonzero(counts[first:last]) + first
                    sums = np.add.reduceat(self.log_p[grams[k:end]], np.maximum(bounds[own], k) - k, axis=0, dtype=np.float64)
                    np.add.at(total, rows[own], sums)
        return self.log_prior + total * np.minimum(1.0, EVIDENCE / np.maximum(n, 1))[:, None]


@dataclass
class Model:
    counts: DataFrame | None  # lang, bucket, n: written once
    languages: list[str]
    texts: np.ndarray  # of each language
    alpha: float

    def blocks(self) -> Iterator[Block]:
        """The matrix, LANGUAGES languages at a time: so neither the driver nor a task holds more, however many there are."""
        for k in range(0, len(self.languages), LANGUAGES):
            own = self.languages[k : k + LANGUAGES]
            rows = self.counts.where((F.col("lang") >= own[0]) & (F.col("lang") <= own[-1]) & (F.col("bucket") >= 0)).toArrow()
            names = rows.column("lang").combine_chunks().dictionary_encode() if len(rows) else None
            counts = np.zeros((BUCKETS, len(own)))
            if names is not None:
                place = {x: i for i, x in enumerate(own)}
                col = np.array([place[x] for x in names.dictionary.to_pylist()])[names.indices.to_numpy()]
                counts[rows.column("bucket").to_numpy(), col] = rows.column("n").to_numpy()
            log_p = np.log(counts + self.alpha) - np.log(counts.sum(0) + self.alpha * BUCKETS)
            yield Block(own, log_p.astype(np.float32), np.log(self.texts[k : k + LANGUAGES] / self.texts.sum()))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts by language of one partition; bucket -1 has the number of texts."""
    counts: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([lang] * (len(at) + 1)), "bucket": pa.array(np.append(at, -1), pa.int32()), "n": pa.array(np.append(own[at], texts[lang]), pa.int64())}
            )

    for batch in slices(batches):
        langs = batch.column(1).to_pylist()
        for lang in langs:
            texts[lang] = texts.get(lang, 0) + 1
            counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
        for own_rows, pieces in _pieces(batch.column(0).to_pylist()):
            own_langs = [langs[r] for r in own_rows]
            names = {x: i for i, x in enumerate(dict.fromkeys(own_langs))}
            which = np.array([names[x] for x in own_langs])
            for grams, n in _grams(pieces):
                of = np.repeat(which, n)
                for lang, i in names.items():
                    counts[lang] += np.bincount(grams[of == i] if len(names) > 1 else grams, minlength=BUCKETS)
        if len(counts) > HELD:
            yield from rows()
            counts, texts = {}, {}
    yield from rows()


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", alpha: float = 0.5) -> Model:
    """Counts the n-grams of all rows with a text and a language.

    Each task sums up its own texts, so what is shuffled is bounded by buckets x languages
    per task, however many texts there are; of the counts, the driver reads those of
    LANGUAGES languages at a time. No labelled rows give a model that answers `und`.
    """
    ship(labelled.sparkSession)
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sums = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums = stash(sums, "language-counts")
    found = {r["lang"]: r["n"] for r in sums.where("bucket = -1").select("lang", "n").collect()}  # a row a language
    languages = sorted(found, key=lambda x: x.encode("utf-8", "surrogatepass"))  # as Spark compares strings
    return Model(sums, languages, np.array([found[x] for x in languages], float), alpha)


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred and score to every row; other columns of those names are replaced.

    Null texts and texts without a letter get `und` and 0.0. Equal texts get equal
    answers; ties go to the first language by name. Texts of any length are read whole, a
    stretch at a time. With over LANGUAGES languages, rows are scored against so many at a
    time, written between, and keep the best and the sum of all so far.
    """
    spark = df.sparkSession
    ship(spark)
    df = df.drop(*({"lang_pred", "score"} - {text}))
    others, at = df.columns, df.columns.index(text)
    fields = [T.StructField("__lang", T.StringType()), T.StructField("__best", T.DoubleType()), T.StructField("__sum", T.DoubleType())]
    schema = T.StructType([*df.schema.fields, *fields])
    rows, first = df, True

    def scored(shared, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block: Block = shared.value
            for batch in slices(batches):
                texts = [x if has_letter(x) else None for x in batch.column(at).to_pylist()]
                logits = block.logits(texts)
                best = np.argmax(logits, axis=1) if len(texts) else np.zeros(0, int)
                top = logits[np.arange(len(texts)), best]
                total = top + np.log(np.exp(logits - top[:, None]).sum(1))
                langs = [None if x is None else block.languages[k] for x, k in zip(texts, best.tolist(), strict=True)]
                if not first:
                    old = [batch.column(len(others) + k) for k in range(3)]
                    best_so_far, sum_so_far = (np.array(x.to_pylist(), float) for x in old[1:])
                    keep = best_so_far >= top
                    langs = [o if k else n for o, n, k in zip(old[0].to_pylist(), langs, keep.tolist(), strict=True)]
                    top, total = np.maximum(top, best_so_far), np.logaddexp(total, sum_so_far)
                columns = [*batch.columns[: len(others)], pa.array(langs, pa.string()), pa.array(top), pa.array(total)]
                yield pa.RecordBatch.from_arrays(columns, [*others, "__lang", "__best", "__sum"])

        return run

    for block in model.blocks():
        if not first:
            rows = stash(rows, "scored-so-far")
        rows, first = rows.mapInArrow(scored(spark.sparkContext.broadcast(block), first), schema), False
    if first:
        return df.withColumn("lang_pred", F.lit(UNDETERMINED)).withColumn("score", F.lit(0.0))
    lang, score = F.coalesce("__lang", F.lit(UNDETERMINED)), F.when(F.col("__lang").isNull(), 0.0).otherwise(F.exp(F.col("__best") - F.col("__sum")))
    return rows.select(*others, lang.alias("lang_pred"), score.alias("score"))


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents, by a checksum of their id, is kept from training. Null ids never are."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trained_on_documents(docs: DataFrame) -> Model:
    return train(docs.where(~held_out(F.col("doc_id"))))


def accepted(lang: Column, score: Column, least: float = 0.5) -> Column:
    """Whether a text is kept: its language is determined, with at least this probability."""
    return (lang != UNDETERMINED) & (score >= least)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model that has seen three quarters of them."""
    docs = documents(spark, sf_dir)
    model = trained_on_documents(docs)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")
