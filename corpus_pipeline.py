"""From raw documents to packed training sequences, in five stages.

Every stage takes the documents that the one before kept and returns documents of the
same columns; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import jaccard_join, langid, mixing, packing, secrets
from tessella.llm.common import WORD, discard, documents, n_words, scope, stash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; texts that are null, without letters or like no language go."""
    found = langid.identify(docs.withColumnsRenamed({"lang_pred": "__l", "score": "__s"}), langid.train(docs))
    kept = found.where(langid.accepted(F.col("lang_pred"), F.col("score"))).drop("lang_pred", "score")
    return kept.withColumnsRenamed({"__l": "lang_pred", "__s": "score"}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: that of the smallest id, null ids last.

    Rows that repeat id and text are one document, of which one row stays; rows of one id
    and different texts are documents of their own. Texts without words are nobody's
    duplicates.
    """
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    found = jaccard_join.similar_components(keyed.select("__key", "text"), key="__key").select("__key", "component_id")
    found = stash(found.distinct(), "components")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__key")
    keepers = keyed.select("__key", "doc_id").join(found, "__key").groupBy("component_id").agg(F.min_by("__key", order).alias("__key"))
    others = stash(found.join(keepers, "__key", "left_anti").select("__key"), "near-duplicates")
    again = stash(keyed.groupBy("__key").count().where("count > 1").select("__key"), "repeated-rows")
    kept = keyed.join(others, "__key", "left_anti")
    if not again.isEmpty():  # only rows that are repeated meet to be one
        kept = kept.join(again, "__key", "left_anti").unionByName(kept.join(again, "__key", "left_semi").dropDuplicates(["__key"]))
    return kept.select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret; null and empty texts and null ids as they are."""
    model = secrets.train(secrets.labelled_findings(spark, secrets.excerpts(docs)))
    rows = docs.withColumn("__text", F.xxhash64("text"))
    found = secrets.scan(rows.select("doc_id", "__text", "source", "text"), model)
    spans = stash(found.where("is_secret").select("doc_id", "__text", "start", "length", "is_secret"), "secret-spans")
    cleaned = secrets.redact(rows, spans, ["doc_id", "__text"])
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it, to the nearest whole time; those without words once.

    Documents are told apart by id and text, so that those of one id, or of none, have counts
    of their own; rows that repeat both are taken equally often.
    """
    key, text = F.xxhash64("doc_id", "text"), F.col("text")
    laid, spans = mixing.mix(docs.select(key.alias("doc_id"), "source", n_words(text).alias("size")))
    found = stash(mixing.times(laid, spans), "mix-times")
    return mixing.repeated(docs, found, key, "source", text.rlike(WORD))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids, in sequences of 4096 tokens; null and empty texts are an end id.

    Places are found without the ids, which are joined to them at the end.
    """
    pieces = packing.token_pieces(docs, packing.default_tokenizer(), with_ids=True)
    pieces = stash(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    placed = packing.pack(pieces.drop("ids"), ["doc_id", "piece", "__row"])
    return placed.join(pieces.select("__row", "ids"), "__row").drop("__row")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("packing", packed),
]

#: The first, second and fourth stage can't be expressed in the other engine's SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again; what a stage wrote on its way goes when it is done, its own rows when the next is."""
    docs, before = documents(spark, sf_dir), []
    for name, stage in STAGES:
        with scope(spark):
            docs = stash(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
        discard(*before)
        before = [docs]
    return docs
