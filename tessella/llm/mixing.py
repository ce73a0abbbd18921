"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.llm.common import chunks_for, documents, n_words, number_rows, running_sums, stash

#: The fractional part of the golden ratio, and that of its multiple by 2**20, which keeps points exact for large slots.
GOLDEN = 0.6180339887498949
GOLDEN_20 = (GOLDEN * 2**20) % 1.0

#: Sources up to this number are sent to every task (about 100 bytes each); beyond it the join shuffles.
FEW_SOURCES = 20_000


def golden_point(slot: Column) -> Column:
    """The golden-ratio point of a slot in [0, 1)."""
    high, low = F.shiftright(slot, 20), slot.bitwiseAND(F.lit(2**20 - 1))
    return (high.cast("double") * GOLDEN_20 % 1.0 + low.cast("double") * GOLDEN + GOLDEN) % 1.0


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """One row per source: index, weight, source_size and target.

    `sizes` has source and source_size. Sources are ordered by code point, null last, and
    take `weights` in turn. Together they get `share` times all sizes by weight; none
    gets over `most` times its own size, and what is over goes to the others by weight.
    That is a level L with target = min(most * size, weight * L), which sorting by
    most * size / weight and running sums give in one pass. The sums are taken in ranges of
    the order, so that a table with a source per host doesn't meet in one task.
    """
    ranked = running_sums(stash(sizes, "source-sizes"), [F.col("source").asc_nulls_last()], {"idx": F.lit(1).cast("long")})
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", turn).withColumn("cap", most * F.col("source_size").cast("double"))
    ranked = running_sums(ranked, [F.col("cap") / F.col("weight"), F.col("idx")], {"cap_before": F.col("cap"), "weight_before": F.col("weight")})
    ranked = stash(ranked, "ranked-sources")
    all_size, all_weight = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double"), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    goal = share * all_size
    full = F.col("cap_before") + F.col("cap") / F.col("weight") * (F.lit(all_weight) - F.col("weight_before")) <= goal
    ranked = ranked.withColumn("full", full)
    used = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0))
    filled, open_weight = ranked.agg(F.coalesce(used, F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))), F.lit(0.0))).first()
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * (goal - filled) / max(open_weight, 1e-300))
    return ranked.select("source", "idx", "weight", "source_size", F.least(target, F.col("cap")).alias("target"))


def _shuffled(seed: int) -> Column:
    """The number by which a source's documents are ordered, those of one number by doc_id."""
    return F.xxhash64("doc_id", F.lit(seed))


def _block_start(j: Column) -> Column:
    return j * F.col("base") + F.least(j, F.col("extra"))


def _block_of(word: Column) -> Column:
    long_part = F.col("extra") * (F.col("base") + 1)
    return F.when(word < long_part, F.floor(word / (F.col("base") + 1))).otherwise(
        F.col("extra") + F.floor((word - long_part) / F.col("base"))
    ).cast("long")


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    slots: int = 100_000,
    block_words: int = 4096,
    seed: int = 6,
) -> tuple[DataFrame, DataFrame]:
    """A mixture of `docs` (doc_id, source, size): (laid, spans).

    Every source's documents are shuffled by a hash of doc_id, laid end to end and cut
    into blocks of equal word counts. A schedule gives slot t to the source in whose
    share of [0, 1) the golden-ratio point of t falls, and the r-th slot of a source
    takes its r-th block, going round again after the last. Slots beyond a source's
    target fall away, the few that it lacks come last, and its final block is cut where
    the target is met, so a source gets its target to within a word.

    Blocks have about `block_words` words, fewer where there would be under `slots` slots.

    laid: idx, source, doc_id, size, start (its place in its source), source_size, target.
    spans: slot, idx, doc_id, doc_start, from_word, words (of the document, in that slot).
    Null sizes count as 0; documents of size 0 have no spans; repeated doc_ids are
    documents of their own; an empty table gives two empty tables.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    rows = stash(rows, "mix-sizes")
    n_chunks = 1 << (chunks_for(rows.count(), 500) - 1).bit_length()
    sources = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    take = F.floor(F.col("target") + 0.5)
    all_words = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    per_block = max(1, min(block_words, int(share * all_words) // slots))
    sources = (
        sources.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / per_block)).cast("long"))
        .withColumn("base", F.expr("source_size div blocks"))
        .withColumn("extra", F.expr("source_size % blocks"))
        .withColumn("take", F.least(take, F.floor(most * F.col("source_size"))).cast("long"))
        .withColumn("rounds", F.expr("if(source_size > 0, take div source_size, 0L)"))
        .withColumn("rest", F.expr("if(source_size > 0, take % source_size, 0L)"))
    )
    part = F.when(F.col("rest") > 0, _block_of(F.col("rest") - 1) + 1).otherwise(F.lit(0))
    needs = F.when(F.col("source_size") > 0, F.col("rounds") * F.col("blocks") + part).otherwise(0).cast("long")
    sources = stash(sources.withColumn("needs", needs), "mix-sources")

    # documents end to end in each source
    h = _shuffled(seed)
    chunk = (F.shiftright(h, 64 - n_chunks.bit_length() + 1) if n_chunks > 1 else F.lit(0)).cast("int")
    named = sources.select(F.col("source").alias("named"), "idx", "source_size", "target", "blocks", "base", "extra")
    n_sources = sources.count()
    if n_sources <= FEW_SOURCES:
        named = F.broadcast(named)
    keyed = rows.join(named, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    keyed = keyed.withColumn("h", h).withColumn("chunk", chunk)
    before = W.partitionBy("idx").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunk_base = keyed.groupBy("idx", "chunk").agg(F.sum("size").alias("n"))
    chunk_base = chunk_base.select("idx", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("chunk_base"))
    inside = W.partitionBy("idx", "chunk").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    laid = keyed.join(chunk_base, ["idx", "chunk"]).withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("chunk_base"))
    laid = stash(laid.drop("h", "chunk", "chunk_base"), "mix-laid")

    # the schedule
    total = sources.agg(F.coalesce(F.sum("needs"), F.lit(0))).first()[0]
    cells = 1 << max(12, n_sources.bit_length())  # about one source's share each
    all_slots = F.lit(float(max(1, total)))
    shares = running_sums(sources.where("needs > 0").select("idx", "needs"), [F.col("idx")], {"below": F.col("needs")})
    shares = shares.select("idx", (F.col("below") / all_slots).alias("low"), ((F.col("below") + F.col("needs")) / all_slots).alias("high"))
    first, last = F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1).cast("long"))
    shares = shares.withColumn("cell", F.explode(F.sequence(first, last)))
    points = spark.range(total).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") * cells))
    dealt = points.join(shares.select("idx", "low", "high", "cell"), "cell").where("point >= low and point < high").select("slot", "idx")
    stretch = F.floor(F.col("slot") / max(1, total // n_chunks)).cast("long")
    dealt = stash(number_rows(dealt, ["idx"], stretch, [F.col("slot")], "r"), "mix-slots")
    got = dealt.groupBy("idx").agg(F.count(F.lit(1)).alias("got"))
    short = sources.join(got, "idx", "left").withColumn("got", F.coalesce("got", F.lit(0).cast("long"))).where("needs > got")
    short = short.select((F.lit(total) + F.col("idx")).cast("long").alias("slot"), "idx", F.explode(F.sequence("got", F.col("needs") - 1)).alias("r"))
    about = sources.select("idx", "needs", "blocks", "base", "extra", "rest")
    slots_df = dealt.unionByName(short).join(about, "idx").where("r < needs")
    slots_df = slots_df.withColumn("block", F.col("r") % F.col("blocks"))
    begin, end = _block_start(F.col("block")), _block_start(F.col("block") + 1)
    last = (F.col("r") == F.col("needs") - 1) & (F.col("rest") > 0)
    slots_df = slots_df.select("slot", "idx", "block", begin.alias("begin"), F.when(last, F.col("rest")).otherwise(end).alias("end"))

    # documents meet the slots of their blocks
    pieces = laid.where("size > 0").select(
        "idx", "doc_id", "start", "size",
        F.explode(F.sequence(_block_of(F.col("start")), _block_of(F.col("start") + F.col("size") - 1))).alias("block"),
    )
    spans = pieces.join(slots_df, ["idx", "block"])
    low, high = F.greatest("begin", "start"), F.least("end", F.col("start") + F.col("size"))
    spans = spans.select("slot", "idx", "doc_id", F.col("start").alias("doc_start"), (low - F.col("start")).alias("from_word"), (high - low).alias("words"))
    return laid.select("idx", "source", "doc_id", "size", "start", "source_size", "target"), spans.where("words > 0")


def taken(laid: DataFrame, spans: DataFrame) -> DataFrame:
    """`laid` with the words that the mixture takes of each document, repeats counted."""
    sums = spans.groupBy("idx", F.col("doc_start").alias("start")).agg(F.sum("words").alias("taken"))
    some = laid.where("size > 0").join(sums, ["idx", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return some.unionByName(laid.where("size = 0").withColumn("taken", F.lit(0).cast("long")))


def times(laid: DataFrame, spans: DataFrame, seed: int = 6) -> DataFrame:
    """One row per source with words: source, more, less, h, last; how often the mixture takes its documents, to the nearest whole time.

    A source's blocks are taken in turn, again and again, so its documents are taken `more`
    times up to a place in their order, and `less` times after it. The last of the first
    ones has the number h of `repeated` and the doc_id `last`. A table of documents needs no
    join with the counts of all documents, only with this one.
    """
    counted = taken(laid, spans).where("size > 0").withColumn("times", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int"))
    most = F.max(F.struct("times", _shuffled(seed).alias("h"), "doc_id")).alias("most")
    found = counted.groupBy("source").agg(most, F.min("times").alias("less"))
    return found.select("source", F.col("most.times").alias("more"), "less", F.col("most.h").alias("h"), F.col("most.doc_id").alias("last"))


def repeated(docs: DataFrame, found: DataFrame, key: Column, source: str, some: Column, seed: int = 6) -> DataFrame:
    """Every row of `docs` as often as `found`, of `times`, says; those that aren't `some` (have no words) once.

    `key` is what was the doc_id there, and has no nulls. Rows of one source and key are taken equally often.
    """
    few = found.count() <= FEW_SOURCES
    about = found.select(*[F.col(c).alias(f"__{c}") for c in found.columns])
    rows = docs.withColumn("__key", key).join(F.broadcast(about) if few else about, F.col(source).eqNullSafe(F.col("__source")), "left")
    h = F.xxhash64("__key", F.lit(seed))
    first = (h < F.col("__h")) | ((h == F.col("__h")) & (F.col("__key") <= F.col("__last")))
    n = F.when(~F.coalesce(some, F.lit(False)) | F.col("__more").isNull(), 1).when(first, F.col("__more")).otherwise(F.col("__less"))
    rows = rows.withColumn("__times", n).where("__times > 0")
    return rows.withColumn("__times", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)


def op6_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source: words that the mixture takes of each."""
    docs = documents(spark, sf_dir).select("doc_id", "source", n_words(F.col("text")).alias("size"))
    laid, spans = mix(docs)
    return taken(laid, spans).select("doc_id", "size", "source_size", "target", "taken", "source")
