"""Document fingerprints by winnowing. DataFrame functions only.

Every run of k words has a rolling hash, a cyclic polynomial over its words' hashes; of each
window of w successive hashes the smallest is kept, the rightmost of equal ones, with its
position. Two texts that share a run of w + k - 1 words share a fingerprint, wherever the
run stands. Hashes and minima of longer stretches are made of those of shorter ones, for
all places of a text at once, so neither k nor w is worked through place by place.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.llm.common import WORD, documents

K = 5
WINDOW = 16
#: Bits for a position: a text has fewer than 2**30 words. Windows compare the other 34 bits of a hash.
POSITION = 30
#: Rows of a bucket in which successors are found, and the most buckets: their starts are a constant of 16 MB then.
ROWS, BUCKETS = 500, 1 << 20
#: Bytes of text that one task takes, about.
TASK_BYTES = 32 << 20


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once however often f names it."""
    return F.transform(F.array(value), f)[0]


def _joined(a: Column, b: Column, offset: int, f: Callable[[Column, Column], Column]) -> Column:
    """f(a[i], b[i + offset]) for every i that b reaches; `a` is at least that long."""
    m = F.size(b) - offset
    return F.zip_with(F.slice(a, F.lit(1), m), F.slice(b, F.lit(1 + offset), m), f)


def _turned(x: Column, n: int) -> Column:
    """The 64 bits of x, n places to the left and round."""
    return F.shiftleft(x, n % 64).bitwiseOR(F.shiftrightunsigned(x, 64 - n % 64)) if n % 64 else x


def rolling(h: Column, k: int) -> Column:
    """For each k successive hashes their cyclic polynomial: turned by k - 1, k - 2, ... 0 places, and added without carry."""

    def both(n: int) -> Callable[[Column, Column], Column]:
        return lambda a, b: _turned(a, n).bitwiseXOR(b)

    def grown(runs: list[tuple[int, Column]]) -> Column:  # lengths 1, 2, 4, ... and the hashes of all runs that long
        n, last = runs[-1]
        if 2 * n <= k:
            return let(_joined(last, last, n, both(n)), lambda twice: grown([*runs, (2 * n, twice)]))
        return added(last, n, runs)

    def added(done: Column, n: int, runs: list[tuple[int, Column]]) -> Column:
        if n == k:
            return done
        m, other = max((x for x in runs if x[0] <= k - n), key=lambda x: x[0])
        return let(_joined(done, other, n, both(m)), lambda longer: added(longer, n + m, runs))

    return grown([(1, h)])


def sliding_least(p: Column, window: int) -> Column:
    """The least of each `window` successive values; of all of them if there are fewer."""

    def grown(of: Column, n: int) -> Column:
        if n == window:
            return of
        step = min(n, window - n)
        return let(_joined(of, of, step, lambda a, b: F.least(a, b)), lambda longer: grown(longer, n + step))

    return F.when(F.size(p) <= window, F.array(F.array_min(p))).otherwise(grown(p, 1))


def fingerprint(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """array<struct<hash bigint, position int>> of a text, in the order of position.

    Words are separated by ASCII white space and compared in lower case. A text of fewer
    than k words has one fingerprint, of all its words; one without words, null included,
    has that of its characters. With fewer hashes than a window takes, there is one window.
    Equal texts have equal fingerprints.
    """
    low = (1 << POSITION) - 1

    def of_words(words: Column) -> Column:
        return let(
            F.when(F.size(words) >= k, let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: rolling(h, k))).otherwise(
                F.array(F.when(F.size(words) > 0, F.xxhash64(words)).otherwise(F.xxhash64(F.coalesce(text, F.lit("")))))
            ),
            of_grams,
        )

    def of_grams(g: Column) -> Column:
        keyed = F.transform(g, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(F.lit(low) - i))
        return let(keyed, lambda p: F.transform(F.array_distinct(sliding_least(p, window)), lambda x: found(g, (F.lit(low) - x.bitwiseAND(F.lit(low))).cast("int"))))

    def found(g: Column, at: Column) -> Column:
        return F.struct(F.get(g, at).alias("hash"), at.alias("position"))

    return let(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)), of_words)


def written(prints: Column) -> Column:
    """The fingerprints as text: hash:position, separated by spaces."""
    return F.array_join(F.transform(prints, lambda x: F.concat(F.lower(F.hex(x["hash"])), F.lit(":"), x["position"].cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the hashes of two fingerprint arrays, which are never empty."""
    p, q = F.transform(a, lambda x: x["hash"]), F.transform(b, lambda x: x["hash"])
    return let(F.struct(p.alias("p"), q.alias("q")), lambda x: F.size(F.array_intersect(x["p"], x["q"])) / F.size(F.array_union(x["p"], x["q"])))


def _bucket(place: Column, starts: list[tuple[int, int]]) -> Column:
    """The last bucket that starts at or before a place, by a search among 16 starts at a time."""

    def among(finer: Column) -> Callable[[Column], Column]:
        return lambda c: c * 16 + F.size(F.filter(F.slice(finer, c * 16 + 1, F.lit(16)), lambda b: b <= place)) - 1

    stride = 1
    while 16 * stride < len(starts):
        stride *= 16
    at = F.size(F.filter(_places(starts[::stride]), lambda b: b <= place)) - 1
    while stride > 1:
        stride //= 16
        at = let(at, among(_places(starts[::stride])))
    return at


def _places(starts: list[tuple[int, int]]) -> Column:
    """A constant array, of two strings' parts rather than an expression each."""
    key, tie = (F.split(F.lit(" ".join(str(x[i]) for x in starts)), " ").cast("array<bigint>") for i in range(2))
    return F.zip_with(key, tie, lambda a, b: F.struct(a.alias("key"), b.alias("tie")))


def with_next(df: DataFrame, key: str, carried: Callable[[DataFrame], DataFrame], names: list[str]) -> DataFrame:
    """Every row with `names` of the next row in the order of (key, hash of the text) as next_<name>; after the last comes the first.

    Buckets of some ROWS rows, as many as the table asks for, start at places drawn from
    the rows by a hash. A row that a bucket starts with also goes to the bucket before, so
    that every row finds its successor in its own bucket: texts are shuffled once. `carried`
    adds columns after that shuffle, before the rows are ordered. Null keys come first;
    rows that repeat key and text follow one another; one row is its own successor, and
    no rows give none.
    """
    place = F.struct(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("tie"))
    keys = df.select(place.alias("p"))
    n, n_bytes, first = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.min(place)).first()
    parts = min(BUCKETS, -(-n // ROWS))
    drawn = keys.where(F.pmod(F.xxhash64("p.key", "p.tie", F.lit(3)), F.lit(max(1, n // max(1, parts)))) == 0) if parts > 1 else keys.limit(0)
    starts = sorted({(r["key"], r["tie"]) for r in drawn.select("p.*").distinct().collect()} | ({tuple(first)} if first else set()))
    df = df.withColumn("__place", place)
    rows = df.withColumn("__bucket", _bucket(F.col("__place"), starts) if len(starts) > 1 else F.lit(0))
    starts_here = F.col("__place") == F.get(_places(starts), F.col("__bucket")) if starts else F.lit(True)
    before = F.pmod(F.col("__bucket") + (len(starts) - 1), F.lit(max(1, len(starts))))
    own, guest = F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("guest")), F.struct(before.alias("b"), F.lit(True).alias("guest"))
    rows = rows.withColumn("__in", F.explode(F.when(starts_here, F.array(own, guest)).otherwise(F.array(own))))
    rows = rows.withColumn("__bucket", F.col("__in.b")).withColumn("__guest", F.col("__in.guest")).drop("__in")
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_bytes // TASK_BYTES)
    rows = carried(rows.repartition(tasks, "__bucket"))
    order = W.partitionBy("__bucket").orderBy("__guest", "__place")
    for name in names:
        rows = rows.withColumn(f"next_{name}", F.lead(name).over(order))
    return rows.where("not __guest").drop("__bucket", "__guest", "__place")


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness.

    Null texts count as empty; an empty text is like another one, and unlike all others.
    """
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, "doc_id", lambda d: d.withColumn("prints", fingerprint(F.col("text"))), ["text", "prints"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        "prints",
        likeness(F.col("prints"), F.col("next_prints")).alias("near_next"),
        let(edited, lambda t: F.struct(F.sha2(t, 256).alias("sha"), fingerprint(t).alias("prints"))).alias("edited"),
    )
    return rows.select(
        "doc_id",
        "n_chars",
        F.col("edited.sha").alias("edited_sha256"),
        written(F.col("prints")).alias("fingerprint"),
        written(F.col("edited.prints")).alias("edited_fingerprint"),
        likeness(F.col("prints"), F.col("edited.prints")).alias("near_edited"),
        "near_next",
    )
