"""How the sources of a language differ in their terms: exact sums over all pairs, dense for terms in many sources and sparse for the rest."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.llm.common import documents, ship, stash
from tessella.llm.words import Numbers, parts

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: A term is heavy where over one in so many sources of its language has it.
LIGHT_PART = 3
#: Cells (terms times sources) of a dense block, and the least number of blocks of a language.
CELLS, LEAST_BLOCKS = 1 << 18, 16
#: Sources of a tile of pairs.
TILE = 64
#: Entries that a task holds before it passes them on.
HELD = 1 << 20


# Counting.


class _Tally:
    """Counts and documents of (group, term), held as sorted numbers; passed on when they become too many."""

    def __init__(self) -> None:
        self.groups, self.terms = Numbers(), Numbers()
        self.keys, self.counts, self.docs = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, groups: list[tuple[str, str]], texts: list[str]) -> None:
        ids, words = self.terms.of(texts, TERM)
        doc = np.repeat(np.arange(len(texts)), words)
        pairs, counts = np.unique(doc << 32 | ids, return_counts=True)
        group = np.fromiter(map(self.groups.__getitem__, groups), np.int64, len(groups))
        keys = group[pairs >> 32] << 32 | pairs & 0xFFFFFFFF
        keys, at = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        self.counts, self.docs = _added(at, len(keys), self.counts, counts), _added(at, len(keys), self.docs, np.ones(len(counts), np.int64))
        self.keys = keys

    def full(self) -> bool:
        return len(self.keys) > HELD or len(self.terms) > HELD

    def rows(self) -> pa.RecordBatch:
        groups, terms = list(self.groups), pa.array(list(self.terms), pa.string())
        at = self.keys >> 32
        sides = [pa.array([g[i] for g in groups], pa.string()).take(pa.array(at)) for i in (0, 1)]
        out = pa.RecordBatch.from_arrays([*sides, terms.take(pa.array(self.keys & 0xFFFFFFFF)), pa.array(self.counts), pa.array(self.docs)], ["lang", "source", "term", "n", "docs"])
        self.__init__()
        return out


def _added(at: np.ndarray, size: int, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, at, np.concatenate([old, new]))
    return out


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and documents of the group that have it."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for batch in batches:
            for part, texts in parts(batch, 2):
                tally.add(list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)), texts)
                if tally.full():
                    yield tally.rows()
        yield tally.rows()

    ship(docs.sparkSession)
    named = docs.select(_given(lang).alias("lang"), _given(source).alias("source"), text)
    found = named.mapInArrow(of, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _given(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


# Divergences.


def share(n: str, all_n: str, kept: str) -> Column:
    """1 + floor(10^9 (n + 2) / (all_n + 2 kept)) in whole numbers; null where nothing is kept."""
    return F.expr(f"if({kept} > 0, 1 + (cast(1000000000 as decimal(10, 0)) * cast({n} + 2 as decimal(19, 0))) div cast({all_n} + 2 * {kept} as decimal(19, 0)), null)").cast("long")


def apart(p: str, q: str) -> str:
    """floor((p - q)^2 / (p + q)) in SQL; shares are at most 10^9 + 1, so the square fits a long."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q})))"


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


class _Pairs:
    """Sums by (language, source, source), compacted as they grow."""

    def __init__(self) -> None:
        self.langs, self.held, self.size = Numbers(), [], 0

    def add(self, lang: np.ndarray, u: np.ndarray, v: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((lang, u, v, value))
        self.size += len(u)
        if self.size > HELD:
            self.compact()
            if self.size > HELD // 2:
                yield self.rows()

    def compact(self) -> None:
        lang, u, v, value = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((v, u, lang))
        lang, u, v, value = lang[order], u[order], v[order], value[order]
        new = np.concatenate([[True], (lang[1:] != lang[:-1]) | (u[1:] != u[:-1]) | (v[1:] != v[:-1])])[: len(u)]
        sums = np.add.reduceat(value, np.flatnonzero(new)) if len(u) else value
        self.held, self.size = [(lang[new], u[new], v[new], sums)], int(new.sum())

    def rows(self) -> pa.RecordBatch:
        if self.held:
            self.compact()
        lang, u, v, value = self.held[0] if self.held else [np.zeros(0, np.int64)] * 4
        names = pa.array(list(self.langs), pa.string()).take(pa.array(lang))
        self.__init__()
        return pa.RecordBatch.from_arrays([names, *map(pa.array, (u, v, value))], ["lang", "u", "v", "value"])


_SUMS = "lang string, u long, v long, value long"


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of posting lists (lang, entries of (idx, p, p0)): what each pair of sources that share the term has beyond both one-sided parts."""
    pairs = _Pairs()
    for batch in batches:
        lists, langs = batch.column("entries"), batch.column("lang").to_pylist()
        code = np.fromiter(map(pairs.langs.__getitem__, langs), np.int64, len(langs))
        starts, sizes = lists.offsets.to_numpy()[:-1], np.diff(lists.offsets.to_numpy())
        idx, p, p0 = (lists.values.field(i).to_numpy() for i in range(3))
        for size in np.unique(sizes[sizes > 1]):
            lists_of = np.flatnonzero(sizes == size)
            a, b = np.triu_indices(size, 1)
            for some in np.array_split(lists_of, -(-len(lists_of) * len(a) // HELD)):
                i, j = (starts[some][:, None] + a).ravel(), (starts[some][:, None] + b).ravel()
                value = _apart(p[i], p[j]) - _apart(p[i], p0[j]) - _apart(p0[i], p[j]) + _apart(p0[i], p0[j])
                yield from pairs.add(np.repeat(code[some], len(a)), np.minimum(idx[i], idx[j]), np.maximum(idx[i], idx[j]), value)
        if len(pairs.langs) > HELD:
            yield pairs.rows()
    yield pairs.rows()


def _dense(key: tuple, postings: pa.Table, groups: pa.Table) -> pa.Table:
    """Of one block of heavy terms of a language: the sums of all pairs of its sources over these terms."""
    idx, p0 = groups.column("idx").to_numpy(), groups.column("p0").to_numpy()
    if not len(postings) or len(idx) < 2:
        return pa.table([pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.int64())], ["lang", "u", "v", "value"])
    order = np.argsort(idx)
    idx, p0 = idx[order], p0[order]
    term = pc.dictionary_encode(postings.column("term").combine_chunks())
    tile = np.repeat(p0[:, None], len(term.dictionary), axis=1)
    tile[np.searchsorted(idx, postings.column("idx").to_numpy()), term.indices.to_numpy()] = postings.column("p").to_numpy()
    sums = [_apart(tile[i], tile[i + 1 :]).sum(axis=1) for i in range(len(idx) - 1)]
    u, v = np.triu_indices(len(idx), 1)
    return pa.table([pa.repeat(key[0], len(u)).cast(pa.string()), pa.array(idx[u]), pa.array(idx[v]), pa.array(np.concatenate(sums))], ["lang", "u", "v", "value"])


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of each language are apart, and the terms that set a source off.

    Terms are runs of letters, A-Z lower-cased; a language keeps those of at least
    `least_docs` of its documents. Every source and every language gives each kept term a
    share of 10^9, smoothed by 2; shares p and q are floor((p - q)^2 / (p + q)) apart.
    Part `pair` has each other source of the language, with the sum over all kept terms;
    part `term` the `top` kept terms that a source has and gives a greater share than its
    language, with how far these shares are apart. Ranks fall by value, ties by item.

    A pair's sum is that of its heavy terms, from dense tiles of the shares of all
    sources, and of its light ones, which few sources have: as if no source had any,
    corrected for each source by its own terms (by how many of them have which share) and
    for each two by the posting lists that have both. All in whole numbers, so the parts
    add up exactly. Pairs are all asked for, so work grows with the square of a language's
    sources; it never grows with the square of documents.

    Null languages, sources and texts are empty ones; groups without terms take part; a
    language that keeps nothing has pairs of value 0. Rows that repeat are documents of
    their own; an empty table gives none. Other columns are left out.
    """
    counts = stash(term_counts(docs, lang, source, text), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.count(F.lit(1)).alias("sources"))
    kept = stash(kept.where(F.col("docs") >= least_docs).drop("docs"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_all"))
    groups = docs.select(_given(lang).alias("lang"), _given(source).alias("source")).distinct()
    own = counts.join(kept, ["lang", "term"]).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "kept", "lang_all"])
    of_lang = W.partitionBy("lang")
    groups = groups.withColumns({"idx": (F.row_number().over(of_lang.orderBy("source")) - 1).cast("long"), "peers": F.count(F.lit(1)).over(of_lang)})
    groups = stash(groups.withColumn("p0", share("0", "total", "kept")), "groups")
    postings = counts.join(kept, ["lang", "term"]).join(groups, ["lang", "source"])
    postings = postings.withColumns({"p": share("n", "total", "kept"), "q": share("lang_n", "lang_all", "kept"), "heavy": F.col("sources") * LIGHT_PART > F.col("peers")})
    postings = stash(postings.select("lang", "source", "term", "idx", "p", "p0", "q", "heavy", "peers", "kept"), "postings")

    ahead = postings.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(apart("p", "q")).alias("value"))
    by_value = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = ahead.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))

    pairs = _pairs(groups, postings).withColumn("rank", F.row_number().over(by_value)).withColumn("part", F.lit("pair"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def _pairs(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of a language's sources."""
    ship(groups.sparkSession)
    light, heavy = postings.where(~F.col("heavy")), postings.where("heavy")
    lists = light.groupBy("lang", "term").agg(F.collect_list(F.struct("idx", "p", "p0")).alias("entries")).where(F.size("entries") > 1)
    sums = lists.select("lang", "entries").mapInArrow(_sparse, _SUMS)

    n_heavy = heavy.groupBy("lang").agg(F.count_distinct("term").alias("n_heavy"))
    blocks = groups.join(n_heavy, "lang").withColumn("blocks", F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("n_heavy") * F.col("peers") / CELLS)).cast("long"))
    dealt = heavy.join(blocks.select("lang", "idx", "blocks"), ["lang", "idx"]).select("lang", "term", "idx", "p", F.pmod(F.xxhash64("term"), "blocks").alias("block"))
    rows = blocks.select("lang", "idx", "p0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    sums = sums.unionByName(dealt.groupBy("lang", "block").cogroup(rows.groupBy("lang", "block")).applyInArrow(_dense, _SUMS))
    sums = sums.groupBy("lang", "u", "v").agg(F.sum("value").alias("found"))

    shares = light.groupBy("lang", "idx", "p").agg(F.count(F.lit(1)).alias("n")).groupBy("lang", "idx").agg(F.collect_list(F.struct("p", "n")).alias("shares"))
    ends = groups.join(n_heavy, "lang", "left").withColumn("n_light", F.col("kept") - F.coalesce("n_heavy", F.lit(0)))
    ends = ends.join(shares, ["lang", "idx"], "left").withColumn("tile", F.floor(F.col("idx") / TILE))
    a = ends.select(
        "lang", F.col("idx").alias("u"), F.col("source").alias("a"), F.col("p0").alias("pa"), F.col("shares").alias("sa"), "n_light",
        F.explode(F.sequence("tile", F.floor((F.col("peers") - 1) / TILE))).alias("tile"),
    )
    b = ends.select("lang", "tile", F.col("idx").alias("v"), F.col("source").alias("b"), F.col("p0").alias("pb"), F.col("shares").alias("sb"))
    met = a.join(b, ["lang", "tile"]).where("u < v").withColumn("none", F.expr(f"if(n_light > 0, {apart('pa', 'pb')}, 0L)"))
    one_side = lambda s, q: f"coalesce(aggregate({s}, 0L, (t, x) -> t + x.n * ({apart('x.p', q)} - none)), 0L)"
    met = met.withColumn("base", F.expr(f"n_light * none + {one_side('sa', 'pb')} + {one_side('sb', 'pa')}"))
    met = met.join(sums, ["lang", "u", "v"], "left").withColumn("value", F.col("base") + F.coalesce("found", F.lit(0)))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return met.select("lang", "value", F.explode(ways).alias("way")).select("lang", "way.source", "way.item", "value")


def op11_heavy_light_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources of each language of `documents` against each other, and the ten terms that set each off most."""
    return audit(documents(spark, sf_dir).select("lang", "source", "text"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
c0 AS MATERIALIZED (SELECT lang, source, term, count(*)::HUGEINT AS c, count(DISTINCT r) AS docs FROM t GROUP BY lang, source, term),
k AS MATERIALIZED (SELECT lang, term, sum(c)::HUGEINT AS n FROM c0 GROUP BY lang, term HAVING sum(docs) >= 10),
c AS MATERIALIZED (SELECT c0.lang, source, c0.term, c FROM c0 JOIN k ON c0.lang = k.lang AND c0.term = k.term),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
s AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM c GROUP BY lang, source),
g AS MATERIALIZED (SELECT x.lang, x.source, coalesce(s.n, 0)::HUGEINT AS n, v.v AS v FROM (SELECT DISTINCT lang, source FROM d) x
  LEFT JOIN s ON x.lang = s.lang AND x.source = s.source LEFT JOIN v ON x.lang = v.lang),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (g.n + 2 * g.v) AS p
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (k.n + 2)) // (v.n + 2 * v.v) AS q FROM k JOIN v ON k.lang = v.lang),
w AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(w.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN w ON w.lang = a.lang AND w.source = a.source AND w.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p.p - q.q) * (p.p - q.q)) // (p.p + q.q) AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.c > 0 AND p.p > q.q),
a AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM a) WHERE part = 'pair' OR rank <= 10
"""
