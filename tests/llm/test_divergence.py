"""Sums over pairs of sources against brute force in Python's whole numbers."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.llm import divergence
from tessella.llm.divergence import audit, op11_heavy_light_divergence

UPPER = {c: c + 32 for c in range(65, 91)}
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=10, top=10):
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        g = (lang or "", source or "")
        words = TERM.findall((text or "").translate(UPPER))
        groups.add(g)
        counts[g].update(words)
        df[g[0]].update(set(words))
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in df[lang].items() if n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        p = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[u] for u in kept) + 2 * len(kept)) for t in kept}
        own = {s: p(counts[lang, s]) for s in sources}
        q = p(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(-sum(f(own[s][t], own[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            term = [(-f(own[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and own[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def corpus(seed: int, sources: int, n: int) -> list[tuple]:
    rnd = random.Random(seed)
    common = [f"w{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(60)] + ["Ünder", "日本", "It's"]
    rows = []
    for i in range(n):
        s = "hot" if i % 3 == 0 else f"s{int(sources * rnd.random() ** 2):03d}"
        rare = [f"rare{chr(97 + (int(s[1:] or 0) if s != 'hot' else 7) % 5)}{chr(97 + rnd.randrange(6))}"] * rnd.randrange(4)
        rows.append((rnd.choice(["en", "en", "de"]), s, " ".join(rnd.choices(common, k=rnd.randrange(30)) + rare)))
    return rows + [(None, None, None), ("", "x", "few words here"), ("de", None, "wAA 1 WAA."), ("fr", "alone", "nothing kept"), ("it", "a", None), ("it", "b", "x" * 50_000)]


SCHEMA = "lang string, source string, text string"


@pytest.mark.parametrize(("sources", "light_part"), [(25, 3), (25, 1), (25, 10**6), (150, 3)])
def test_equals_brute_force(spark, sources, light_part, monkeypatch):
    """With some terms heavy, with none (1) and with all, and over several tiles of sources."""
    monkeypatch.setattr(divergence, "LIGHT_PART", light_part)
    rows = corpus(sources, sources, 700)
    assert found(audit(spark.createDataFrame(rows, SCHEMA).repartition(4))) == brute(rows)


def test_little_memory(spark, monkeypatch):
    for name, value in (("HELD", 50), ("CELLS", 100)):
        monkeypatch.setattr(divergence, name, value)
    rows = corpus(7, 20, 400)
    assert found(audit(spark.createDataFrame(rows, SCHEMA), least_docs=3, top=4)) == brute(rows, 3, 4)


def test_both_parts_are_used(spark):
    rows = corpus(25, 25, 700)
    df = spark.createDataFrame(rows, SCHEMA)
    sources = df.where("lang = 'en'").select("source").distinct().count()
    per_term = df.where("lang = 'en'").withColumn("t", F.explode(F.array_distinct(F.split(F.lower("text"), " ")))).groupBy("t").agg(F.count_distinct("source").alias("n"), F.count(F.lit(1)).alias("docs")).where("docs >= 10")
    assert 0 < per_term.where(F.col("n") * divergence.LIGHT_PART > sources).count() < per_term.count()


def test_counts_beyond_what_a_product_with_a_billion_holds(spark):
    big = 10**13
    got = spark.range(1).select(divergence.share(str(big), str(3 * big), "5").alias("p")).first().p
    assert got == 1 + 10**9 * (big + 2) // (3 * big + 10)


def test_edge_rows_and_empty_tables(spark, edge_dir, empty_dir):
    rows = [(r.lang, r.source, r.text) for r in spark.read.parquet(f"{edge_dir}/documents.parquet").collect()]
    assert found(op11_heavy_light_divergence(spark, edge_dir)) == brute(rows)
    assert op11_heavy_light_divergence(spark, empty_dir).collect() == []


def test_repeated_rows_and_clashing_columns(spark, clashing):
    docs = clashing.withColumns({c: F.lit("own") for c in ("term", "rank", "idx", "total", "kept", "p", "q", "part", "docs")})
    thrice = docs.union(docs).union(docs)
    rows = [(r.lang, r.source, r.text) for r in docs.collect()] * 3
    assert found(audit(thrice, least_docs=4)) == brute(rows, 4)
