"""Line deduplication against brute force, updates against stores made at once, filters by themselves."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm.linededup import SPACE, LineStore, cuckoo_contains, cuckoo_delete, cuckoo_insert, kept_lines, n_buckets, op13_cuckoo_line_dedup

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, copies=3, least=20):
    """Of (doc_id, text): doc_id, kept text, lines, dropped; each row is a document."""
    key = lambda line: line.strip(SPACE).translate(UPPER)
    docs = [(i, (t or "").split("\n")) for i, t in rows]
    held = {}
    for i, lines in docs:
        for k in {key(x) for x in lines}:
            held.setdefault(k, []).append(i)
    last = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= copies and len(k) >= least}
    out = []
    for i, lines in docs:
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=str)


def corpus(seed: int, n: int) -> list[tuple]:
    rnd = random.Random(seed)
    pool = [f"{'Common' if j % 2 else 'common'} line number {j} of the corpus" for j in range(30)] + ["short line", "", "é" * 19, "É" * 20, "ab" * 10_000]
    pad = lambda x: rnd.choice(["", " ", "\t", "\r", " "]) + (x.upper() if rnd.random() < 0.2 else x) + rnd.choice(["", "  ", "\x0b"])
    rows = [(i, "\n".join(pad(rnd.choice(pool)) if rnd.random() < 0.7 else f"own line {rnd.random()} of {i}" for _ in range(rnd.randrange(0, 12)))) for i in range(n)]
    rows += [(None, pool[0]), (None, "only without ids, but many"), (None, "only without ids, but many"), (None, "only without ids, but many"), (-3, None), (-4, ""), (5, pool[1]), (n + 5, pool[1] + "\n" + pool[1]), (n + 5, pool[1])]
    return rows


SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed, 60)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(kept_lines(docs, LineStore.of(docs))) == brute(rows)


def test_insertions_and_deletions_can_be_undone(spark):
    rows = corpus(3, 80)
    first = [r for r in rows if r[0] is None or r[0] % 3 != 1]
    more = [r for r in rows if not (r[0] is None or r[0] % 3 != 1)]
    df = lambda x: spark.createDataFrame(x, SCHEMA)
    before = LineStore.of(df(first), keys_per_shard=8)
    assert before.shards > 1
    both = before.insert(df(more))
    assert found(kept_lines(df(rows), both)) == brute(rows)
    assert sorted(both.counts.collect()) == sorted(LineStore.of(df(rows)).counts.collect())
    after = both.delete(df([(i, "") for i, _ in more]).select("doc_id").union(spark.createDataFrame([(None,), (10**9,)], "i long")))
    assert sorted(after.counts.collect()) == sorted(before.counts.collect())
    assert found(kept_lines(df(first), after)) == brute(first)
    none = after.delete(df(first).select("doc_id"))  # rows without id stay
    assert found(kept_lines(df(first), none))
    assert none.counts.where("last is not null").isEmpty()


def test_a_full_filter_is_built_anew(spark):
    line = lambda j: f"a line that many documents have {j:06d}"
    few = [(i, line(0)) for i in range(3)]
    many = [(i, "\n".join(map(line, range(1, 400)))) for i in range(10, 13)]
    df = lambda x: spark.createDataFrame(x, SCHEMA)
    store = LineStore.of(df(few)).insert(df(many))
    assert store.filters.where("table is null").isEmpty()
    assert found(kept_lines(df(few + many), store)) == brute(few + many)


@pytest.mark.parametrize("bound", ["FILTER_BYTES", "EXACT_KEYS"])
def test_by_joins(spark, monkeypatch, bound):
    """Without exact counts in the tasks, with and without filters there."""
    monkeypatch.setattr(f"tessella.llm.linededup.{bound}", -1)
    rows = corpus(4, 40)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert found(kept_lines(docs, LineStore.of(docs))) == brute(rows)


def test_thresholds(spark):
    rows = corpus(5, 40)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert found(kept_lines(docs, LineStore.of(docs, copies=2, least=1))) == brute(rows, 2, 1)


def test_query_on_edge_rows(spark, edge_dir, empty_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{edge_dir}/documents.parquet").collect()]
    want = sorted(((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in brute(rows)), key=str)
    assert sorted((tuple(r) for r in op13_cuckoo_line_dedup(spark, edge_dir).collect()), key=str) == want
    assert op13_cuckoo_line_dedup(spark, empty_dir).collect() == []


def test_other_columns_may_clash(spark, clashing):
    docs = clashing.withColumns({c: F.lit(1) for c in ("n_lines", "n_dropped", "drops", "h1", "h2", "k1", "last", "docs")})
    assert kept_lines(docs, LineStore.of(docs)).columns == ["doc_id", "text", "n_lines", "n_dropped"]


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-(2**63), 2**63 - 1, 6000))
    inside, outside = keys[:3000], keys[3000:]
    table = np.zeros((n_buckets(3000), 4), np.uint16)
    assert cuckoo_insert(table, inside)
    assert cuckoo_contains(table, inside).all()
    assert cuckoo_contains(table, outside).mean() < 0.01
    cuckoo_delete(table, inside[:1500])
    assert cuckoo_contains(table, inside[1500:]).all() and cuckoo_contains(table, inside[:1500]).mean() < 0.01
    small = np.zeros((16, 4), np.uint16)
    assert not cuckoo_insert(small, inside) and not small.any()  # as it was
