import hashlib

import pytest
from pyspark.sql import functions as F

from tessella.llm.winnowing import K, WINDOW, fingerprint, likeness, op3_winnowing, rolling, sliding_least, with_next
from tests.llm.conftest import edge_rows, prose


def _brute(grams: list[int]) -> list[int]:
    """Positions by the definition: the rightmost least of the upper 34 bits in every window."""
    upper = [g >> 30 for g in grams]
    out = []
    for i in range(max(1, len(grams) - WINDOW + 1)):
        own = upper[i : i + WINDOW]
        at = i + max(j for j, x in enumerate(own) if x == min(own))
        if at not in out:
            out.append(at)
    return out


def _rolled(h: list[int]) -> list[int]:
    """One hash after another: turn, take out the word that leaves, take in the next."""
    mask = 2**64 - 1
    turn = lambda x, n: ((x << n) | (x >> (64 - n))) & mask
    now, out = 0, []
    for i, x in enumerate(v & mask for v in h):
        now = turn(now, 1) ^ x
        if i >= K:
            now ^= turn(h[i - K] & mask, K)
        if i >= K - 1:
            out.append(now - 2**64 if now >> 63 else now)
    return out


def test_positions_are_those_of_the_definition(spark):
    texts = [prose(i, n) for i, n in enumerate((5, 6, 20, 21, 100, 700))] + [" ".join(["same"] * 60), "a b " * 40]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    h = F.transform(F.split(F.lower(F.trim("text")), " "), lambda w: F.xxhash64(w))
    for r in df.withColumn("h", h).select("text", "h", fingerprint(F.col("text")).alias("f")).collect():
        grams = _rolled(r.h)
        want = _brute(grams)
        assert [x.position for x in r.f] == want
        assert [x.hash for x in r.f] == [grams[i] for i in want]


@pytest.mark.parametrize(("k", "window"), [(1, 1), (2, 3), (3, 7), (7, 16), (13, 5)])
def test_any_lengths(spark, k, window):
    values = [(i * 2654435761) % 1000 - 500 for i in range(40)]
    df = spark.createDataFrame([(values,)], "v array<bigint>")
    least, rolled = df.select(sliding_least(F.col("v"), window), rolling(F.col("v"), k)).first()
    assert least == [min(values[i : i + window]) for i in range(len(values) - window + 1)]
    assert len(rolled) == len(values) - k + 1


def test_shared_runs_share_a_fingerprint(spark):
    run = prose(50, K + WINDOW - 1)
    df = spark.createDataFrame([(f"{prose(1, 37)} {run} {prose(2, 11)}", f"{prose(3, 90)} {run}")], "a string, b string")
    assert df.select(likeness(fingerprint(F.col("a")), fingerprint(F.col("b")))).first()[0] > 0


def test_edited_texts_and_successors(spark, edge_dir):
    rows = op3_winnowing(spark, edge_dir).collect()
    docs = sorted(((-(2**63) if i is None else i, t or "") for i, t, *_ in edge_rows()))
    assert len(rows) == len(docs)
    want = []
    for k, (i, text) in enumerate(docs):
        half = len(text) // 2
        edited = text[: len(text) - half] + docs[(k + 1) % len(docs)][1][:half]
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(want) == sorted((-(2**63) if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, r)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and r.fingerprint
    assert by[0].fingerprint == by[2].fingerprint and by[4].fingerprint == by[5].fingerprint
    assert by[22].near_next == 1.0  # equal texts
    assert by[3].near_edited > 0.2


def test_no_rows_and_one_row(spark, empty_dir, tmp_path):
    assert op3_winnowing(spark, empty_dir).collect() == []
    spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.doc_id, r.near_next) for r in op3_winnowing(spark, str(tmp_path)).collect()] == [(1, 1.0)]


def test_many_buckets(spark, tmp_path):
    docs = [(i * 3, prose(i, 8)) for i in range(1300)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.edited_sha256 for r in op3_winnowing(spark, str(tmp_path)).collect()}
    for k, (i, text) in enumerate(docs):
        half = len(text) // 2
        assert got[i] == hashlib.sha256((text[: len(text) - half] + docs[(k + 1) % len(docs)][1][:half]).encode()).hexdigest()


def test_other_columns_and_repeated_keys(spark, clashing):
    """Successors in the order of (key, hash), each row once, other columns as they were."""
    out = with_next(clashing.withColumn("text", F.coalesce("text", F.lit(""))), "doc_id", lambda d: d, ["text"])
    assert out.count() == clashing.count() and set(out.columns) == set(clashing.columns) | {"next_text"}
    assert out.first()["size"] == "own size"
    same = spark.createDataFrame([(7, f"text {i}") for i in range(1500)], "doc_id long, text string")
    rows = with_next(same, "doc_id", lambda d: d, ["text"]).collect()
    assert len(rows) == 1500 and len({r.next_text for r in rows}) == 1500
