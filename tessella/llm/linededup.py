"""Line deduplication that can be undone: sharded cuckoo filters over exact reference counts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import documents, ship, stash
from tessella.llm.words import slices

#: The six ASCII white-space characters, which are stripped from both ends of a line.
SPACE = " \t\n\x0b\x0c\r"
SLOTS = 4
KICKS = 500
#: Filters up to this size are sent to the tasks that read documents; beyond it every line meets the exact table.
FILTER_BYTES = 32 << 20
#: As many exact counts (16 bytes and an id each) are sent along with them; beyond it lines and counts meet by join.
EXACT_KEYS = 1 << 20

_KEYS = "k1 long, k2 long"


# Cuckoo filters: 16-bit fingerprints in buckets of four, each in one of two buckets, of
# which either is found from the other and the fingerprint. Unlike bits that several keys
# share, a fingerprint can be taken out again.


def n_buckets(keys: int) -> int:
    """A power of two that `keys` fingerprints fill to at most 80 %."""
    return 1 << max(4, int(np.ceil(np.log2(max(1, keys) / (0.8 * SLOTS)))))


def _places(k2: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = k2.astype(np.uint64)
    print_ = (h >> np.uint64(48)).astype(np.uint16)
    print_[print_ == 0] = 1  # 0 is an empty slot
    first = (h & np.uint64(buckets - 1)).astype(np.int64)
    return print_, first, first ^ _turn(print_, buckets)


def _turn(print_: np.ndarray, buckets: int) -> np.ndarray:
    return ((print_.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(buckets - 1)).astype(np.int64)


def cuckoo_contains(table: np.ndarray, k2: np.ndarray) -> np.ndarray:
    print_, a, b = _places(k2, len(table))
    return ((table[a] == print_[:, None]) | (table[b] == print_[:, None])).any(axis=1)


def cuckoo_insert(table: np.ndarray, k2: np.ndarray) -> bool:
    """Puts in all keys; False where one finds no place, with the table as it was."""
    before = table.copy()
    prints, firsts, seconds = _places(k2, len(table))
    for p, a, b in zip(prints.tolist(), firsts.tolist(), seconds.tolist(), strict=True):
        for at in (a, b):
            if (free := np.flatnonzero(table[at] == 0)).size:
                table[at, free[0]] = p
                break
        else:
            at = a
            for kick in range(KICKS):  # the slot that goes is chosen in turn, so that a rerun gives the same table
                slot = (kick + p) % SLOTS
                p, table[at, slot] = int(table[at, slot]), p
                at ^= int(_turn(np.array([p], np.uint16), len(table))[0])
                if (free := np.flatnonzero(table[at] == 0)).size:
                    table[at, free[0]] = p
                    break
            else:
                table[:] = before
                return False
    return True


def cuckoo_delete(table: np.ndarray, k2: np.ndarray) -> None:
    """Takes out one fingerprint of each key; the keys have to be in."""
    prints, firsts, seconds = _places(k2, len(table))
    for p, a, b in zip(prints.tolist(), firsts.tolist(), seconds.tolist(), strict=True):
        for at in (a, b):
            if (own := np.flatnonzero(table[at] == p)).size:
                table[at, own[0]] = 0
                break


def _built(k2: np.ndarray, room: int) -> np.ndarray:
    table = np.zeros((n_buckets(max(room, len(k2))), SLOTS), np.uint16)
    while not cuckoo_insert(table, k2):
        table = np.zeros((2 * len(table), SLOTS), np.uint16)
    return table


# Keys of lines.


def line_keys(texts: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, k1, k2, long) of each line in order: its text's number, the 128-bit hash of its key, whether the key counts."""
    lowered = pc.ascii_lower(pc.fill_null(texts, ""))
    lines = pc.split_pattern(lowered, "\n")
    flat = pc.ascii_trim(lines.flatten(), characters=SPACE)
    rows = np.repeat(np.arange(len(lines)), np.diff(lines.offsets.to_numpy()))
    long = pc.greater_equal(pc.utf8_length(flat), least).to_numpy(zero_copy_only=False)
    halves = np.zeros((len(flat), 2), np.int64)
    for i, line in zip(np.flatnonzero(long).tolist(), flat.filter(pa.array(long)).to_pylist(), strict=True):
        halves[i] = np.frombuffer(xxhash.xxh3_128_digest(line), np.int64)
    return rows, halves[:, 0], halves[:, 1], long


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few MB of text at a time, which stands in the second column."""
    for batch in batches:
        yield from slices(batch, 1)


def references(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(k1, k2, doc_id): every document with each key of its lines once."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _some(batches):
            rows, k1, k2, long = line_keys(batch.column(1), least)
            once = np.unique(np.stack([rows, k1, k2], axis=1)[long], axis=0)
            ids = batch.column(0).take(pa.array(once[:, 0]))
            yield pa.RecordBatch.from_arrays([pa.array(once[:, 1]), pa.array(once[:, 2]), ids], ["k1", "k2", "doc_id"])

    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(of, f"{_KEYS}, doc_id {kind}")


# The store.


@dataclass(frozen=True)
class LineStore:
    """What is known of the lines of all documents put in and not taken out since.

    references: (k1, k2, doc_id), a row for each document and key. counts: (k1, k2, docs,
    last), exact, a row a key; `last` is the largest id. filters: (shard, table), a cuckoo
    filter each of the keys of at least `copies` documents whose k1 falls to the shard.
    Every table is a written one; an update makes new tables and leaves the old as they
    are. Only the keys that pass `copies` upwards or downwards change a filter.
    """

    references: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    copies: int = 3
    least: int = 20

    @staticmethod
    def of(docs: DataFrame, key: str = "doc_id", text: str = "text", copies: int = 3, least: int = 20, keys_per_shard: int = 1 << 18, keep_references: bool = True) -> LineStore:
        """A store of all documents. Without `keep_references` documents can't be taken out later, but far less is written."""
        refs = references(docs, key, text, least)
        refs = stash(refs, "line-references") if keep_references else refs
        counts = stash(_counted(refs), "line-counts")
        hot = counts.where(F.col("docs") >= copies)
        shards = max(1, -(-hot.count() // keys_per_shard))
        none = docs.sparkSession.createDataFrame([], "shard int, table binary")
        return LineStore(refs, counts, stash(_filters(hot, none, shards, keys_per_shard), "line-filters"), shards, copies, least)

    def insert(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> LineStore:
        """With more documents; ids that the store has already get a further row each, like repeated rows."""
        new = stash(references(docs, key, text, self.least), "line-references")
        refs = stash(self.references.unionByName(new), "line-references")
        both = self.counts.unionByName(_counted(new))
        counts = both.groupBy("k1", "k2").agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))
        return self._changed(refs, stash(counts, "line-counts"))

    def delete(self, ids: DataFrame) -> LineStore:
        """Without the documents of these ids (one column); unknown and null ids take nothing out.

        Counts of keys that lose a document are made anew from the references that stay.
        """
        gone = ids.toDF("doc_id").distinct()
        refs = stash(self.references.join(gone, "doc_id", "left_anti").select("k1", "k2", "doc_id"), "line-references")
        lost = stash(self.references.join(gone, "doc_id", "left_semi").select("k1", "k2").distinct(), "lost-keys")
        again = _counted(refs.join(lost, ["k1", "k2"], "left_semi"))
        counts = self.counts.join(lost, ["k1", "k2"], "left_anti").select("k1", "k2", "docs", "last").unionByName(again)
        return self._changed(refs, stash(counts, "line-counts"))

    def _changed(self, refs: DataFrame, counts: DataFrame) -> LineStore:
        """With keys moved in and out of the filters; where one is full, all are built anew from the exact counts."""
        hot = lambda df: df.where(F.col("docs") >= self.copies)
        old, new = hot(self.counts).select("k1", "k2"), hot(counts).select("k1", "k2")
        moves = new.join(old, ["k1", "k2"], "left_anti").withColumn("in", F.lit(True)).unionByName(old.join(new, ["k1", "k2"], "left_anti").withColumn("in", F.lit(False)))
        filters, shards = stash(_filters(moves, self.filters, self.shards, 0), "line-filters"), self.shards
        if not filters.where("table is null").isEmpty():
            shards, none = 2 * self.shards, self.filters.limit(0)
            filters = stash(_filters(hot(counts), none, shards, 1 << 30), "line-filters")
        return replace(self, references=refs, counts=counts, filters=filters, shards=shards)


def _counted(refs: DataFrame) -> DataFrame:
    """Counts combine in each task before the shuffle, so a line of every document is a row a task."""
    return refs.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last"))


def _shard(shards: int) -> Column:
    return F.pmod(F.col("k1"), F.lit(shards)).cast("int")


def _filters(moves: DataFrame, filters: DataFrame, shards: int, room: int) -> DataFrame:
    """The filters after keys have gone in and (where `in` is false) out, null where one has become full.

    A shard's keys and its filter meet in one task, bounded by the number of shards. A new
    filter has room for twice its keys, `room` at most.
    """

    def update(key: tuple, moved: pa.Table, kept: pa.Table) -> pa.Table:
        k2 = moved.column("k2").to_numpy()
        enters = moved.column("in").to_numpy() if "in" in moved.column_names else np.ones(len(k2), bool)
        held = kept.column("table").to_pylist()
        if held:
            table = np.frombuffer(held[0], np.uint16).reshape(-1, SLOTS).copy()
            cuckoo_delete(table, k2[~enters])
            table = table if cuckoo_insert(table, k2[enters]) else None
        else:
            table = _built(np.sort(k2[enters]), min(room, 2 * len(k2)))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "table": pa.array([None if table is None else table.tobytes()], pa.binary())})

    ship(moves.sparkSession)
    keyed = moves.select(*[c for c in ("k2", "in") if c in moves.columns], _shard(shards).alias("shard"))
    return keyed.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(update, "shard int, table binary")


# Documents without their repeated lines.


class _Filters:
    """All filters, in a task."""

    def __init__(self, tables: dict[int, np.ndarray], shards: int) -> None:
        self.tables, self.shards = tables, shards

    def hold(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        out, own = np.zeros(len(k1), bool), np.mod(k1, self.shards)
        for shard in np.unique(own):
            if (table := self.tables.get(int(shard))) is not None:
                mine = own == shard
                out[mine] = cuckoo_contains(table, k2[mine])
        return out


class _Exact:
    """The exact counts of the keys that lose lines, in a task: sorted by k1, the ids as they are."""

    def __init__(self, rows: pa.Table) -> None:
        rows = rows.sort_by("k1").combine_chunks()
        self.k1, self.k2 = (rows.column(i).to_numpy() for i in (0, 1))
        self.last = rows.column(2).combine_chunks()
        runs = np.unique(self.k1, return_counts=True)[1]
        self.longest = int(runs.max()) if len(runs) else 0  # keys that share the half that is sorted by

    def place(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """The key's row, or -1."""
        out, first = np.full(len(k1), -1), np.searchsorted(self.k1, k1)
        for step in range(self.longest):
            at = np.minimum(first + step, len(self.k1) - 1)
            out = np.where((self.k1[at] == k1) & (self.k2[at] == k2), at, out)
        return out


def _sent(store: LineStore) -> _Filters | None:
    """The filters, where they are small enough to be sent to the tasks."""
    if (store.filters.agg(F.sum(F.octet_length("table"))).first()[0] or 0) > FILTER_BYTES:
        return None
    return _Filters({r.shard: np.frombuffer(r.table, np.uint16).reshape(-1, SLOTS) for r in store.filters.collect()}, store.shards)


def _cut(batch: pa.RecordBatch, rows: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
    """(doc_id, text, n_lines, n_dropped) without the lines that are gone."""
    n_lines, n_dropped = (np.bincount(rows[x], minlength=len(batch)) for x in (slice(None), gone))
    texts, starts = pc.fill_null(batch.column(1), ""), np.concatenate([[0], np.cumsum(n_lines)])
    if touched := np.flatnonzero(n_dropped).tolist():
        texts = texts.to_pylist()
        for i in touched:
            lost = gone[starts[i] : starts[i + 1]].tolist()
            texts[i] = "\n".join(line for line, x in zip(texts[i].split("\n"), lost, strict=True) if not x)
    columns = [batch.column(0), pa.array(texts, pa.string()), pa.array(n_lines), pa.array(n_dropped)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "n_lines", "n_dropped"])


def _cut_schema(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, n_lines long, n_dropped long"


def _decided_in_tasks(docs: DataFrame, filters: _Filters, hot: DataFrame, least: int) -> DataFrame:
    """Filters and exact counts are both sent: every text is read once and moved nowhere."""
    sent = docs.sparkSession.sparkContext.broadcast((filters, _Exact(hot.toArrow())))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, exact = sent.value
        for batch in _some(batches):
            rows, k1, k2, long = line_keys(batch.column(1), least)
            gone, at = np.zeros(len(rows), bool), np.flatnonzero(long)
            at = at[filters.hold(k1[at], k2[at])]
            place = exact.place(k1[at], k2[at])
            at, place = at[place >= 0], pa.array(place[place >= 0])
            own, last = batch.column(0).take(pa.array(rows[at])), exact.last.take(place)
            same = pc.or_(pc.fill_null(pc.equal(own, last), False), pc.and_(pc.is_null(own), pc.is_null(last)))
            gone[at] = ~same.to_numpy(zero_copy_only=False)
            yield _cut(batch, rows, gone)

    return docs.mapInArrow(of, _cut_schema(docs))


def _hits(docs: DataFrame, filters: _Filters | None, least: int) -> DataFrame:
    """(doc_id, text, h1, h2): the keys of a document's lines that the filters hold, all of them where the filters are too large to be sent."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _some(batches):
            rows, k1, k2, long = line_keys(batch.column(1), least)
            hit, at = long.copy(), np.flatnonzero(long)
            if sent.value is not None:
                hit[at] = sent.value.hold(k1[at], k2[at])
            once = np.unique(np.stack([rows, k1, k2], axis=1)[hit], axis=0)
            offsets = pa.array(np.searchsorted(once[:, 0], np.arange(len(batch) + 1)), pa.int32())
            keys = [pa.ListArray.from_arrays(offsets, pa.array(once[:, i])) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *keys], ["doc_id", "text", "h1", "h2"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(of, f"doc_id {kind}, text string, h1 array<long>, h2 array<long>")


def _without(docs: DataFrame, least: int) -> DataFrame:
    """Texts without the lines whose keys stand in `drops`."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _some(batches):
            rows, k1, k2, _ = line_keys(batch.column(1), least)
            drops = [{(d["k1"], d["k2"]) for d in x or ()} for x in batch.column("drops").to_pylist()]
            gone = np.fromiter(((a, b) in drops[i] for i, a, b in zip(rows.tolist(), k1.tolist(), k2.tolist(), strict=True)), bool, len(rows))
            yield _cut(batch, rows, gone)

    return docs.select("doc_id", "text", "drops").mapInArrow(of, _cut_schema(docs))


def _decided_by_joins(docs: DataFrame, filters: _Filters | None, hot: DataFrame, least: int) -> DataFrame:
    """Lines that the filters hold meet the exact counts by join; documents that lose one are shuffled with their texts."""
    hits = stash(_hits(docs, filters, least), "line-hits").withColumn("__row", F.monotonically_increasing_id())
    lines = hits.select("__row", "doc_id", F.explode(F.arrays_zip("h1", "h2")).alias("h")).select("__row", "doc_id", F.col("h.h1").alias("k1"), F.col("h.h2").alias("k2"))
    dropped = lines.join(hot, ["k1", "k2"]).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    drops = stash(dropped.groupBy("__row").agg(F.collect_list(F.struct("k1", "k2")).alias("drops")), "line-drops")
    whole = hits.join(drops.select("__row"), "__row", "left_anti").withColumn("drops", F.lit(None).cast(drops.schema["drops"].dataType))
    return _without(whole.select("doc_id", "text", "drops").unionByName(hits.join(drops, "__row").select("doc_id", "text", "drops")), least)


def kept_lines(docs: DataFrame, store: LineStore, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): documents without the lines that the store knows from enough documents, except in the last of these.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased; keys
    of under `least` code points are never dropped. A key that the store holds from
    `copies` documents or more loses its lines in all documents but the one of the
    largest id; null ids come before all others, and if all ids of a key are null, its
    lines stay. Lines are split at "\\n" and joined by it; null and empty texts are one
    empty line. Rows that repeat an id each count as a document; of the largest id all
    rows keep their lines. Other columns are left out. An empty table gives none.

    Every line asks the filters; only those that they hold meet the exact counts, which
    decide. Where the filters and the exact counts of their keys are small (FILTER_BYTES
    and EXACT_KEYS, both checked), tasks get both and texts stay where they are; else the
    lines that filters hold meet the counts by join.
    """
    ship(docs.sparkSession)
    named = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    hot = store.counts.where(F.col("docs") >= store.copies).select("k1", "k2", "last")
    filters = _sent(store)
    few = filters is not None and hot.count() <= EXACT_KEYS
    return (_decided_in_tasks if few else _decided_by_joins)(named, filters, hot, store.least)


def op13_cuckoo_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that stand in three of them or more, kept in the last one only."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    kept = kept_lines(docs, LineStore.of(docs, keep_references=False))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
c AS (SELECT k, max(doc_id) AS last FROM k WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.i, k.line, c.k IS NOT NULL AND k.doc_id <> c.last AS gone FROM k LEFT JOIN c ON k.k = c.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
