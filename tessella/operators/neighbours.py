"""Nearest neighbours by cosine: an inverted-file index as a table, probed by join, with exact similarities of what it finds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.shipping import ship
from tessella.sources.scratch import written

#: What the lists are fitted on, and their probes chosen by: so many vectors at most, and so many bytes.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_QUERIES = 20_000, 64 << 20, 400
#: Lists lie between these bounds; their centres are sent to every task.
LEAST_LISTS, MOST_LISTS = 16, 4096
#: Rows and queries of a cell, whose similarities are one product of matrices.
CELL_ROWS, CELL_QUERIES = 2048, 2048
#: Similarities are told apart to this many places.
PLACES = 6


@dataclass(frozen=True)
class VectorIndex:
    """rows: (id, vector of length 1, list, chunk), every vector once. lists: (list, chunks), a row a list that has vectors.

    `probes` is the number of lists, nearest first, that a search visits.
    """

    rows: DataFrame
    lists: DataFrame
    centres: np.ndarray
    probes: int


def _unit(id_: str, vector: str, df: DataFrame) -> DataFrame:
    """(id, vector of length 1); rows with a null id, a null or empty vector, a null in it or no length are left out."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    rows = df.select(F.col(id_).alias("id"), v.alias("v"), length.alias("length")).where("id is not null and length > 0 and not isnan(length) and length < double('infinity')")
    return rows.select("id", F.expr("transform(v, x -> x / length)").alias("vector"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _nearest_lists(rows: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """(id, vector, list): each vector with its `n` nearest lists, a row each."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), CELL_ROWS):
                batch = whole.slice(start, CELL_ROWS)
                near = _matrix(batch.column(1)) @ sent.value.T
                best = np.argsort(-near, axis=1, kind="stable")[:, :n]
                at = pa.array(np.repeat(np.arange(len(batch)), best.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(best.ravel())], ["id", "vector", "list"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(of, f"id {kind}, vector array<double>, list long")


def _parts(count: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(count / size)).cast("int")


def _probes(sample: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """Lists to visit so that `recall` of the k nearest others in the sample are found there.

    Neighbours within a sample lie farther apart than those among all rows, so this is on
    the safe side.
    """
    queries = sample[: min(SAMPLE_QUERIES, len(sample))]
    near = queries @ sample.T
    near[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    found = np.argsort(-near, axis=1)[:, : min(k, len(sample) - 1)]
    own = (sample @ centres.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(queries @ centres.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, own[found], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1 if len(needed) else 1


def build(df: DataFrame, id_: str, vector: str, k: int = 10, recall: float = 0.95, seed: int = 41) -> VectorIndex:
    """An index of all vectors of `df`, which searches for `k` neighbours with about this recall.

    Lists are k-means clusters, about as many as the root of the number of vectors, fitted
    on the SAMPLE_ROWS vectors (fewer where they are long) of least hash of the id; every
    vector is then put in the list of its nearest centre. How many lists a search visits is
    measured on that sample: few where vectors stand in clusters, most where they lie
    evenly in many dimensions. Large lists are split into chunks by hash of the id. Ids are
    unique. Rows without id or a vector of positive length are left out; vectors have one
    number of dimensions.
    """
    ship(df.sparkSession)
    rows = written(_unit(id_, vector, df), "vectors")
    n = rows.count()
    first = rows.first()
    dims = len(first.vector) if first else 1
    size = max(2, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dims)))
    sample = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(size)
    held = np.array([r.vector for r in sample.select("vector").collect()], np.float64).reshape(-1, dims)
    lists = max(1, min(len(held), MOST_LISTS, max(LEAST_LISTS, int(np.sqrt(n)))))
    if lists > 1:
        points = rows.sparkSession.createDataFrame([(x,) for x in held.tolist()], "vector array<double>").select(array_to_vector("vector").alias("features"))
        centres = np.array(KMeans(k=lists, seed=seed, maxIter=8, initMode="random").fit(points).clusterCenters())
        centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    else:
        centres = np.zeros((1, dims))
    placed = written(_nearest_lists(rows, centres, 1), "placed-vectors")
    counts = written(placed.groupBy("list").agg(_parts(F.count(F.lit(1)), CELL_ROWS).alias("chunks")), "lists")
    chunked = placed.join(F.broadcast(counts), "list")  # at most MOST_LISTS rows
    chunked = chunked.select("id", "vector", "list", F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("chunk"))
    return VectorIndex(chunked, counts, centres, _probes(held, centres, k, recall) if len(held) > 1 else 1)


def search(index: VectorIndex, queries: DataFrame, id_: str, vector: str, k: int = 10, probes: int | None = None) -> DataFrame:
    """(query_id, rank, id, similarity): the k nearest vectors to each query, itself left out, among the lists that it visits.

    Similarities are cosines to 6 places; ties go to the smaller id. With as many probes as
    there are lists the result is exact. A query meets each chunk of its lists in a cell of
    bounded size, one product of matrices; a list that very many queries visit is met in
    several blocks of them. Only k rows a cell and query go on. Queries without a vector
    of positive length find nothing.
    """
    ship(queries.sparkSession)
    visits = _nearest_lists(_unit(id_, vector, queries), index.centres, probes or index.probes)
    visits = written(visits.withColumnsRenamed({"id": "query_id", "vector": "query"}).join(F.broadcast(index.lists), "list"), "visits")
    blocks = written(visits.groupBy("list").agg(_parts(F.count(F.lit(1)), CELL_QUERIES).alias("blocks")), "visit-blocks")
    asked = visits.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int"))
    asked = asked.select("query_id", "query", "list", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    held = index.rows.join(F.broadcast(blocks), "list").select("id", "vector", "list", "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def meet(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(queries) or not len(rows):
            return pa.table({"query_id": queries.column("query_id").slice(0, 0), "id": rows.column("id").slice(0, 0), "similarity": pa.array([], pa.float64())})
        rows = rows.take(pc.sort_indices(rows.column("id")))
        near = np.rint(_matrix(queries.column("query")) @ _matrix(rows.column("vector")).T * 10**PLACES).astype(np.int64)
        place = near * len(rows) - np.arange(len(rows))  # falls with the id where similarities tie
        top = min(k + 1, len(rows))  # one more, as a query may find itself
        best = np.argpartition(-place, top - 1, axis=1)[:, :top]
        at = np.repeat(np.arange(len(queries)), top)
        found = np.take_along_axis(near, best, axis=1).ravel() / 10**PLACES
        return pa.table({"query_id": queries.column("query_id").take(pa.array(at)), "id": rows.column("id").take(pa.array(best.ravel())), "similarity": pa.array(found)})

    kinds = f"query_id {visits.schema['query_id'].dataType.simpleString()}, id {index.rows.schema['id'].dataType.simpleString()}, similarity double"
    cell = ["list", "chunk", "block"]
    pairs = asked.groupBy(*cell).cogroup(held.groupBy(*cell)).applyInArrow(meet, kinds).where("query_id <> id")
    best = W.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "id", "similarity")


def recall(index: VectorIndex, queries: DataFrame, id_: str, vector: str, k: int = 10) -> float:
    """The part of the k nearest vectors to the queries that a search finds, against one through all lists."""
    found = search(index, queries, id_, vector, k).select("query_id", "id")
    exact = written(search(index, queries, id_, vector, k, probes=len(index.centres)).select("query_id", "id"), "exact-neighbours")
    return exact.join(found, ["query_id", "id"], "left_semi").count() / max(1, exact.count())
