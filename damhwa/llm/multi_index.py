"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into halves, each half quantised by a codebook of its own; a cell is a pair of centroids. A query visits
cells in order of the summed squared distances of its halves, walking both sorted lists with a heap, until it has met a
set number of entries; those are reranked by their exact distance.

What is fitted comes from a bounded sample (`SAMPLE` rows of smallest hash): the codebooks, and how large a share of
the entries a query must meet for `TARGET` of the true neighbours to be among them, as measured on the sample. Every
row is indexed. Entries are stored by blocks of about `BLOCK` rows: small cells share one, a cell of any size is split
over several, so no cell makes a large task; a query goes once to each block that it visits, with its cells there.

Edge cases: vectors that are null, zero, hold a null or non-finite component, or differ in length from most, take no
part; a row never finds its own id; fewer candidates than asked for are all returned; repeated rows are candidates
each, but one query; ties go to the smaller id; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from damhwa.llm.common import arrow_schema, map_batches, materialize, to_batch

SAMPLE = 8192
TARGET = 0.985
TUNING_QUERIES = 256
BLOCK = 4096
MOST_CENTROIDS = 256


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec array<double>) of the vectors that take part, of the most frequent length."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull())
    rows = rows.where(F.forall("vec", fine) & F.exists("vec", lambda x: x != 0))
    length = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vec") == (length[0] if length else 0))


def kmeans(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's method from k points spread over the sample; empty centroids move to the farthest points."""
    centroids = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        d = squared(points, centroids)
        near = d.argmin(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=k)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
        if (empty := np.flatnonzero(n == 0)).size:
            centroids[empty] = points[np.argsort(-d.min(1), kind="stable")[: empty.size]]
    return centroids


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None])


class MultiIndex:
    """The fitted part: codebooks, entries by cell, blocks by cell."""

    def __init__(self, sample: np.ndarray, rows: int):
        self.half = (sample.shape[1] + 1) // 2
        k = int(min(MOST_CENTROIDS, len(sample), max(2, (rows / 16) ** 0.5)))
        self.books = [kmeans(x, k) for x in self._halves(sample)]
        self.k, self.counts, self.rows = k, None, rows

    def _halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, : self.half], x[:, self.half :]] if x.shape[1] > 1 else [x, np.zeros((len(x), 1))]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = (squared(h, c).argmin(1) for h, c in zip(self._halves(x), self.books))
        return a * self.k + b

    def tune(self, sample: np.ndarray, nearest: int) -> None:
        """The share of entries to meet, so that TARGET of the sample's own neighbours are met by queries from it."""
        cells = self.cells(sample)
        counts = np.bincount(cells, minlength=self.k**2)
        queries = np.linspace(0, len(sample) - 1, min(TUNING_QUERIES, len(sample))).astype(int)
        met = []
        for q in queries:
            d = squared(sample[q : q + 1], sample)[0]
            d[q] = np.inf
            order = np.argsort(d, kind="stable")[: min(nearest, len(sample) - 1)]
            places, seen = {}, 0
            for cell in self.walk(sample[q], counts, len(sample)):
                seen += counts[cell]
                places[cell] = seen
            met += [places[c] for c in cells[order]]
        self.share = float(np.quantile(met, TARGET)) / len(sample) if met else 1.0

    def place(self, counts: dict[int, int]) -> None:
        """Blocks: (first, how many) by cell, from the entries by cell."""
        self.counts = np.zeros(self.k**2, np.int64)
        for cell, n in counts.items():
            self.counts[cell] = n
        self.first, self.parts = np.zeros(self.k**2, np.int64), np.ones(self.k**2, np.int64)
        block, filled = 0, 0
        for cell in range(self.k**2):
            n = int(self.counts[cell])
            if filled and filled + n > BLOCK:
                block, filled = block + 1, 0
            self.first[cell] = block
            if n > BLOCK:
                self.parts[cell] = -(-n // BLOCK)
                block, filled = block + int(self.parts[cell]), 0
            else:
                filled += n

    def walk(self, query: np.ndarray, counts: np.ndarray, enough: int):
        """Cells by summed distance, nearest first, empty ones left out, until they hold `enough` entries."""
        (da, db) = (squared(h, c)[0] for h, c in zip(self._halves(query[None]), self.books))
        a, b = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
        sa, sb = da[a].tolist(), db[b].tolist()
        a, b, k, counts = a.tolist(), b.tolist(), self.k, counts.tolist() if hasattr(counts, "tolist") else counts
        heap, done_in_row, seen = [(sa[0] + sb[0], 0, 0)], [0] * k, 0
        while heap and seen < enough:
            _, i, j = heapq.heappop(heap)
            done_in_row[i] = j + 1
            cell = a[i] * k + b[j]
            if counts[cell]:
                seen += counts[cell]
                yield cell
            # a pair enters once both its neighbours nearer the corner are out
            if j + 1 < k and (i == 0 or done_in_row[i - 1] > j + 1):
                heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
            if i + 1 < k and done_in_row[i + 1] == j:
                heapq.heappush(heap, (sa[i + 1] + sb[j], i + 1, j))


def vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def search(df: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", nearest: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of the nearest found; `is_query`: a Column over `id`."""
    spark = df.sparkSession
    rows = usable(df, id_col, vec_col)
    n = rows.count()
    ddl = "query_id long, rank int, vec_id long, score double"
    if n == 0:
        return spark.createDataFrame([], ddl)
    sample = np.array([r[0] for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").collect()])
    index = MultiIndex(sample, n)
    index.tune(sample, nearest)

    def assign():
        def step(batch: pa.RecordBatch) -> dict:
            return {"id": batch.column(0), "cell": index.cells(vectors(batch.column(1))), "vec": batch.column(1)}

        return step

    entries = materialize(map_batches(rows, "id long, cell int, vec array<double>", assign), "multi-index")
    index.place(dict(entries.groupBy("cell").count().collect()))  # at most 65,536 cells
    enough = max(10 * nearest, int(np.ceil(index.share * n)))
    fixed = spark.sparkContext.broadcast(index)

    def probe(batches):
        schema = arrow_
        for batch in batches:
            index = fixed.value
            for q, vec in zip(batch.column(0).to_pylist(), vectors(batch.column(1))):
                cells = np.fromiter(index.walk(vec, index.counts, enough), np.int64)
                first, parts = index.first[cells], index.parts[cells]
                by: dict[int, list[int]] = {}
                for cell, f, p in zip(cells.tolist(), first.tolist(), parts.tolist()):
                    for block in range(f, f + p):
                        by.setdefault(block, []).append(cell)
                yield to_batch({"block": list(by), "query_id": [q] * len(by), "query": [vec] * len(by), "cells": list(by.values())}, schema)

    probe_ddl = "block int, query_id long, query array<double>, cells array<int>"
    arrow_ = arrow_schema(spark, probe_ddl)
    queries = entries.where(is_query).dropDuplicates(["id", "vec"]).select("id", "vec").repartition(F.col("id"))
    probes = queries.mapInArrow(probe, probe_ddl)

    def block_of():
        def step(batch: pa.RecordBatch) -> dict:
            ids, cells = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            index = fixed.value
            salt = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
            return {"block": index.first[cells] + (salt % index.parts[cells].astype(np.uint64)).astype(np.int64), "id": batch.column(0), "cell": batch.column(1), "vec": batch.column(2)}

        return step

    stored = map_batches(entries, "block int, id long, cell int, vec array<double>", block_of)
    out_schema = arrow_schema(spark, "query_id long, vec_id long, score double")

    def rerank(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            left = left.combine_chunks()
            cells, ids = left["cell"].to_numpy(), left["id"].to_numpy()
            order = np.lexsort((ids, cells))
            cells, ids, vecs = cells[order], ids[order], vectors(left["vec"].combine_chunks())[order]
            for q, vec, wanted in zip(right["query_id"].to_pylist(), right["query"].to_pylist(), right["cells"].to_pylist()):
                low, high = np.searchsorted(cells, wanted), np.searchsorted(cells, wanted, "right")
                at = np.concatenate([np.arange(a, b) for a, b in zip(low.tolist(), high.tolist())] or [np.empty(0, int)]).astype(int)
                at = at[ids[at] != q]
                if at.size:
                    d = np.sqrt(((vecs[at] - np.array(vec)) ** 2).sum(1))
                    if at.size > nearest:
                        close = d <= np.partition(d, nearest - 1)[nearest - 1]
                        at, d = at[close], d[close]
                    best = np.lexsort((ids[at], d))[:nearest]
                    out["query_id"] += [q] * len(best)
                    out["vec_id"] += ids[at][best].tolist()
                    out["score"] += d[best].tolist()
        return pa.table({f.name: pa.array(out[f.name], f.type) for f in out_schema}, schema=out_schema)

    found = stored.groupBy("block").cogroup(probes.groupBy("block")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
