"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pick, stored

#: Bytes of weights of a block of candidates, and of the queries that one pass over the candidates takes along.
CANDIDATE_BYTES, QUERY_BYTES = 32 << 20, 16 << 20
_LONG = 2.0**62


def _terms(scale: int) -> Column:
    """Sparse row of a vector: integer weight by dimension; saturates at +-2**62."""
    return F.transform("embedding", lambda x: F.greatest(F.lit(-_LONG), F.least(F.lit(_LONG), F.floor(x.cast("double") * scale).cast("double"))).cast("long"))


def _valid() -> Column:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(False))


class _Rows(NamedTuple):
    """Ragged rows of weights, sorted by id."""

    ids: np.ndarray
    offsets: np.ndarray
    weights: np.ndarray


def _pack(ids: list[int], rows: list[np.ndarray]) -> _Rows:
    order = np.argsort(np.array(ids, np.int64), kind="stable")
    lens = np.array([len(rows[i]) for i in order], np.int64)
    flat = np.concatenate([rows[i] for i in order]) if len(order) else np.zeros(0, np.int64)
    return _Rows(np.array(ids, np.int64)[order], np.concatenate([[0], np.cumsum(lens)]), flat)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Rows]:
    """The candidates in blocks of about CANDIDATE_BYTES."""
    ids, rows, size = [], [], 0
    for b in batches:
        terms = b.column(1)
        offsets, values = terms.offsets.to_numpy(), terms.values.to_numpy(zero_copy_only=False).astype(np.int64)
        for i, v in enumerate(b.column(0).to_pylist()):
            ids.append(v)
            rows.append(values[offsets[i] : offsets[i + 1]])
            size += 8 * len(rows[-1]) + 16
            if size >= CANDIDATE_BYTES:
                yield _pack(ids, rows)
                ids, rows, size = [], [], 0
    if ids:
        yield _pack(ids, rows)


def _postings(block: _Rows) -> list[tuple[slice | np.ndarray, np.ndarray]]:
    """By term: the rows with a weight there, and the weights."""
    lens = np.diff(block.offsets)
    term = np.arange(len(block.weights)) - np.repeat(block.offsets[:-1], lens)
    row = np.repeat(np.arange(len(block.ids)), lens)
    live = block.weights != 0
    order = np.argsort(term[live], kind="stable")
    t, rows, weights = term[live][order], row[live][order], block.weights[live][order]
    cut = np.searchsorted(t, np.arange((t[-1] + 2) if len(t) else 1))
    parts = [(rows[a:b], weights[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
    return [(slice(None) if len(p) == len(block.ids) else p, x) for p, x in parts]


def _select(score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to the smaller position (positions are in id order)."""
    if len(score) <= k:
        return np.arange(len(score))
    least = np.partition(score, len(score) - k)[len(score) - k]
    above = np.flatnonzero(score > least)
    return np.concatenate([above, np.flatnonzero(score == least)[: k - len(above)]])


_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _search(k: int, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: _Rows = sent.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries.ids)
        for block in _blocks(batches):
            postings = _postings(block)
            for q, qid in enumerate(queries.ids.tolist()):
                acc = np.zeros(len(block.ids), np.int64)
                for (where, weight), x in zip(postings, queries.weights[queries.offsets[q] : queries.offsets[q + 1]].tolist(), strict=False):
                    if x:
                        acc[where] += x * weight
                ids = block.ids
                lo, hi = np.searchsorted(ids, [qid, qid + 1])
                if lo < hi:
                    acc, ids = np.delete(acc, slice(lo, hi)), np.delete(ids, slice(lo, hi))
                at = _select(acc, k)
                score, ids = np.concatenate([best[q][0], acc[at]]), np.concatenate([best[q][1], ids[at]])
                kept = np.lexsort((ids, -score))[:k] if len(ids) > k else slice(None)
                best[q] = score[kept], ids[kept]
        count = [len(s) for s, _ in best]
        if sum(count):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(queries.ids, count)), pa.array(np.concatenate([i for _, i in best])), pa.array(np.concatenate([s for s, _ in best]))], schema=_HITS)

    return run


def exact_topk(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each query the k candidates of highest integer inner product.

    vectors: vec_id, embedding (further columns are ignored). Queries: rows whose vec_id is divisible by `every`;
    candidates: all rows but those with the query's own vec_id. A component x weighs floor(scale * x), x as double,
    saturating at +-2**62; sums wrap as 64-bit integers. Vectors of unequal length count as 0 beyond their end.
    Null ids, null vectors and vectors with null or non-finite components take no part; empty vectors score 0.
    Rows repeating a vec_id are separate candidates; of those that are queries the least vector asks. An empty table
    gives no rows.

    Candidates stay where they are read, in blocks of CANDIDATE_BYTES. Queries go to them QUERY_BYTES at a time, a pass
    over the candidates each. A query scatters weighted postings term by term into a dense score array of the block,
    keeps k by partition selection, and merges them with those of the task's earlier blocks; a window merges the tasks.
    """
    spark = vectors.sparkSession
    rows = pick(vectors, "vec_id", "embedding").filter(_valid()).select(F.col("vec_id").cast("long").alias("vec_id"), _terms(scale).alias("terms"))
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("terms").alias("terms"))
    size = asked.agg(F.sum(8 * F.size("terms") + 24)).first()[0] or 0
    passes, found = max(1, -(-size // QUERY_BYTES)), []
    for i in range(passes):
        some = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == i).collect()
        sent = spark.sparkContext.broadcast(_pack([r.vec_id for r in some], [np.array(r.terms, np.int64) for r in some]))
        hits = rows.mapInArrow(_search(k, sent), "query_id long, vec_id long, score long")
        if passes > 1:  # one pass's queries are let go before the next
            hits = stored(hits, "hits")
            sent.unpersist()
        found.append(hits)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return reduce(DataFrame.unionAll, found).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
