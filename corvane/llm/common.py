"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected as connected_components  # noqa: F401
from ..storage import written  # noqa: F401

#: Lower-casing of A-Z alone, as the contracts ask; other letters stay as they are.
ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_runs(rows: Iterable, sizes: Iterable[int], most: int) -> Iterator[list]:
    """Consecutive rows in runs of about ``most`` units at most; a larger single row is a run of its own."""
    run, held = [], 0
    for row, size in zip(rows, sizes):
        if run and held + size > most:
            yield run
            run, held = [], 0
        run.append(row)
        held += size
    if run:
        yield run


def within(docs: DataFrame, ids: DataFrame, how: str, small: int = 500_000) -> DataFrame:
    """A semi or anti join by doc_id; ``ids`` is broadcast if it has ``small`` rows at most, else both sides are shuffled."""
    return docs.join(F.broadcast(ids) if ids.count() <= small else ids, "doc_id", how)


def text_runs(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """``texts`` in consecutive slices of about ``most`` bytes, so a worker's memory doesn't follow the batch."""
    low = 0
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for run in in_runs(sizes, sizes, most):
        yield texts.slice(low, len(run))
        low += len(run)


def release(spark: SparkSession) -> None:
    """Has Spark delete shuffle files that no plan refers to any more, which it does when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def group_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, list[int]]]:
    """Whole groups of rows that come sorted by their first ``keys`` columns (64-bit numbers), as (rows, bounds of the groups).

    Only the group that a batch ends in is held over, so memory follows a batch and the largest group.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch]).combine_chunks()
        group = np.stack([rows.column(k).to_numpy() for k in range(keys)], axis=1)
        cuts = (np.nonzero((group[1:] != group[:-1]).any(axis=1))[0] + 1).tolist()
        last = cuts[-1] if cuts else 0
        held = rows.slice(last).combine_chunks().to_batches()
        if last:
            yield rows.slice(0, last), [0, *cuts]
    if held:
        rows = pa.Table.from_batches(held)
        yield rows, [0, rows.num_rows]


def forest(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs: at most n - 1 of them keep all that is connected connected."""
    parent, out = list(range(n)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = root(i), root(j)
            if x != y:
                parent[y] = x
                out.append((i, j))
    return out
