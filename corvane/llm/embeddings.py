"""Embedding near-duplicates by Euclidean p-stable hashing and exact cosine checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, forest, group_runs, written

#: Rows of a bucket that one task compares; a larger bucket is dealt out as pairs of blocks of this size.
BLOCK = 2048


def usable(vector: Column) -> Column:
    """Neither null nor empty nor all zero, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(flat: np.ndarray, width: int) -> np.ndarray:
    rows = flat.reshape(-1, width).astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # first, lest squares overflow
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def bucket_keys(unit: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """For each row its bucket in each table: quantised Gaussian projections, hashed together."""
    rng = np.random.default_rng([seed, unit.shape[1]])
    normals, shifts = rng.standard_normal((unit.shape[1], tables * projections)), rng.uniform(0, width, tables * projections)
    cells = np.floor((unit @ normals + shifts) / width).astype(np.int64).view(np.uint64).reshape(len(unit), tables, projections)
    keys = np.full((len(unit), tables), unit.shape[1], np.uint64)
    for k in range(projections):
        keys = (keys ^ cells[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def linked(unit: np.ndarray, keys: np.ndarray, block: np.ndarray, table: int, cross: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j at the threshold or above that no earlier table has in one bucket; of two blocks, only pairs across."""
    for low in range(0, len(unit), 512):
        i, j = np.nonzero(unit[low : low + 512] @ unit.T >= threshold)
        i += low
        keep = i < j
        if cross:
            keep &= block[i] != block[j]
        i, j = i[keep], j[keep]
        for at in range(0, len(i), 100_000):
            a, b = i[at : at + 100_000], j[at : at + 100_000]
            new = ~(keys[a, :table] == keys[b, :table]).any(axis=1)
            yield a[new], b[new]


def compared(vectors: DataFrame, tables: int, projections: int, width: float, threshold: float, seed: int) -> DataFrame:
    """(a, b, links): b null, the links that one comparison adds to vector a; or links null, an edge of a forest."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            sizes = np.diff(vectors.offsets.to_numpy())
            flat, starts = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()[:-1]
            for size in np.unique(sizes):
                rows = np.nonzero(sizes == size)[0]
                unit = units(flat[(starts[rows][:, None] + np.arange(size)).ravel()], int(size))
                keys = bucket_keys(unit, tables, projections, width, seed)
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(copies[rows]), vectors.take(pa.array(rows)), pa.array(list(keys), pa.list_(pa.int64()))], ["id", "copies", "vector", "keys"])

    inner = vectors.schema["vector"].dataType.simpleString()
    keyed = written(vectors.mapInArrow(hashed, f"id long, copies long, vector {inner}, keys array<long>"), "keys")
    # buckets of one row go at once; only ids and keys are dealt out for that, and vectors follow where they are compared
    each = keyed.select("id", F.posexplode("keys").alias("t", "key"))
    shared = written(each.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = each.join(shared, ["t", "key"]).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("id", F.col("t").cast("long").alias("t"), "key", F.least("block", "other").cast("long").alias("low"), F.greatest("block", "other").cast("long").alias("high"), F.col("block").cast("long").alias("block"))
    tiles = tiles.join(keyed, "id").select("t", "key", "low", "high", "block", "id", "copies", "vector", "keys")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, bounds in group_runs(batches, 4):  # a tile is bounded
            yield from tile_rows(whole, bounds)

    def tile_rows(whole: pa.Table, bounds: list[int]) -> Iterator[pa.RecordBatch]:
        t, low, high, block, ids, copies = (whole.column(k).to_numpy() for k in (0, 2, 3, 4, 5, 6))
        vectors, keys = whole.column(7).combine_chunks(), np.array(whole.column(8).combine_chunks().flatten()).reshape(-1, tables)
        flat, starts = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
        out: list[tuple] = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a < 2:
                continue
            unit, own = units(flat[starts[a] : starts[b]], int(starts[a + 1] - starts[a])), ids[a:b]
            links, pairs = np.zeros(b - a, np.int64), []
            for i, j in linked(unit, keys[a:b], block[a:b], int(t[a]), low[a] != high[a], threshold):
                if len(i):
                    np.add.at(links, i, copies[a:b][j])
                    np.add.at(links, j, copies[a:b][i])
                    pairs.append((i, j))
            some = np.nonzero(links)[0]
            out += [(int(own[k]), None, int(links[k])) for k in some]
            out += [(int(own[i]), int(own[j]), None) for i, j in forest(b - a, pairs)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], ["a", "b", "links"])

    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = tiles.repartition(partitions, "t", "key", "low", "high").sortWithinPartitions("t", "key", "low", "high")
    return ordered.mapInArrow(compare, "a long, b long, links long")


def near_duplicates(rows: DataFrame, threshold: float = 0.95, tables: int = 20, projections: int = 12, width: float = 2.0, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept): links at ``threshold`` cosine or more between all usable vectors.

    Equal vectors collapse first and count as so many links. The others are filed by p-stable hashes of their unit
    vectors in ``tables`` tables of ``projections`` quantised projections each; vectors in one bucket are
    compared exactly, in double precision, and a pair counts in the first table that brings it together. At cosine
    0.95 (distance 0.316) a table brings a pair together with probability 0.2, all 20 with 0.99, and nearer pairs
    oftener. Buckets over ``BLOCK`` rows are compared as pairs of blocks, each in a task of its own. Tasks
    return counts and spanning forests, never the pairs of a group.

    Null, empty and zero vectors, and those with null or non-finite components, link with nothing and are kept;
    vectors of different length never link. Equal vectors are told by 128 bits of hash. Repeated rows count and
    have a result each (one vec_id must not have different vectors); an empty table gives an empty one; other columns
    aren't read.
    """
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    good = rows.where(usable(F.col("vector")))
    # equal vectors meet by 128 bits of hash, as a common vector itself would be sent with each of its rows
    marked = good.select("vec_id", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"))
    distinct = written(marked.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.any_value("vector").alias("vector")), "vectors")
    found = written(compared(distinct.select("id", "copies", "vector"), tables, projections, width, threshold, seed), "links")
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    classes = connected_components(found.where("b is not null").select("a", "b"))
    of_vector = distinct.join(links, F.col("id") == links["a"], "left").join(classes, F.col("id") == classes["node"], "left").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = marked.select("vec_id", "h1", "h2").join(written(of_vector, "classes"), ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable(F.col("vector"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
