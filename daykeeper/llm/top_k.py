"""Exact inner-product search in three phases under a uniform threshold over slices of the dimensions."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from daykeeper.session import durable

#: Candidates in a chunk and queries in a block: what one task scores of each at a time.
CHUNK = 2_048
BLOCK = 1_024
#: Blocks of queries that travel together, and chunks that meet such a group in one cell of the grid.
GROUP = 16
CELL = 16
#: Queries in a block that is scored by integer arithmetic, of which an entry takes some 100 bytes.
EXACT_BLOCK = 128
SLICES = 2
#: Sums of products below this are exact in double precision.
EXACT = float(1 << 53)


def usable(column: str) -> Column:
    """The array is there and all its components are finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(column).isNotNull() & ~F.exists(F.col(column), bad)


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id and ``q``, floor(scale * x) of every component as a double that holds a whole number, without
    vectors that take no part. ``reach`` is the largest absolute component."""
    whole = vectors.where(usable("embedding") & F.col("vec_id").isNotNull())

    def floored(x: Column) -> Column:
        y = x.cast("double") * F.lit(scale)
        # From 2 ** 52 on a double is whole; what the scale would carry beyond its range is at its end.
        clipped = F.greatest(F.least(y, F.lit(sys.float_info.max)), F.lit(-sys.float_info.max))
        return F.when(F.abs(y) < F.lit(float(1 << 52)), F.floor(y).cast("double")).otherwise(clipped)

    rows = whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", floored).alias("q"))
    return rows.withColumn("reach", F.coalesce(F.array_max(F.transform("q", F.abs)), F.lit(0.0)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix; shorter ones end in zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return values.reshape(len(column), width)
    out = np.zeros((len(column), width), values.dtype)
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out


def _chunks(rows: DataFrame, width: int, kind: str = "<i4") -> DataFrame:
    """Candidates packed: ids (int64) and components of ``kind`` of up to CHUNK vectors in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            matrix = _matrix(batch.column(1), width).astype(kind)
            parts = range(0, len(ids), CHUNK)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[a : a + CHUNK].astype("<i8").tobytes() for a in parts], pa.binary()),
                    pa.array([matrix[a : a + CHUNK].tobytes() for a in parts], pa.binary()),
                ],
                names=["ids", "parts"],
            )

    return rows.select("vec_id", "q").mapInArrow(run, "ids binary, parts binary")


def _blocks(queries: DataFrame, blocks: int, width: int, kind: str = "<i4") -> DataFrame:
    """Queries packed in ``blocks`` rows: ids, components and cutoffs."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        matrix = _matrix(table.column("q").chunk(0), width).astype(kind)
        return pa.table(
            {
                "block": table.column("block").slice(0, 1),
                "q_ids": pa.array([table.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()),
                "q_parts": pa.array([matrix.tobytes()], pa.binary()),
                "q_cuts": pa.array([table.column("cut").to_numpy().astype("<f8").tobytes()], pa.binary()),
            }
        )

    keyed = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return keyed.groupBy("block").applyInArrow(run, "block int, q_ids binary, q_parts binary, q_cuts binary")


Pairing = Callable[[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _paired(chunks: DataFrame, blocks: DataFrame, count: int, width: int, slices: int, work: Pairing) -> DataFrame:
    """``work`` on every chunk and block of queries; rows query_id, vec_id, score."""
    edges = np.linspace(0, width, slices + 1).astype(int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, parts, q_ids, q_parts, q_cuts in zip(*(c for c in batch.columns)):
                own = np.frombuffer(ids.as_py(), "<i8")
                theirs = np.frombuffer(q_ids.as_py(), "<i8")
                left = np.frombuffer(parts.as_py(), "<i4").reshape(len(own), width).astype(float)
                asked = np.frombuffer(q_parts.as_py(), "<i4").reshape(len(theirs), width)
                cuts = np.frombuffer(q_cuts.as_py(), "<f8")
                for at in range(0, len(theirs), BLOCK):
                    some = theirs[at : at + BLOCK]
                    right = asked[at : at + BLOCK].astype(float)
                    local = [left[:, a:b] @ right[:, a:b].T for a, b in zip(edges, edges[1:])]
                    local[0][own[:, None] == some[None, :]] = -np.inf
                    row, query, score = work(own, some, local, cuts[at : at + BLOCK])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some[query]), pa.array(own[row]), pa.array(score.astype(np.int64))], names=["query_id", "vec_id", "score"]
                    )

    return _met(chunks, blocks, count).mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def _met(chunks: DataFrame, blocks: DataFrame, count: int) -> DataFrame:
    """Every chunk beside every packed row of queries, in a grid of cells.

    A chunk is copied once for each of the ``count`` packed rows, and each of those once for the CELL
    chunks of a cell: neither side once for every single row of the other.
    """
    parts = max(1, -(-chunks.count() // CELL))
    spread = chunks.select("*", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int").alias("part"))
    spread = spread.select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("block"))
    dealt = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    return spread.join(dealt, ["block", "part"]).select("ids", "parts", "q_ids", "q_parts", "q_cuts")


def _limbs(matrix: np.ndarray, bits: int) -> list[np.ndarray]:
    """Whole numbers as sums of limbs below 2 ** bits times powers of it, each exact in a double."""
    sign, rest, out = np.sign(matrix), np.abs(matrix), []
    while rest.any():
        low = np.fmod(rest, float(1 << bits))
        out.append(sign * low)
        rest = (rest - low) / float(1 << bits)
    return out


def exact_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole doubles of any size as longs; beyond their range, the nearest end.

    Products of limbs are exact in double precision; they are added as longs where the sums fit, else
    as Python's integers.
    """
    width = max(1, left.shape[1])
    bits = (52 - width.bit_length()) // 2
    reach = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * width
    small = reach < 2.0**62
    total = np.zeros((len(left), len(right)), np.int64 if small else object)
    theirs = _limbs(right, bits)
    for i, a in enumerate(_limbs(left, bits)):
        for j, b in enumerate(theirs):
            part = (a @ b.T).astype(np.int64)
            total += part << (bits * (i + j)) if small else part.astype(object) * (1 << bits * (i + j))
    return total if small else np.clip(total, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _paired_exactly(chunks: DataFrame, blocks: DataFrame, count: int, width: int, k: int) -> DataFrame:
    """Each chunk's ``k`` best of every query by exact products; chunks and blocks hold doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, parts, q_ids, q_parts, _ in zip(*(c for c in batch.columns)):
                own = np.frombuffer(ids.as_py(), "<i8")
                theirs = np.frombuffer(q_ids.as_py(), "<i8")
                score = exact_products(np.frombuffer(parts.as_py(), "<f8").reshape(len(own), width), np.frombuffer(q_parts.as_py(), "<f8").reshape(len(theirs), width))
                rows, columns = [], []
                for column in range(len(theirs)):
                    order = np.lexsort((own, ~score[:, column]))
                    order = order[own[order] != theirs[column]][:k]
                    rows.append(order)
                    columns.append(np.full(len(order), column))
                row, query = np.concatenate(rows), np.concatenate(columns)
                yield pa.RecordBatch.from_arrays([pa.array(theirs[query]), pa.array(own[row]), pa.array(score[row, query])], names=["query_id", "vec_id", "score"])

    return _met(chunks, blocks, count).mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """A mask of the k best rows of every column; of equal scores the smaller ids."""
    if len(scores) <= k:
        return np.isfinite(scores)
    least = -np.partition(-scores, k - 1, axis=0)[k - 1]
    mask = (scores >= least) & np.isfinite(scores)
    for column in np.flatnonzero(mask.sum(axis=0) > k):
        rows = np.flatnonzero(mask[:, column])
        order = np.lexsort((ids[rows], -scores[rows, column]))
        mask[rows[order[k:]], column] = False
    return mask


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, slices: int = SLICES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` highest integer inner products.

    Vectors are cut into chunks, queries into blocks, the dimensions into ``slices``. Phase one: every
    chunk gives, for every slice, its k entries with the highest local scores, with their totals; the
    k-th highest total of a query is a safe cutoff. Phase two: the cutoff goes back with the query, and
    a chunk keeps an entry only if some slice holds at least an equal share of it, since a total that
    reaches the cutoff must do so in one slice; entries whose bound over the missing slices falls short
    go. Phase three: what remains is scored exactly, and a chunk hands on its k best that reach the
    cutoff. So no chunk gives more than k rows a query and phase, however many vectors are alike.

    Vectors whose products could leave the exact range of double precision are scored apart, by exact
    integer arithmetic: all queries against such candidates, and such queries against all others.

    Ties go to the smaller vec_id. A row with the query's own vec_id is no candidate. A query id that is
    there several times is asked once, with the smallest of its vectors; repeated candidates each count.
    Vectors that are null or hold null or non-finite components take no part, nor do rows without vec_id;
    missing trailing components count as zero. A score beyond the range of a long is its nearest end.
    """
    rows = quantised(vectors, scale)
    asked = quantised(vectors.where(is_query), scale).groupBy("vec_id").agg(F.min(F.struct("q", "reach")).alias("best"))
    asked = asked.select("vec_id", "best.q", "best.reach")
    width, reach = rows.agg(F.max(F.size("q")), F.max("reach")).first()
    empty = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not width:
        return vectors.sparkSession.createDataFrame([], empty)
    asked = durable(asked)
    bound = min(float(1 << 31) - 1, (EXACT / width) ** 0.5)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if reach < bound:
        found = _three_phases(rows, asked, width, k, slices, order)
    else:
        near, far = F.col("reach") < bound, F.col("reach") >= bound
        found = _three_phases(rows.where(near), asked.where(near), width, k, slices, order)
        for candidates, queries in ((rows.where(far), asked), (rows.where(near), asked.where(far))):
            blocks = max(1, -(-queries.count() // EXACT_BLOCK))
            packed = _blocks(queries.withColumn("cut", F.lit(0.0)), blocks, width, "<f8")
            found = found.unionByName(_paired_exactly(durable(_chunks(candidates, width, "<f8")), packed, blocks, width, k))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _three_phases(rows: DataFrame, asked: DataFrame, width: int, k: int, slices: int, order: WindowSpec) -> DataFrame:
    """query_id, vec_id, score: every chunk's entries that can be among the ``k`` best of a query."""
    blocks = max(1, -(-asked.count() // (BLOCK * GROUP)))
    chunks = durable(_chunks(rows, width))

    def gather(own, theirs, local, _):
        mask = np.zeros(local[0].shape, bool)
        total = sum(local)
        for part in local:
            mask |= _best(np.where(np.isfinite(total), part, -np.inf), own, k)
        row, query = np.nonzero(mask)
        return row, query, total[row, query]

    first = _paired(chunks, _blocks(asked.withColumn("cut", F.lit(0.0)), blocks, width), blocks, width, slices, gather)
    cutoffs = first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).where(F.col("place") == k)
    cutoffs = durable(cutoffs.select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("cut")))
    limited = asked.join(cutoffs, "vec_id", "left").select("vec_id", "q", F.coalesce("cut", F.lit(float("-inf"))).alias("cut"))

    def resolve(own, theirs, local, cut):
        share = cut / len(local)
        high = [part >= share for part in local]
        kept = np.logical_or.reduce(high)
        bound = sum(np.where(h, part, share) for h, part in zip(high, local))
        kept &= bound >= cut
        total = np.where(kept, sum(local), -np.inf)
        total[total < cut] = -np.inf
        row, query = np.nonzero(_best(total, own, k))
        return row, query, total[row, query]

    return _paired(chunks, _blocks(limited, blocks, width), blocks, width, slices, resolve)
