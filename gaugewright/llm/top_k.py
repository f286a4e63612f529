"""Exact top-k search by inner product over vectors sorted by length.

Candidates lie in blocks by descending length, queries in blocks of their own; a task takes one of each,
so neither side has to fit into one place. Vectors are rotated by the leading singular vectors of a bounded
sample, which puts most of their length into the first components; what length is left follows from the whole
one. Against a query's k-th best score so far:

* a block is left out if the product of lengths can't reach it (Cauchy-Schwarz),
* a pair is left out if the partial sum over the first rotated components plus the product of the
  remaining lengths can't,
* for the others the score is computed from the integers themselves, so results are exact.

The longest vectors are searched first for all queries. The blocks after them follow in rounds, each with several times
as many blocks as the one before; after each round a query's k-th best score is that of all rounds so far.

Cases: vectors that are null or hold a null or a component that isn't finite take no part; vectors of
different dimensions count as padded with zeros; equal scores go to the smaller identifier; a query is
never its own neighbour (by identifier), rows that share an identifier are candidates each on their own;
query rows that share an identifier share one list, of the best of all their pairs;
null identifiers take no part; with fewer than k candidates all are returned; further columns are not read.
Vectors so long that a score may not fit into 64 bits (a squared length of 2**63 or more) are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.session import bound_batches, materialize, temporary

#: Vectors in a block of candidates and of queries, and in a step within a task.
BLOCK, QUERIES, STEP = 8192, 4096, 1024
#: Bytes of a block at most; longer vectors make smaller blocks.
BLOCK_BYTES = 32 << 20
#: Vectors that the rotation is fitted on, about.
SAMPLE = 16_384
#: Rotated components of the partial sums.
LEADING = 16
#: Blocks of the first round after the longest vectors, and how many times as many each later round has.
ROUND, GROWTH = 8, 8
#: Bytes of the list of blocks that is broadcast, at most.
LIST_BYTES = 256 << 20


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as double; null for vectors that take no part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def matrix(lists: pa.Array, dimension: int) -> np.ndarray:
    """Rows padded with zeros, as int64."""
    lengths = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == dimension).all():
        return flat.reshape(-1, dimension)
    out = np.zeros((len(lengths), dimension), dtype=np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def lengths(vectors: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each vector: its length, its leading rotated components, and the length of the rest."""
    lead = vectors @ rotation
    squared = (vectors.astype(np.float64) ** 2).sum(axis=1)
    return np.sqrt(squared), lead, np.sqrt(np.maximum(squared - (lead**2).sum(axis=1), 0.0))


class Search:
    """The k best of all candidates seen so far, for one block of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.exact, self.rotation, self.k = ids, vectors, rotation, k
        self.norm, self.lead, self.tail = lengths(vectors, rotation)
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor.copy()
        self.hits = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))  # query's row, candidate, score

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Search candidates in order of descending length."""
        for at in range(0, len(ids), STEP):
            if not self._step(ids[at : at + STEP], vectors[at : at + STEP]):
                return

    def _step(self, ids: np.ndarray, vectors: np.ndarray) -> bool:
        norm, lead, tail = lengths(vectors, self.rotation)
        slack = 1e-6 + 1e-7 * self.norm * norm[0]  # what rounding does to the remaining lengths, and more
        active = np.flatnonzero(self.norm * norm[0] + slack >= self.floor)
        if not len(active):
            return False
        bound = self.lead[active] @ lead.T
        bound += np.outer(self.tail[active], tail)
        q, c = np.nonzero(bound >= (self.floor - slack)[active, None])
        q = active[q]
        small = float(np.abs(self.exact).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * vectors.shape[1] < 2.0**53
        if small and len(q) > 0.05 * len(active) * len(ids):
            score = (self.exact.astype(np.float64) @ vectors.astype(np.float64).T)[q, c].astype(np.int64)
        else:
            score = np.concatenate([np.einsum("ij,ij->i", self.exact[q[s : s + 65536]], vectors[c[s : s + 65536]]) for s in range(0, len(q), 65536)] or [np.zeros(0, dtype=np.int64)])
        good = (score >= self.floor[q]) & (ids[c] != self.ids[q])
        self.hits = self._best(*(np.concatenate([old, new[good]]) for old, new in zip(self.hits, (q, ids[c], score), strict=True)))
        return True

    def _best(self, q: np.ndarray, c: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((c, -score, q))
        q, c, score = q[order], c[order], score[order]
        first = np.searchsorted(q, q)
        place = np.arange(len(q)) - first
        last = place == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], score[last])
        kept = place < self.k
        return q[kept], c[kept], score[kept]


def _packed(dimension: int, size: int, kind: str):
    """Turn rows (id, vector) into rows that hold a block each: name, rows, greatest length, ids and vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        ids, rows = np.zeros(0, dtype=np.int64), np.zeros((0, dimension), dtype=np.int64)

        def out(i: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            nonlocal made
            made += 1
            longest = float(np.sqrt((v.astype(np.float64) ** 2).sum(axis=1)).max())
            return pa.RecordBatch.from_arrays([pa.array([f"{task}-{made}"]), pa.array([len(i)], pa.int64()), pa.array([longest]), pa.array([i.tobytes()], pa.binary()), pa.array([v.astype(kind).tobytes()], pa.binary())], ["block", "n", "longest", "ids", "vectors"])

        for batch in batches:
            ids, rows = np.concatenate([ids, batch.column(0).to_numpy()]), np.concatenate([rows, matrix(batch.column(1), dimension)])
            while len(ids) >= size:
                yield out(ids[:size], rows[:size])
                ids, rows = ids[size:], rows[size:]
        if len(ids):
            yield out(ids, rows)

    return run


def leading_rotation(candidates: DataFrame, total: int, dimension: int) -> np.ndarray:
    """(dimension, LEADING) first right singular vectors of a bounded sample, chosen by a hash of the identifier."""
    rate = min(1 << 20, (SAMPLE << 20) // max(1, total) + 1)
    sample = candidates.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < rate).select("_vector")
    fitted = matrix(sample.toArrow().column(0).combine_chunks(), dimension).astype(np.float64)
    if not len(fitted):
        return np.eye(dimension)[:, :LEADING]
    if len(fitted) <= dimension:
        return np.ascontiguousarray(np.linalg.svd(fitted, full_matrices=True)[2].T[:, :LEADING])
    return np.linalg.eigh(fitted.T @ fitted)[1][:, ::-1][:, :LEADING].copy()


def top_k(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Of each query its ``k`` best: ``query_id``, ``rank``, ``vec_id``, ``score``. Both sides have ``_id`` and ``_vector`` (array of long)."""
    with temporary() as tables:
        hits = _search(candidates, queries, k)
        tables.keep(hits)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    rows = hits.select(F.explode(F.arrays_zip("query", "candidate", "score")).alias("hit")).select(F.col("hit.query").alias("query_id"), F.col("hit.candidate").alias("vec_id"), F.col("hit.score").alias("score"))
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_STATE = "query_block string, need double, qids binary, qvectors binary, floors binary, place array<int>, query array<long>, candidate array<long>, score array<long>"


def _search(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """A written table with a row for each block of queries and the ``k`` best of each of its rows."""
    spark = candidates.sparkSession
    bound_batches(spark)
    squared = F.aggregate("_vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    known = candidates.agg(F.count(F.lit(1)), F.max(F.size("_vector")), F.max(squared), F.max(F.array_max(F.transform("_vector", lambda x: F.abs(x.cast("double")))))).first()
    total, dimension = known[0], known[1] or 1
    if (known[2] or 0.0) >= 2.0**63 * (1 - 1e-9):
        raise ValueError("vectors are so long that their inner products may not fit into 64 bits")
    kind = "<i2" if (known[3] or 0) < 2**15 else "<i4" if known[3] < 2**31 else "<i8"
    size = max(1, min(BLOCK, BLOCK_BYTES // (8 * dimension)))
    asked_size = max(1, min(QUERIES, BLOCK_BYTES // (8 * dimension)))
    count = queries.count()
    rotation = leading_rotation(candidates, total, dimension)

    schema = "block string, n long, longest double, ids binary, vectors binary"
    by_length = candidates.withColumn("_squared", squared).repartitionByRange(max(1, -(-total // size)), F.desc("_squared"), "_id").sortWithinPartitions(F.desc("_squared"), "_id")
    blocks = materialize(by_length.select("_id", "_vector").mapInArrow(_packed(dimension, size, kind), schema), "topk-blocks")
    asked = materialize(queries.repartition(max(1, -(-count // asked_size)), "_id").mapInArrow(_packed(dimension, asked_size, kind), schema), "topk-queries")

    listed = [(r["block"], r["n"], r["longest"]) for r in blocks.select("block", "n", "longest").collect()]  # a row for thousands of vectors
    listed.sort(key=lambda r: (-r[2], r[0]))
    if 100 * len(listed) > LIST_BYTES:
        raise ValueError(f"{len(listed)} blocks are too many to broadcast their list")
    ahead, held = 0, 0
    while ahead < len(listed) and held < size:  # a full block's worth of the longest vectors, however small blocks are
        held += listed[ahead][1]
        ahead += 1

    def unpack(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(ids, dtype=np.int64), np.frombuffer(vectors, dtype=kind).reshape(-1, dimension).astype(np.int64)

    longest = sorted(blocks.where(F.col("block").isin([b for b, _, _ in listed[:ahead]])).collect(), key=lambda r: (-r["longest"], r["block"])) if ahead else []  # less than two blocks
    shared = spark.sparkContext.broadcast((rotation, [(bytes(r["ids"]), bytes(r["vectors"])) for r in longest], [b for b, _, _ in listed], np.array([-x for _, _, x in listed])))

    def state(block: str, search: Search, ids: bytes, vectors: bytes) -> pa.RecordBatch:
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(search.floor <= 0, 0.0, np.where(search.norm > 0, search.floor / search.norm, np.inf))
        q, c, score = search.hits
        columns = [pa.array([block]), pa.array([float(need.min()) * (1 - 1e-7) - 1e-6]), *(pa.array([x], pa.binary()) for x in (ids, vectors, search.floor.tobytes()))]
        columns += [pa.array([q.tolist()], pa.list_(pa.int32())), *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in (search.ids[q], c, score))]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _STATE.split(", ")])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, top, _, _ = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                search = Search(*unpack(row["ids"], row["vectors"]), turn, k)
                for part in top:
                    search.add(*unpack(*part))
                yield state(row["block"], search, row["ids"], row["vectors"])

    def met(low: int, high: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Blocks of this round that are long enough for a block of queries."""
            names, order = shared.value[2:]
            for batch in batches:
                for name, need in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = names[low : min(high, int(np.searchsorted(order, -need, side="right")))]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found, pa.string())], ["query_block", "block"])

        return run

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = shared.value[0]
        for batch in batches:
            for row in batch.to_pylist():
                one = Search(*unpack(row["qids"], row["qvectors"]), turn, k, np.frombuffer(row["floors"], dtype=np.float64))
                one.add(*unpack(row["ids"], row["vectors"]))
                q, c, score = one.hits
                yield pa.RecordBatch.from_arrays([pa.array([row["query_block"]] * len(q), pa.string()), pa.array(q.astype(np.int32)), pa.array(c), pa.array(score)], ["query_block", "q", "c", "s"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = shared.value[0]
        for batch in batches:
            for row in batch.to_pylist():
                one = Search(*unpack(row["qids"], row["qvectors"]), turn, k, np.frombuffer(row["floors"], dtype=np.float64))
                new = row["found"] or []
                old = [np.array(row[x], dtype=np.int64) for x in ("place", "candidate", "score")]
                one.hits = one._best(*(np.concatenate([o, np.array([h[x] for h in new], dtype=np.int64)]) for o, x in zip(old, "qcs", strict=True)))
                yield state(row["query_block"], one, row["qids"], row["qvectors"])

    now = materialize(asked.mapInArrow(first, _STATE), "topk-state")
    low, many = ahead, ROUND
    while low < len(listed):
        pairs = now.select("query_block", "need").mapInArrow(met(low, low + many), "query_block string, block string")
        pairs = materialize(pairs, "topk-pairs")
        if pairs.isEmpty():
            break  # later blocks are shorter still
        sides = pairs.join(now.select("query_block", "qids", "qvectors", "floors"), "query_block").join(blocks.select("block", "ids", "vectors"), "block")
        found = sides.select("query_block", "qids", "qvectors", "floors", "ids", "vectors").mapInArrow(search, "query_block string, q int, c long, s long")
        found = found.withColumn("r", F.row_number().over(Window.partitionBy("query_block", "q").orderBy(F.desc("s"), "c"))).where(F.col("r") <= k)
        lists = found.groupBy("query_block").agg(F.collect_list(F.struct("q", "c", "s")).alias("found"))  # at most k for each query of a block
        now = materialize(now.join(lists, "query_block", "left").mapInArrow(merged, _STATE), "topk-state")
        low, many = low + many, many * GROWTH
    return now


def search_table(embeddings: DataFrame, *, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows whose identifier is divisible by ``every`` against all rows, by inner product of their quantised vectors."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("_id"), quantised(F.col(vector_col), scale).alias("_vector")).where("_id IS NOT NULL AND _vector IS NOT NULL")
    return top_k(rows, rows.where(F.col("_id") % every == 0), k)
