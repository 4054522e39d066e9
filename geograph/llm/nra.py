"""Exact top-k search by no-random-access aggregation.

Vectors are packed into blocks, those of large norm first. A block holds a posting
list (value, row) for each dimension, sorted by value. A block of queries reads the
lists in order: those with a positive weight from the top, those with a negative one
from the bottom, a share of the lists' useful parts at a time. What has been read
bounds every row's score: unread entries lie between the reading point and the far
end. A query stops once few rows can still reach the k-th best score known, which
is carried from block to block; the scores of those rows are resolved by reading on
for them alone. A query that the bounds do not stop reads the lists to their ends.
Each task's best k meet in a window at the end.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_partitions, stage_table

#: Rows in a block of candidates and of queries, and blocks of candidates that a task reads in turn.
CANDIDATES, QUERIES, RUN = 4096, 128, 8
#: Shares of the lists' useful parts (entries that raise a score) read before bounds are compared.
SHARES = (0, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 1)
#: Entries of a list that are added in one go.
SLICE = 1024
#: A query stops once at most so many times k rows are left.
FEW = 4
LONG = (1 << 63) - 1


def fine_vectors(embeddings: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (double components) of the vectors without null or non-finite components."""
    double = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    sound = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return embeddings.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), double.alias("v"))


def pack(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """Blocks of at most `size` rows, as they come in each task: block, dim, kind, ids and m
    (row-major; scaled, or for huge components as they are, of kind 'x')."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        vectors: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal at
            dim = max(map(len, vectors))
            m = np.zeros((len(vectors), dim))
            for i, v in enumerate(vectors):
                m[i, : len(v)] = v
            with np.errstate(over="ignore"):
                whole = np.floor(m * float(scale))
            kind = next((c for c in "bhi" if np.abs(whole).max(initial=0) <= np.iinfo(c).max), "d" if np.abs(whole).max() < 1 << 53 else "x")
            raw = (m if kind == "x" else whole.astype(kind)).tobytes()
            at += 1
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([dim], pa.int32()), pa.array([kind]), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([raw], pa.binary())], names=["block", "dim", "kind", "ids", "m"])

        for b in batches:
            for i, v in zip(b.column("id").to_pylist(), b.column("v"), strict=True):
                ids.append(i)
                vectors.append(v.values.to_numpy(zero_copy_only=False))
                if len(ids) == size:
                    yield flush()
                    ids, vectors = [], []
        if ids:
            yield flush()

    return rows.select("id", "v").mapInArrow(blocks, "block long, dim int, kind string, ids binary, m binary")


def unpack(raw: bytes, kind: str, dim: int, width: int, scale: int) -> np.ndarray:
    """A block's matrix, filled up to `width`: of the packed type, or of Python's integers where components are huge."""
    m = np.frombuffer(raw, float if kind == "x" else kind).reshape(-1, dim)
    if kind == "x":
        whole = [math.floor(y) if math.isfinite(y := x * float(scale)) else int(x) * scale for x in m.ravel().tolist()]
        m = np.array(whole, object).reshape(m.shape)
    return np.pad(m, ((0, 0), (0, width - dim)))


def exact_kind(x: np.ndarray, q: np.ndarray) -> type:
    """A type in which all sums of products are exact."""
    if x.dtype == object or q.dtype == object:
        return object
    norm = lambda m: float(np.sqrt((m.astype(float) ** 2).sum(1).max(initial=0))) + 1
    if norm(x) * norm(q) < 1 << 15:  # no sum of some products is larger
        return np.int16
    bound = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    return np.float32 if bound < 1 << 23 else np.float64 if bound < 1 << 52 else object


def _as(a: np.ndarray, kind: type) -> np.ndarray:
    if kind is not object:
        return a.astype(kind)
    return np.array([int(x) for x in a.ravel().tolist()], object).reshape(a.shape)


@dataclass
class Lists:
    """Posting lists of a block (dimension, place): rows and values by falling value."""

    ids: np.ndarray
    rows: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, m: np.ndarray) -> Lists:
        rows = np.argsort(-(m.T.astype(float) if m.dtype != object else m.T), axis=1, kind="stable")
        return cls(ids, rows, np.take_along_axis(m.T, rows, axis=1))


def read_lists(block: Lists, q: np.ndarray, k: int, least: np.ndarray | None = None, barred: np.ndarray | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """(for each query: rows and exact scores of those that may be among its k best; entries read).

    least: a score for each query that its answers must reach. barred (row, query):
    rows that are no answer. Rows that tie with the k-th are all there.
    """
    n, dims, asked = len(block.ids), len(block.rows), len(q)
    kind = exact_kind(block.values.T, q)
    q, values = _as(q, kind), _as(block.values, kind)
    zero = q.dtype.type(0) if kind is not object else 0
    plus, minus = np.ascontiguousarray(np.maximum(q, zero).T), np.ascontiguousarray(np.minimum(q, zero).T)  # (dimension, query)
    never = -(1 << 4200) if kind is object else -np.inf  # lower than any score
    wide = object if kind is object else float  # for sums over entries of different rows
    least = np.full(asked, -np.inf) if least is None else least.copy()
    first = least == -np.inf  # no answers known yet: lower bounds in this block give a score that the k-th reaches
    up, down = (values > 0).sum(1), (values < 0).sum(1)
    top, bottom = np.zeros(dims, int), np.zeros(dims, int)  # entries read from either end of each list
    floor = (np.minimum(plus * values[:, -1:], zero) + np.minimum(minus * values[:, :1], zero)).sum(0, dtype=wide)  # the least that unread entries add
    score = np.full((n, asked), zero, kind)
    out: list = [(np.zeros(0, np.int64), np.zeros(0, kind))] * asked
    live, entries = np.arange(asked), 0

    def read(to_top: np.ndarray, to_bottom: np.ndarray) -> None:
        nonlocal entries
        sums, parts = np.empty((2, SLICE, len(live)), kind)
        for d in range(dims):
            for low, high, weight in ((top[d], to_top[d], plus[d]), (n - to_bottom[d], n - bottom[d], minus[d])):
                entries += int(high - low) * int(np.count_nonzero(weight))
                for at in range(low, high, SLICE):  # a row is in a list once, so no sum is lost
                    rows = block.rows[d, at : min(high, at + SLICE)]
                    some = sums[: len(rows)]
                    np.take(score, rows, axis=0, out=some, mode="clip")
                    some += np.multiply(values[d, at : at + len(rows), None], weight, out=parts[: len(rows)])
                    score[rows] = some
        top[:], bottom[:] = to_top, to_bottom

    def resolve(i: int, rows: np.ndarray) -> np.ndarray:
        """Scores of some rows: the unread entries that belong to them are added."""
        nonlocal entries
        wanted = np.zeros(n, bool)
        wanted[rows] = True
        d, at = np.nonzero(wanted[block.rows])
        unread = np.where(plus[d, i] > 0, at >= top[d], at < n - bottom[d])
        d, at = d[unread], at[unread]
        entries += len(d)
        total = score[:, i].copy()
        np.add.at(total, block.rows[d, at], values[d, at] * (plus[d, i] + minus[d, i]))
        return total[rows]

    for share in SHARES:
        read(np.ceil(up * share).astype(int), np.ceil(down * share).astype(int))
        lists = np.arange(dims)
        front = np.where(top < up, values[lists, np.minimum(top, n - 1)], zero)
        back = np.where(bottom < down, values[lists, np.maximum(n - 1 - bottom, 0)], zero)
        slack = (plus * front[:, None] + minus * back[:, None]).sum(0, dtype=wide)  # the most that unread entries add
        new = np.flatnonzero(first[live])
        if n > k and len(new) and share:
            known = score[:, new] if barred is None else np.where(barred[:, live[new]], never, score[:, new])
            kth = np.sort(known, axis=0)[n - k] if kind is object else np.partition(known, n - k, axis=0)[n - k]
            least[live[new]] = np.maximum(least[live[new]], kth + floor[new])
        can = np.asarray(score + slack >= least[live] if kind is object else score >= least[live] - slack, bool)
        if barred is not None:
            can &= ~barred[:, live]
        few = can.sum(0) <= FEW * k
        for i in np.flatnonzero(few):
            rows = np.flatnonzero(can[:, i])
            out[live[i]] = rows, resolve(i, rows)
        if few.any():
            live, score, plus, minus, floor = live[~few], np.ascontiguousarray(score[:, ~few]), plus[:, ~few], minus[:, ~few], floor[~few]
        if not len(live):
            return out, entries
    read(np.full(dims, n), np.full(dims, n))
    for i, own in enumerate(live):
        fit = np.ones(n, bool) if barred is None else ~barred[:, own]
        known = score[fit, i]
        if len(known) > k:  # all scores are whole now: the k-th best of them cuts
            kth = np.sort(known)[len(known) - k] if kind is object else np.partition(known, len(known) - k)[len(known) - k]
            least[own] = max(least[own], kth)
        can = fit & np.asarray(score[:, i] >= least[own], bool)
        rows = np.flatnonzero(can)
        out[own] = rows, score[rows, i]
    return out, entries


def order_key(x: int) -> bytes:
    """Bytes that sort as the integers do."""
    size = (abs(x).bit_length() + 7) // 8
    if x >= 0:
        return b"\1" + size.to_bytes(2, "big") + x.to_bytes(size, "big")
    return b"\0" + (65535 - size).to_bytes(2, "big") + ((1 << 8 * size) - 1 + x).to_bytes(size, "big")


def top_k(embeddings: DataFrame, k: int = 20, scale: int = 64, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest inner products, ties to the smaller id.

    Queries are the rows whose id is divisible by `every`; a row never answers a
    query of its own id. Vectors that are null or hold null or non-finite
    components, and rows without id, take no part; shorter vectors count as filled
    up with zeros. Scores of any size are compared exactly; the column holds the
    nearest long. A repeated row answers once for each time it stands in the table;
    a repeated query is answered once. Fewer rows than k give all. An empty table
    gives none; other columns are not read.
    """
    spark = embeddings.sparkSession
    rows = fine_vectors(embeddings, id_col, vec_col)
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    ranged = rows.withColumn("norm", norm).repartitionByRange(shuffle_partitions(spark), F.desc("norm")).sortWithinPartitions(F.desc("norm"), "id")
    candidates = stage_table(pack(ranged, CANDIDATES, scale), "candidates")
    runs = max(1, -(-candidates.count() // RUN))
    asked = rows.where(F.col("id") % every == 0).dropDuplicates()
    asked = stage_table(pack(asked, QUERIES, scale), "queries").select(F.col("block").alias("asked"), *[F.col(c).alias(f"q{c}") for c in ("dim", "kind", "ids", "m")], F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    pairs = candidates.withColumn("run", F.pmod(F.xxhash64("block"), F.lit(runs)).cast("int")).join(asked.hint("shuffle_hash"), "run")
    dealt = pairs.repartition(shuffle_partitions(spark), "asked", "run").sortWithinPartitions("asked", "run", "block").select("asked", "run", "block", "dim", "kind", "ids", "m", "qdim", "qkind", "qids", "qm")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, qids, qm, best = None, None, None, []
        opened: dict[tuple[int, int], Lists] = {}  # a run's blocks, which the next queries read again

        def answers() -> pa.RecordBatch:
            out = []
            for i, (own, found) in enumerate(zip(qids.tolist(), best, strict=True)):
                name = int.from_bytes(hashlib.blake2b(repr(qm[i].tolist()).encode(), digest_size=8).digest(), "little", signed=True)
                for x, v in found:
                    held = max(-LONG - 1, min(LONG, x))
                    out.append((own, name, v, held, order_key(x) if abs(x) >= LONG else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], names=["query_id", "query", "vec_id", "score", "beyond"])

        for b in batches:
            for of, run, block, dim, kind, ids, m, qdim, qkind, q_ids, q_m in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (of, run) != group:
                    if group is not None:
                        yield answers()
                    group, qids, qm = (of, run), np.frombuffer(q_ids, np.int64), unpack(q_m, qkind, qdim, qdim, scale)
                    best = [[] for _ in qids]
                width = max(dim, qdim)
                lists = opened.get((block, width))
                if lists is None:
                    if len(opened) >= RUN:
                        opened.clear()
                    lists = opened[block, width] = Lists.of(np.frombuffer(ids, np.int64), unpack(m, kind, dim, width, scale))
                q = np.pad(qm, ((0, 0), (0, width - qdim)))
                huge = q.dtype == object or lists.values.dtype == object
                least = np.array([own[-1][0] if len(own) == k else -np.inf for own in best], object if huge else float)
                barred = lists.ids[:, None] == qids[None, :]
                answered, _ = read_lists(lists, q, k, least, barred if barred.any() else None)
                for i, (found, score) in enumerate(answered):
                    merged = best[i] + [(int(s), int(v)) for s, v in zip(score.tolist(), lists.ids[found].tolist(), strict=True)]
                    best[i] = sorted(merged, key=lambda r: (-r[0], r[1]))[:k]
        if group is not None:
            yield answers()

    found = dealt.mapInArrow(search, "query_id long, query long, vec_id long, score long, beyond binary")
    up, down = F.when(F.col("score") > 0, F.col("beyond")), F.when(F.col("score") < 0, F.col("beyond"))
    w = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), F.desc_nulls_last(up), F.desc_nulls_last(down), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
