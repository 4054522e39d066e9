"""An inverted-file index over vectors, with probing and with exact search.

Every vector lies in the cell of its nearest pivot. Angles between vectors are a
metric, so the least and the greatest angle of a cell's members to their pivot bound
how near to a query any of them can be. A search reads a query's nearest cells first;
an exact one goes on with those cells that may still hold a better row, and no others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .links import dedupe_pairs
from .staging import settled
from .vectors import LEAST_COSINE, NEIGHBOURS, sound

#: Rows that pivots are fitted on, rounds of fitting, cells and rows of the sample for each.
FITTED, ROUNDS, MOST_CELLS, FOR_EACH = 20_000, 8, 1024, 16
#: Rows of a cell's part, queries dealt at a time, visits that one task takes from a bin.
PART, ASKED, VISITS = 8192, 256, 1 << 16
#: Rows and components of a bin, scores that a task holds at a time, pairs that leave it at a time.
BIN, COMPONENTS, SCORES, PAIRS = 1 << 16, 1 << 23, 1 << 22, 1 << 16
#: Rows whose neighbours tell how many cells to read, and what rounding may add to an angle.
ASKED_FOR_RECALL, SLACK = 512, 4e-6


@dataclass
class VectorIndex:
    """pivots: a unit row for each cell. rows: cell, bin, node_id, v, angle of every
    sound node, settled. n, low, high: each cell's size and its least and greatest
    angle; bins: the first and the last bin of its parts. A row of these for each cell, at
    most MOST_CELLS, is all that the driver holds. A bin is what a task holds at a time:
    neighbouring cells, or parts of one."""

    pivots: np.ndarray
    rows: DataFrame
    n: np.ndarray
    low: np.ndarray
    high: np.ndarray
    bins: np.ndarray

    def __len__(self) -> int:
        return len(self.pivots)


def _unit_rows(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Rows as unit vectors of `width` components: shorter ones are filled up with zeros, and
    what is beyond counts in the norm alone. A norm of zero counts as 1e-9."""
    lengths = np.diff(vectors.offsets.to_numpy())
    m = np.zeros((len(vectors), max(width, int(lengths.max(initial=1)))))
    m[np.arange(m.shape[1]) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    largest = np.maximum(np.abs(m).max(axis=1, keepdims=True), 1.0)  # so that no square overflows
    norm = np.linalg.norm(m / largest, axis=1, keepdims=True) * largest
    return (m / np.maximum(norm, 1e-9))[:, :width]


def _angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ pivots.T, -1.0, 1.0))


def fit_pivots(nodes: DataFrame, cells: int | None = None, node_id: str = "node_id", vec_col: str = "embedding") -> np.ndarray:
    """Unit pivots, fitted by spherical k-means on at most FITTED rows, those of the least
    hashes. cells: how many at most; by default the square root of the nodes, up to
    MOST_CELLS. Each has FOR_EACH rows of the sample at least, on average."""
    fine = nodes.where(sound(vec_col) & F.col(node_id).isNotNull()).select(node_id, F.col(vec_col).alias("v"))
    width, count = fine.agg(F.max(F.size("v")), F.count("*")).first()
    sample = fine.select("v").orderBy(F.xxhash64(node_id, "v"), "v").limit(FITTED).toArrow().column(0).combine_chunks()
    if not count:
        return np.zeros((0, 1))
    rows = _unit_rows(sample, width)
    k = max(1, min(cells or int(count**0.5), MOST_CELLS, len(rows) // FOR_EACH))
    pivots = rows[:k].copy()
    for _ in range(ROUNDS):
        nearest = np.argmax(rows @ pivots.T, axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, nearest, rows)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        pivots = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), pivots)
    norm = np.linalg.norm(pivots, axis=1, keepdims=True)
    return np.where(norm > 1e-9, pivots / np.maximum(norm, 1e-9), np.eye(1, width))


def build(nodes: DataFrame, pivots: np.ndarray | None = None, node_id: str = "node_id", vec_col: str = "embedding") -> VectorIndex:
    """Index of all sound vectors of nodes; equal vectors share a cell, and a cell, however
    large, is cut into parts of about PART rows."""
    pivots = fit_pivots(nodes, None, node_id, vec_col) if pivots is None else pivots
    kind, vec = nodes.schema[node_id].dataType.simpleString(), nodes.schema[vec_col].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                angles = _angles(_unit_rows(b.column(1), pivots.shape[1]), pivots)
                cell = angles.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(cell)), cell])], names=["node_id", "v", "cell", "angle"])

    placed = settled(nodes.where(sound(vec_col) & F.col(node_id).isNotNull()).select(node_id, vec_col).mapInArrow(assign, f"node_id {kind}, v {vec}, cell int, angle double"))
    n, low, high = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.zeros(len(pivots))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect():  # a row a cell
        n[r.cell], low[r.cell], high[r.cell] = r.n, r.low, r.high
    parts = -(-n // PART)
    first = np.cumsum(parts) - parts
    start = np.cumsum(np.repeat(n / np.maximum(parts, 1), parts))  # rows up to and with each part
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(1, min(BIN, COMPONENTS // pivots.shape[1], -(-int(n.sum()) // max(1, int(tasks**0.5)))))
    bin_of = (np.maximum(start - 1, 0) // most).astype(int)
    bins = np.stack([bin_of[np.minimum(first, len(bin_of) - 1)], bin_of[np.maximum(first + parts - 1, 0)]], axis=1) if len(bin_of) else np.zeros((len(pivots), 2), int)
    cells = nodes.sparkSession.createDataFrame([(c, int(f), int(p)) for c, (f, p) in enumerate(zip(first, parts, strict=True))], "cell int, _first int, _parts int")
    held = nodes.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(bin_of)], "_part int, bin int")
    rows = placed.join(F.broadcast(cells), "cell").withColumn("_part", (F.col("_first") + F.pmod(F.xxhash64("node_id", "v"), F.col("_parts"))).cast("int"))
    return VectorIndex(pivots, settled(rows.join(F.broadcast(held), "_part").drop("_part", "_first", "_parts")), n, low, high, bins)


def _reader(index: VectorIndex, after: int, upto: int):
    """A function of unit rows and their reaches: each row's places of the cells, in the order
    of their pivots' angles, and which it reads: from `after` up to `upto`, those that
    may hold a row within its reach."""
    pivots, low, high, n = index.pivots, index.low, index.high, index.n

    def read(rows: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        angles = _angles(rows, pivots)
        places = np.empty(angles.shape, np.int32)
        np.put_along_axis(places, np.argsort(angles, axis=1, kind="stable"), np.arange(len(pivots), dtype=np.int32)[None, :], axis=1)
        near = np.maximum(angles - high, low - angles) <= reach[:, None] + SLACK
        return places, (places >= after) & (places < upto) & near & (n > 0)

    return read


def _visits(index: VectorIndex, queries: DataFrame, after: int, upto: int) -> DataFrame:
    """query_id, v, reach, home, bin: queries (query_id, v, reach) once at each bin of the cells
    that they read. home, if they have it: bins before it are left out."""
    kind, vec = (queries.schema[c].dataType.simpleString() for c in ("query_id", "v"))
    width, bins, read = index.pivots.shape[1], index.bins, _reader(index, after, upto)
    every = np.arange(int(bins.max(initial=0)) + 1)
    holds = ((bins[:, :1] <= every) & (every <= bins[:, 1:])).astype(np.float32)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, ASKED) for b in batches for at in range(0, b.num_rows, ASKED)):
            _, reads = read(_unit_rows(b.column(1), width), b.column(2).to_numpy(zero_copy_only=False))
            home = b.column(3).to_numpy(zero_copy_only=False)
            q, to = np.nonzero((reads.astype(np.float32) @ holds > 0) & (every >= home[:, None]))
            for at in range(0, len(q), 4 * ASKED):
                cut = slice(at, at + 4 * ASKED)
                own = b.take(pa.array(q[cut]))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(to[cut].astype(np.int32))], names=["query_id", "v", "reach", "home", "bin"])

    home = "home" if "home" in queries.columns else F.lit(-1).alias("home")
    return queries.select("query_id", "v", "reach", home).mapInArrow(visit, f"query_id {kind}, v {vec}, reach double, home int, bin int")


def _scored(index: VectorIndex, queries: DataFrame, after: int, upto: int, k: int | None, least: float | None, skip_same: bool) -> DataFrame:
    """query_id, node_id, similarity, place: each query's (query_id, v, reach) k best rows of each
    bin, of the cells that it reads. Where queries have a home, pairs of that bin are
    listed from their smaller id alone.

    A task holds a bin's rows and reads its queries a few at a time; which cells a query
    reads follows from the pivots there, so it goes to a bin once, however many of
    the bin's cells it reads. Bins that very many queries visit are copied to several tasks.
    """
    visits = _visits(index, queries, after, upto)
    q_kind, n_kind = visits.schema["query_id"].dataType.simpleString(), index.rows.schema["node_id"].dataType.simpleString()
    q_vec, n_vec = (df.schema["v"].dataType.simpleString() for df in (visits, index.rows))
    vec = n_vec if q_vec == n_vec else "array<double>"
    parts = int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked_at = {r.bin: r["n"] for r in visits.groupBy("bin").agg(F.count("*").alias("n")).collect()}  # a row a bin
    groups = visits.sparkSession.createDataFrame([(b, max(-(-parts // len(asked_at)), -(-n // VISITS))) for b, n in asked_at.items()], "bin int, _groups int")
    null = lambda kind: F.lit(None).cast(kind)
    there = index.rows.join(F.broadcast(groups), "bin").select("bin", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)).alias("group"), F.lit(True).alias("node"), "node_id", "cell", null(q_kind).alias("query_id"), null("double").alias("reach"), null("int").alias("home"), F.col("v").cast(vec).alias("v"))
    asked = visits.join(F.broadcast(groups), "bin").select("bin", F.pmod(F.xxhash64("query_id", "v"), F.col("_groups")).cast("int").alias("group"), F.lit(False).alias("node"), null(n_kind).alias("node_id"), null("int").alias("cell"), "query_id", "reach", "home", F.col("v").cast(vec).alias("v"))
    dealt = there.unionByName(asked).repartition(parts, "bin", "group").sortWithinPartitions("bin", "group", F.desc("node"))
    width, read = index.pivots.shape[1], _reader(index, after, upto)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, side = None, [], None
        for b in batches:
            key = np.stack([b.column(i).cast(pa.int32()).to_numpy(zero_copy_only=False) for i in range(3)])
            edges = [0, *(np.nonzero(np.any(key[:, 1:] != key[:, :-1], axis=0))[0] + 1), b.num_rows]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                if tuple(key[:2, low]) != own:
                    own, held, side = tuple(key[:2, low]), [], None
                run = b.slice(low, high - low)
                if key[2, low]:
                    held.append((run.column(3).to_numpy(zero_copy_only=False), run.column(4).to_numpy(zero_copy_only=False), _unit_rows(run.column(8), width)))
                    continue
                if not held:
                    continue
                if side is None:
                    side = [np.concatenate(x) for x in zip(*held, strict=True)]
                    side.append(side[2].astype(np.float32) if least is not None else None)
                step = max(1, SCORES // len(side[0]))
                for at in range(0, run.num_rows, step):
                    q = run.slice(at, step)
                    q_ids, rows = q.column(5).to_numpy(zero_copy_only=False), _unit_rows(q.column(8), width)
                    places, reads = read(rows, q.column(6).to_numpy(zero_copy_only=False))
                    qi, ni, found = _met(rows, q_ids, side, reads, k, least, skip_same)
                    home = q.column(7).to_numpy(zero_copy_only=False)[qi] == own[0]
                    if home.any():
                        mine = np.flatnonzero(~home | (q_ids[qi] < side[0][ni]))
                        qi, ni, found = qi[mine], ni[mine], found[mine]
                    for first in range(0, len(qi), PAIRS):
                        x, y, z = qi[first : first + PAIRS], ni[first : first + PAIRS], found[first : first + PAIRS]
                        yield pa.RecordBatch.from_arrays([pa.array(q_ids[x]), pa.array(side[0][y]), pa.array(np.round(z, 12)), pa.array(places[x, side[1][y]])], names=["query_id", "node_id", "similarity", "place"])

    found = dealt.mapInArrow(score, f"query_id {q_kind}, node_id {n_kind}, similarity double, place int")
    return found.where(F.col("similarity") >= least) if least is not None else found


def _met(rows: np.ndarray, q_ids: np.ndarray, side: list, reads: np.ndarray, k: int | None, least: float | None, skip_same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and scores of the pairs of a bin's rows (ids, cells, unit rows, also in single
    precision) that may be among the k best of a query. With `least`, single precision,
    whose error is bounded, tells which pairs are worth an exact score."""
    ids, cells, unit, single = side
    may = slice(None) if reads[:, np.unique(cells)].all() else reads[:, cells]
    if least is not None:
        error = (unit.shape[1] + 4) * 1.2e-7
        keep = rows.astype(np.float32) @ single.T >= np.float32(least - error - 1e-7)
        qi, ni = np.nonzero(keep if isinstance(may, slice) else keep & may)
        if skip_same:
            other = q_ids[qi] != ids[ni]
            qi, ni = qi[other], ni[other]
        s = np.concatenate([np.einsum("ij,ij->i", rows[qi[at : at + PAIRS]], unit[ni[at : at + PAIRS]]) for at in range(0, max(1, len(qi)), PAIRS)])
        good = s >= least - 1e-9
        qi, ni, s = qi[good], ni[good], s[good]
        if k is not None and len(qi):
            order = np.lexsort((-s, qi))
            starts = np.searchsorted(qi, np.arange(len(rows)))  # qi ascends
            ends = np.append(starts[1:], len(qi))
            cut = np.full(len(rows), -np.inf)
            many = ends - starts > k
            cut[many] = s[order][starts[many] + k - 1]
            good = s >= cut[qi] - 1e-9  # sums differ in their last digits: what may tie stays
            qi, ni, s = qi[good], ni[good], s[good]
        return qi, ni, s
    s = rows @ unit.T
    if not isinstance(may, slice):
        s[~may] = -np.inf
    if skip_same:
        s[q_ids[:, None] == ids[None, :]] = -np.inf
    keep = s > -np.inf
    if k is not None and len(ids) > k:
        keep &= s >= np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k][:, None] - 1e-9
    qi, ni = np.nonzero(keep)
    return qi, ni, s[qi, ni]


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "node_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(index: VectorIndex, queries: DataFrame, k: int | None, probes: int, exact: bool = False, least: float | None = None, query_id: str = "query_id", vec_col: str = "embedding", skip_same: bool = False) -> DataFrame:
    """query_id, node_id, similarity, place, rank: each query's k most similar nodes among its
    `probes` nearest cells, ties to the smaller id; with `least`, none less similar.
    place: the number, from 0, of the node's cell among the query's cells.

    exact: then the cells are read that may hold a row as similar as the k-th so far, so
    that the result is that of vectors.best_matches(). k None: all rows that reach
    `least`, from all cells that may hold one, without rank; exact as well. Query ids
    are distinct. Null ids and vectors that are not sound take no part.
    """
    asked = queries.where(sound(vec_col) & F.col(query_id).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(vec_col).alias("v"))
    reach = F.lit(float(np.arccos(np.clip(-1.0 if least is None else least, -1.0, 1.0))))
    if k is None:
        return _scored(index, asked.withColumn("reach", reach), 0, len(index), None, least, skip_same)
    found = _best(_scored(index, asked.withColumn("reach", reach), 0, probes, k, least, skip_same), k)
    if not exact:
        return found
    first = settled(found)
    last = first.where(F.col("rank") == k).select("query_id", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "similarity"))).alias("_last"))
    open_ones = settled(asked.join(last, "query_id", "left").select("query_id", "v", F.least(reach, F.coalesce("_last", reach)).alias("reach")))
    rest = _scored(index, open_ones, probes, len(index), k, least, skip_same)
    return _best(first.drop("rank").unionByName(rest), k)


def probes_for(index: VectorIndex, recall: float = 0.95, k: int = 10) -> int:
    """Cells that a query must read so that it finds the share `recall` of its k best rows:
    measured by an exact search for ASKED_FOR_RECALL of the indexed rows, whose
    neighbours' places tell the recall for every number of cells at once."""
    asked = index.rows.select(F.col("node_id").alias("query_id"), F.col("v").alias("embedding")).orderBy(F.xxhash64(F.lit(1), "node_id"), "node_id").limit(ASKED_FOR_RECALL)
    found = search(index, settled(asked), k, max(1, len(index) // 8), exact=True, skip_same=True)
    at = sorted((r.place, r.n) for r in found.groupBy("place").agg(F.count("*").alias("n")).collect())  # a row a place
    total, seen = sum(n for _, n in at), 0
    for place, n in at:
        seen += n
        if seen >= recall * total:
            return place + 1
    return max(1, len(index))


def knn_candidates(index: VectorIndex, k: int = NEIGHBOURS, least: float = LEAST_COSINE, probes: int = 1) -> DataFrame:
    """source_id < target_id, score: vectors.knn_candidates() from the index, exact."""
    asked = index.rows.select(F.col("node_id").alias("query_id"), F.col("v").alias("embedding"))
    return dedupe_pairs(search(index, asked, k, probes, exact=True, least=least, skip_same=True), "query_id", "node_id", "similarity")


def similar_pairs(index: VectorIndex, least: float) -> DataFrame:
    """a < b, similarity of all pairs with a cosine of `least`, from cells that may hold one; each two bins meet once."""
    reach = F.lit(float(np.arccos(np.clip(least, -1.0, 1.0))))
    asked = index.rows.select(F.col("node_id").alias("query_id"), "v", reach.alias("reach"), F.col("bin").alias("home"))
    found = _scored(index, asked, 0, len(index), None, least, True)
    return found.select(F.least("query_id", "node_id").alias("a"), F.greatest("query_id", "node_id").alias("b"), "similarity")
