"""Exact Jaccard join of documents' shingle sets in their metric space.

The distance 1 - Jaccard obeys the triangle inequality. Pivots cut the space into
regions, twice:

* First, each shingle s is a pivot, the set {s}, rare ones first. A document's
  region is that of its first pivot. A document within the distance e misses few of
  its shingles, so its region is among the first few pivots of the document; into
  those regions, its window, the document is replicated, and into no other. (This
  is a prefix filter. With documents as pivots of all sets, nearly every document
  falls into every window, since unlike documents are all about 1 apart.)
* Regions whose documents may be within e (as small count vectors, another lower
  bound of the distance, tell) make clusters. In a cluster documents are pivots:
  each document goes to the region of its nearest pivot and, if its distance to
  another is at most 2 e more, to that one's. Regions join recursively, with whole
  sets, so that links are exact. A region whose documents are all connected already
  needs no further join. Clusters that fit a task are joined in it; larger ones in
  rounds of Spark jobs, in which members, dealt in blocks, meet their region's
  pivots, until each region fits a task or is connected. A region that windows do
  not make smaller is joined block by block, but only between members that are not
  connected yet.

Only distinct sets take part; copies share their set's row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import shuffle_partitions, stage_table
from .texthash import LOWER, U, mix, shingle_hashes, text_bytes, word_hashes

#: Shingle counts are kept for 2**RARITY_BITS classes of hashes: 2 MB, whatever the input.
RARITY_BITS = 18
#: A document of n shingles has a count vector of about n / 8 bytes, 32 at least.
PER_COUNT, LEAST_COUNTS = 8, 32
#: Members of a first region that a task holds to see whether another region has the same.
REGION_ROWS = 1 << 20
#: Document pivots of a region, and members up to which all are compared.
PIVOTS, LEAF = 16, 24
#: Members, and their shingles, of a cluster or region that a task joins in memory, and of a block of a larger one.
LARGE, LARGE_SHINGLES, BLOCK = 1024, 1 << 22, 256
#: Rows up to which a table of large regions is broadcast.
FEW = 100_000
#: A class of shingles with over 1 / HOT of all is hot; rows of its pivots are dealt to SALTS tasks.
HOT, SALTS = 20_000, 64
_CHUNKS = 16


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(LOWER[text_bytes(text)]), width))


def prefix_length(n: int, percent: int) -> int:
    """A linked document has at least percent % of n shingles in common, so it has one of the first so many."""
    return n - -(-n * percent // 100) + 1 if n else 0


def count_vector(shingles: np.ndarray) -> np.ndarray:
    size = LEAST_COUNTS
    while size * PER_COUNT < len(shingles):
        size *= 2
    return np.minimum(np.bincount((shingles & U(size - 1)).astype(np.int64), minlength=size), 255).astype(np.uint8)


def _folded(v: np.ndarray, size: int) -> np.ndarray:
    return v.reshape(-1, size).sum(0, dtype=np.int32) if len(v) > size else v.astype(np.int32)


class Forest:
    """Union-find over a few members in a task."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return int(i)

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)
        return a != b

    def roots(self, members: np.ndarray) -> np.ndarray:
        return np.array([self.find(int(i)) for i in members])


def link_all(members: np.ndarray, forest: Forest, near) -> list[tuple[int, int]]:
    """Join all members that are near each other, and return the pairs that joined.

    near(p, others) -> those of the others that are near p. Every member is compared
    with all, unless it is already connected with all that have not been compared.
    """
    joined, todo = [], members
    while len(todo) > 1:
        roots = forest.roots(todo)
        if (roots == roots[0]).all():
            break
        values, counts = np.unique(roots, return_counts=True)
        p = int(todo[np.flatnonzero(roots != values[counts.argmax()])[0]])
        todo = todo[todo != p]
        for x in near(p, todo):
            if forest.join(p, int(x)):
                joined.append((p, int(x)))
    return joined


class Sets:
    """Shingle sets of a cluster, with distances from one to many."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.size = np.array([len(s) for s in sets])
        self.percent = percent
        self.e = 1 - percent / 100
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.start = np.r_[0, np.cumsum(self.size)]
        self.ids = ids
        self.mark = np.zeros(ids.max() + 1, bool)

    def common(self, p: int, others: np.ndarray) -> np.ndarray:
        own = self.ids[self.start[p] : self.start[p + 1]]
        self.mark[own] = True
        sizes = self.size[others]
        first = np.r_[0, np.cumsum(sizes)[:-1]]
        at = np.arange(sizes.sum()) + np.repeat(self.start[others] - first, sizes)
        out = np.add.reduceat(self.mark[self.ids[at]].astype(np.int64), first)
        self.mark[own] = False
        return out

    def linked(self, p: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact links of p to the others, and the distances."""
        both = self.common(p, others)
        union = self.size[p] + self.size[others] - both
        return 100 * both >= self.percent * union, 1 - both / union

    def near(self, p: int, others: np.ndarray) -> np.ndarray:
        fits = (100 * self.size[others] >= self.percent * self.size[p]) & (100 * self.size[p] >= self.percent * self.size[others])
        others = others[fits]
        return others[self.linked(p, others)[0]] if len(others) else others

    def join(self, members: np.ndarray, forest: Forest) -> None:
        """Join all linked members of a region, exactly."""
        roots = forest.roots(members)
        if (roots == roots[0]).all():
            return
        if len(members) <= LEAF:
            link_all(members, forest, self.near)
            return
        pivots = members[np.linspace(0, len(members) - 1, PIVOTS).astype(int)]
        distance = np.empty((len(pivots), len(members)))
        for k, p in enumerate(pivots):
            links, distance[k] = self.linked(int(p), members)
            for x in members[links]:
                forest.join(int(p), int(x))
        nearest = distance.min(0)
        # a document of another region is within e of one of this only if it is at most 2 e farther from this pivot than from its own
        regions = [members[row <= nearest + 2 * self.e + 1e-9] for row in distance if (row == nearest).any()]
        if 2 * sum(len(r) ** 2 for r in regions) > len(members) ** 2:  # windows as wide as the region: compare as it is
            link_all(members, forest, self.near)
            return
        for region in regions:
            self.join(region, forest)


def _complete(batches: Iterator[pa.RecordBatch], key: str, most: int | None = None) -> Iterator[tuple[pa.Table, bool]]:
    """Sorted rows in pieces that end where a key ends; with `most`, a key of more
    rows is handed on in parts, which are marked."""
    held, parted = None, None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        if parted is not None:
            n = int(np.searchsorted(t.column(key).to_numpy(), parted, "right"))
            if n:
                yield t.slice(0, n).combine_chunks(), True
            t = t.slice(n)
            if not t.num_rows:
                continue
            parted = None
        t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t.combine_chunks()
        keys = t.column(key).to_numpy()
        n = int(np.searchsorted(keys, keys[-1], "left"))
        if n:
            yield t.slice(0, n).combine_chunks(), False
        held = t.slice(n)
        if most and held.num_rows > most:
            yield held.combine_chunks(), True
            parted, held = int(keys[-1]), None
    if held is not None and held.num_rows:
        yield held.combine_chunks(), False


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool]]:
    """Rows of first regions, of ordinary pivots in whole regions; of hot ones as they come, marked as parts."""
    hot: list[pa.Table] = []

    def ordinary() -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = pc.greater_equal(b.column("salt"), 0)
            if pc.any(some).as_py():
                hot.append(pa.Table.from_batches([b.filter(some)]))
                b = b.filter(pc.invert(some))
            yield b

    for found in _complete(ordinary(), "pivot", REGION_ROWS):
        while hot:
            yield hot.pop(), True
        yield found
    while hot:
        yield hot.pop(), True


def _bounds(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])


def describe(keyed: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """(sets, rarity). sets: id, h1, sid (fingerprint of the set), n, counts for each
    document, staged. rarity: how many shingles fall to each class of hashes; the
    tasks' counts are summed in tasks, and the 2**RARITY_BITS sums go to the driver."""
    id_type = keyed.schema["id"].dataType
    schema = T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("id", id_type), *(T.StructField(n, t) for n, t in (("h1", T.LongType()), ("sid", T.LongType()), ("n", T.LongType()), ("counts", T.BinaryType())))])
    size = 1 << RARITY_BITS

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros(size, np.int64), set()
        id_field = None
        for b in batches:
            id_field = b.schema.field("id")
            sids, n, counts, new = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), [], []
            for i, text in enumerate(b.column("text")):
                s = shingle_set(text.as_py(), width)
                sids[i] = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
                n[i] = len(s)
                counts.append(count_vector(s).tobytes())
                if int(sids[i]) not in met:
                    met.add(int(sids[i]))
                    new.append(s)
            total += np.bincount((np.concatenate([np.zeros(0, np.uint64), *new]) >> U(64 - RARITY_BITS)).astype(np.int64), minlength=size)
            yield pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int32()), b.column("id"), b.column("h1"), pa.array(sids), pa.array(n), pa.array(counts, pa.binary())], names=schema.names)
        if id_field is not None:
            none = [pa.nulls(_CHUNKS, t) for t in (id_field.type, pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(_CHUNKS, dtype=np.int32)), *none, pa.array([x.tobytes() for x in np.split(total, _CHUNKS)], pa.binary())], names=schema.names)

    staged = stage_table(keyed.select("id", "h1", "text").mapInArrow(scan, schema), "sets")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["chunk", "counts"])

    parts = staged.where("chunk is not null").select("chunk", "counts").repartition(_CHUNKS, "chunk").mapInArrow(add, "chunk int, counts binary").collect()  # _CHUNKS rows
    rarity = np.zeros((_CHUNKS, size // _CHUNKS), np.int64)
    for r in parts:
        rarity[r.chunk] = np.frombuffer(r.counts, np.int64)
    return staged.where("chunk is null").drop("chunk"), rarity.ravel()


def first_regions(keyed: DataFrame, rarity: np.ndarray, width: int, percent: int) -> DataFrame:
    """region, sid: the sets of each pivot's region and window, of regions with several
    sets; regions with the same sets become one."""
    spark = keyed.sparkSession
    table = spark.sparkContext.broadcast(np.minimum(rarity, (1 << 24) - 1).astype(np.uint64))  # 2**RARITY_BITS numbers
    most = max(1, int(rarity.sum()) // HOT)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for b in batches:
            pivots, sids, hot = [], [], []
            for text in b.column(0):
                s = shingle_set(text.as_py(), width)
                sid = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
                if not len(s) or sid in met:
                    continue
                met.add(sid)
                k = prefix_length(len(s), percent)
                count = table.value[(s >> U(64 - RARITY_BITS)).astype(np.int64)]
                first = np.argpartition((count << U(40)) | (s >> U(24)), k - 1)[:k]
                pivots.append(s[first])
                sids.append(np.full(k, sid))
                hot.append(count[first] > most)
            if pivots:
                sid, hot = np.concatenate(sids), np.concatenate(hot)
                salt = np.where(hot, sid % SALTS, -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(pivots).view(np.int64)), pa.array(sid), pa.array(salt)], names=["pivot", "sid", "salt"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, parted in _parts(batches):
            pivot, sid = t.column("pivot").to_numpy(), t.column("sid").to_numpy()
            new = np.r_[True, (pivot[1:] != pivot[:-1]) | (sid[1:] != sid[:-1])]
            pivot, sid = pivot[new], sid[new]
            if parted:  # a region too large to be held: its pivot names it
                yield pa.RecordBatch.from_arrays([pa.array(pivot), pa.array(sid)], names=["region", "sid"])
                continue
            at = _bounds(pivot)
            sizes = np.diff(at)
            names = np.add.reduceat(mix(sid.astype(np.uint64)), at[:-1])
            several = np.repeat(sizes > 1, sizes)
            if several.any():
                rows = np.unique(np.stack([np.repeat(names, sizes)[several].view(np.int64), sid[several]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, 0])), pa.array(np.ascontiguousarray(rows[:, 1]))], names=["region", "sid"])

    rows = keyed.select("text").mapInArrow(replicate, "pivot long, sid long, salt int")
    ordered = rows.repartition(shuffle_partitions(spark), "pivot", "salt").sortWithinPartitions("pivot", "sid")
    return stage_table(ordered.mapInArrow(gather, "region long, sid long").distinct(), "regions")


def few(staged: DataFrame) -> DataFrame:
    """A staged table of large regions, to be broadcast if it has FEW rows at most. Else it is
    merged; large regions' rows are then split where they are skewed."""
    return F.broadcast(staged) if staged.limit(FEW + 1).count() <= FEW else staged.hint("merge")


def may_link(regions: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs that connect the sets of each region whose count vectors allow a link.

    In a region of over LARGE sets, all sets of like size are connected instead; the
    join of whole sets tells them apart.
    """
    spark = regions.sparkSession
    vectors = sets.where("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.first("counts").alias("counts"))
    large = few(stage_table(regions.groupBy("region").agg(F.count("*").alias("members")).where(F.col("members") > LARGE).select("region"), "large"))
    rows = regions.join(large, "region", "left_anti").join(vectors, "sid").repartition(shuffle_partitions(spark), "region").sortWithinPartitions("region", "n", "sid").select("region", "sid", "n", "counts")
    many = regions.join(large, "region", "left_semi").join(vectors.select("sid", "n"), "sid")
    band = F.floor(F.log("n") / float(np.log(100 / percent) * 1.0001)).cast("long") if percent < 100 else F.col("n")
    like = stage_table(many.select("region", "sid", F.explode(F.array(band, band + 1)).alias("band")), "like")
    least = few(stage_table(like.groupBy("region", "band").agg(F.min("sid").alias("a")), "stars"))
    stars = like.join(least, ["region", "band"]).where("a <> sid").select("a", F.col("sid").alias("b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in _complete(batches, "region"):
            sid, n, at = t.column("sid").to_numpy(), t.column("n").to_numpy(), _bounds(t.column("region").to_numpy())
            raw = t.column("counts").to_pylist()
            a, b = [], []
            for low, high in zip(at[:-1], at[1:], strict=True):
                vectors = [np.frombuffer(x, np.uint8) for x in raw[low:high]]
                sizes = n[low:high]  # ascending
                folded: dict[int, np.ndarray] = {}

                def near(p: int, others: np.ndarray, vectors=vectors, sizes=sizes, folded=folded) -> np.ndarray:
                    fits = others[(100 * sizes[others] >= percent * sizes[p]) & (100 * sizes[p] >= percent * sizes[others])]
                    if not len(fits):
                        return fits
                    width = min(len(vectors[p]), len(vectors[int(fits[0])]))  # of the smallest set
                    if width not in folded:
                        folded[width] = np.array([_folded(v, width) if len(v) >= width else np.zeros(width, np.int32) for v in vectors])
                    m = folded[width]
                    least = np.abs(m[fits] - m[p]).sum(1)
                    return fits[least * (100 + percent) <= (sizes[fits] + sizes[p]) * (100 - percent)]

                forest = Forest(high - low)
                for x, y in link_all(np.arange(high - low), forest, near):
                    a.append(sid[low + x])
                    b.append(sid[low + y])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return stage_table(rows.mapInArrow(compare, "a long, b long").unionByName(stars).distinct(), "pairs")


def connected(pairs: DataFrame) -> DataFrame:
    """node, root: the least node of each component of the pairs (a, b).

    Labels go to neighbours and are then followed one step further, so that rounds
    grow with the logarithm of a component's width. Each round is staged.
    """
    both = stage_table(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = stage_table(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("heard"))
        told = labels.join(heard, labels.node == heard.a).select("node", "root", F.least("root", "heard").alias("next"))
        target = labels.select(F.col("node").alias("at"), F.col("root").alias("further"))
        moved = stage_table(told.join(target, told.next == target.at, "left").select("node", F.least("next", F.coalesce("further", "next")).alias("root"), (F.col("root") != F.least("next", F.coalesce("further", "next"))).alias("moved")), "labels")
        labels = moved.select("node", "root")
        if not moved.where("moved").limit(1).count():
            return labels


MEMBER = "region long, sid long, label long, shingles binary"


def join_small(members: DataFrame, percent: int) -> DataFrame:
    """a, b: links that connect the linked sets of each region (MEMBER rows). Sets of one label are connected already."""
    spark = members.sparkSession
    ordered = members.repartition(shuffle_partitions(spark), "region").sortWithinPartitions("region", "sid").select("region", "sid", "label", "shingles")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in _complete(batches, "region"):
            at = _bounds(t.column("region").to_numpy())
            sid, label = t.column("sid").to_numpy(), t.column("label").to_numpy()
            a, b = [], []
            for low, high in zip(at[:-1], at[1:], strict=True):
                own, first = np.unique(sid[low:high], return_index=True)
                forest = Forest(len(own))
                _, of = np.unique(label[low:high][first], return_inverse=True)
                _, one = np.unique(of, return_index=True)
                for i, j in enumerate(of):
                    forest.join(int(one[j]), i)
                before = forest.roots(np.arange(len(own)))
                if len(own) > 1:
                    Sets([np.frombuffer(t.column("shingles")[int(low + i)].as_py(), np.uint64) for i in first], percent).join(np.arange(len(own)), forest)
                after = forest.roots(np.arange(len(own)))
                new = before != after
                a.append(own[after[new]])
                b.append(own[before[new]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return ordered.mapInArrow(join, "a long, b long")


def _blocks(members: str, shingles: str) -> Column:
    """Blocks that a region's members are dealt to."""
    return F.greatest(F.ceil(F.col(members) / BLOCK), F.ceil(F.col(shingles) / (LARGE_SHINGLES // 4))).cast("long")


def meet_pivots(members: DataFrame, sizes: DataFrame, seed: int, percent: int) -> DataFrame:
    """One round for large regions, staged: link (a pivot, a member that it links with), or
    the member's windows (parent, regions). Members are dealt in blocks, each of which
    gets the region's PIVOTS pivots."""
    spark = members.sparkSession
    dealt = members.join(few(sizes), "region").withColumn("blocks", _blocks("members", "shingles_in"))
    nth = F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("sid", F.lit(seed)), "sid"))
    chosen = stage_table(dealt.select("region", "sid", "blocks").withColumn("nth", nth).where(F.col("nth") <= PIVOTS).drop("nth"), "pivots")
    pivots = members.select("region", "sid", "shingles").join(few(chosen), ["region", "sid"]).select("region", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), "sid", "shingles")
    own = dealt.select("region", F.pmod(F.xxhash64("sid"), F.col("blocks")).alias("block"), F.lit(1).alias("kind"), "sid", "shingles")
    ordered = pivots.unionByName(own).repartition(shuffle_partitions(spark), "region", "block").sortWithinPartitions("region", "block", "kind", "sid").select("region", "block", "kind", "sid", "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, names, sets, known = None, [], [], None
        for b in batches:
            out = []
            for region, block, kind, sid, raw in zip(*b.columns, strict=True):
                region, sid, s = region.as_py(), sid.as_py(), np.frombuffer(raw.as_py(), np.uint64)
                if (region, block.as_py()) != group:
                    group, names, sets, known = (region, block.as_py()), [], [], None
                if not kind.as_py():
                    names.append(sid)
                    sets.append(s)
                    continue
                if known is None:
                    known = np.unique(np.concatenate(sets))
                    has = np.array([np.isin(known, p, assume_unique=True) for p in sets])
                    size = np.array([len(p) for p in sets])
                    joined = Sets(sets, percent)
                    forest = Forest(len(sets))
                    tree = link_all(np.arange(len(sets)), forest, joined.near)
                    root = forest.roots(np.arange(len(sets)))
                at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                both = has[:, at[known[at] == s]].sum(1)
                union = size + len(s) - both
                distance = 1 - both / union
                linked = np.flatnonzero(100 * both >= percent * union)
                if sid in names:  # a pivot: its own part of what connects the pivots
                    out += [(True, names[j], sid, None) for i, j in tree if names[i] == sid]
                elif len(linked):  # one link for all pivots that are connected themselves
                    _, one = np.unique(root[linked], return_index=True)
                    out += [(True, names[i], sid, None) for i in linked[one]]
                # a set of another region is within e of this one only if it is at most 2 e farther from this pivot than from its own
                near = np.array(names, np.int64)[distance <= distance.min() + 2 * (1 - percent / 100) + 1e-9]
                out.append((False, region, sid, mix(mix(np.full(1, region, np.int64).view(np.uint64)) + near.view(np.uint64)).view(np.int64)))
            kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], names=["link", "parent", "sid", "regions"])

    return stage_table(ordered.mapInArrow(compare, "link boolean, parent long, sid long, regions array<long>"), "windows")


def join_blocks(members: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """a, b: links of regions that windows do not make smaller. All members of a region but
    those of its commonest label meet all members, block by block, where labels differ."""
    spark = members.sparkSession
    counts = members.groupBy("region", "label").agg(F.count("*").alias("n"), F.sum(F.length("shingles") / 8).alias("s"))
    main = counts.groupBy("region").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"), F.sum("s").alias("minor_shingles"))
    shape = stage_table(main.join(sizes, "region").select("region", "main", _blocks("members", "shingles_in").alias("blocks"), F.expr("all - most").alias("minor"), "minor_shingles").where("minor > 0").withColumn("minors", _blocks("minor", "minor_shingles")).drop("minor", "minor_shingles"), "shape")
    dealt = members.join(few(shape), "region")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    minor = dealt.where("label <> main").select("region", F.pmod(F.xxhash64("sid", F.lit(1)), F.col("minors")).alias("x"), upto("blocks").alias("y"), F.lit(0).alias("kind"), "sid", "label", "shingles")
    every = dealt.select("region", upto("minors").alias("x"), F.pmod(F.xxhash64("sid"), F.col("blocks")).alias("y"), F.lit(1).alias("kind"), "sid", "label", "shingles")
    ordered = minor.unionByName(every).repartition(shuffle_partitions(spark), "region", "x", "y").sortWithinPartitions("region", "x", "y", "kind", "sid")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asked, sets = None, [], None
        for b in batches:
            out = []
            for region, x, y, kind, sid, label, raw in zip(*b.columns, strict=True):
                s = np.frombuffer(raw.as_py(), np.uint64)
                if (key := (region.as_py(), x.as_py(), y.as_py())) != group:
                    group, asked, sets = key, [], None
                if not kind.as_py():
                    asked.append((sid.as_py(), label.as_py(), s))
                    continue
                if not asked:
                    continue
                if sets is None:
                    sets = np.unique(np.concatenate([q for _, _, q in asked]))
                    ids = np.concatenate([np.searchsorted(sets, q) for _, _, q in asked])
                    size = np.array([len(q) for _, _, q in asked])
                    first, labels = np.cumsum(size) - size, np.array([q[1] for q in asked])
                    mark = np.zeros(len(sets), np.int64)
                at = np.minimum(np.searchsorted(sets, s), len(sets) - 1)
                at = at[sets[at] == s]
                mark[at] = 1
                both = np.add.reduceat(mark[ids], first)
                mark[at] = 0
                linked = (100 * both >= percent * (size + len(s) - both)) & (labels != label.as_py())
                out += [(asked[i][0], sid.as_py()) for i in np.flatnonzero(linked)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(2)], names=["a", "b"])

    return ordered.select("region", "x", "y", "kind", "sid", "label", "shingles").mapInArrow(compare, "a long, b long")


def join_large(members: DataFrame, percent: int) -> DataFrame:
    """a, b: links that connect the linked sets of large clusters (region, sid, shingles;
    staged), in rounds. Each round stages its links, labels and rows."""
    sets = members.select("sid", "shingles")
    held, links, seed = members.withColumn("label", F.col("sid")), None, 0
    while True:
        sizes = held.groupBy("region").agg(F.count("*").alias("members"), F.sum(F.length("shingles") / 8).alias("shingles_in"))
        fits = (F.col("members") <= LARGE) & (F.col("shingles_in") <= LARGE_SHINGLES)
        large = stage_table(sizes.where(~fits), "large")
        new = [join_small(held.join(few(large.select("region")), "region", "left_anti"), percent)]
        more = large.limit(1).count() > 0
        if more:
            seed += 1
            windows = meet_pivots(held, large, seed, percent)
            new.append(windows.where("link").select(F.col("parent").alias("a"), F.col("sid").alias("b")))
        found = stage_table(reduce(DataFrame.unionByName, new).where("a <> b").distinct(), "links")
        links = found if links is None else stage_table(links.unionByName(found), "links")
        if not more:
            return links
        named = lambda df, found: df.join(found, df.sid == found.node, "left").withColumn("label", F.coalesce("root", "sid")).drop("node", "root")
        labels = connected(links)
        spread = stage_table(named(windows.where("not link").select("parent", "sid", "regions"), labels), "spread")
        apart = spread.groupBy("parent").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("parent")
        spread = spread.join(few(stage_table(apart, "apart")), "parent", "left_semi").select("parent", F.explode("regions").alias("region"), "sid", "label")
        of = spread.groupBy("parent", "region").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
        open_ones = stage_table(of.where("low <> high"), "open")  # a region of one label is connected
        work = open_ones.groupBy("parent").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("work"))
        judged = work.join(large.select(F.col("region").alias("parent"), "members", "shingles_in"), "parent").withColumn("stuck", 2 * F.col("work") > F.col("members").cast("double") * F.col("members"))
        judged = stage_table(judged, "judged")
        stuck = stage_table(judged.where("stuck").select(F.col("parent").alias("region"), "members", "shingles_in"), "stuck")
        if stuck.limit(1).count():
            again = named(held.drop("label").join(few(stuck.select("region")), "region", "left_semi"), labels)
            links = stage_table(links.unionByName(join_blocks(stage_table(again, "members"), stuck, percent)).distinct(), "links")
        smaller = stage_table(open_ones.join(judged.where("not stuck").select("parent"), "parent").select("region").distinct(), "smaller")
        if not smaller.limit(1).count():
            return links
        rows = named(spread.drop("label").join(few(smaller), "region", "left_semi").select("region", "sid").distinct(), labels)
        held = stage_table(rows.join(sets, "sid").select("region", "sid", "label", "shingles"), "members")


def exact_groups(keyed: DataFrame, sets: DataFrame, clusters: DataFrame, width: int, percent: int) -> DataFrame:
    """sid, root: sets of each cluster that links connect, found with whole sets."""
    chosen = sets.where("n > 0").groupBy("sid").agg(F.min(F.struct("id", "h1")).alias("doc"), F.first("n").alias("n"))
    named = clusters.join(chosen, clusters.node == chosen.sid).select(F.col("root").alias("region"), "sid", "n", F.col("doc.id").alias("_id"), F.col("doc.h1").alias("_h1"))
    sizes = named.groupBy("region").agg(F.count("*").alias("members"), F.sum("n").alias("shingles_in"))
    large = stage_table(sizes.where((F.col("members") > LARGE) | (F.col("shingles_in") > LARGE_SHINGLES)).select("region"), "clusters")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 256):
                part = b.slice(low, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(1), pa.array([shingle_set(x.as_py(), width).tobytes() for x in part.column(2)], pa.binary())], names=["region", "sid", "label", "shingles"])

    def members(how: str) -> DataFrame:
        wanted = named.join(few(large), "region", how)
        return wanted.join(keyed, wanted._id.eqNullSafe(keyed.id) & (wanted._h1 == keyed.h1)).select("region", "sid", "text").mapInArrow(cut, MEMBER)

    links = stage_table(join_small(members("left_anti"), percent), "links")
    if large.limit(1).count():
        rows = stage_table(members("left_semi").select("region", "sid", "shingles").dropDuplicates(["sid"]), "large")
        links = stage_table(links.unionByName(join_large(rows, percent)), "links")
    return connected(links).select(F.col("node").alias("sid"), "root")


def components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id of each document.

    Words are lower-cased (A-Z) and cut at ASCII white space; a text of fewer than
    `width` words has its whole sequence as its one shingle. Documents link when
    100 * intersection >= percent * union; component_id is the smallest id that
    links reach. Null, empty and blank texts have no shingle and stand alone.
    Repeated rows link; a null id takes the smallest other id of its component, if
    any. Sets and shingles are told apart by 64-bit fingerprints; other columns are
    not read.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h1", F.xxhash64("text"))
    sets, rarity = describe(keyed, width)
    pairs = may_link(first_regions(keyed, rarity, width, percent), sets, percent)
    groups = exact_groups(keyed, sets, connected(pairs), width, percent)
    least = sets.where("n > 0").groupBy("sid").agg(F.min("id").alias("least"))
    rooted = stage_table(least.join(groups, "sid", "left").select("sid", "least", F.coalesce("root", "sid").alias("root")), "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("sid", "component_id")
    own = sets.select("id", "sid", "n").join(named, "sid", "left")
    return own.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the least id, and of equal ids the
    first. A null id comes after all others. Every row is judged by its own text,
    whatever other rows have its id; rows without a shingle stay."""
    columns = docs.columns
    rows = stage_table(docs.select(F.monotonically_increasing_id().alias("row"), *[F.col(c).alias(f"d_{c}") for c in columns]), "rows")
    found = components(rows.select("row", f"d_{text_col}"), width, percent, "row", f"d_{text_col}")
    ranked = found.select("row", "component_id").join(rows.select("row", F.col(f"d_{id_col}").alias("id")), "row")
    kept = ranked.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least")).select(F.col("least.row").alias("row"))
    return rows.join(kept, "row", "left_semi").select(*[F.col(f"d_{c}").alias(c) for c in columns])
