"""Vector code compression by member-resident Lloyd iteration.

Vectors are cut into parts, and each part position has a codebook of its own. The parts
live with the codebook entry they belong to: rows are partitioned by (position, entry,
salt). In each round the owners add up their resident members, the sums move the
entries, and every member is held against the new codebook where it lies; only parts
whose entry changes migrate, in the shuffle that writes the next arrivals. What is
broadcast are the codebooks, `entries` vectors at most.

Components become whole numbers, and all sums and distances are exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_staged, row_keys, shuffle_partitions, stage_table

#: Members of an entry under one salt, at most and about.
MEMBERS = 1 << 12
#: Rows that are held against a codebook at a time.
AT_ONCE = 1 << 12
#: Sums leave the tasks in digits of so many bits, so that no total of theirs outgrows a long.
DIGIT = 40
#: Labels whose sums are broadcast at most, and the keys that each label is dealt to beyond.
LABELS, SALTS = 100_000, 64
LONG = (1 << 63) - 1


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of rows: as doubles if all squared distances are exact as such, else as Python's integers."""
    with np.errstate(over="ignore"):
        v = np.floor(x * float(scale))
    if np.abs(v).max(initial=0) < _small(x.shape[1]):
        return v
    exact = lambda y: math.floor(y * scale) if math.isfinite(y * scale) else int(y) * scale
    return np.array([exact(y) for y in x.ravel().tolist()], object).reshape(x.shape)


def _small(width: int) -> int:
    return int(math.sqrt((1 << 52) / max(1, width))) // 2


def _plain(m: np.ndarray) -> list[list[int]]:
    return [[int(y) for y in row] for row in m.tolist()]


def nearest(v: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry, ties to the lower index, and the squared distance."""
    best, error = np.zeros(len(v), np.int64), np.zeros(len(v), object)
    if v.dtype == object or book.dtype == object:
        entries = _plain(book)
        for i, row in enumerate(_plain(v)):
            error[i], best[i] = min((sum((a - b) ** 2 for a, b in zip(row, entry, strict=True)), k) for k, entry in enumerate(entries))
        return best, error
    norm = (book * book).sum(1)
    for low in range(0, len(v), AT_ONCE):
        part = v[low : low + AT_ONCE]
        far = norm - 2 * (part @ book.T)
        at = far.argmin(1)
        best[low : low + AT_ONCE] = at
        error[low : low + AT_ONCE] = (far[np.arange(len(part)), at] + (part * part).sum(1)).astype(np.int64)
    return best, error


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def kept_vectors(embeddings: DataFrame, parts: int, columns: list[str], vec_col: str) -> tuple[DataFrame, int]:
    """(row, the columns and x of the rows with sound vectors, staged; components of a part).
    x is filled up with zeros to equal parts of the longest vector."""
    fine = F.forall(vec_col, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y.cast("double")) < float("inf")))
    sound = embeddings.where(F.coalesce(F.col(vec_col).isNotNull() & fine, F.lit(False))).select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)], F.transform(vec_col, lambda y: y.cast("double")).alias("x"))
    longest = sound.agg(F.max(F.size("x"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    filled = sound.withColumn("x", F.concat("x", F.array_repeat(F.lit(0.0), F.lit(parts * width) - F.size("x"))))
    schema = T.StructType([T.StructField("row", T.LongType()), *filled.schema])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, b in row_keys(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys), *b.columns], names=schema.names)

    return stage_table(filled.mapInArrow(number, schema), "vectors"), width


def first_books(kept: DataFrame, parts: int, width: int, entries: int, scale: int) -> list[np.ndarray]:
    """The codebooks of the first vectors by id (k0); null ids come last, rows of equal ids go by their components."""
    rows = kept.orderBy(F.asc_nulls_last("k0"), "x").limit(entries).select("x").collect()  # entries vectors
    x = np.array([r.x for r in rows], float).reshape(len(rows), parts * width)
    return [_book(whole_numbers(x[:, p * width : (p + 1) * width], scale).tolist(), width) for p in range(parts)]


def _book(rows: list[list], width: int) -> np.ndarray:
    """A codebook as doubles, or as Python's integers if some component is large."""
    whole = [[int(y) for y in row] for row in rows]
    large = any(abs(y) >= _small(width) for row in whole for y in row)
    out = np.empty((len(whole), width), object if large else float)
    out[:] = whole if whole else out
    return out


def assigned(members: DataFrame, books: list[np.ndarray], width: int, scale: int) -> DataFrame:
    """members (row, pos, x, entry) with `was`, their entry, and their nearest entry instead. Nothing is shuffled."""
    shared = members.sparkSession.sparkContext.broadcast(books)  # entries vectors

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos, v = b.column(1).to_numpy(), whole_numbers(_rows(b.column(2), width), scale)
            now = np.zeros(b.num_rows, np.int32)
            for p in np.unique(pos).tolist():
                own = np.flatnonzero(pos == p)
                now[own] = nearest(v[own], shared.value[p])[0]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], b.column(3), pa.array(now)], names=["row", "pos", "x", "was", "entry"])

    return members.select("row", "pos", "x", "entry").mapInArrow(hold, "row long, pos int, x array<double>, was int, entry int")


def moved_books(books: list[np.ndarray], members: DataFrame, width: int, scale: int) -> list[np.ndarray]:
    """The codebooks with each entry at the floors of its members' means; entries without members stay.

    Tasks add up the members that are resident with them; the sums, and the numbers of
    members at place `width`, leave them in digits."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = [np.zeros((len(book), width + 1), np.int64) for book in books]
        large: dict[tuple[int, int, int], int] = {}
        for b in batches:
            pos, v, entry = b.column(0).to_numpy(), whole_numbers(_rows(b.column(1), width), scale), b.column(2).to_numpy()
            for p in np.unique(pos).tolist():
                own = np.flatnonzero(pos == p)
                np.add.at(small[p][:, width], entry[own], 1)
                if v.dtype != object:
                    np.add.at(small[p][:, :width], entry[own], v[own].astype(np.int64))
                    continue
                for e, row in zip(entry[own].tolist(), v[own].tolist(), strict=True):
                    for i, y in enumerate(row):
                        large[p, e, i] = large.get((p, e, i), 0) + y
        sums = [((p, e, i), y) for p, held in enumerate(small) for e, i in np.argwhere(held).tolist() for y in [int(held[e, i])]] + [*large.items()]
        out = [(*key, d, y >> d * DIGIT if d == top else y >> d * DIGIT & (1 << DIGIT) - 1) for key, y in sums for top in [max(0, y.bit_length() - 1) // DIGIT] for d in range(top + 1)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], names=["pos", "entry", "place", "digit", "value"])

    sums = members.select("pos", "x", "entry").mapInArrow(add, "pos int, entry int, place int, digit int, value long").groupBy("pos", "entry", "place", "digit").agg(F.sum("value").alias("value"))
    total: dict[tuple[int, int], list[int]] = {}
    for r in sums.collect():  # a few digits for each component of the codebooks
        total.setdefault((r.pos, r.entry), [0] * (width + 1))[r.place] += r.value << r.digit * DIGIT
    mean = lambda p, e, row: [s // total[p, e][width] for s in total[p, e][:width]] if (p, e) in total else row
    return [_book([mean(p, e, row) for e, row in enumerate(book.tolist())], width) for p, book in enumerate(books)]


def fit(kept: DataFrame, parts: int, width: int, entries: int, rounds: int, scale: int) -> list[np.ndarray]:
    """The codebooks of kept_vectors() after so many rounds. The members of each round stay
    in the files where they lie; those that change their entry are shuffled to its owners."""
    spark = kept.sparkSession
    books = first_books(kept, parts, width, entries, scale)
    if not len(books[0]) or not rounds:
        return books
    salts = -(-kept.count() // MEMBERS)
    owner = lambda df: df.repartition(shuffle_partitions(spark), "pos", "entry", F.pmod(F.xxhash64("row"), F.lit(salts)))
    pos = F.explode(F.array(*[F.lit(p) for p in range(parts)])).alias("pos")
    placed = kept.select("row", pos, "x").select("row", "pos", F.slice("x", F.col("pos") * width + 1, width).alias("x"), F.lit(-1).alias("entry"))
    residents = [stage_table(owner(assigned(placed, books, width, scale)), "residents")]
    for n in range(rounds):
        members = residents[0] if len(residents) == 1 else residents[0].where("entry = was").unionByName(residents[1])
        if n:
            held = stage_table(assigned(members, books, width, scale), "residents")
            arrived = stage_table(owner(held.where("entry <> was")), "arrivals")
            drop_staged(*residents)
            residents = [held, arrived]
            members = held.where("entry = was").unionByName(arrived)
        books = moved_books(books, members, width, scale)
    drop_staged(*residents)
    return books


def encode(kept: DataFrame, books: list[np.ndarray], width: int, scale: int) -> DataFrame:
    """kept_vectors() with code and error: the nearest entries in part order, in two hex digits each (or as many as the last entry has), and their squared distances' sum."""
    shared = kept.sparkSession.sparkContext.broadcast(books)  # entries vectors
    digits = max(2, len(f"{max(0, len(books[0]) - 1):x}"))
    schema = T.StructType([*(f for f in kept.schema if f.name.startswith("k")), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _rows(b.column(b.num_columns - 1), width * len(books))
            found = [nearest(whole_numbers(x[:, p * width : (p + 1) * width], scale), book) for p, book in enumerate(shared.value)]
            codes = ["".join(f"{e:0{digits}x}" for e in code) for code in zip(*(best.tolist() for best, _ in found), strict=True)]
            errors = [min(LONG, int(sum(e))) for e in zip(*(error for _, error in found), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:-1], pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=schema.names)

    return kept.mapInArrow(hold, schema)


def with_label_error(coded: DataFrame, label: str) -> DataFrame:
    """coded with label_error, the errors' sum over the rows of its label; nulls are one label."""
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(LONG).cast("decimal(30,0)")).cast("long").alias("label_error")
    sums = stage_table(coded.groupBy(F.col(label).alias("_label")).agg(total), "labels")
    same = F.col(label).eqNullSafe(F.col("_label"))
    if sums.count() <= LABELS:
        return coded.join(F.broadcast(sums), same).drop("_label")
    dealt = coded.withColumn("_salt", F.pmod(F.xxhash64("error", "code"), F.lit(SALTS)))
    copied = sums.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(copied.hint("merge"), same & (F.col("_salt") == F.col("_at"))).drop("_label", "_salt", "_at")


def compress(embeddings: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, code, error, label_error, codebooks_sha256 of each row with a sound vector.

    Vectors that are null or hold null or non-finite components take no part.
    Components count as floor(scale * x); vectors are cut into equal parts, shorter ones
    filled up with zeros to the longest one's. The codebooks start from the vectors of
    the smallest ids (null ids last; of equal ids by components), fewer where there are
    fewer, repeated rows each. Each of `rounds` rounds assigns all parts and moves the
    entries to the floors of their members' means. Components of any size are exact;
    errors hold the nearest long. An empty table gives no rows; other columns are not
    read.
    """
    kept, width = kept_vectors(embeddings, parts, [id_col, label_col], vec_col)
    books = fit(kept, parts, width, entries, rounds, scale)
    digest = hashlib.sha256(",".join(str(int(y)) for book in books for row in book.tolist() for y in row).encode()).hexdigest()
    coded = stage_table(encode(kept, books, width, scale), "codes")
    drop_staged(kept)
    found = with_label_error(coded, "k1")
    return found.select(F.col("k0").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
