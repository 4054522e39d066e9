"""Removal of long repeated strings by bucket-pointer refinement.

Suffixes are put into buckets by their first Q bytes. A bucket's identifier is a
fingerprint, so it needs no renumbering across tasks. Identifiers of longer
prefixes come from pairs: a suffix's own identifier and the one at a later offset;
each level reuses the one below, 1, 2, 4, ... bytes, until LENGTH bytes are told
apart. Sorting by identifier brings equal suffixes together, and buckets of one
member drop out.

Only some suffixes need a row: of the Q-grams in each string of LENGTH bytes, the
one with the least fingerprint (the leftmost, if equal) is its anchor. Equal
strings have equal anchors at equal offsets, so strings are compared only under
anchors of one bucket, about two rows to LENGTH - Q bytes. First whole runs of
strings that share an anchor are compared by their joint extent, and only those
that differ inside a bucket are refined string by string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_partitions, stage_table
from .texthash import BYTE_VALUES, U, mix, span_hashes, text_bytes

#: Bytes of a string that counts as repeated, and of the first buckets' prefix.
LENGTH, Q = 200, 32
#: Bytes of a text looked at in one go.
CHUNK = 1 << 22
#: Extents of a bucket that a task holds; strings of larger buckets are counted one row each.
BUCKET_ROWS = 16_384
#: A bucket with over 1 / HOT of all rows is hot; there are at most HOT of them. Their rows are dealt to SALTS keys.
HOT, SALTS = 2000, 64
#: Keys to which the extents of a hot bucket are dealt, many, so that all tasks get like shares of them.
SHARES = 4096
_POSITION = U((1 << 24) - 1)
_A, _B = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def _pair(own: np.ndarray, later: np.ndarray) -> np.ndarray:
    x = own * _A + later * _B
    return x ^ (x >> U(32))


def identifiers(data: np.ndarray, length: int, ids: np.ndarray | None = None, have: int = 1) -> np.ndarray:
    """Bucket identifiers of the `length`-byte strings at each place, from those of `have` bytes."""
    ids = BYTE_VALUES[data] if ids is None else ids
    while have < length:
        step = min(have, length - have)
        ids, have = _pair(ids[:-step], ids[step:]), have + step
    return ids


def anchor_runs(data: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and place of each anchor, and the first and last string start that it stands for."""
    grams = mix(identifiers(data, q))
    least = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    width, have = length - q + 1, 1
    while have < width:
        step = min(have, width - have)
        least, have = np.minimum(least[:-step], least[step:]), have + step
    anchor = (least & _POSITION).astype(np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    last = np.r_[first[1:], len(anchor)] - 1
    return grams[anchor[first]], anchor[first], first, last


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


ANCHORS = T.StructType([T.StructField(n, t) for n, t in (("bucket", T.LongType()), ("ext", T.LongType()), ("h1", T.LongType()), ("h2", T.IntegerType()), ("begin", T.IntegerType()), ("span", T.IntegerType()), ("lead", T.IntegerType()), ("several", T.BooleanType()))])


def _anchors(keyed: DataFrame, length: int, q: int) -> DataFrame:
    """A row for each anchor, staged. Extents met twice in a batch are settled at once:
    their rows get no bucket, and one row marked `several` goes on for them. A text
    met before in the task is left out; copies are settled by their count."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for b in batches:
            parts, rows = [], []
            for i, value in enumerate(b.column("text")):
                data = text_bytes(value.as_py())
                if len(data) < length or (own := hash(data.tobytes())) in met:
                    continue
                met.add(own)
                for low in range(0, len(data) - length + 1, CHUNK):
                    part = data[low : low + CHUNK + length - 1]
                    bucket, anchor, first, last = anchor_runs(part, length, q)
                    ext = mix(span_hashes(part, first, last + length) + (anchor - first).astype(np.uint64) * _A)
                    parts.append((bucket, ext, first + low, last - first, anchor - first))
                    rows.append(np.full(len(bucket), i))
            if not parts:
                continue
            bucket, ext, begin, span, lead = (np.concatenate(x) for x in zip(*parts, strict=True))
            row = np.concatenate(rows)
            _, at, of, n = np.unique(bucket ^ mix(ext), return_index=True, return_inverse=True, return_counts=True)
            several = n[of] > 1
            h1, h2 = b.column("h1").take(pa.array(row)), b.column("h2").take(pa.array(row))
            anchor_rows = np.sort(at)  # one of each extent
            settled = np.flatnonzero(several)
            order = np.concatenate([anchor_rows, settled])
            bare = np.arange(len(order)) >= len(anchor_rows)
            take = pa.array(order)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[order].view(np.int64), mask=bare),
                    pa.array(ext[order].view(np.int64), mask=bare),
                    h1.take(take),
                    h2.take(take),
                    *(pa.array(x[order].astype(np.int32)) for x in (begin, span, lead)),
                    pa.array(several[order]),
                ],
                names=ANCHORS.names,
            )

    return stage_table(keyed.select("h1", "h2", "text").mapInArrow(find, ANCHORS), "anchors")


def _hot_buckets(rows: DataFrame) -> DataFrame:
    """The buckets with over 1 / HOT of the rows, at most HOT of them, staged."""
    counts = stage_table(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0  # one number
    return stage_table(counts.where(F.col("n") * HOT > total).select("bucket"), "hot")


def _marked(rows: DataFrame, hot: DataFrame, salts: int) -> DataFrame:
    """rows with _hot, and with _salt, 0 but for hot buckets' rows. `hot` has HOT rows at most."""
    found = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "bucket", "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    return found.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("h1", "begin"), F.lit(salts))).otherwise(F.lit(0).cast("long")))


def _sort_buckets(anchors: DataFrame, hot: DataFrame, length: int) -> DataFrame:
    """Anchors by bucket and extent. Rows of an extent that occurs again are settled
    (no bucket); where a bucket has several extents, the last row of each goes on.
    Rows stream through with one row of look-ahead, whatever the bucket's size. Hot
    buckets are sorted in parts; of each part the last row of each extent goes on."""
    spark = anchors.sparkSession
    ordered = _marked(anchors.where("bucket is not null"), hot, SALTS).repartition(shuffle_partitions(spark), "bucket", "_salt").sortWithinPartitions("bucket", "_salt", "ext").select(*ANCHORS.names, "_hot", "_salt")

    def emit(t: pa.Table, n: int, before: tuple | None, opened: int | None) -> tuple[pa.RecordBatch, int | None]:
        """Judge the first n rows of t; before: bucket, part and extent of the row above them; opened: the extent that opened that bucket."""
        bucket, ext, salt = (t.column(c).to_numpy() for c in ("bucket", "ext", "_salt"))
        flagged = t.column("several").to_numpy(zero_copy_only=False)
        split = t.column("_hot").to_numpy(zero_copy_only=False)
        size = len(bucket)
        same_bucket = np.r_[(bucket[1:] == bucket[:-1]) & (salt[1:] == salt[:-1]), False]
        same_class = same_bucket & np.r_[ext[1:] == ext[:-1], False]
        above_bucket = np.r_[before is not None and before[:2] == (bucket[0], salt[0]), same_bucket[:-1]]
        above_class = np.r_[before is not None and before == (bucket[0], salt[0], ext[0]), same_class[:-1]]
        starts = np.flatnonzero(~above_bucket)
        first_ext = np.full(size, opened if opened is not None else 0, np.int64)
        if len(starts):
            first_ext[starts[0] :] = np.repeat(ext[starts], np.diff(np.r_[starts, size]))
        several = flagged | same_class | above_class
        mixed = ~same_class & ((first_ext != ext) | same_bucket | split)
        settled, going = np.flatnonzero(several[:n]), np.flatnonzero(mixed[:n])
        order = np.concatenate([settled, going])
        out = t.take(pa.array(order)).to_batches()
        keep = pa.Table.from_batches(out, t.schema) if out else t.slice(0, 0)
        bare = np.arange(len(order)) < len(settled)
        arrays = {c: keep.column(c).combine_chunks() for c in ANCHORS.names}
        arrays["bucket"] = pa.array(bucket[order], mask=bare)
        arrays["ext"] = pa.array(ext[order], mask=bare)
        arrays["several"] = pa.array(several[order])
        return pa.RecordBatch.from_arrays([arrays[c] for c in ANCHORS.names], names=ANCHORS.names), int(first_ext[n - 1])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before, opened = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            if t.num_rows > 1:
                n = t.num_rows - 1
                made, opened = emit(t, n, before, opened)
                before = tuple(t.column(c)[n - 1].as_py() for c in ("bucket", "_salt", "ext"))
                yield made
            held = t.slice(t.num_rows - 1)
        if held is not None:
            yield emit(held, 1, before, opened)[0]

    return stage_table(ordered.mapInArrow(stream, ANCHORS), "buckets")


def _runs(dup: np.ndarray, of: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of marked strings: which extent, the first string's start and the last one's."""
    at = np.flatnonzero(dup)
    if not len(at):
        return at, at, at
    new = np.r_[True, (at[1:] != at[:-1] + 1) | (of[at[1:]] != of[at[:-1]])]
    first, last = at[new], at[np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]]
    return of[first], begin[first], begin[last]


def _refine(extents: DataFrame, hot: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(spans, open): the repeated strings among the extents of each bucket, and one row for
    each different string of each part of a bucket that is hot or too large for a
    task, to be counted by Spark."""
    spark = extents.sparkSession
    ordered = _marked(extents, hot, SHARES).repartition(shuffle_partitions(spark), "bucket", "_salt").sortWithinPartitions("bucket").select("bucket", "h1", "h2", "begin", "several", "extent", "_hot")
    names = ["name", "bucket", "h1", "h2", "begin", "end", "several"]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, (T.LongType(), T.LongType(), T.LongType(), T.IntegerType(), T.IntegerType(), T.IntegerType(), T.BooleanType()), strict=True)])

    def strings(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Identifier, extent and start in its text of each string."""
        raw = [np.frombuffer(x, np.uint8) for x in t.column("extent").to_pylist()]
        sizes = np.array([len(x) for x in raw])
        ids = identifiers(np.concatenate(raw), length)
        at = np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], sizes - length + 1)
        nth = np.arange(len(at)) - np.repeat(np.r_[0, np.cumsum(sizes - length + 1)[:-1]], sizes - length + 1)
        of = np.repeat(np.arange(len(raw)), sizes - length + 1)
        return mix(ids[at + nth]), of, t.column("begin").to_numpy()[of] + nth

    def settle(t: pa.Table, whole: bool = True) -> Iterator[pa.RecordBatch]:
        """The repeated strings of t, as runs. Of a part of a bucket (not whole), one row goes
        on for each different string, marked `several` where its place is settled."""
        ids, of, begin = strings(t)
        several = t.column("several").to_numpy(zero_copy_only=False)
        names_in, at, inverse, n = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
        donated = np.zeros(len(n), bool)
        donated[inverse[several[of]]] = True
        again = (n > 1) | donated
        row, first, last = _runs(again[inverse] & ~several[of], of, begin)
        take = pa.array(row)
        none = pa.nulls(len(row), pa.int64())
        own = lambda rows: [t.column(c).take(rows).combine_chunks() for c in ("h1", "h2")]
        yield pa.RecordBatch.from_arrays([none, none, *own(take), pa.array(first.astype(np.int32)), pa.array((last + length).astype(np.int32)), pa.array(np.zeros(len(row), bool))], names=names)
        if not whole:
            one = pa.array(of[at])
            yield pa.RecordBatch.from_arrays([_long(names_in), t.column("bucket").take(one).combine_chunks(), *own(one), pa.array(begin[at].astype(np.int32)), pa.array((begin[at] + length).astype(np.int32)), pa.array(again)], names=names)

    def leave_open(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for low in range(0, t.num_rows, BUCKET_ROWS):
            yield from settle(t.slice(low, BUCKET_ROWS).combine_chunks(), whole=False)

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, too_large, hot_rows = None, None, []
        for b in batches:
            for low in range(0, b.num_rows, BUCKET_ROWS):
                t = pa.Table.from_batches([b.slice(low, BUCKET_ROWS)])
                if pc.any(t.column("_hot")).as_py():
                    hot_rows.append(t.filter(t.column("_hot")))
                    if sum(x.num_rows for x in hot_rows) >= BUCKET_ROWS:
                        yield from leave_open(pa.concat_tables(hot_rows))
                        hot_rows = []
                    t = t.filter(pc.invert(t.column("_hot")))
                t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
                if not t.num_rows:
                    continue
                bucket = t.column("bucket").to_numpy()
                if too_large is not None:
                    n = int(np.searchsorted(bucket, too_large, "right"))
                    yield from leave_open(t.slice(0, n))
                    t, bucket = t.slice(n), bucket[n:]
                    held = None
                    if not len(bucket):
                        continue
                    too_large = None
                n = int(np.searchsorted(bucket, bucket[-1], "left"))
                if n:
                    yield from settle(t.slice(0, n).combine_chunks())
                held = t.slice(n)
                if held.num_rows > BUCKET_ROWS:
                    yield from leave_open(held)
                    too_large, held = int(bucket[-1]), None
        if hot_rows:
            yield from leave_open(pa.concat_tables(hot_rows))
        if held is not None and held.num_rows:
            yield from settle(held.combine_chunks())

    found = stage_table(ordered.mapInArrow(refine, schema), "strings")
    return found.where("name is null").select("h1", "h2", "begin", "end"), found.where("name is not null")


def _extents(keyed: DataFrame, going: DataFrame, first: DataFrame, length: int) -> DataFrame:
    """The bytes of the extents that go on, cut from one document of each text."""
    wanted = going.groupBy("h1", "h2").agg(F.collect_list(F.struct("bucket", "begin", "span", "several")).alias("runs")).join(first.select("h1", "h2", "id"), ["h1", "h2"])
    texts = wanted.join(keyed, [wanted.h1 == keyed.h1, wanted.h2 == keyed.h2, wanted.id.eqNullSafe(keyed.id)]).select(wanted.h1, wanted.h2, "runs", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h1, h2, runs, text in zip(*(x for x in b.columns), strict=True):
                data, runs = text_bytes(text.as_py()).tobytes(), runs.as_py()
                n = len(runs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["bucket"] for r in runs], pa.int64()), pa.array([h1.as_py()] * n, pa.int64()), pa.array([h2.as_py()] * n, pa.int32()), pa.array([r["begin"] for r in runs], pa.int32()), pa.array([r["several"] for r in runs], pa.bool_()), pa.array([data[r["begin"] : r["begin"] + r["span"] + length] for r in runs], pa.binary())],
                    names=["bucket", "h1", "h2", "begin", "several", "extent"],
                )

    return texts.mapInArrow(cut, "bucket long, h1 long, h2 int, begin int, several boolean, extent binary")


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(b, e) for b, e in out]


def with_spans(docs: DataFrame, id_col: str, text_col: str, length: int, q: int) -> DataFrame:
    """docs with `spans`, the byte intervals of each text covered by repeated strings
    (unmerged; null: none), and `copied`, true where another row has the same text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h1"), F.hash(text).alias("h2"))
    first = stage_table(keyed.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "texts")
    anchors = _anchors(keyed, length, q)
    hot = _hot_buckets(anchors.where("bucket is not null"))
    buckets = _sort_buckets(anchors, hot, length)
    own = lambda df: df.where("bucket is null").select("h1", "h2", "begin", (F.col("begin") + F.col("span") + length).alias("end"))
    refined, unsettled = _refine(_extents(keyed, buckets.where("bucket is not null"), first, length), hot, length)
    seen = unsettled.groupBy("name", "bucket").agg(F.count("*").alias("n"), F.max("several").alias("several")).where("n > 1 or several").select("name", "bucket")
    counted = unsettled.where("not several").join(seen, ["name", "bucket"]).select("h1", "h2", "begin", "end")
    spans = own(anchors).unionByName(own(buckets)).unionByName(refined).unionByName(counted)
    by_text = spans.groupBy("h1", "h2").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    marked = first.select("h1", "h2", (F.col("copies") > 1).alias("copied")).join(by_text, ["h1", "h2"], "left").where("copied or spans is not null")
    rest = docs.withColumns({"_h1": F.xxhash64(text), "_h2": F.hash(text)})
    return rest.join(marked, (F.col("_h1") == F.col("h1")) & (F.col("_h2") == F.col("h2")), "left").drop("_h1", "_h2", "h1", "h2")


def _removed(spans: list[dict] | None, copied: bool | None, size: int, length: int) -> list[tuple[int, int]]:
    if copied and size >= length:
        return [(0, size)]
    return merge_spans([(s["begin"], s["end"]) for s in spans or ()])


def remove_repeats(docs: DataFrame, length: int = LENGTH, q: int = Q, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and spans of each document.

    Removed are the bytes covered by a string of `length` bytes that also starts
    anywhere else in the input, every occurrence alike. Texts count as UTF-8 bytes,
    null as empty; texts shorter than `length` lose nothing, copies of a longer one
    everything. Repeated rows are copies. Strings are told apart by 64-bit
    fingerprints under 64-bit buckets; other columns are not read.
    """
    span = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([docs.schema[id_col], *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), T.StructField("spans", span)])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans, copied in zip(b.column(1), b.column(2), b.column(3), strict=True):
                data = text_bytes(text.as_py()).tobytes()
                gone = _removed(spans.as_py(), copied.as_py(), len(data), length)
                kept, at = hashlib.sha256(), 0
                for begin, end in gone:
                    kept.update(data[at:begin])
                    at = end
                kept.update(data[at:])
                rows.append((len(data), sum(e - s for s, e in gone), len(gone), kept.hexdigest(), [{"begin": s, "end": e} for s, e in gone]))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[j] for r in rows], pa.int64()) for j in range(3)), pa.array([r[3] for r in rows], pa.string()), pa.array([r[4] for r in rows], pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))], names=schema.names)

    marked = with_spans(docs.select(id_col, text_col), id_col, text_col, length, q)
    return marked.select(id_col, text_col, "spans", "copied").mapInArrow(digest, schema)


def cut_repeats(docs: DataFrame, length: int = LENGTH, q: int = Q, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated strings cut out of their texts; a character that is cut in
    part goes whole. n_chars, if there is one, follows the text. Documents that
    have nothing left go; those that were empty or null before stay. Repeated rows
    are copies, so long ones go, and all of them; columns of any name go through;
    an empty table stays empty."""
    columns, schema = docs.columns, T.StructType(list(docs.schema))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, texts = [], []
            for i, (text, spans, copied) in enumerate(zip(b.column(f"d_{text_col}"), b.column("spans"), b.column("copied"), strict=True)):
                whole = text.as_py()
                data = text_bytes(whole).tobytes()
                gone = _removed(spans.as_py(), copied.as_py(), len(data), length)
                if gone:
                    kept = [data[s:e] for s, e in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(data)], strict=True)]
                    whole = "".join(x.decode("utf-8", "ignore") for x in kept)
                    if not whole:
                        continue
                at.append(i)
                texts.append(whole)
            kept_rows = b.take(pa.array(at, pa.int64()))
            made = {text_col: pa.array(texts, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([made[c].cast(kept_rows.column(f"d_{c}").type) if c in made else kept_rows.column(f"d_{c}") for c in columns], names=columns)

    plain = docs.select(*[F.col(c).alias(f"d_{c}") for c in columns])
    return with_spans(plain, f"d_{id_col}", f"d_{text_col}", length, q).mapInArrow(cut, schema)
