"""Target-distribution importance resampling over a head-tail vocabulary.

Features are runs of one to three words, each in the bucket of its CRC-32. The words
and pairs that are frequent in the corpus, its head, are broadcast with their exact
CRC states; a run is extended by a head word through that word's state alone. Words
of the tail are read byte by byte. Either way the CRC is exact, so what belongs to
the head decides the speed only, never a bucket. Bucket totals of all documents and
of the target texts give each bucket a gain, a document's weight is the sum of its
features' gains, and Gumbel noise picks the documents of the highest scores.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import running_total, stage_table
from .importance import largest
from .wordbytes import chunks, rows_of, text_column, word_array, words

BUCKETS = 10_000
#: Words and pairs of the head, twice as many at most, and most bytes of a word of it: at most 6 MB and 9 MB reach the driver and are broadcast.
HEAD_WORDS, HEAD_PAIRS, HEAD_BYTES = 1 << 15, 1 << 16, 64
#: Pairs that each chunk of texts proposes for the head.
PROPOSED = 1024
#: Longer spans are left to zlib, one by one.
LONG_SPAN = 256
#: Fixed value: the polynomial of CRC-32, bits reversed.
POLYNOMIAL = 0xEDB88320
SPACE = 0x20


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


TABLE = _table()


def _shifts(most: int) -> np.ndarray:
    """(number of bytes, place of a byte in the CRC, byte) -> what it becomes when so many zero bytes follow."""
    place = np.arange(4, dtype=np.uint32)[:, None] * 8
    out = [np.arange(256, dtype=np.uint32)[None, :] << place]
    for _ in range(most):
        out.append(TABLE[out[-1] & 0xFF] ^ (out[-1] >> 8))
    return np.stack(out).astype(np.uint32)


SHIFTS = _shifts(HEAD_BYTES + 1)


def shift(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """crc(a) -> crc(a || b) ^ crc(b), where b has `by` bytes, at most HEAD_BYTES + 1."""
    return SHIFTS[by, 0, crc & 0xFF] ^ SHIFTS[by, 1, (crc >> 8) & 0xFF] ^ SHIFTS[by, 2, (crc >> 16) & 0xFF] ^ SHIFTS[by, 3, crc >> 24]


def read_on(crc: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, spaced: bool) -> np.ndarray:
    """CRCs, continued by the bytes of one span each, after a space if `spaced`."""
    state = ~crc.astype(np.uint32)
    if spaced:
        state = TABLE[(state ^ np.uint32(SPACE)) & 0xFF] ^ (state >> 8)
    size = ends - starts
    order = np.argsort(-np.minimum(size, LONG_SPAN + 1), kind="stable")
    own, begin, left = state[order], starts[order], size[order]
    n_long = int(np.searchsorted(-left, -LONG_SPAN, "left")) if len(left) else 0
    for i in range(n_long):
        own[i] = ~np.uint32(zlib.crc32(data[begin[i] : begin[i] + left[i]], int(~own[i])))
    rest, at, left = own[n_long:], begin[n_long:], left[n_long:]
    for j in range(int(left[0]) if len(left) else 0):
        k = int(np.searchsorted(-left, -j, "left"))  # the spans of more than j bytes
        rest[:k] = TABLE[(rest[:k] ^ data[at[:k] + j]) & 0xFF] ^ (rest[:k] >> 8)
    out = np.empty_like(own)
    out[order] = ~own
    return out


@dataclass
class Head:
    """Frequent words with the CRC of each and of each after a space; keys of frequent pairs (place of the first word * words + place of the second) with the pair's CRC."""

    words: pa.Array
    alone: np.ndarray
    spaced: np.ndarray
    pairs: pa.Array
    pair_crc: np.ndarray

    @classmethod
    def of(cls, frequent: list[bytes], pairs: list[bytes]) -> Head:
        place = {w: i for i, w in enumerate(frequent)}
        known = sorted((place[a] * len(frequent) + place[b], zlib.crc32(p)) for p in pairs for a, b in [p.split(b" ")] if a in place and b in place)
        crcs = lambda xs: np.array([zlib.crc32(x) for x in xs], np.uint32)
        return cls(pa.array(frequent, pa.large_binary()), crcs(frequent), crcs([b" " + w for w in frequent]), pa.array([k for k, _ in known], pa.int64()), np.array([c for _, c in known], np.uint32))


def feature_crcs(data: np.ndarray, at: np.ndarray, counts: np.ndarray, head: Head) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, CRC) of every run of one, two and three words of the rows."""
    n, row = len(at) - 1, rows_of(counts)
    place = pc.index_in(word_array(data, at), head.words).fill_null(-1).to_numpy(zero_copy_only=False)
    known = place >= 0
    size = np.diff(at)
    one = np.zeros(n, np.uint32)
    one[known] = head.alone[place[known]]
    tail = np.flatnonzero(~known)
    one[tail] = read_on(np.zeros(len(tail), np.uint32), data, at[tail], at[tail + 1], False)

    def extend(crc: np.ndarray, word: np.ndarray) -> np.ndarray:
        """CRCs of runs, each continued by a space and one more word."""
        out = np.empty(len(crc), np.uint32)
        by_state = known[word]
        short = word[by_state]
        out[by_state] = shift(crc[by_state], size[short] + 1) ^ head.spaced[place[short]]
        rest = word[~by_state]
        out[~by_state] = read_on(crc[~by_state], data, at[rest], at[rest + 1], True)
        return out

    first = np.flatnonzero(row[:-1] == row[1:]) if n > 1 else np.zeros(0, np.int64)
    keys = np.where(known[first] & known[first + 1], place[first].astype(np.int64) * len(head.words) + place[first + 1], -1)
    frequent = pc.index_in(pa.array(keys), head.pairs).fill_null(-1).to_numpy(zero_copy_only=False)
    listed = frequent >= 0
    two = np.empty(len(first), np.uint32)
    two[listed] = head.pair_crc[frequent[listed]]
    two[~listed] = extend(one[first[~listed]], first[~listed] + 1)
    longer = np.flatnonzero(row[first] == row[np.minimum(first + 2, n - 1)]) if n > 2 else np.zeros(0, np.int64)
    longer = longer[first[longer] + 2 < n]
    three = extend(two[longer], first[longer] + 2)
    return [(row, one), (row[first], two), (row[first[longer]], three)]


def find_head(texts: DataFrame, n_words: int = HEAD_WORDS, n_pairs: int = HEAD_PAIRS) -> Head:
    """The head of one string column. Words are counted over all texts; pairs are those
    that chunks of the texts propose most often."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_column(b.column(0))
            for low, high in chunks(offsets):
                found, at, counts = words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                if len(at) < 2:
                    continue
                encoded = word_array(found, at).dictionary_encode()
                names, code = encoded.dictionary, encoded.indices.to_numpy()
                times = np.bincount(code)
                row, held = rows_of(counts), np.diff(at)[np.unique(code, return_index=True)[1]] <= HEAD_BYTES
                pair = (code[:-1].astype(np.int64) * len(names) + code[1:])[(row[:-1] == row[1:]) & held[code[:-1]] & held[code[1:]]]
                keys, often = np.unique(pair, return_counts=True)
                best = np.argsort(-often, kind="stable")[:PROPOSED]
                some = np.flatnonzero(held)
                joined = pc.binary_join_element_wise(names.take(pa.array(keys[best] // len(names))), names.take(pa.array(keys[best] % len(names))), pa.scalar(b" ", pa.large_binary()))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([names.take(pa.array(some)), joined]).cast(pa.binary()), pa.array(np.r_[np.zeros(len(some), np.int32), np.ones(len(best), np.int32)]), pa.array(np.r_[times[some], often[best]].astype(np.int64))], names=["run", "kind", "n"])

    runs = texts.mapInArrow(count, "run binary, kind int, n long").groupBy("kind", "run").agg(F.sum("n").alias("n"))
    runs = stage_table(runs, "runs")

    def most(kind: int, k: int) -> list[bytes]:
        """The runs that occur as often as the k-th does, or more often if very many tie with it: 2 k at most."""
        own = runs.where(F.col("kind") == kind).select("run", F.col("n").cast("double").alias("n"))
        edge = largest(own, "n", k)
        if edge is None:
            return []
        tied = own.where(F.col("n") >= edge)
        return sorted(bytes(r.run) for r in (tied if tied.count() <= 2 * k else own.where(F.col("n") > edge)).collect())

    return Head.of(most(0, n_words), most(1, n_pairs))


def bucket_totals(texts: DataFrame, head: Head) -> np.ndarray:
    """How many features of one string column fall into each bucket. Each task counts for itself; two numbers for each of BUCKETS buckets leave it."""
    shared = texts.sparkSession.sparkContext.broadcast(head)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            data, offsets = text_column(b.column(0))
            for low, high in chunks(offsets):
                found = words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                for _, crc in feature_crcs(*found, shared.value):
                    total += np.bincount(crc % np.uint32(BUCKETS), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target likelihood / raw likelihood)) of each bucket, with one more feature in each."""
    all_raw, all_target = float(raw.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log(float(t + 1) * all_raw / (float(s + 1) * all_target))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(id_col: str, seed: int) -> Column:
    """floor(1000 x) of the Gumbel noise that a hash of the id gives; a null id hashes as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weigh(docs: DataFrame, gain: np.ndarray, head: Head, id_col: str, text_col: str) -> DataFrame:
    """id, n_words, n_features, weight of each row."""
    shared = docs.sparkSession.sparkContext.broadcast((head, gain.astype(float)))
    schema = T.StructType([docs.schema[id_col], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, gain = shared.value
        for b in batches:
            data, offsets = text_column(b.column(1))
            n, features, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for low, high in chunks(offsets):
                found = words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                n[low:high] = found[2]
                for row, crc in feature_crcs(*found, head):
                    features[low:high] += np.bincount(row, minlength=high - low)
                    weight[low:high] += np.bincount(row, gain[crc % np.uint32(BUCKETS)], high - low).astype(np.int64)  # whole numbers, exact as doubles
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(features), pa.array(weight)], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(score, schema)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """id, n_words, n_features, weight, score, rank of every document.

    Of the N documents of at least least_words words, the floor(percent N / 100) of
    the highest scores are drawn and ranked from 1, ties to the smaller id; the
    others' rank is null. Texts of any length are read whole. A null or empty text
    has no feature and weight 0. A null id draws noise of its own like any other id
    and comes after the others at a tie. Repeated rows have equal scores and ranks
    next to each other. An empty target table gives gains by the raw totals alone,
    an empty table of documents no rows. Other columns are not read.
    """
    head = find_head(docs.select(text_col))
    gain = gains(bucket_totals(docs.select(text_col), head), bucket_totals(target.select(target_col), head))
    scored = weigh(docs, gain, head, id_col, text_col).withColumn("score", F.col("weight") + gumbel(id_col, seed))
    scored = stage_table(scored, "scored")
    able = scored.where(F.col("n_words") >= least_words)
    k = percent * able.count() // 100
    edge = largest(able.withColumn("_score", F.col("score").cast("double")), "_score", k)
    rank = F.lit(None).cast("long")
    if edge is None:
        return scored.withColumn("rank", rank)
    reach = (F.col("n_words") >= least_words) & (F.col("score") >= edge)
    keyed = scored.where(reach).withColumns({"_one": F.lit(1).cast("long"), "_by": -F.col("score"), "_no_id": F.col(id_col).isNull()})
    drawn = running_total(keyed, "_one", ["_by", "_no_id", id_col, "n_features"], label="drawn").withColumn("rank", F.when(F.col("start") < k, F.col("start") + 1))
    return drawn.select(*scored.columns, "rank").unionByName(scored.where(~reach).withColumn("rank", rank))
