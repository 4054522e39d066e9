"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, one of the target text and one of all
raw text, give each document an importance weight, the ratio of its likelihoods. The
log ratio is taken per n-gram and counts as that of TEMPER independent ones, however
long the text: neighbouring n-grams repeat each other's evidence, and a weight that
grew with the length would leave the noise without effect. Documents are then
sampled without replacement by Gumbel top-k: the k largest of log weight + Gumbel
noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage_table, unit_noise
from .texthash import SPACE, U, mix, span_hashes, text_bytes

#: Hash buckets of each model.
BUCKETS = 1 << 14
#: A document's evidence counts as that of so many independent n-grams.
TEMPER = 16
#: Documents counted at a time.
ROWS_AT_ONCE = 256
#: Documents' worth of evidence for "as likely in either" that each bucket starts with.
PRIOR = 0.25
#: The share of good rows lost weighs so many times the share of bad rows kept.
GOOD_LOSS = 4
#: Most labelled rows that the target model and the threshold are fitted on.
MAX_LABELLED = 100_000

REPEAT, NEAR_REPEAT = mix(np.array([1, 2], np.uint64))
#: 1 for bytes of letters and digits (any byte from 0x80 on counts), 2 for other visible bytes.
KIND = np.full(256, 2, np.int8)
KIND[0x80:] = 1
for _low, _high in ((48, 58), (65, 91), (97, 123)):
    KIND[_low:_high] = 1
KIND[SPACE] = 0


def features(text: str | None) -> np.ndarray:
    """Buckets of a text's tokens and token pairs. A token is a run of letters and
    digits or a run of other signs. Pairs of equal tokens, next to each other or
    with one between, share a bucket whatever the token, so that the models also
    learn how often tokens repeat. Texts are read whole."""
    data = text_bytes(text)
    kind = np.zeros(len(data) + 2, np.int8)
    kind[1:-1] = KIND[data]
    change = np.flatnonzero(np.diff(kind))
    inside = kind[change + 1] > 0
    starts = change[inside]
    ends = change[np.flatnonzero(inside) + 1] if len(starts) else starts
    h = span_hashes(data, starts, ends)
    pairs = np.where(h[:-1] == h[1:], REPEAT, mix(h[:-1] * U(3) + h[1:])) if len(h) > 1 else h[:0]
    near = np.full(int((h[:-2] == h[2:]).sum()), NEAR_REPEAT)
    return (np.concatenate([h, pairs, near]) & U(BUCKETS - 1)).astype(np.int64)


def fit_log_ratio(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """log target frequency / raw frequency of each bucket.

    Raw counts come from every document; target counts from the documents that
    `labels` (id, good) calls good. Each document weighs alike in the target and
    in the raw model, however long. Counting happens in the tasks; what reaches
    the driver is two numbers for each of BUCKETS buckets.
    """
    marked = docs.select(id_col, text_col).join(F.broadcast(labels.select(id_col, "good")), id_col, "left")  # at most MAX_LABELLED rows
    marked = marked.select(text_col, "good")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for b in batches:
            for low in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(low, ROWS_AT_ONCE)
                found = [features(text.as_py()) for text in part.column(0)]
                n = np.array([len(f) for f in found])
                weight = np.repeat(1 / np.maximum(n, 1), n)
                at = np.concatenate([np.zeros(0, np.int64), *found])
                raw += np.bincount(at, weight, BUCKETS)
                target += np.bincount(at, weight * np.repeat([g is True for g in part.column(1).to_pylist()], n), BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.round(raw[at] * 1e6).astype(np.int64)), pa.array(np.round(target[at] * 1e6).astype(np.int64))], names=["bucket", "raw", "target"])

    counts = marked.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.collect():  # at most BUCKETS rows
        raw[r.bucket], target[r.bucket] = r.raw / 1e6, r.target / 1e6
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log(target + PRIOR) - np.log(raw * (target.sum() / raw.sum()) + PRIOR)


def log_weights(docs: DataFrame, log_ratio: np.ndarray, seed: int, id_col: str, text_col: str) -> DataFrame:
    """docs with n_features, log_weight (TEMPER times the mean log ratio of the features)
    and sample_key (log_weight plus Gumbel noise, to six digits)."""
    table = docs.sparkSession.sparkContext.broadcast(log_ratio.astype(np.float64))
    schema = T.StructType([*docs.schema, T.StructField("n_features", T.LongType()), T.StructField("log_weight", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, w = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for i, text in enumerate(b.column(text_col)):
                f = features(text.as_py())
                if len(f):
                    n[i], w[i] = len(f), round(float(table.value[f].mean()) * TEMPER, 9)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n), pa.array(w)], names=schema.names)

    noise = -F.log(-F.log(unit_noise(F.col(id_col), F.xxhash64(text_col), F.lit(seed))))
    return docs.mapInArrow(score, schema).withColumn("sample_key", F.round(F.col("log_weight") + noise, 6))


def threshold(scored: DataFrame) -> float:
    """The log weight that parts good from bad labelled rows with the least error
    (good rows lost, weighted by GOOD_LOSS, and bad rows kept), found on a histogram of the
    score in steps of 0.05, which is all that reaches the driver, a row for each labelled
    row at most; 0 if a class has no row."""
    step = 0.05
    at = F.floor(F.col("log_weight") / step)
    rows = scored.where("good is not null").groupBy(at.alias("at")).agg(F.sum(F.col("good").cast("long")).alias("good"), F.count("*").alias("n")).orderBy("at").collect()
    good, bad = sum(r.good for r in rows), sum(r.n - r.good for r in rows)
    if not good or not bad:
        return 0.0
    best, edge, previous, below_good, below_bad = None, 0.0, None, 0, 0
    for r in rows:
        error = GOOD_LOSS * below_good / good + (bad - below_bad) / bad
        if best is None or error < best - 1e-12:
            best, edge = error, r["at"] if previous is None else (previous + 1 + r["at"]) / 2
        previous, below_good, below_bad = r["at"], below_good + r.good, below_bad + r.n - r.good
    return edge * step


def largest(df: DataFrame, key: str, k: int) -> float | None:
    """The k-th largest value of a double column, by radix selection: each pass
    counts one of 2**16 digits, and only those counts reach the driver."""
    if k <= 0:
        return None
    scaled = df.select(F.round(F.col(key) * 1e6).cast("long").alias("v"))
    bounds = scaled.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("n")).first()
    if not bounds.n:
        return None
    low, width = bounds.low, bounds.high - bounds.low + 1
    k = min(k, bounds.n)
    while width > 1:
        step = -(-width // 65536)
        inside = scaled.where((F.col("v") >= low) & (F.col("v") < low + width))
        digits = inside.groupBy(F.floor((F.col("v") - low) / step).alias("d")).count().orderBy(F.desc("d")).collect()
        for d in digits:
            if k <= d["count"]:
                break
            k -= d["count"]
        low, width = low + d.d * step, step
    return low / 1e6


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, seed: int, share: float | None, keep: list[str]) -> tuple[DataFrame, float | None]:
    """(scored, edge): the columns of keep with the scores of all docs, staged, and the
    k-th largest sample key (None where k is 0)."""
    chosen = labels.where(F.col("good").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(id_col)).agg(F.max("good").alias("good")).orderBy(F.xxhash64(id_col), id_col).limit(MAX_LABELLED)
    chosen = stage_table(chosen, "labels")
    half = F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(2))
    log_ratio = fit_log_ratio(docs.select(id_col, text_col), chosen.where(half == 0), id_col, text_col)
    scored = log_weights(docs.select(*dict.fromkeys([*keep, id_col, text_col])), log_ratio, seed, id_col, text_col)
    scored = stage_table(scored.select(*dict.fromkeys([*keep, id_col]), "n_features", "log_weight", "sample_key"), "weights")
    usable = scored.where("n_features > 0")
    if share is None:
        marked = usable.select(id_col, "log_weight").join(F.broadcast(chosen.where(half == 1)), id_col, "left")  # at most MAX_LABELLED rows
        k = usable.where(F.col("log_weight") >= threshold(marked)).count()
    else:
        k = round(share * scored.count())
    return scored, largest(usable, "sample_key", k)


def _kept(edge: float | None):
    return F.lit(False) if edge is None else (F.col("n_features") > 0) & (F.col("sample_key") >= edge)


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, share: float | None = None) -> DataFrame:
    """id, n_features, log_weight, sample_key and kept of each document.

    labels: (doc_id, good boolean), of which at most MAX_LABELLED rows, those with the
    smallest hash of the id, are used; rows with a null good are left out. One half
    of them fits the target model, the other the threshold. k is `share` of all
    documents, or, where share is None, the number of documents whose log weight
    reaches the threshold that parts the labelled rows best. Documents with the k
    largest sample_key = log_weight + Gumbel noise (a hash of id and text, so reruns
    agree) are kept; ties at the k-th key are all kept. A null or empty text has
    weight 0 and no feature; it is never kept. Repeated rows are scored alike. Of a
    document labelled twice, good holds if any row says so. Without good or bad
    labels the threshold is 0. Other columns are not read.
    """
    scored, edge = fit(docs, labels, id_col, text_col, seed, share, [id_col])
    return scored.withColumn("kept", _kept(edge))


def keep_best(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, share: float | None = None) -> DataFrame:
    """The documents that resample() keeps, with their columns, which go through the
    scoring under other names, so that none clashes. Null and empty texts go;
    repeated rows stay or go alike; an empty table stays empty."""
    plain = docs.select(*[F.col(c).alias(f"d_{c}") for c in docs.columns])
    scored, edge = fit(plain, labels.select(F.col(id_col).alias("doc_id"), "good"), f"d_{id_col}", f"d_{text_col}", seed, share, plain.columns)
    return scored.where(_kept(edge)).select(*[F.col(f"d_{c}").alias(c) for c in docs.columns])
