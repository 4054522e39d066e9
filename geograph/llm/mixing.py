"""Mixing sources to target weights.

Each source is one stream of words, cut into blocks of fixed length. The mix is a
row of slots, dealt into output shards. Each shard draws a multinomial count for
every source, on its own, with the sources' quotas as weights. Over all shards a
source then has drawn a little more or less than its quota; draws beyond a quota
are handed, in order, to the sources that fell short, so that every source meets
its quota and none is repeated too often. A draw's index goes through the source's
pseudorandom permutation to a block, and blocks join their documents by index.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import running_total, shuffle_partitions, stage_table
from .texthash import U, mix, text_bytes, word_bounds

WORD = "[^\\x20\\x09-\\x0D]+"
#: Words in a block, slots in an output shard, and times a source may be repeated.
BLOCK_WORDS, SHARD_SLOTS, MOST_TIMES = 128, 1024, 3
#: Sources up to which their table, about 50 bytes a row, is broadcast to joins.
FEW_SOURCES = 100_000


def targets(sizes: list[int], weights: list[int], most: int = MOST_TIMES) -> list[Fraction]:
    """Shares of the total size by weight, none above `most` times its size; what is
    above is shared anew among the rest by weight."""
    out, left, rest = [Fraction(0)] * len(sizes), set(range(len(sizes))), Fraction(sum(sizes))
    while left:
        level = rest / sum(weights[i] for i in left)
        full = {i for i in left if level * weights[i] > most * sizes[i]}
        for i in full or left:
            out[i] = Fraction(most * sizes[i]) if full else level * weights[i]
        rest -= sum(out[i] for i in full)
        left = left - full if full else set()
    return out


def permute(at: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(n), chosen by key, at each index: a
    four-round Feistel network on enough bits, walked until it is back in range."""
    half = np.zeros(len(at), np.uint64)
    while (short := (U(1) << (half * U(2))) < n.astype(np.uint64)).any():
        half[short] += U(1)
    mask = (U(1) << half) - U(1)

    def once(x: np.ndarray, i: np.ndarray) -> np.ndarray:
        left, right = x >> half[i], x & mask[i]
        for r in range(4):
            left, right = right, left ^ (mix(right + key[i] * U(4) + U(r)) & mask[i])
        return (left << half[i]) | right

    every = np.arange(len(at))
    x, todo = at.astype(np.uint64), every
    while len(todo):
        x[todo] = once(x[todo], todo)
        todo = todo[x[todo] >= n[todo].astype(np.uint64)]
    return x.astype(np.int64)


def shard_counts(quotas: np.ndarray, shard: int, slots: int, seed: int) -> np.ndarray:
    """Multinomial counts of a shard: how many of its slots each source draws."""
    rng = np.random.Generator(np.random.Philox(key=[seed, shard]))
    return rng.multinomial(slots, quotas / max(1, quotas.sum()))


def hand_on(nth: np.ndarray, at: np.ndarray, quotas: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Source and index of each draw (source, index among its draws) once the draws
    beyond a source's quota went to the sources that drew less than theirs."""
    excess, lack = np.maximum(totals - quotas, 0), np.maximum(quotas - totals, 0)
    over = at >= quotas[nth]
    place = (np.cumsum(excess) - excess)[nth[over]] + at[over] - quotas[nth[over]]
    to = np.searchsorted(np.cumsum(lack), place, "right")
    nth, at = nth.copy(), at.copy()
    nth[over], at[over] = to, totals[to] + place - (np.cumsum(lack) - lack)[to]
    return nth, at


def plan(docs: DataFrame, source_col: str = "source", block_words: int = BLOCK_WORDS, seed: int = 29) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, slots, pieces) of docs (row, size, order and the source column).

    sources: source, nth, source_size, target, n_blocks. slots: shard, slot, nth,
    times (how often its source was through before), block. pieces: row, nth,
    block, word (the piece's first word in the document), words.
    """
    spark = docs.sparkSession
    found = docs.groupBy(source_col).agg(F.sum("size").alias("size")).collect()  # one row a source
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [r["size"] for r in found]
    share = targets(sizes, [1 + i % 3 for i in range(len(sizes))])
    blocks = [-(-n // block_words) for n in sizes]
    quotas = [min(MOST_TIMES * b, round(t * b / n)) if n else 0 for t, b, n in zip(share, blocks, sizes, strict=True)]
    table = T.StructType([T.StructField("source", T.StringType()), T.StructField("nth", T.IntegerType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("n_blocks", T.LongType())])
    sources = spark.createDataFrame([(r[0], i, sizes[i], float(share[i]), blocks[i]) for i, r in enumerate(found)], table)
    wanted, n_blocks = np.array(quotas, np.int64), np.array(blocks, np.int64)
    all_slots = int(wanted.sum())
    shards = max(1, -(-all_slots // SHARD_SLOTS))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column(0).to_pylist():
                counts = shard_counts(wanted, shard, min(SHARD_SLOTS, all_slots - shard * SHARD_SLOTS), seed) if all_slots else wanted
                some = np.flatnonzero(counts)
                n = counts[some]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), shard)), pa.array(some.astype(np.int32)), pa.array(n), pa.array(np.cumsum(n) - n)], names=["shard", "nth", "n", "at"])

    drawn = stage_table(spark.range(shards, numPartitions=min(shards, shuffle_partitions(spark))).mapInArrow(draw, "shard long, nth int, n long, at long"), "drawn")
    totals = np.zeros(len(found), np.int64)
    for r in drawn.groupBy("nth").agg(F.sum("n").alias("n")).collect():  # one row a source
        totals[r.nth] = r.n

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, nth, n, at, start = (b.column(c).to_numpy() for c in ("shard", "nth", "n", "at", "start"))
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            source, index = hand_on(np.repeat(nth, n).astype(np.int64), np.repeat(start, n) + within, wanted, totals)
            size = n_blocks[source]
            times = index // np.maximum(size, 1)
            salt = mix(np.full(len(source), seed, np.uint64))
            block = permute(index % np.maximum(size, 1), size, mix((source.astype(np.uint64) << U(8)) + times.astype(np.uint64) + salt))
            of = np.repeat(shard, n)
            slot = permute(np.repeat(at, n) + within, np.minimum(SHARD_SLOTS, all_slots - of * SHARD_SLOTS), mix(of.astype(np.uint64) + salt * U(3)))
            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(slot), pa.array(source.astype(np.int32)), pa.array(times.astype(np.int32)), pa.array(block)], names=["shard", "slot", "nth", "times", "block"])

    firsts = running_total(drawn, "n", ["shard"], ["nth"], "draws").select("shard", "nth", "n", "at", "start")
    slots = firsts.mapInArrow(place, "shard long, slot long, nth int, times int, block long")
    numbered = _with_source(docs.withColumnRenamed(source_col, "_source"), sources.select("source", "nth")).select("row", "order", "nth", "size")
    placed = running_total(numbered.where("size > 0"), "size", ["order", "row"], ["nth"], "placed")
    first, last = F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")
    cut = placed.withColumn("block", F.explode(F.sequence(first, last)))
    begin, end = F.greatest("start", F.col("block") * block_words), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    return sources, slots, cut.select("row", "nth", "block", (begin - F.col("start")).alias("word"), (end - begin).alias("words"))


def _with_source(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """docs with the columns of their source (_source). The table of sources is sent to
    every task while it is small; the documents' side never is."""
    few = sources.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    return docs.join(F.broadcast(sources) if few else sources.hint("merge"), F.col("_source").eqNullSafe(F.col("source")))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, keep: list[str]) -> DataFrame:
    """docs with row, size and order, written out so that row numbers stay."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return stage_table(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("order"), F.col(source_col).cast("string").alias("_source"), size.alias("size"), *[F.col(c).alias(f"d_{c}") for c in keep]), "sized")


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, seed: int = 29) -> DataFrame:
    """id, size, source_size, target, taken of each document.

    Sizes count words; a null or empty text has 0 and is never taken. The target is
    the document's source's; a null source is a source, the last. Sources hold one
    row each on the driver, which knows their targets. Repeated rows are documents of their own. No block is
    drawn over MOST_TIMES times. Reruns agree, since all draws follow from the seed
    and documents go by id, equal ids by their place in the table.
    """
    rows = sized(docs, id_col, text_col, source_col, [])
    sources, slots, pieces = plan(rows, "_source", block_words, seed)
    drawn = slots.groupBy("nth", "block").agg(F.count("*").alias("n"))
    taken = pieces.join(drawn.hint("merge"), ["nth", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("n")).alias("taken"))
    own = _with_source(rows, sources).join(taken.hint("merge"), "row", "left")
    return own.select(F.col("order").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, seed: int = 29) -> DataFrame:
    """The mix itself, with the columns of docs: a document for each time it is taken;
    where only some of its blocks are, its text is cut to each run of words taken.
    n_chars, if there is one, follows the text. Documents that are not taken, such as
    null, empty and blank ones, are not in it. Repeated rows are documents of their
    own; columns of any name go through; an empty table gives an empty mix."""
    columns = docs.columns
    rows = sized(docs, id_col, text_col, source_col, columns)
    _, slots, pieces = plan(rows, "_source", block_words, seed)
    runs = slots.hint("merge").join(pieces, ["nth", "block"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("times", "word", "words"))).alias("runs"))
    joined = rows.select("row", "size", *[f"d_{c}" for c in columns]).join(runs.hint("merge"), "row").drop("row")
    schema = T.StructType(list(docs.schema))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, texts = [], []
            for i, (size, text, drawn) in enumerate(zip(b.column("size").to_pylist(), b.column(f"d_{text_col}"), b.column("runs").to_pylist(), strict=True)):
                merged: list[list[int]] = []
                for r in drawn:
                    if merged and merged[-1][0] == r["times"] and merged[-1][2] == r["word"]:
                        merged[-1][2] += r["words"]
                    else:
                        merged.append([r["times"], r["word"], r["word"] + r["words"]])
                whole = text.as_py()
                if any(m[2] - m[1] < size for m in merged):
                    data = text_bytes(whole)
                    starts, ends = word_bounds(data)
                for _, begin, end in merged:
                    at.append(i)
                    texts.append(whole if end - begin == size else data[starts[begin] : ends[end - 1]].tobytes().decode("utf-8", "surrogatepass"))
            taken = b.take(pa.array(at, pa.int64()))
            text = pa.array(texts, pa.string())
            made = {text_col: text, "n_chars": pa.array([len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([made[c].cast(taken.column(f"d_{c}").type) if c in made else taken.column(f"d_{c}") for c in columns], names=columns)

    return joined.mapInArrow(cut, schema)
