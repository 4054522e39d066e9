"""Quality rules with adaptive thresholds, in DataFrame functions alone.

Each document's measures go into log-linear histogram sketches per language and
source. The sketches are mergeable: one of a coarser group is the sum of those of
its parts. Fences read off a sketch's quartiles replace fixed cutoffs, and a join
brings each group's fences back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage_table

#: What parts words.
SPACE = "[\\x20\\x09-\\x0D]+"
#: A sketch keeps 2**SUB_BITS buckets for each power of two: quantiles are within 1/32 of the value.
SUB_BITS = 5
#: A group's fences are means of its own, by its documents, and of its language's, which count as so many
#: documents; a language's are blended with those of all documents in the same way.
PARENT_DOCS = 100
#: Fences lie so many interquartile ranges beyond the outer quartile ...
FENCE = 3
#: ... and the range counts as this much at least. Measures are in 1/10000, but mean_chars in 1/100.
LEAST_RANGE = {"symbols": 200, "dup_lines": 1000, "repeats": 500, "mean_chars": 100}
#: Measures that may also be too low.
TWO_SIDED = ("mean_chars",)


def measures(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns of keep, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Repeated 3-word windows are found inside the row: windows' hashes are sorted
    with their positions, and those equal to a neighbour are the repeated ones.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(
        *keep,
        F.filter(F.split(text, SPACE), lambda w: w != "").alias("_w"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_lines"),
    )
    windows = F.when(
        F.size("_w") >= 3,
        F.transform(F.arrays_zip(F.slice("_w", 1, F.size("_w") - 2).alias("a"), F.slice("_w", 2, F.size("_w") - 2).alias("b"), F.slice("_w", 3, F.size("_w") - 2).alias("c")), lambda x: F.xxhash64(x["a"], x["b"], x["c"])),
    ).otherwise(F.array().cast("array<bigint>"))
    hashed = split.select(
        *keep,
        "n_symbols",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("_h"),
    )
    #: Only texts in which a window repeats go through the sort.
    sorted_windows = hashed.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.array_sort(F.arrays_zip(F.col("_h").alias("h"), F.sequence(F.lit(1), F.size("_h")).alias("at")))))
    repeated = sorted_windows.withColumn(
        "_at",
        F.array_sort(
            F.filter(
                F.transform(
                    "_s",
                    lambda x, i: F.when((x["h"] == F.get(F.col("_s"), i - 1)["h"]) | (x["h"] == F.get(F.col("_s"), i + 1)["h"]), x["at"]),
                ),
                lambda x: x.isNotNull(),
            )
        ),
    )
    covered = F.aggregate(F.transform("_at", lambda x, i: F.least(F.lit(3), F.coalesce(F.get(F.col("_at"), i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return repeated.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def ratios() -> dict[str, Column]:
    per = lambda a, b, scale: F.when(F.col(b) > 0, F.expr(f"{a} * {scale} div {b}")).otherwise(F.lit(0).cast("long"))
    return {
        "symbols": per("n_symbols", "word_chars", 10000),
        "dup_lines": per("n_dup_lines", "n_lines", 10000),
        "repeats": per("n_repeat_words", "n_words", 10000),
        "mean_chars": per("word_chars", "n_words", 100),
    }


def bucket(value: Column) -> Column:
    """Sketch bucket of a count: exact below 2**(SUB_BITS + 1), then 2**SUB_BITS to each power of two."""
    shift = F.greatest(F.length(F.bin(value)) - (SUB_BITS + 1), F.lit(0))
    return (shift.cast("long") * (1 << SUB_BITS)) + F.call_function("shiftright", value, shift)


def bucket_low(b: Column) -> Column:
    """The smallest value of a bucket."""
    shift = F.greatest((b / (1 << SUB_BITS)).cast("int") - 1, F.lit(0))
    return F.call_function("shiftleft", (b - shift * (1 << SUB_BITS)).cast("long"), shift)


def sketch(measured: DataFrame, group: list[str]) -> DataFrame:
    """Documents by group, measure and bucket; pre-aggregated in each task before it moves."""
    pairs = F.array(*[F.struct(F.lit(name).alias("measure"), bucket(value).alias("bucket")) for name, value in ratios().items()])
    return measured.select(*group, F.explode(pairs).alias("p")).groupBy(*group, "p.measure", "p.bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, group: list[str]) -> DataFrame:
    return sketches.groupBy(*group, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, group: list[str]) -> DataFrame:
    """group, measure, docs, low and high: quartiles less or plus FENCE ranges."""
    by = Window.partitionBy(*group, "measure")
    ranked = sketches.withColumn("up_to", F.sum("n").over(by.orderBy("bucket"))).withColumn("docs", F.sum("n").over(by))
    quartile = lambda q: F.min(F.when(F.col("up_to") * 4 >= F.col("docs") * q, bucket_low(F.col("bucket"))))
    least = F.coalesce(*[F.when(F.col("measure") == k, F.lit(v)) for k, v in LEAST_RANGE.items()])
    spread = F.greatest(F.col("q3") - F.col("q1"), least)
    return ranked.groupBy(*group, "measure").agg(F.max("docs").alias("docs"), quartile(1).alias("q1"), quartile(3).alias("q3")).select(*group, "measure", "docs", (F.col("q1") - FENCE * spread).alias("low"), (F.col("q3") + FENCE * spread).alias("high"))


def wide(fenced: DataFrame, group: list[str], prefix: str) -> DataFrame:
    picks = [F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{prefix}{m}_{side}") for m in LEAST_RANGE for side in ("low", "high")]
    return fenced.groupBy(*group).agg(F.max("docs").alias(f"{prefix}docs"), *picks)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """id, the measures, base_failed, failed (the measures beyond their fence) and kept.

    base_failed: under 50 words, or over half of them in repeated 3-word windows.
    Fences come from the documents that pass the base rules, blended by count with
    those of the language and of all documents, so that no group's size switches
    its rule. Null languages and sources form groups of their own. A null text
    counts as empty and fails; texts are read whole. Repeated rows are judged each,
    and alike; other columns are not read; an empty table gives no rows. Windows
    are compared by 64-bit hash.
    """
    keys = [f"_g{i}" for i in range(len(group))]
    text = docs.select(F.col(id_col), F.col(text_col), *[F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")).alias(k) for c, k in zip(group, keys, strict=True)])
    measured = stage_table(
        measures(text, [id_col, *keys], text_col).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))),
        "measures",
    )
    fine = stage_table(sketch(measured.where("not base_failed"), keys), "sketches")
    own, language = wide(fences(fine, keys), keys, "g_"), wide(fences(merge(fine, keys[:1]), keys[:1]), keys[:1], "l_")
    every = {(r.measure, side): r[side] for r in fences(merge(fine, []), []).collect() for side in ("low", "high")}  # one row for each measure
    groups = own.join(language, keys[:1])
    blend = lambda docs, own, parent: F.call_function("div", docs * own + PARENT_DOCS * parent, docs + PARENT_DOCS)
    pick = lambda m, side: blend(F.col("g_docs"), F.col(f"g_{m}_{side}"), blend(F.col("l_docs"), F.col(f"l_{m}_{side}"), F.lit(every.get((m, side)))))
    limits = groups.select(*keys, *[pick(m, side).alias(f"{m}_{side}") for m in LEAST_RANGE for side in ("low", "high")])
    joined = measured.join(limits, keys, "left")
    values = ratios()
    broken = [
        F.when((values[m] > F.col(f"{m}_high")) | ((values[m] < F.col(f"{m}_low")) if m in TWO_SIDED else F.lit(False)), F.lit(m)) for m in LEAST_RANGE
    ]
    failed = F.array_compact(F.array(*broken))
    return joined.select(id_col, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", failed.alias("failed"), (~F.col("base_failed") & (F.size(failed) == 0)).alias("kept"))
