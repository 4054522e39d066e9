"""Vector search, retrieval, embedding and semantic duplicates.

Exact scores of queries against nodes are computed in blocks: both sides are packed
into matrices, each block of queries meets each shard of nodes once, and only each
shard's best rows leave the task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import text
from .components import components, join_unique
from .links import dedupe_pairs
from .staging import settled

#: Rows in a block of nodes and of queries, blocks of nodes that a task holds, and rows that leave it at a time.
BLOCK, ASKED, HELD, MOST_ROWS = 1024, 256, 8, 1 << 16
#: Different vectors that a task remembers while it looks for equal ones.
REMEMBERED = 1 << 16
# Defaults of matching, candidates and duplicates.
MATCH_COUNT, ANSWER_FROM = 3, 0.70
NEIGHBOURS, LEAST_COSINE = 6, 0.35
DUPLICATE_FROM = 0.93
EMBEDDING_SIZE = 384


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays as an expression; a norm of zero counts as 1e-9."""
    a, b = (F.transform(F.col(c) if isinstance(c, str) else c, lambda x: x.cast("double")) for c in (a, b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.greatest(F.sqrt(dot(x, x)), F.lit(1e-9))
    return dot(a, b) / (norm(a) * norm(b))


def sound(vec_col: str) -> Column:
    """True for vectors that can be compared: not null or empty, and without null, NaN or infinite components."""
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vec_col) > 0) & fine, F.lit(False))


def _packed(df: DataFrame, id_col: str, vec_col: str, prefix: str, size: int) -> DataFrame:
    """Blocks of sound vectors: ids and a row-major matrix, short vectors filled up with zeros."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, size):
                ids, vectors = b.column(0)[low : low + size], b.column(1)[low : low + size]
                lengths = np.diff(vectors.offsets.to_numpy())
                flat = vectors.flatten().to_numpy(zero_copy_only=False)
                m = np.zeros((len(vectors), int(lengths.max())), np.float32 if flat.dtype == np.float32 else np.float64)
                m[np.arange(m.shape[1]) < lengths[:, None]] = flat
                yield pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([m.shape[1]], pa.int32()), pa.array([m.dtype.str]), pa.array([m.tobytes()], pa.binary())], names=[f"{prefix}_{c}" for c in ("ids", "dim", "type", "m")])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.where(sound(vec_col)).select(id_col, vec_col)
    return rows.mapInArrow(pack, f"{prefix}_ids array<{kind}>, {prefix}_dim int, {prefix}_type string, {prefix}_m binary")


def _unit(raw: bytes, kind: str, dim: int, width: int) -> np.ndarray:
    """Rows of a packed block as unit vectors of `width` components; a norm of zero counts as 1e-9."""
    m = np.frombuffer(raw, kind).reshape(-1, dim).astype(np.float64)
    largest = np.maximum(np.abs(m).max(axis=1, keepdims=True), 1.0)  # so that no square overflows
    norm = np.linalg.norm(m / largest, axis=1, keepdims=True) * largest
    return np.pad(m / np.maximum(norm, 1e-9), ((0, 0), (0, width - dim)))


def _blocks(df: DataFrame, id_col: str, vec_col: str, size: int, is_node: bool) -> DataFrame:
    """Packed blocks as rows of one shape for nodes and queries: node (whether they are), n_ids or q_ids, dim, type, m."""
    p = "n" if is_node else "q"
    packed = _packed(df, id_col, vec_col, p, size)
    return packed.select(F.lit(is_node).alias("node"), f"{p}_ids", F.col(f"{p}_dim").alias("dim"), F.col(f"{p}_type").alias("type"), F.col(f"{p}_m").alias("m"))


def best_matches(queries: DataFrame, nodes: DataFrame, k: int | None, least: float | None = None, query_id: str = "query_id", node_id: str = "node_id", vec_col: str = "embedding", skip_same: bool = False) -> DataFrame:
    """query_id, node_id, similarity, rank: each query's k most similar nodes, ties to the
    smaller id; with `least`, none less similar. skip_same: a node is no match of its
    own id. k None: all that reach `least`, without rank. Null and empty vectors, and
    those with null, NaN or infinite components, take no part, as query or as node;
    shorter vectors count as filled up with zeros.

    Nodes are dealt to shards of at most about HELD blocks, queries to groups. A task
    holds a shard's nodes while it reads the queries of a group, a block at a time;
    only each shard's best rows leave it.
    """
    kind = nodes.schema[node_id].dataType.simpleString()
    q_kind = queries.schema[query_id].dataType.simpleString()
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    there, asked = settled(_blocks(nodes, node_id, vec_col, BLOCK, True)), _blocks(queries, query_id, vec_col, ASKED, False)
    shards = max(1, -(-2 * there.count() // HELD))  # shards differ in size, so they are half full on average
    groups = max(1, -(-parts // shards))
    deal = lambda ids, n: F.pmod(F.xxhash64(ids, "m"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = there.withColumn("shard", deal("n_ids", shards)).withColumn("group", every(groups)).unionByName(asked.withColumn("group", deal("q_ids", groups)).withColumn("shard", every(shards)), allowMissingColumns=True)
    dealt = both.repartition(parts, "shard", "group").sortWithinPartitions("shard", "group", F.desc("node")).select("shard", "group", "node", "n_ids", "q_ids", "dim", "type", "m")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, held = None, [], []
        for b in batches:
            for row in range(b.num_rows):
                shard, group, is_node, n_ids, q_ids, dim, kind, m = (c[row].as_py() for c in b.columns)
                if (shard, group) != own:
                    own, ids, held, matrix = (shard, group), [], [], None
                if is_node:
                    ids.append(np.array(n_ids))
                    held.append(_unit(m, kind, dim, dim))
                    continue
                if not held:
                    continue
                width = max(dim, max(x.shape[1] for x in held)) if matrix is None else max(dim, matrix.shape[1])
                if matrix is None or matrix.shape[1] < width:
                    all_ids, matrix = np.concatenate(ids), np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in held])
                q_ids = np.array(q_ids)
                s = _unit(m, kind, dim, width) @ matrix.T
                if skip_same:
                    s[q_ids[:, None] == all_ids[None, :]] = -np.inf
                keep = s > -np.inf
                if k is not None and len(all_ids) > k:
                    cut = np.partition(s, len(all_ids) - k, axis=1)[:, len(all_ids) - k]
                    keep &= s >= cut[:, None] - 1e-9  # sums differ in their last digits: what may tie stays
                if least is not None:
                    keep &= s >= least - 1e-9
                qi, ni = np.nonzero(keep)
                for low in range(0, len(qi), MOST_ROWS):
                    q, n = qi[low : low + MOST_ROWS], ni[low : low + MOST_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[q]), pa.array(all_ids[n]), pa.array(np.round(s[q, n], 12))], names=["query_id", "node_id", "similarity"])

    found = dealt.mapInArrow(score, f"query_id {q_kind}, node_id {kind}, similarity double")
    if least is not None:
        found = found.where(F.col("similarity") >= least)
    if k is None:
        return found
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "node_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def alike(rows: DataFrame, id_col: str, vec_col: str = "embedding") -> DataFrame:
    """id, key, v of the sound vectors, settled: equal vectors share a key (a digest of 128
    bits), and v is there in the first row of a key that a task meets."""
    kind, vec = (rows.schema[c].dataType.simpleString() for c in (id_col, vec_col))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False)
            at = b.column(1).offsets.to_numpy() - (b.column(1).offsets[0].as_py() if b.num_rows else 0)
            keys = [hashlib.blake2b(flat[low:high], digest_size=16).hexdigest() for low, high in zip(at[:-1], at[1:], strict=True)]
            new = []
            for i, key in enumerate(keys):
                if key in seen:
                    new.append(None)
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(key)
                new.append(i)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.string()), b.column(1).take(pa.array(new, pa.int32()))], names=["id", "key", "v"])

    return settled(rows.where(sound(vec_col)).select(id_col, vec_col).mapInArrow(digest, f"id {kind}, key string, v {vec}"))


def _heads(rows: DataFrame) -> DataFrame:
    """key, v of each different vector of alike() rows."""
    return rows.where("v is not null").select("key", "v").dropDuplicates(["key"])


def best_alike(asked: DataFrame, there: DataFrame, k: int | None, least: float | None = None, only: DataFrame | None = None) -> DataFrame:
    """best_matches() of alike() rows: each different vector asks once; only: the ids (id) that ask. Of equal nodes only
    the k least ids can be among a query's k best, so no others are met; k None: equal
    nodes are met once, and each pair that reaches `least` is listed."""
    heads = _heads(asked)
    if only is not None:
        asked = asked.select("id", "key").join(only, "id", "left_semi")
        heads = heads.join(asked.select("key").distinct(), "key")
    queries = heads.select(F.col("key").alias("query_id"), F.col("v").alias("embedding"))
    if k is None:
        met = best_matches(queries, _heads(there).select(F.col("key").alias("node_id"), F.col("v").alias("embedding")), None, least)
        own = lambda rows, c: rows.select(F.col("key").alias(c), F.col("id").alias(f"{c}_own"))
        return met.join(own(there, "node_id"), "node_id").join(own(asked, "query_id"), "query_id").select(F.col("query_id_own").alias("query_id"), F.col("node_id_own").alias("node_id"), "similarity")
    first = there.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("_n") <= k).select("key", "id")
    met = best_matches(queries, first.join(_heads(there), "key").select(F.col("id").alias("node_id"), F.col("v").alias("embedding")), k, least)
    found = met.select(F.col("query_id").alias("key"), "node_id", "similarity").join(asked.select("key", F.col("id").alias("query_id")), "key").select("query_id", "node_id", "similarity")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "node_id"))).where(F.col("rank") <= k)


def confirmed_alike(pairs: DataFrame, asked: DataFrame, there: DataFrame, least: float) -> DataFrame:
    """query_id, node_id, similarity of those of the given pairs that reach `least`: only their vectors are measured, each two once."""
    own = lambda rows, c: rows.select(F.col("id").alias(c), F.col("key").alias(f"{c}_key"))
    keyed = settled(pairs.join(own(asked, "query_id"), "query_id").join(own(there, "node_id"), "node_id"))
    by = lambda rows, c: _heads(rows).select(F.col("key").alias(f"{c}_key"), F.col("v").alias(c))
    keys = ["query_id_key", "node_id_key"]
    met = keyed.select(*keys).distinct().join(by(asked, "query_id"), "query_id_key").join(by(there, "node_id"), "node_id_key")
    reached = met.select(*keys, _filled_cosine("query_id", "node_id").alias("similarity")).where(F.col("similarity") >= least)
    return keyed.join(reached, keys).select("query_id", "node_id", "similarity")


def _filled_cosine(a: str, b: str) -> Column:
    """Cosine of two arrays, the shorter one filled up with zeros, rounded as best_matches() does."""
    width = F.greatest(F.size(a), F.size(b))
    filled = lambda c: F.concat(c, F.array_repeat(F.lit(0.0), width - F.size(c)))
    return F.round(cosine(filled(F.col(a)), filled(F.col(b))), 12)


def register_search(nodes: DataFrame, name: str = "match_nodes", node_id: str = "node_id", vec_col: str = "embedding") -> None:
    """Make the search callable from SQL in the nodes' session: cosine_similarity(a, b), and
    SELECT * FROM match_nodes(vector, match_count), the rows (node_id, similarity) of the
    most similar nodes, ties to the smaller id. For one vector at a time; tables of
    queries go through best_matches()."""
    spark = nodes.sparkSession
    rows = nodes.where(sound(vec_col)).select(F.col(node_id).alias("node_id"), F.transform(vec_col, lambda x: x.cast("double")).alias("embedding"))
    rows.createOrReplaceTempView(f"{name}_rows")
    norm = lambda c: f"greatest(sqrt(aggregate(transform({c}, x -> x * x), 0D, (s, v) -> s + v)), 1e-9D)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION cosine_similarity(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> coalesce(x, 0D) * coalesce(y, 0D)), 0D, (s, v) -> s + v) / ({norm('a')} * {norm('b')})")
    kind = rows.schema["node_id"].dataType.simpleString()
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(query ARRAY<DOUBLE>, match_count INT) RETURNS TABLE (node_id {kind}, similarity DOUBLE) RETURN
      SELECT node_id, similarity FROM (SELECT *, row_number() OVER (ORDER BY similarity DESC, node_id) AS n FROM (SELECT node_id, cosine_similarity(query, embedding) AS similarity FROM {name}_rows)) WHERE n <= match_count""")


def knn_candidates(nodes: DataFrame, k: int = NEIGHBOURS, least: float = LEAST_COSINE, node_id: str = "node_id", vec_col: str = "embedding") -> DataFrame:
    """source_id < target_id, score: pairs in which either is among the other's k nearest of a cosine of `least`."""
    asked = nodes.select(F.col(node_id).alias("query_id"), F.col(vec_col).alias("embedding"))
    there = nodes.select(F.col(node_id).alias("node_id"), F.col(vec_col).alias("embedding"))
    found = best_matches(asked, there, k, least, skip_same=True)
    return dedupe_pairs(found, "query_id", "node_id", "similarity")


def similar_pairs(nodes: DataFrame, least: float, node_id: str = "node_id", vec_col: str = "embedding") -> DataFrame:
    """a < b, similarity of all pairs with a cosine of `least`; exact, block by block."""
    found = best_matches(nodes.select(F.col(node_id).alias("query_id"), F.col(vec_col).alias("embedding")), nodes.select(F.col(node_id).alias("node_id"), F.col(vec_col).alias("embedding")), None, least, skip_same=True)
    return found.where("query_id < node_id").select(F.col("query_id").alias("a"), F.col("node_id").alias("b"), "similarity")


def similar_links(nodes: DataFrame, least: float, within: str | None = None, node_id: str = "node_id", vec_col: str = "embedding") -> DataFrame:
    """a < b, similarity: links between nodes of a cosine of `least` that join the same
    nodes as all such pairs do. Equal vectors are linked to their least id alone, so n
    of them give n - 1 links; of different vectors all pairs are there. within: a
    column in which linked nodes agree."""
    same = F.col(within).cast("string") if within else F.lit("")
    own = nodes.where(sound(vec_col)).select(F.col(node_id).alias("b"), F.col(vec_col).alias("v"), same.alias("w")).withColumn("key", F.struct("w", "v"))
    keyed = settled(own.where(F.col("b").isNotNull()))
    first = settled(keyed.groupBy("key").agg(F.min("b").alias("a"), F.count("*").alias("n")))
    copies = join_unique(keyed, first, "key", "n").where("a < b").select("a", "b", F.round(cosine("v", "v"), 12).alias("similarity")).where(F.col("similarity") >= least)
    heads = first.select(F.col("a").alias("node_id"), "key.w", F.col("key.v").alias("embedding"))
    pairs = similar_pairs(heads, least)
    named = lambda c: heads.select(F.col("node_id").alias(c), F.col("w").alias(f"{c}_w"))
    met = pairs.join(named("a"), "a").join(named("b"), "b").where(F.col("a_w").eqNullSafe(F.col("b_w"))) if within else pairs
    return copies.unionByName(met.select("a", "b", "similarity"))


def semantic_dedupe(nodes: DataFrame, verdicts: DataFrame, least: float = DUPLICATE_FROM, node_id: str = "node_id", vec_col: str = "embedding") -> DataFrame:
    """node_id, canonical: nodes to merge. Pairs of a cosine of `least` that a verdict
    (id_a, id_b, same_subject) confirms are joined, and each component's least id is
    canonical. Components merge more than a greedy pass over the pairs would, but
    they depend on no order and leave no chains. Only the verdicts' pairs are measured."""
    said = verdicts.where("same_subject and id_a <> id_b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()
    own = nodes.where(sound(vec_col)).select(F.col(node_id).alias("id"), F.col(vec_col).alias("v"))
    side = lambda c: own.select(F.col("id").alias(c), F.col("v").alias(f"v_{c}"))
    measured = said.join(side("a"), "a").join(side("b"), "b").withColumn("similarity", _filled_cosine("v_a", "v_b"))
    return merged_components(measured.where(F.col("similarity") >= least).select("a", "b"))


def merged_components(pairs: DataFrame) -> DataFrame:
    """node_id, canonical of the nodes that confirmed pairs (a, b) merge into a smaller id."""
    return components(pairs).where("node <> root").select(F.col("node").alias("node_id"), F.col("root").alias("canonical"))


def resolve_canonical(nodes: DataFrame, rounds: int = 40) -> DataFrame:
    """node_id, canonical: where merged_into leads in the end, following chains. Each round
    doubles the steps; a circle ends at one of its own nodes."""
    now = settled(nodes.select("node_id", F.coalesce("merged_into", "node_id").alias("canonical")))
    for _ in range(rounds):
        step = now.select(F.col("node_id").alias("_at"), F.col("canonical").alias("_to"))
        nxt = settled(now.join(step, now.canonical == step._at, "left").select("node_id", "canonical", F.coalesce("_to", "canonical").alias("to")))
        now = nxt.select("node_id", F.col("to").alias("canonical"))
        if nxt.where("canonical <> to").isEmpty():
            break
    return now


def answers(queries: DataFrame, nodes: DataFrame, k: int = MATCH_COUNT, least: float = ANSWER_FROM, skip_same: bool = False) -> DataFrame:
    """query_id, refused, top_similarity, context, prompt. nodes: node_id, title, content,
    embedding; queries: query_id, user_query, embedding. A query is refused where
    nothing matches or the best match is less similar than `least`."""
    asked = queries.where(F.trim(text("user_query")) != "")
    matches = best_matches(asked.select("query_id", "embedding"), nodes.select("node_id", "embedding"), k, skip_same=skip_same).join(nodes.select("node_id", "title", "content"), "node_id")
    chunk = F.concat(F.lit("Title: "), text("title"), F.lit("\nContent: "), text("content"))
    gathered = matches.groupBy("query_id").agg(F.max("similarity").alias("top_similarity"), F.array_sort(F.collect_list(F.struct("rank", chunk.alias("t")))).alias("m"))
    context = F.array_join(F.transform("m", lambda x: x["t"]), "\n\n---\n\n")
    refused = F.coalesce(F.col("top_similarity") < least, F.lit(True))
    out = asked.select("query_id", "user_query").join(gathered, "query_id", "left").withColumn("refused", refused).withColumn("context", F.when(~refused, context))
    prompt = F.concat(F.lit("Context:\n"), F.col("context"), F.lit("\n\nQuestion: "), F.trim("user_query"), F.lit("\n\nAnswer the question using only the context above."))
    return out.select("query_id", "refused", "top_similarity", "context", prompt.alias("prompt"))


def hashed_embedding(texts: list[str | None]) -> np.ndarray:
    """A text's words, hashed into EMBEDDING_SIZE signed places, as a unit vector: the embedder that needs no model."""
    import re
    import zlib
    from collections import Counter

    out = np.zeros((len(texts), EMBEDDING_SIZE), np.float32)
    places: dict[str, tuple[int, int]] = {}  # each word of the batch is hashed once
    for i, t in enumerate(texts):
        for w, n in Counter(re.findall(r"\w+", (t or "").lower())).items():
            if w not in places:
                h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                places[w] = (h >> 1) % EMBEDDING_SIZE, 1 if h & 1 else -1
            at, sign = places[w]
            out[i, at] += sign * n
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def embed(df: DataFrame, text_col: str, embedder: Callable[[list[str | None]], np.ndarray] = hashed_embedding, out_col: str = "embedding", batch: int = 32) -> DataFrame:
    """df with a vector of its text, made in batches in the tasks."""
    schema = df.select("*", F.lit(None).cast("array<float>").alias(out_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_col).to_pylist()
            vectors = [v for low in range(0, len(texts), batch) for v in embedder(texts[low : low + batch])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*b.schema.names, out_col])

    return df.mapInArrow(run, schema)


def judge(df: DataFrame, prompt_col: str, ask: Callable[[str], str], out: tuple[str, str, str] = ("ok", "raw", "error")) -> DataFrame:
    """df with a function's reply to each prompt. A call that fails gives ok = false and
    its error, and no reply; nothing is made up, and the job goes on."""
    extra = [F.lit(True).alias(out[0]), F.lit(None).cast("string").alias(out[1]), F.lit(None).cast("string").alias(out[2])]
    schema = df.select("*", *extra).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            replies = []
            for p in b.column(prompt_col).to_pylist():
                try:
                    replies.append((True, ask(p), None))
                except Exception as e:  # noqa: BLE001
                    replies.append((False, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r[0] for r in replies], pa.bool_()), *(pa.array([r[i] for r in replies], pa.string()) for i in (1, 2))], names=[*b.schema.names, *out])

    return df.mapInArrow(run, schema)
