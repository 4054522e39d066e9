"""Chat formatting as a prefix tree.

Conversations that share initial turns share those turns' nodes. A node belongs
to the smallest conversation that passes through it, so each conversation owns one
run of nodes at the end of its path, its chain, and the tree is laid out chain by
chain in depth-first order: every node's tokens are emitted once, with the positions
they have in the conversation, and with the intervals of the layout that they may
attend to. Marks around turns are tokens of their own, beyond the tokenizer's ids,
and head, message and end of a turn are encoded apart, so that shared turns have
equal tokens and the loss mask falls on token bounds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import running_total, shuffle_partitions, stage_table
from .token_counts import encode_whole, encoding

START, END = "<|im_start|>", "<|im_end|>\n"
#: Stands for a null conversation id while conversations are put in order.
NO_ID = -(1 << 63)
#: A node with over 1 / HOT of all turns is hot; there are at most HOT of them. Their rows are dealt to SALTS keys.
HOT, SALTS = 2000, 64
#: Turns that a task holds as Python lists at a time.
TURNS_AT_ONCE = 512


def escape(text: str) -> str:
    """One backslash more between each '<' and '|', so that no '<|' is left."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The turn's formatted text, and where the message begins and ends in it."""
    head = START + escape((role or "").replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
    body = escape(text or "")
    return head + body + END, len(head), len(head) + len(body)


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if not formatted.startswith(START) or not formatted.endswith(END):
        raise ValueError("not a turn")
    role, _, body = formatted[len(START) : -len(END)].partition("\n")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))
    return role, unescape(body)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices, as lists of tokens take many times their bytes."""
    for b in batches:
        for low in range(0, b.num_rows, TURNS_AT_ONCE):
            yield b.slice(low, TURNS_AT_ONCE)


def encode_turn(tokenizer, role: str | None, text: str | None) -> tuple[list[int], int, int]:
    """The turn's tokens, and where the message begins and ends in them. The marks have the ids after the tokenizer's last."""
    formatted, begin, end = format_turn(role, text)
    head = [tokenizer.n_vocab, *encode_whole(tokenizer, formatted[len(START) : begin])]
    body = encode_whole(tokenizer, formatted[begin:end])
    return [*head, *body, tokenizer.n_vocab + 1, *tokenizer.encode_ordinary(END[-1])], len(head), len(head) + len(body)


def decode_turn(tokenizer, tokens: list[int]) -> str:
    """The formatted text of a turn's tokens."""
    end = len(tokens) - 1 - tokens[::-1].index(tokenizer.n_vocab + 1)
    return START + tokenizer.decode(tokens[1:end]) + END[:-1] + tokenizer.decode(tokens[end + 1 :])


_TURN = (("conv", T.LongType(), pa.int64()), ("nth", T.LongType(), pa.int64()), ("node", T.BinaryType(), pa.binary()), ("position", T.LongType(), pa.int64()), ("length", T.LongType(), pa.int64()), ("loss_begin", T.LongType(), pa.int64()), ("loss_end", T.LongType(), pa.int64()), ("tokens", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())))


def _turns(conversations: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Each turn, in its conversation's order, with its node: a digest of all turns up to it."""
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition(shuffle_partitions(rows.sparkSession), "conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, _ = encoding(ranks_path, pattern)
        conv, nth, position, digest = None, 0, 0, b""
        for b in _parts(batches):
            out = []
            for c, role, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if c != conv:
                    conv, nth, position, digest = c, 0, 0, b""
                tokens, begin, end = encode_turn(tokenizer, role, text)
                formatted = format_turn(role, text)[0]
                digest = hashlib.blake2b(digest + formatted.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                lost = role == "assistant"
                out.append((c, nth, digest, position, len(tokens), begin if lost else 0, end if lost else 0, tokens))
                nth, position = nth + 1, position + len(tokens)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, (_, _, kind) in enumerate(_TURN)], names=[name for name, _, _ in _TURN])

    return stage_table(ordered.mapInArrow(chain, T.StructType([T.StructField(n, t) for n, t, _ in _TURN])), "turns")


def join_by_node(left: DataFrame, right: DataFrame, hot: DataFrame) -> DataFrame:
    """left joined to right, which has each node once. Rows of the hot nodes (at most HOT,
    so they are broadcast) are dealt to SALTS keys, and the right side's are copied."""
    marked = lambda df: df.join(F.broadcast(hot.select("node", F.lit(True).alias("_hot"))), "node", "left")
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("conv", "nth"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    dealt = marked(left).withColumn("_salt", salt).drop("_hot")
    return dealt.join(marked(right).withColumn("_salt", F.explode(salts)).drop("_hot"), ["node", "_salt"]).drop("_salt")


def _paths(owned: DataFrame) -> DataFrame:
    """conv, links: for each chain on a conversation's path, in order: its owner, the
    nth turn and the position where it begins, and its tokens on this path."""
    ordered = owned.select("conv", "nth", "owner", "position", "length").repartition(shuffle_partitions(owned.sparkSession), "conv").sortWithinPartitions("conv", "nth")
    link = pa.struct([("owner", pa.int64()), ("nth", pa.int64()), ("position", pa.int64()), ("size", pa.int64())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, links = None, []
        for b in batches:
            out = []
            for c, nth, owner, position, length in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if c != conv:
                    if links:
                        out.append((conv, links))
                    conv, links = c, []
                if not links or links[-1]["owner"] != owner:
                    links.append({"owner": owner, "nth": nth, "position": position, "size": 0})
                links[-1]["size"] += length
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([x for _, x in out], pa.list_(link))], names=["conv", "links"])
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([links], pa.list_(link))], names=["conv", "links"])

    return ordered.mapInArrow(walk, "conv long, links array<struct<owner: long, nth: long, position: long, size: long>>")


def build_tree(conversations: DataFrame, ranks_path: str, pattern: str) -> dict[str, DataFrame]:
    """The tables of the tree of conversations (conv_id, turn, role, text), in tokens of a ranks file.

    nodes: tree, offset (of the node's first token in the tree's layout), position (in
    its conversations; the position ids of its tokens follow from it), length,
    loss_begin and loss_end (the assistant's message inside the node, else 0), tokens,
    node, and ancestors, the intervals [begin, end) of the layout before the node
    that its tokens attend to besides the node's own; intervals that touch are one.
    members: conv, conv_id, nth, node for every turn of every conversation.
    hot: node, of the nodes that very many conversations share.

    Turns go by `turn`, then role and text; repeated rows are turns that repeat. A
    null text or role counts as empty, a null turn comes first, and rows with a
    null conv_id form one conversation. Texts of any length are encoded whole, a
    turn at a time. Other columns are not read. An empty table gives empty tables.
    """
    turns = _turns(conversations, ranks_path, pattern)
    owners = stage_table(turns.groupBy("node").agg(F.min("conv").alias("owner"), F.count("*").alias("turns")), "owners")
    total = turns.count()
    hot = owners.where(F.col("turns") * HOT > total).select("node")
    owned = stage_table(join_by_node(turns.drop("tokens"), owners.select("node", "owner"), hot), "owned")
    paths = stage_table(_paths(owned), "paths")
    last = F.element_at("links", -1)
    order = F.transform("links", lambda x: F.struct((-x["nth"]).alias("turn"), x["owner"].alias("owner")))
    chains = paths.where(last["owner"] == F.col("conv")).select("conv", F.element_at("links", 1)["owner"].alias("tree"), order.alias("order"), last["size"].alias("size"), last["position"].alias("begins"))
    laid = stage_table(running_total(chains, "size", ["order"], ["tree"], "chains").select(F.col("conv").alias("owner"), "tree", "begins", F.col("start").alias("chain_offset")), "laid")
    before = paths.where(last["owner"] == F.col("conv")).select("conv", F.posexplode("links").alias("k", "link")).where("link.owner <> conv").select("conv", "k", "link.owner", "link.size")
    spans = before.join(laid.select("owner", "chain_offset"), "owner").groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("k", F.col("chain_offset").alias("begin"), (F.col("chain_offset") + F.col("size")).alias("end")))).alias("s"))
    spans = spans.select(F.col("conv").alias("owner"), F.transform("s", lambda x: F.struct(x["begin"].alias("begin"), x["end"].alias("end"))).alias("above"))
    own = turns.join(owned.where("conv = owner").select("conv", "nth", "owner"), ["conv", "nth"]).join(laid, "owner").join(spans, "owner", "left")
    offset = F.col("chain_offset") + F.col("position") - F.col("begins")
    none = F.array().cast("array<struct<begin: bigint, end: bigint>>")
    inside = F.when(offset > F.col("chain_offset"), F.array(F.struct(F.col("chain_offset").alias("begin"), offset.alias("end")))).otherwise(none)
    placed = own.withColumns({"offset": offset, "_a": F.concat(F.coalesce("above", none), inside)})
    begins = F.filter("_a", lambda x, i: (i == 0) | (x["begin"] != F.get(F.col("_a"), i - 1)["end"]))
    ends = F.filter("_a", lambda x, i: (i == F.size("_a") - 1) | (x["end"] != F.get(F.col("_a"), i + 1)["begin"]))
    conv_id = F.when(F.col("conv") != NO_ID, F.col("conv")).alias("conv_id")
    return {
        "nodes": placed.select(F.when(F.col("tree") != NO_ID, F.col("tree")).alias("tree"), "offset", "position", "length", "loss_begin", "loss_end", "tokens", "node", F.zip_with(begins, ends, lambda x, y: F.struct(x["begin"].alias("begin"), y["end"].alias("end"))).alias("ancestors")),
        "members": owned.select("conv", conv_id, "nth", "node"),
        "hot": hot,
    }


def read_back(tree: dict[str, DataFrame], ranks_path: str, pattern: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all
    decoded from the tree's tokens. Hashes are fed turn by turn, so that a
    conversation of any length takes the memory of one turn."""
    rows = join_by_node(tree["members"], tree["nodes"].select("node", "tokens", "loss_begin", "loss_end"), tree["hot"])
    ordered = rows.repartition(shuffle_partitions(rows.sparkSession), "conv").sortWithinPartitions("conv", "nth").select("conv_id", "nth", "tokens", "loss_begin", "loss_end")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, _ = encoding(ranks_path, pattern)
        conv, n, turns, lost, loss, chars = None, 0, None, 0, None, 0
        for b in _parts(batches):
            out = []
            for c, nth, tokens, begin, end in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if not nth:
                    if n:
                        out.append((conv, n, turns.hexdigest(), lost, loss.hexdigest(), chars))
                    conv, n, turns, lost, loss, chars = c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                formatted = decode_turn(tokenizer, tokens)
                role, text = read_turn(formatted)
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if end:
                    said = unescape(tokenizer.decode(tokens[begin:end]))
                    loss.update(said.encode("utf-8", "surrogatepass"))
                    lost += len(said)
                n, chars = n + 1, chars + len(formatted)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((conv, n, turns.hexdigest(), lost, loss.hexdigest(), chars), kinds, strict=True)], names=names)

    return ordered.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
