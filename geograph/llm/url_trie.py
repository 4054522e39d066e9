"""URL filters: one trie over reversed host labels and then path segments,
broadcast to every task, with longest-match precedence between allow and block
entries. Rules too large for a broadcast are joined to the trie's nodes that each url
passes, with the same results. Either way a url costs time in proportion to its
length."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most bytes of a trie that is broadcast, and the bytes that a node of it takes at most beside its text.
MAX_TRIE_BYTES, NODE_BYTES = 64_000_000, 700


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without '://'."""
    if url is None:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    cut = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    rest = rest[:cut]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def build_trie(rules: list[tuple[str, str, str]]) -> dict:
    """rules: (host, path, verdict). Nodes are dicts: host labels from the right,
    then under "/" the path's full segments; the rest of a rule's path, after its
    last '/', is kept as a prefix of the next segment. Of equal rules with
    different verdicts, block holds."""
    root: dict = {}
    for host, path, verdict in sorted(rules):
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(("host", label), {})
        *segments, tail = path.split("/")
        for segment in segments:
            node = node.setdefault(("path", segment), {})
        ends = node.setdefault("ends", {})
        ends[tail] = (host + path, verdict)
        sizes = node.setdefault("sizes", [])  # lengths of the tails, the longest first
        if len(tail) not in sizes:
            sizes.append(len(tail))
            sizes.sort(reverse=True)
    return root


def trie_bytes(rules: DataFrame) -> int:
    """A bound of the bytes of a trie of these rules."""
    nodes = F.size(F.split(F.coalesce("host", F.lit("")), r"\.")) + F.size(F.split(F.coalesce("path", F.lit("")), "/")) + 1
    text = 4 * (F.length(F.coalesce("host", F.lit(""))) + F.length(F.coalesce("path", F.lit(""))))
    return rules.agg(F.sum(nodes * NODE_BYTES + 2 * text)).first()[0] or 0


def _longest_end(node: dict, segment: str) -> tuple[str, str] | None:
    for n in node.get("sizes", ()):
        if n <= len(segment) and (found := node["ends"].get(segment[:n])):
            return found
    return None


def match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """The rule with the longest host and, of those, the longest path."""
    nodes, node = [], trie
    for label in reversed(host.split(".")):
        node = node.get(("host", label))
        if node is None:
            break
        nodes.append(node)
    segments = path.split("/")
    for node in reversed(nodes):
        best = None
        for segment in segments:
            best = _longest_end(node, segment) or best
            node = node.get(("path", segment))
            if node is None:
                break
        if best:
            return best
    return None


def _places(host: str, path: str, labels: int, depth: int, longest: int) -> Iterator[tuple[bytes, int, str]]:
    """The trie's nodes that a url passes, as deep as rules go: a digest of host suffix and
    full segments, the suffix's labels, and the beginning of the segment after them."""
    suffixes, at = [], len(host)
    for _ in range(min(labels, host.count(".") + 1)):
        at = host.rfind(".", 0, at)
        suffixes.append(host[at + 1 :])
    segments = path.split("/", depth + 1)[: depth + 1]
    for n, suffix in enumerate(suffixes):
        node = hashlib.sha256(f"{suffix}\0".encode())
        for segment in segments:
            yield node.copy().digest(), n + 1, segment[:longest]
            node.update(f"{segment}/".encode())


def match_by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url (its digest), rule, verdict of each distinct url (column url, not null) that a rule fits.

    Nodes meet rules by equal keys alone: the node's digest, then the beginnings of the
    next segment that are as long as one of the node's rules asks. A url has as many
    nodes as the rules' hosts have labels, times their paths' segments, at most.
    """
    ends = rules.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    tail = F.substring_index("path", "/", -1)
    above = F.substr("path", F.lit(1), F.length("path") - F.length(tail))
    ends = ends.select("host", tail.alias("tail"), "path", "verdict", F.unhex(F.sha2(F.concat("host", F.lit("\0"), above), 256)).alias("node"))
    most = ends.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.max(F.size(F.split("path", "/")) - 1).alias("depth"), F.max(F.length("tail")).alias("longest")).first()
    bounds = [n or 0 for n in most]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 256):
                rows = [(hashlib.sha256(u.encode()).digest(), *p) for u in b.column(0)[low : low + 256].to_pylist() for p in _places(*split_url(u), *bounds)]
                kinds = (pa.binary(), pa.binary(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["url", "node", "labels", "segment"])

    passed = urls.select("url").distinct().mapInArrow(walk, "url binary, node binary, labels int, segment string")
    sizes = ends.groupBy("node").agg(F.collect_set(F.length("tail")).alias("sizes"))
    held = passed.join(sizes, "node")
    tails = F.filter("sizes", lambda n: n <= F.length("segment"))
    fits = held.select("url", "node", "labels", F.explode(F.transform(tails, lambda n: F.substr("segment", F.lit(1), n))).alias("tail")).join(ends, ["node", "tail"])
    best = F.max_by(F.struct(F.concat("host", "path").alias("rule"), "verdict"), F.struct("labels", F.length("path")))
    return fits.groupBy("url").agg(best.alias("b")).select("url", "b.rule", "b.verdict")


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule, verdict of each url.

    rules: host, path, verdict ('allow' or 'block'). A trie of at most MAX_TRIE_BYTES
    is sent to every task; more rules are joined, with the same results. Of
    equal rules with different verdicts, block holds. A null url, or one without
    '://', has an empty host and path, no rule (unless one has an empty host), and
    the default verdict; so has a url that no rule fits. Urls of any length are
    read whole. Repeated rows are judged alike; other columns of pages are not read.
    """
    if trie_bytes(rules) > MAX_TRIE_BYTES:
        found = match_by_join(pages.select(F.coalesce(F.col(url_col), F.lit("")).alias("url")), rules)
        keyed = filter_urls(pages.select(F.struct(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url")).alias("key"), F.col(url_col).alias("url")), rules.limit(0), "key", "url", default)
        both = keyed.select("key.id", F.unhex(F.sha2("key.url", 256)).alias("url"), "host", "path").join(found, "url", "left")
        return both.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    trie = pages.sparkSession.sparkContext.broadcast(build_trie([(r.host or "", r.path or "", r.verdict) for r in rules.select("host", "path", "verdict").collect()]))  # at most MAX_TRIE_BYTES

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [split_url(u) for u in b.column(1).to_pylist()]
            found = [match(trie.value, h, p) for h, p in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array([f and f[0] for f in found], pa.string()),
                    pa.array([f[1] if f else default for f in found], pa.string()),
                ],
                names=[id_col, "host", "path", "rule", "verdict"],
            )

    schema = T.StructType([pages.schema[id_col], *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict"))])
    return pages.select(id_col, url_col).mapInArrow(judge, schema)
