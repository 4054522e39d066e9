"""A distributed positional inverted index of training texts, exact phrase and proximity
search in it, and benchmark decontamination by it.

The index is a table of segments. A segment holds some texts' words as postings: the
terms, and for each term the places where it stands, in order. No text crosses a
segment, so a search needs no shuffle: every segment is asked for all queries, whose
number in one broadcast is bounded; more go in blocks. In a segment a query starts from
the list of its rarest term there, and the others' lists, moved by their offsets in the
query, are intersected with it from the rarer to the more common ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage_table
from .wordbytes import chunks, text_column, word_array, words

#: Bytes of texts in a segment, and words of a text that one of its pieces owns.
SEGMENT, PIECE = 1 << 22, 1 << 18
#: Words around its own that a piece holds: the longest phrase and the widest span that can be asked for.
REACH = 64
#: Most queries, and bytes of their words and names, in one broadcast.
ASKED, ASKED_BYTES = 100_000, 1 << 24
#: Places that are held against the lists at a time.
AT_ONCE = 1 << 21


def _each(counts: np.ndarray, starts: np.ndarray | int = 0) -> np.ndarray:
    """starts[i], starts[i] + 1, ... of counts[i] numbers for each i."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - starts, counts)


def _ranges(running: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of a running sum that add at most `most`, or are one row."""
    low, before = 0, 0
    while low < len(running):
        high = max(low + 1, int(np.searchsorted(running, before + most, "right")))
        yield low, high
        low, before = high, int(running[high - 1])


def build_index(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """The staged table of segments of a table of texts.

    terms: the segment's words; counts, gaps: for each of them how many postings it has,
    and the steps between them. rows, ids, begins, owned, held: for each piece its
    text's row and id, the number of its first own word, how many words it owns and how
    many it holds. A text of over PIECE words is cut into pieces, which own its words
    and hold up to reach - 1 more on either side. Places count the words that the
    pieces hold, one after the other. Null and empty texts have a piece without words.
    """
    schema = T.StructType.fromDDL("terms array<string>, counts binary, gaps binary, rows array<bigint>, begins binary, owned binary, held binary").add("ids", T.ArrayType(texts.schema[id_col].dataType))

    def segment(ids: pa.Array, row: int, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        found, at, counts = words(data, offsets)
        encoded = word_array(found, at).dictionary_encode()
        names, code = encoded.dictionary, encoded.indices.to_numpy()
        cut = np.maximum(1, -(-counts // PIECE))
        of = np.repeat(np.arange(len(counts)), cut)
        begin = _each(cut) * PIECE
        own = np.minimum(counts[of] - begin, PIECE)
        left = np.minimum(begin, reach - 1)
        held = left + own + np.minimum(counts[of] - begin - own, reach - 1)
        if len(of) > len(counts):  # some words stand in two pieces
            code = code[_each(held, (np.cumsum(counts) - counts)[of] + begin - left)]
        places = np.argsort(code, kind="stable").astype(np.int32)
        sizes = np.bincount(code, minlength=len(names))
        gaps = np.diff(places, prepend=np.int32(0))
        first = np.cumsum(sizes) - sizes
        gaps[first] = places[first]
        raw = lambda x, kind=np.int32: pa.array([x.astype(kind).tobytes()], pa.binary())
        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        terms = names.cast(pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([whole(terms), raw(sizes), raw(gaps), whole(pa.array(row + of)), raw(begin, np.int64), raw(own), raw(held), whole(ids.take(pa.array(of)))], names=schema.names)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for b in batches:
            data, offsets = text_column(b.column(1))
            for low, high in chunks(offsets, SEGMENT):
                yield segment(b.column(0).slice(low, high - low), row + low, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            row += b.num_rows

    return stage_table(texts.select(id_col, text_col).mapInArrow(build, schema), "postings")


def windows(items: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """name, words of each run of `width` words of each item; of all words of a shorter one. Items without words have none; a null id is an empty name."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_column(b.column(1))
            for low, high in chunks(offsets):
                found, at, counts = words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                terms = word_array(found, at).cast(pa.binary()).cast(pa.string())
                runs = np.where(counts > 0, np.maximum(1, counts - width + 1), 0)
                of = np.repeat(np.arange(len(counts)), runs)
                start, size = _each(runs, np.cumsum(counts) - counts), np.minimum(counts[of], width)
                for some, stop in _ranges(np.cumsum(size), 1 << 20):
                    own = size[some:stop]
                    run = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(own)].astype(np.int32)), terms.take(pa.array(_each(own, start[some:stop]))))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(low + of[some:stop])), run], names=["name", "words"])

    named = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).alias("text"))
    return named.mapInArrow(cut, "name string, words array<string>").distinct()


def query_blocks(asked: DataFrame, reach: int = REACH) -> list[DataFrame]:
    """asked (name, words of 1 to `reach` words) in blocks that a broadcast can hold, one at least."""
    held = stage_table(asked.where(F.size("words") > 0).select("name", "words"), "asked")
    found = held.agg(F.count("*").alias("n"), F.sum(F.length(F.concat_ws(" ", "words")) * 4 + F.length("name") * 4 + 16).alias("bytes"), F.max(F.size("words")).alias("longest")).first()
    if (found.longest or 0) > reach:
        raise ValueError(f"queries have at most {reach} words")
    n = max(1, -(-found.n // ASKED), -(-(found.bytes or 0) // ASKED_BYTES))
    return [held.where(F.pmod(F.xxhash64("name", "words"), F.lit(n)) == i) for i in range(n)]


@dataclass
class Queries:
    """Distinct queries: their terms, for each query the places of its words among the terms, and the names of those who ask it."""

    terms: pa.Array
    words: np.ndarray
    at: np.ndarray
    names: np.ndarray
    names_at: np.ndarray

    @classmethod
    def of(cls, asked: list[tuple[str, list[str]]]) -> Queries:
        by: dict[tuple[str, ...], set[str]] = {}
        for name, query in asked:
            by.setdefault(tuple(query), set()).add(name)
        place: dict[str, int] = {}
        flat = [place.setdefault(w, len(place)) for q in by for w in q]
        bounds = lambda xs: np.r_[0, np.cumsum([len(x) for x in xs], dtype=np.int64)]
        return cls(pa.array([*place], pa.string()), np.array(flat, np.int64), bounds(by), np.array([n for names in by.values() for n in sorted(names)], object), bounds(by.values()))

    @classmethod
    def shared(cls, block: DataFrame):
        """A broadcast of a block of queries, of at most ASKED rows and ASKED_BYTES bytes."""
        return block.sparkSession.sparkContext.broadcast(cls.of([(r.name, list(r.words)) for r in block.collect()]))

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.at)


class Segment:
    """An opened segment: its pieces, and the lists of those of its terms that are asked for."""

    def __init__(self, b: pa.RecordBatch, k: int, asked: pa.Array, reach: int):
        at = {name: b.column(i)[k] for i, name in enumerate(b.schema.names)}
        numbers = lambda name, kind=np.int32: np.frombuffer(at[name].as_py(), kind).astype(np.int64)
        self.rows, self.ids = at["rows"].values, at["ids"].values
        self.word0, self.own, self.held = numbers("begins", np.int64), numbers("owned"), numbers("held")
        self.place = np.cumsum(self.held) - self.held
        self.left = np.minimum(self.word0, reach - 1)
        self.total = max(1, int(self.held.sum()))
        sizes, gaps = numbers("counts"), np.frombuffer(at["gaps"].as_py(), np.int32)
        own = pc.index_in(asked, value_set=at["terms"].values).fill_null(-1).to_numpy(zero_copy_only=False)
        there = np.flatnonzero(own >= 0)
        self.count = np.zeros(len(asked), np.int64)
        self.count[there] = sizes[own[there]]
        self.begin = np.cumsum(self.count) - self.count
        opened = gaps[_each(sizes[own[there]], (np.cumsum(sizes) - sizes)[own[there]])].astype(np.int64)
        first = self.begin[there]
        run = np.cumsum(opened)
        self.places = run - np.repeat(run[first] - opened[first], self.count[there])
        self.keys = np.repeat(np.arange(len(asked)), self.count) * self.total + self.places  # rising: each term's places in order

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the terms stand at these places."""
        want = term * self.total + place
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return (place >= 0) & (place < self.total) & (self.keys[at] == want)

    def piece_of(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece in which a run of places begins, and whether it ends there as well."""
        piece = np.searchsorted(self.place + self.held, first, "right")
        return piece, last < self.place[piece] + self.held[piece]


def phrase_places(seg: Segment, q: Queries) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, first place, last place) of all occurrences, as if the segment were one text."""
    sizes = q.sizes
    rarest = np.minimum.reduceat(seg.count[q.words], q.at[:-1]) if len(sizes) else sizes
    live = np.flatnonzero(rarest)
    for low, high in _ranges(np.cumsum(rarest[live]), AT_ONCE):
        some = live[low:high]
        size = sizes[some]
        offset, word = _each(size), q.words[_each(size, q.at[some])]
        order = np.lexsort((offset, seg.count[word], np.repeat(np.arange(len(some)), size)))
        word, offset, head = word[order], offset[order], np.cumsum(size) - size  # each query's words, the rarest first
        n = seg.count[word[head]]
        of = np.repeat(np.arange(len(some)), n)
        place = seg.places[_each(n, seg.begin[word[head]])] - offset[head][of]
        for j in range(1, int(size.max())):
            more = np.flatnonzero(size[of] > j)
            at = head[of[more]] + j
            good = np.ones(len(of), bool)
            good[more] = seg.has(word[at], place[more] + offset[at])
            of, place = of[good], place[good]
        yield some[of], place, place + size[of] - 1


def near_places(seg: Segment, q: Queries, span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, first place, last place) of the narrowest runs of at most `span` words that hold all distinct words of a query, as if the segment were one text."""
    for i in range(len(q.sizes)):
        terms = np.unique(q.words[q.at[i] : q.at[i + 1]])
        rarest, *others = sorted((seg.places[seg.begin[t] : seg.begin[t] + seg.count[t]] for t in terms), key=len)
        if not len(rarest):
            continue
        last = rarest
        for own in others:  # a run ends at most span - 1 words after the rarest term
            last = np.union1d(last, own[np.searchsorted(rarest, own, "right") > np.searchsorted(rarest, own - span, "right")])
        first = last
        for own in (rarest, *others):  # the last place of each term before the end
            at = np.searchsorted(own, last, "right") - 1
            first = np.minimum(first, np.where(at >= 0, own[np.maximum(at, 0)], -span))
        fine = (first >= 0) & (last - first < span)
        first, last = first[fine], last[fine]
        narrow = np.flatnonzero(np.diff(first, prepend=-1))  # of runs that begin alike the shortest
        yield np.full(len(narrow), i), first[narrow], last[narrow]


def search(index: DataFrame, asked: DataFrame, span: int | None = None, reach: int = REACH) -> DataFrame:
    """row, id, name, first, last: the exact matches of queries (name, words) in the index.

    Without span, phrases: the words in order, next to each other. With span, proximity:
    the narrowest runs of at most `span` words that hold every distinct word of the
    query. first and last are the numbers of words in their text, from 0. Queries have at
    most `reach` words, and span is at most `reach`, with which the index was built;
    queries without words match nothing.
    """
    if (span or 0) > reach:
        raise ValueError(f"span is at most {reach}")
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", index.schema["ids"].dataType.elementType), *T.StructType.fromDDL("name string, first long, last long").fields])

    def one(block: DataFrame) -> DataFrame:
        shared = Queries.shared(block)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = shared.value
            for b in batches:
                for k in range(b.num_rows):
                    seg = Segment(b, k, q.terms, reach)
                    for of, first, last in phrase_places(seg, q) if span is None else near_places(seg, q, span):
                        piece, fine = seg.piece_of(first, last)
                        at = first - seg.place[piece] - seg.left[piece]  # from the piece's own words
                        fine &= (at >= 0) & (at < seg.own[piece])
                        of, first, last, piece, at = (x[fine] for x in (of, first, last, piece, at))
                        n = np.diff(q.names_at)[of]
                        name, owner = q.names[_each(n, q.names_at[of])], pa.array(np.repeat(piece, n))
                        number = np.repeat(seg.word0[piece] + at, n)
                        yield pa.RecordBatch.from_arrays([seg.rows.take(owner), seg.ids.take(owner), pa.array(name, pa.string()), pa.array(number), pa.array(number + np.repeat(last - first, n))], names=schema.names)

        return index.mapInArrow(find, schema)

    first, *rest = [one(b) for b in query_blocks(asked, reach)]
    for more in rest:
        first = first.unionByName(more)
    return first


def marked(index: DataFrame, block: DataFrame, reach: int = REACH) -> DataFrame:
    """row, id, n_words, hits, names of each piece, for a block of phrases: its own words,
    the runs [first, end) of them that lie inside an occurrence, and who asked for what occurs."""
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", index.schema["ids"].dataType.elementType), *T.StructType.fromDDL("n_words long, hits array<array<bigint>>, names array<string>").fields])
    shared = Queries.shared(block)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for b in batches:
            for k in range(b.num_rows):
                seg = Segment(b, k, q.terms, reach)
                depth = np.zeros(seg.total + 1, np.int64)
                names: list[set[str]] = [set() for _ in seg.own]
                for of, first, last in phrase_places(seg, q):
                    piece, fine = seg.piece_of(first, last)
                    np.add.at(depth, first[fine], 1)
                    np.add.at(depth, last[fine] + 1, -1)
                    for x in np.unique(piece[fine] * len(q.sizes) + of[fine]).tolist():
                        p, i = divmod(x, len(q.sizes))
                        names[p].update(q.names[q.names_at[i] : q.names_at[i + 1]])
                begin = seg.place + seg.left
                own = np.flatnonzero(seg.own)
                inside = np.zeros(seg.total + 1, np.int8)
                inside[begin[own]] = 1
                np.add.at(inside, (begin + seg.own)[own], -1)
                hit = np.r_[(np.cumsum(depth[:-1]) > 0) & (np.cumsum(inside[:-1]) > 0), False]
                apart = np.zeros(seg.total + 1, bool)
                apart[begin[own]] = apart[(begin + seg.own)[own]] = True  # runs do not go on in the next piece
                starts = np.flatnonzero(hit & (apart | ~np.r_[False, hit[:-1]]))
                ends = np.flatnonzero(hit[:-1] & (apart[1:] | ~hit[1:])) + 1
                of = np.searchsorted(seg.place + seg.held, starts, "right")
                moved = (seg.word0 - begin)[of]
                runs = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(of) + 1, 2, dtype=np.int32)), pa.array(np.column_stack([starts + moved, ends + moved]).ravel()))
                hits = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(seg.own) + 1)).astype(np.int32)), runs)
                yield pa.RecordBatch.from_arrays([seg.rows, seg.ids, pa.array(seg.own), hits, pa.array([sorted(n) for n in names], pa.list_(pa.string()))], names=schema.names)

    return index.mapInArrow(mark, schema)


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated of every document.

    A window is `width` consecutive words of an item, or all words of a shorter one. A
    document's word is hit inside any occurrence of a window; items are those with a
    window that occurs, and items_sha256 the digest of their ids, sorted as strings
    and joined by commas. Null and empty texts have no words; items without words
    have no window; a null item id counts as an empty one. Rows of one item id are one
    item. Repeated documents are judged each; texts of any length are read whole. An
    empty table of items hits nothing, an empty table of documents gives no rows.
    Other columns are not read.
    """
    reach = max(REACH, width)
    index = build_index(docs, id_col, text_col, reach)
    blocks = [marked(index, b, reach).withColumn("n_words", F.col("n_words") * F.lit(int(i == 0))) for i, b in enumerate(query_blocks(windows(items, width, item_col, item_text), reach))]
    pieces = blocks[0]
    for more in blocks[1:]:
        pieces = pieces.unionByName(more)
    whole = pieces.groupBy("row").agg(F.first("id").alias(id_col), F.sum("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))
    start = F.struct(F.lit(0).cast("long").alias("up_to"), F.lit(0).cast("long").alias("n"))
    grow = lambda s, x: F.struct(F.greatest(s["up_to"], x[1]).alias("up_to"), (s["n"] + F.greatest(F.lit(0).cast("long"), x[1] - F.greatest(s["up_to"], x[0]))).alias("n"))
    n_hit = F.aggregate(F.array_sort("hits"), start, grow, lambda s: s["n"])
    digest = F.sha2(F.array_join("names", ","), 256)
    return whole.select(id_col, "n_words", n_hit.alias("n_hit"), F.size("names").cast("long").alias("n_items"), digest.alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)
