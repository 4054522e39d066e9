"""Token counts by offset-mapped attribution.

A document, all its fields joined, is encoded once, as a whole. Its tokens' spans are
then interval-joined to the spans of its fields' sections, and a token that crosses
a boundary is allocated by an explicit rule.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: 'first': a token counts where its first character is; 'last': where its last one is.
RULES = ("first", "last")
_encodings: dict[tuple[str, str], tuple] = {}
#: White space of so many characters is taken out of a text's way: the tokenizer's own pattern overflows its stack on about a million.
LONG_SPACE = 100_000
_parting: dict[str, bool] = {}


def encoding(path: str, pattern: str) -> tuple:
    """The tokenizer of a ranks file and the number of bytes of each token; made once in each worker."""
    if (path, pattern) not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _encodings[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return _encodings[path, pattern]


def parts_at_space(pattern: str) -> bool:
    """True for patterns that always part a text where white space follows anything else (but for the space before a word)."""
    import regex

    if pattern not in _parting:
        _parting[pattern] = all(regex.search(pattern, c + space + "x", pos=0)[0] == c for c in "a1.é名_" for space in ("   ", "\n\n\n", "\r\n\t"))
    return _parting[pattern]


def encode_whole(tokenizer, text: str) -> list[int]:
    """The ids of a text as a whole, however long its white space.

    Very long runs of it are parted by a regular expression without recursion, as the
    pattern parts them, and encoded piece by piece; what stands between them by the
    tokenizer. With a pattern that joins white space to what is before, all pieces
    of such a text are found that way.
    """
    import regex

    long = [m for m in regex.finditer(r"\p{White_Space}{2}\p{White_Space}*+", text) if m.end() - m.start() >= LONG_SPACE] if len(text) >= LONG_SPACE else []
    if not long:
        return tokenizer.encode_ordinary(text)
    pattern = tokenizer._pat_str
    piece = lambda m: tokenizer._encode_single_piece(m[0])
    if not parts_at_space(pattern):
        return [i for m in regex.finditer(pattern, text) for i in piece(m)]
    ids, at = [], 0
    for run in long:
        ids += tokenizer.encode_ordinary(text[at : run.start()])
        at = run.start()
        for m in regex.finditer(pattern, text[run.start() : run.end() + 1]):
            if run.start() + m.end() > run.end():  # goes on in what follows
                break
            ids += piece(m)
            at = run.start() + m.end()
    return ids + tokenizer.encode_ordinary(text[at:])


def lines(text: str) -> list[tuple[int, int]]:
    """Each line with its line feed. They cover the text, so each token counts once."""
    data = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(data == 10) + 1
    bounds = np.unique(np.r_[0, ends, len(data)])
    return [*zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def allocate(token_bytes: np.ndarray, data: np.ndarray, spans: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """For each span of characters: the tokens that count for it, and those that cross its bounds.

    A token's place is given in bytes, of which a character has one to four; a
    token that holds only a part of a character lies in that character.
    """
    char_starts = np.flatnonzero((data & 0xC0) != 0x80)
    place = np.append(char_starts, len(data))
    ends = np.cumsum(token_bytes)
    starts = ends - token_bytes
    first = np.searchsorted(char_starts, starts, "right") - 1  # the token's first and last character
    last = np.searchsorted(char_starts, ends - 1, "right") - 1
    begin, end = spans[:, 0], spans[:, 1]
    if len(place) <= 1:
        return np.zeros(len(spans), np.int64), np.zeros(len(spans), np.int64)
    by = first if rule == "first" else last
    counted = np.searchsorted(by, end, "left") - np.searchsorted(by, begin, "left")
    touching = np.searchsorted(first, end, "left") - np.searchsorted(last, begin, "left")
    inside = np.maximum(np.searchsorted(last, end, "left") - np.searchsorted(first, begin, "left"), 0)
    empty = end <= begin
    return np.where(empty, 0, counted), np.where(empty, 0, touching - inside)


def whole(text: str) -> list[tuple[int, int]]:
    """The text as one section."""
    return [(0, len(text))]


def attribute(
    docs: DataFrame, ranks_path: str, pattern: str, fields: dict[str, Callable[[str], list[tuple[int, int]]]] | None = None, joiner: str = "\n", rule: str = "first", id_col: str = "doc_id"
) -> DataFrame:
    """id, field, section (from 0 in its field), begin, end (code points of the document),
    n_tokens, n_crossing, doc_tokens for each section of each field of each document.

    fields: string columns, in the order in which `joiner` joins them, each with a
    function that gives its text's spans of code points; they may overlap or leave
    gaps. Default: the lines of `text`. A null or empty field takes no part, and
    neither do its joiner's characters; a field without sections has no row, but
    counts in doc_tokens. Tokens between sections count for none. Texts of any
    length are encoded whole; repeated rows are counted each; other columns are not
    read; an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    fields = fields or {"text": lines}
    names = ["section", "begin", "end", "n_tokens", "n_crossing", "doc_tokens"]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("field", T.StringType()), *(T.StructField(n, T.LongType()) for n in names)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, lengths = encoding(ranks_path, pattern)
        for b in batches:
            at, of, parts = [], [], []
            for i in range(b.num_rows):
                values = [(name, sections, text) for n, (name, sections) in enumerate(fields.items()) if (text := b.column(n + 1)[i].as_py())]
                spans, start = [], 0
                for name, sections, text in values:
                    own = sections(text)
                    of += [name] * len(own)
                    spans += [(n, start + low, start + high) for n, (low, high) in enumerate(own)]
                    start += len(text) + len(joiner)
                if not spans:
                    continue
                record = joiner.join(text for _, _, text in values)
                sizes = lengths[encode_whole(tokenizer, record)]
                spans = np.array(spans, np.int64)
                counted, crossing = allocate(sizes, np.frombuffer(record.encode("utf-8", "surrogatepass"), np.uint8), spans[:, 1:], rule)
                at.append(np.full(len(spans), i))
                parts.append(np.column_stack([spans, counted, crossing, np.full(len(spans), len(sizes))]))
            if parts:
                rows = np.concatenate(parts)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(at))), pa.array(of, pa.string()), *(pa.array(np.ascontiguousarray(rows[:, j])) for j in range(6))], names=schema.names)

    return docs.select(F.col(id_col), *[F.col(c).alias(f"f{i}") for i, c in enumerate(fields)]).mapInArrow(count, schema)
