"""Packing along a space-filling curve.

A document's hashed token vector is projected to a few dimensions; the Hilbert key
of that point orders documents, so that neighbours on the curve are alike. Token
streams are laid end to end along the curve and cut into sequences.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_keys, running_total, stage_table
from .texthash import LOWER, U, mix, span_hashes, word_bounds

SEQUENCE, END_ID = 2048, 1
DIMS, BITS = 4, 15
#: Words whose ids a worker remembers, about 150 bytes each, and bytes of text encoded at a time.
CACHE_WORDS, CHUNK = 1_000_000, 1 << 20
WORDS_A_CALL = 256
#: Marks that end a word; after a letter or digit they are encoded apart from it.
MARK = np.zeros(256, bool)
MARK[list(b".,;:!?*$%&#")] = True
ALNUM = np.array([bytes([x]).isalnum() for x in range(256)])
#: Encoded whole and word by word when a tokenizer is opened, to see whether that makes a difference.
PROBE = "Ab cD, ef. GH!? x12 3y (a)b <q> don't IT'S n\u00e9 \u00c9a\n\tz  w\x0bv a.b,c ..x 5% 7$, r#s*** <|A|>, \u00df\u00fc\u00f1.  "


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes
    stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    return {x: chr(x) for x in plain} | {x: chr(256 + i) for i, x in enumerate(rest)}


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of runs of the given starts and sizes, one after another."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def _parts(text: bytes) -> list[bytes]:
    """A text in parts of about CHUNK bytes, cut at spaces."""
    parts, low = [], 0
    while len(text) - low > CHUNK:
        at = text.rfind(b" ", low + 1, low + CHUNK)
        at = text.find(b" ", low + CHUNK) if at < 0 else at
        if at < 0:
            break
        parts.append(text[low:at])
        low = at
    return [*parts, text[low:]]


class WordEncoder:
    """Ids of texts, with a bounded memory of words met before.

    Words are found and told apart by 64-bit hashes, a chunk of texts at a time, so
    that each distinct word of a chunk is looked up once. That holds for tokenizers
    that drop white space and the case of ASCII letters and part marks from the
    words before them; for any other (PROBE tells, and the first text of each
    worker) texts are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        self.letters = Tokenizer(self.tokenizer.model)  # for words of small letters, which the tokenizer takes as they are
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.byte_letters = _byte_letters()
        self.ends_word = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends_word[i] = token.endswith("</w>")
        self._forget()
        self.by_words = True
        self.tried = False
        self.by_words = self._agree(PROBE.encode())

    def _forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.ids = np.zeros(0, self.kind)
        self.starts = self.sizes = np.zeros(0, np.int64)

    def _agree(self, text: bytes) -> bool:
        whole = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return self._encode_parts([text])[0].tolist() == whole

    def _learn(self, hashes: list[int], words: list[bytes]) -> None:
        """Ids of new words. Words of small letters go many to a call; their ids are told
        apart by the tokens that end a word."""
        starts, sizes, made, at = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [self.ids], len(self.ids)
        plain, texts, single = [], [], []
        for i, w in enumerate(words):
            if w.isalpha():
                plain.append(i)
                texts.append(w.decode())
                continue
            text = w.decode("utf-8", "replace")
            if text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text):
                plain.append(i)
                texts.append(w.decode("latin-1").translate(self.byte_letters))
            else:
                single.append(i)
        lows = range(0, len(plain), WORDS_A_CALL)
        for low, e in zip(lows, self.letters.encode_batch_fast([" ".join(texts[low : low + WORDS_A_CALL]) for low in lows], add_special_tokens=False), strict=True):
            ids, group = np.array(e.ids, self.kind), plain[low : low + WORDS_A_CALL]
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(group):
                single += group
                continue
            sizes[group] = np.diff(np.r_[0, ends])
            starts[group] = at + ends - sizes[group]
            made.append(ids)
            at += len(ids)
        for i, e in zip(single, self.tokenizer.encode_batch_fast([words[i].decode("utf-8", "replace") for i in single], add_special_tokens=False), strict=True):
            starts[i], sizes[i] = at, len(e.ids)
            made.append(np.array(e.ids, self.kind))
            at += len(e.ids)
        self.slots.update(zip(hashes, range(len(self.starts), len(self.starts) + len(words)), strict=True))
        self.starts, self.sizes, self.ids = np.r_[self.starts, starts], np.r_[self.sizes, sizes], np.concatenate(made)

    def _encode_parts(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts, laid end to end, and how many each has."""
        joined = b" ".join(parts)
        data = np.frombuffer(joined, np.uint8)
        low = LOWER[data]
        begin, end = word_bounds(data)
        if b"<" in joined:  # marks in angle brackets may be special tokens, which have their case
            cased = np.zeros(len(begin), bool)
            cased[np.searchsorted(begin, np.flatnonzero(data == ord("<")), "right") - 1] = True
            at = _ragged(begin[cased], (end - begin)[cased])
            low[at] = data[at]
        letter = np.maximum.accumulate(np.where(MARK[data], 0, np.arange(1, len(data) + 1, dtype=np.int32))) if len(data) else np.zeros(0, np.int32)
        head = letter[end - 1].astype(np.int64)  # where the last byte that is no mark ends
        head = np.where((head > begin) & ALNUM[data[np.maximum(head, 1) - 1]], head, end) if len(end) else end
        tail = head < end
        place = np.arange(len(begin)) + np.cumsum(tail) - tail
        first, last = np.zeros(len(begin) + int(tail.sum()), np.int64), np.zeros(len(begin) + int(tail.sum()), np.int64)
        first[place], last[place] = begin, head
        first[place[tail] + 1], last[place[tail] + 1] = head[tail], end[tail]
        distinct, inverse = np.unique(span_hashes(low, first, last), return_inverse=True)
        if len(self.slots) + len(distinct) > CACHE_WORDS:
            self._forget()
        keys = distinct.tolist()
        found = [*map(self.slots.get, keys)]
        missing = [i for i, slot in enumerate(found) if slot is None]
        if missing:
            some = np.zeros(len(distinct), np.int64)
            some[inverse] = np.arange(len(inverse))
            raw = low.tobytes()
            self._learn([keys[i] for i in missing], [raw[b:e] for b, e in zip(first[some[missing]].tolist(), last[some[missing]].tolist(), strict=True)])
            for i in missing:
                found[i] = self.slots[keys[i]]
        slot = np.array(found, np.int64)[inverse]
        sizes = self.sizes[slot]
        lengths = np.array([len(p) for p in parts], np.int64)
        bounds = np.searchsorted(first, np.r_[np.cumsum(lengths + 1) - lengths - 1, len(data) + 1])
        up_to = np.r_[0, np.cumsum(sizes)]
        return self.ids[_ragged(self.starts[slot], sizes)], np.diff(up_to[bounds])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, laid end to end, and how many each has."""
        if not self.tried and any(texts):
            self.by_words = self.by_words and self._agree(next(t for t in texts if t)[:CHUNK])
            self.tried = True
        if not self.by_words:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
            return np.array([i for x in ids for i in x], self.kind), np.array([len(x) for x in ids], np.int64)
        parts = [_parts(t) for t in texts]
        flat, at = [p for x in parts for p in x], 0
        made = []
        while at < len(flat):
            size, high = 0, at
            while high < len(flat) and (high == at or size + len(flat[high]) <= CHUNK):
                size += len(flat[high])
                high += 1
            made.append(self._encode_parts(flat[at:high]))
            at = high
        counts = np.concatenate([np.zeros(0, np.int64), *[c for _, c in made]])
        firsts = np.cumsum([0, *[len(x) for x in parts]])
        return np.concatenate([np.zeros(0, self.kind), *[i for i, _ in made]]), np.diff(np.r_[0, np.cumsum(counts)][firsts])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and tokenizer."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of small unsigned integers (n, dims)."""
    x = points.astype(np.uint64).T.copy()
    dims = len(x)
    q = U(1 << (bits - 1))
    while q > 1:  # undo the curve's turns, from the largest cube to the smallest
        p = q - U(1)
        for i in range(dims):
            turned = (x[i] & q) != 0
            swap = np.where(turned, U(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(turned, p, swap)
            x[i] ^= swap
        q >>= U(1)
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    q = U(1 << (bits - 1))
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - U(1), U(0))
        q >>= U(1)
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << U(1)) | ((x[i] >> U(b)) & U(1))
    return key.astype(np.int64)


def directions(vocabulary: int, dims: int = DIMS) -> np.ndarray:
    """Each token's hashed direction: +1 or -1 in each dimension."""
    h = mix(np.arange(1, vocabulary + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
    return np.stack([((h >> U(d)) & U(1)).astype(np.int8) * 2 - 1 for d in range(dims)], axis=1)


def curve_key(ids: np.ndarray, counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hilbert key of each document's mean direction; an empty document stands in the middle."""
    total = np.zeros((len(counts), table.shape[1]), np.int64)
    some = counts > 0
    if some.any():
        total[some] = np.add.reduceat(table[ids], (np.cumsum(counts) - counts)[some], axis=0, dtype=np.int64)
    mean = total / np.maximum(counts, 1)[:, None]
    return hilbert_key(np.minimum((mean + 1) / 2 * (1 << BITS), (1 << BITS) - 1).astype(np.uint64))


def pack(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids.

    Every document ends with end_id. Sequences hold `sequence` ids each, but for the
    last, which is padded to a power of two. Documents follow the curve, those of
    equal key their id, then their place in the table. A null or empty text is one
    end_id; repeated rows are packed each; other columns are not read.
    """

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        table = directions(enc.tokenizer.get_vocab_size())
        for keys, b in row_keys(batches):
            texts = b.column(1).cast(pa.binary())
            low = 0
            while low < b.num_rows:
                chunk, size, high = [], 0, low
                while high < b.num_rows and (not chunk or size < CHUNK):
                    chunk.append(texts[high].as_py() or b"")
                    size += len(chunk[-1])
                    high += 1
                ids, counts = enc.encode(chunk)
                ends = np.cumsum(counts + 1)
                stream = np.full(len(ids) + len(counts), end_id, enc.kind)
                own = np.ones(len(stream), bool)
                own[ends - 1] = False
                stream[own] = ids
                offsets = np.r_[0, ends * stream.itemsize].astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(stream)])
                yield pa.RecordBatch.from_arrays([pa.array(keys[low:high]), b.column(0)[low:high], pa.array(curve_key(ids, counts, table)), pa.array(counts + 1), packed], names=["row", id_col, "key", "tokens", "ids"])
                low = high

    made = T.StructType([T.StructField("row", T.LongType()), docs.schema[id_col], T.StructField("key", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    encoded = stage_table(docs.select(id_col, text_col).mapInArrow(tokenize, made), "encoded")
    placed = running_total(encoded.select("row", id_col, "key", "tokens"), "tokens", ["key", id_col, "row"], label="curve").select("row", "start")
    fields = [("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())] + [("ids", T.ArrayType(T.IntegerType()))] * with_ids
    out = T.StructType([docs.schema[id_col], *(T.StructField(n, t) for n, t in fields)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows, all_ids = [], [], []
            for i, (n, packed, start) in enumerate(zip(b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True)):
                raw = packed.as_py()
                ids = np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32).astype("<u4")
                done = 0
                while done < n:
                    offset = (start + done) % sequence
                    size = min(n - done, sequence - offset)
                    piece = ids[done : done + size]
                    at.append(i)
                    rows.append((done, size, zlib.crc32(piece.tobytes()), n, (start + done) // sequence, offset))
                    if with_ids:
                        all_ids.append(piece.astype(np.int32))
                    done += size
            arrays = [b.column(0).take(pa.array(at, pa.int64())), *(pa.array([r[j] for r in rows], pa.int64()) for j in range(6))]
            yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(all_ids, pa.list_(pa.int32()))] * with_ids], names=out.names)

    return encoded.join(placed.hint("merge"), "row").select(id_col, "tokens", "ids", "start").mapInArrow(cut, out)
