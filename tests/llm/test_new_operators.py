"""Operators 11 to 13 against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from geograph.llm import head_tail, positional_index, vector_codes, wordbytes

from .brute import lower_ascii

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(lower_ascii(text or ""))


def texts(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Élan", "a1", "名前", "x" * 300, "river", "Stone", "9", "ß", *(f"w{i}" for i in range(40))]
    return [rng.choice(["", " ", "\x00", "-"]).join(rng.choice(vocabulary) + rng.choice([" ", "\n", ", ", "\x7f"]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def runs(ws, most=3):
    return [" ".join(ws[i : i + k]) for k in range(1, most + 1) for i in range(len(ws) - k + 1)]


# words


@pytest.mark.parametrize("size", [1 << 21, 40])
def test_words_of_a_batch(size):
    import pyarrow as pa

    rows = [None, "", "aB1é", "c d", *texts(1), "Z" * 500]
    for column in (pa.array(["x", *rows]).slice(1), pa.array(rows, pa.large_string())):
        data, offsets = wordbytes.text_column(column)
        got = []
        for low, high in wordbytes.chunks(offsets, size):
            found, at, counts = wordbytes.words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            all_words = [bytes(found[s:e]).decode() for s, e in zip(at[:-1], at[1:], strict=True)]
            for n in counts:
                got.append(all_words[:n])
                all_words = all_words[n:]
        assert got == [words(t) for t in rows]


# head-tail vocabulary


def plain_resample(docs, target, percent=5, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % head_tail.BUCKETS
    raw, aim = Counter(bucket(f) for _, t in docs for f in runs(words(t))), Counter(bucket(f) for t in target for f in runs(words(t)))
    s_all, t_all = float(sum(raw.values()) + 10000), float(sum(aim.values()) + 10000)
    gain = lambda b: math.floor(1000 * math.log(float(aim[b] + 1) * s_all / (float(raw[b] + 1) * t_all)))
    out = []
    for i, t in docs:
        f = runs(words(t))
        weight = sum(gain(bucket(x)) for x in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words(t)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for n, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = n + 1
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize(("n_words", "n_pairs"), [(1 << 15, 1 << 16), (3, 2), (0, 0)])
def test_resample(spark, monkeypatch, n_words, n_pairs):
    """A head of all, of few and of no words gives the same buckets."""
    find = head_tail.find_head
    monkeypatch.setattr(head_tail, "find_head", lambda t: find(t, n_words, n_pairs))
    rows = [*enumerate(texts(2)), (900, None), (901, ""), (902, " \n"), (903, "q" * 5000), (904, "one two"), (None, " ".join(texts(3, 3))), (5, texts(2)[5])]
    target = [*texts(4, 5), None, ""]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, score string, _one int")
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    for percent in (5, 60):
        out = head_tail.resample(df, aim, percent).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
        assert sorted(map(tuple, out), key=str) == plain_resample(rows, target, percent)


def test_resample_of_nothing(spark):
    empty, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, " ".join("abcdefghijklmnopqrstuvwxyz"))], "doc_id long, text string")
    assert head_tail.resample(empty, one).collect() == []
    (r,) = head_tail.resample(one, empty, 100).collect()
    assert r["rank"] == 1 and (1, r.n_words, r.n_features, r.weight, r.score, 1) == plain_resample([(1, " ".join("abcdefghijklmnopqrstuvwxyz"))], [], 100)[0]


def test_crcs_of_long_words():
    data = np.frombuffer(("ab" * 1000 + "xyz").encode(), np.uint8)
    starts, ends = np.array([0, 2000, 5, 7, 0]), np.array([2000, 2003, 262, 7, 256])
    got = head_tail.read_on(np.full(5, zlib.crc32(b"left"), np.uint32), data, starts, ends, True)
    assert got.tolist() == [zlib.crc32(b"left " + bytes(data[s:e])) for s, e in zip(starts, ends, strict=True)]


# positional index


def plain_hits(docs, items, width=10):
    wanted = {}
    for name, t in items:
        w = words(t)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            wanted.setdefault(tuple(w[i : i + width]), set()).add("" if name is None else str(name))
    out = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for size in {len(x) for x in wanted}:
            for at in range(len(w) - size + 1):
                if found := wanted.get(tuple(w[at : at + size])):
                    hit |= set(range(at, at + size))
                    names |= found
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def tainted(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh")
    items = [(i, " ".join(word() for _ in range(rng.randint(4, 14)))) for i in range(12)] + [(3, "a b a b"), (None, "h g f"), (20, "zz"), (21, None), (22, " -"), (23, "A-B a.B")]
    docs = [(i, " ".join([*(word() for _ in range(rng.randint(0, 30))), rng.choice(items)[1] or "", *(word() for _ in range(rng.randint(0, 30)))])) for i in range(40)]
    return [*docs, docs[3], (None, "a b a b"), (50, None), (51, ""), (52, "h g"), (53, "f"), (54, " ".join(items[0][1] for _ in range(200)))], items


@pytest.mark.parametrize(("segment", "piece", "asked", "at_once"), [(1 << 22, 1 << 18, 100_000, 1 << 21), (64, 1 << 18, 100_000, 5), (400, 7, 4, 1 << 21)])
def test_decontaminate(spark, monkeypatch, segment, piece, asked, at_once):
    """Also with small segments, texts cut to pieces, queries in many blocks, few places at once."""
    for name, value in (("SEGMENT", segment), ("PIECE", piece), ("ASKED", asked), ("AT_ONCE", at_once)):
        monkeypatch.setattr(positional_index, name, value)
    docs, items = tainted(1)
    df = spark.createDataFrame([(i, t, "x", 2) for i, t in docs], "doc_id long, text string, row string, n_hit int")
    asks = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    for width in (5, 10):
        out = positional_index.decontaminate(df, asks, width).collect()
        assert sorted(map(tuple, out), key=str) == plain_hits(docs, items, width)


def test_decontaminate_without_items_or_documents(spark):
    docs, items = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert sorted(map(tuple, positional_index.decontaminate(docs, items).collect())) == plain_hits([(1, "a b"), (2, None)], [])
    assert positional_index.decontaminate(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).collect() == []


@pytest.mark.parametrize("piece", [1 << 18, 9])
def test_phrase_and_proximity_search(spark, monkeypatch, piece):
    monkeypatch.setattr(positional_index, "PIECE", piece)
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 60)))) for i in range(30)]
    asked = [("p", ["a", "b"]), ("q", ["c", "a", "d"]), ("again", ["a", "b"]), ("one", ["e"]), ("none", ["zz", "a"]), ("empty", []), ("twice", ["a", "a"])]
    index = positional_index.build_index(spark.createDataFrame(docs, "doc_id long, text string"), reach=12)
    queries = spark.createDataFrame(asked, "name string, words array<string>")
    phrases = sorted((i, name, at, at + len(q) - 1) for i, t in docs for name, q in asked if q for at in range(len(t.split())) if t.split()[at : at + len(q)] == q)
    assert sorted((r.id, r.name, r.first, r["last"]) for r in positional_index.search(index, queries, reach=12).collect()) == phrases
    near = []
    for i, t in docs:
        w = t.split()
        for name, q in asked:
            fits = [(s, e) for s in range(len(w)) for e in range(s, min(len(w), s + 8)) if q and set(q) <= set(w[s : e + 1])]
            near += [(i, name, s, e) for s, e in fits if not any((a, b) != (s, e) and s <= a and b <= e for a, b in fits)]
    assert sorted((r.id, r.name, r.first, r["last"]) for r in positional_index.search(index, queries, span=8, reach=12).collect()) == sorted(near)
    with pytest.raises(ValueError):
        positional_index.search(index, queries, span=13, reach=12)


# vector codes


def plain_codes(rows, parts, entries, rounds, scale):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(y is not None and math.isfinite(y) for y in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    exact = lambda y: math.floor(y * scale) if math.isfinite(y * scale) else int(y) * scale
    whole = [(i, [exact(y) for y in v] + [0] * (parts * width - len(v)), label) for i, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    order = [next(w for w, k in zip(whole, kept, strict=True) if k is f) for f in first][:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in order] for p in range(parts)]
    best = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        at = [[best(v, p)[1] for p in range(parts)] for _, v, _ in whole]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), a in zip(whole, at, strict=True) if a[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = []
    for i, v, label in whole:
        found = [best(v, p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), min(vector_codes.LONG, sum(min(10**40, d) for d, _ in found)), label))
    total = Counter()
    for _, _, error, label in out:
        total[label] += error
    digest = hashlib.sha256(",".join(str(y) for b in books for e in b for y in e).encode()).hexdigest()
    return sorted(((i, code, error, min(vector_codes.LONG, total[label]), digest) for i, code, error, label in out), key=str)


def vectors(seed, dims=10, n=80, size=1.0):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=dims) * size], int(i) % 3 or None) for i in rng.permutation(n)]
    twice = rows[4 % n]
    return [*rows, twice, twice, (None, rows[0][1], 1), (7, rows[9 % n][1][:3], 2), (500, None, 1), (501, [1.0, None], 1), (502, [float("nan")] * dims, 1), (503, [float("inf")] * dims, 1), (504, [0.0] * dims, None), (505, [], 1)]


@pytest.mark.parametrize(("size", "members", "labels"), [(1.0, 4096, 100_000), (0.001, 5, 1), (1e30, 5, 100_000)])
def test_compress(spark, monkeypatch, size, members, labels):
    """Small owners, labels dealt to keys, ties among tiny components, and components beyond a long."""
    monkeypatch.setattr(vector_codes, "MEMBERS", members)
    monkeypatch.setattr(vector_codes, "LABELS", labels)
    rows = vectors(1, size=size)
    df = spark.createDataFrame([(i, v, label, "x", 1.0) for i, v, label in rows], "vec_id long, embedding array<float>, label int, code string, entry double")
    out = vector_codes.compress(df, parts=4, entries=16, rounds=4, scale=1024).collect()
    assert sorted(map(tuple, out), key=str) == plain_codes(rows, 4, 16, 4, 1024)


def test_compress_few_and_no_rows(spark):
    rows = vectors(2, dims=4, n=3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, vector_codes.compress(df).collect()), key=str) == plain_codes(rows, 4, 256, 4, 1024)
    assert vector_codes.compress(df.limit(0)).collect() == [] and vector_codes.compress(df.where("vec_id = 500")).collect() == []
