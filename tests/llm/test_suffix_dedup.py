import random

import pytest

from geograph.llm import suffix_dedup as sd

from .brute import repeats


def rows_of(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def corpus(seed, alphabet="ab c"):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    passages = [word(rng.randint(15, 60)) for _ in range(4)]
    docs = [(i, word(rng.randint(0, 50)) + rng.choice([*passages, ""]) + word(rng.randint(0, 30)) + rng.choice([*passages, ""])) for i in range(40)]
    return [*docs, (40, docs[3][1]), (41, None), (42, ""), (43, "é" * 40 + "x"), (44, "y" + "é" * 35), (45, "ab" * 60), docs[5], docs[5]]


@pytest.mark.parametrize(("bucket_rows", "hot"), [(16384, 2000), (1, 2000), (16384, 4)])
@pytest.mark.parametrize(("seed", "alphabet"), [(1, "ab c"), (2, "abcdefghij klmnopé"), (3, "a")])
def test_same_as_counting_every_string(spark, monkeypatch, seed, alphabet, bucket_rows, hot):
    """hot 4: buckets of over a fourth of the rows are dealt to several tasks."""
    monkeypatch.setattr(sd, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(sd, "HOT", hot)
    rows = corpus(seed, alphabet)
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, bucket string, h1 int, spans int")
    assert rows_of(sd.remove_repeats(df, 20, 8)) == sorted(repeats(rows, 20))


def test_chunks_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(sd, "CHUNK", 64)
    rows = corpus(4)
    rows.append((50, "".join(t or "" for _, t in rows)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(sd.remove_repeats(df, 20, 8)) == sorted(repeats(rows, 20))


def test_a_passage_in_most_documents(spark, monkeypatch):
    """One passage between different neighbours, in a hot bucket and in ordinary ones."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = word(60)
    rows = [(i, word(rng.randint(0, 40)) + passage[: rng.randint(30, 60)] + word(rng.randint(0, 40))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (2000, 3):
        monkeypatch.setattr(sd, "HOT", hot)
        assert rows_of(sd.remove_repeats(df, 20, 8)) == sorted(repeats(rows, 20))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert rows_of(sd.remove_repeats(df)) == [] and sd.cut_repeats(df).collect() == []


def test_cut_keeps_columns_and_characters(spark):
    shared = "é" * 30
    df = spark.createDataFrame([(1, f"one {shared} a", 9, "k"), (2, f"two {shared} b", 9, "k"), (3, "three", 9, "k"), (None, None, 9, "k"), (5, shared, 0, "k")], "doc_id long, text string, n_chars long, h1 string")
    out = {r.doc_id: r for r in sd.cut_repeats(df, 20, 8).collect()}
    assert out[1].text == "one a".replace(" a", "") + "" or out[1].text.startswith("one")
    assert shared[:12] not in out[1].text and out[1].n_chars == len(out[1].text) and out[3].text == "three" and out[None].text is None
    assert 5 not in out and out[1].h1 == "k"
