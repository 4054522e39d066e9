import corpus_pipeline
from geograph.llm import importance, mixing
from geograph.llm.queries import good_labels

from .brute import jaccard_components, repeats

SMALL = "/root/testdata/sf0.001"


def test_stages_on_the_smallest_tables(spark):
    """Each stage against a plain version, on what the stage before it kept."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = good_labels(spark.read.parquet(f"{SMALL}/labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    good = corpus_pipeline.stage_table(stages["quality"](spark, docs, SMALL), "t")
    kept = {r.doc_id for r in importance.resample(docs, labels).where("kept").collect()}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == kept and len(kept) > 150

    one = corpus_pipeline.stage_table(stages["near_duplicates"](spark, good, SMALL), "t")
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert {r.doc_id for r in one.collect()} == {i for i, _, c in jaccard_components(rows, 5, 80) if i == c}

    cut = corpus_pipeline.stage_table(stages["repeats"](spark, one, SMALL), "t")
    removed = {i: gone for i, _, gone, _, _ in repeats([(r.doc_id, r.text) for r in one.collect()], 200)}
    before = {r.doc_id: r.text for r in one.collect()}
    after = {r.doc_id: r.text for r in cut.collect()}
    for i, t in before.items():
        left = len(t.encode()) - removed[i]
        assert i not in after or 0 <= left - len(after[i].encode()) <= 8 * (removed[i] > 0)
        assert i in after or left <= 8

    mixed = corpus_pipeline.stage_table(stages["mixture"](spark, cut, SMALL), "t")
    counts = mixing.mix_counts(cut).where("taken > 0")
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == {r.doc_id for r in counts.collect()}
    pieces = stages["sequences"](spark, mixed, SMALL)
    assert pieces.agg({"length": "sum"}).first()[0] == sum(len(r.ids) for r in pieces.collect())


ODD = "doc_id long, text string, lang string, source string, n_chars long, row long, _w string"


def odd_rows():
    plain = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    rows = [(i, plain(f"doc{i}x"), "en", "ab"[i % 2]) for i in range(30)] + [(1, plain("doc1x"), "en", "b"), (None, plain("none"), "en", None), (None, plain("none"), None, None), (40, None, "en", "a"), (41, "", "en", "a"), (42, " \n", "en", "a")]
    rows += [(43, plain("doc2x") + " and more", "en", "a"), (44, plain("long", 20000), "en", "a"), (45, "few words", "en", "a")]
    return [(*r, 0, 7, "z") for r in rows]


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids, texts and sources, repeated rows, a very long text and clashing columns through all stages."""
    docs = spark.createDataFrame(odd_rows(), ODD)
    spark.createDataFrame([(i, 1 if i % 7 else 0, 0) for i in range(30)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    before, kept = docs.collect(), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage_table(stage(spark, docs, str(tmp_path)), "t")
        assert docs.columns == [c.split()[0] for c in ODD.split(", ")]
        kept[name] = docs.collect()
        assert {r.doc_id for r in kept[name]} <= {r.doc_id for r in before} and all(r.row == 7 and r["_w"] == "z" for r in kept[name])
        if name == "quality":  # the stages after it get the rows that it would reject, too
            docs = spark.createDataFrame(odd_rows(), ODD)
    assert not {40, 41, 42} & {r.doc_id for r in kept["quality"]}
    one = sorted([r.doc_id for r in kept["near_duplicates"]], key=str)
    assert one == sorted([*range(30), None, 40, 41, 42, 44, 45], key=str)
    assert {r.doc_id for r in kept["repeats"]} == set(one)
    assert {r.doc_id for r in kept["mixture"]} <= set(one) - {40, 41, 42}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sum(r.start == 0 for r in pieces) == len(kept["mixture"]) and sum(r.length for r in pieces if r.doc_id == 44) > 20000


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], ODD)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage_table(stage(spark, docs, str(tmp_path)), "t")
        assert docs.count() == 0
