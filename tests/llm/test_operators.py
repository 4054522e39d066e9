import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest

from geograph.llm import adaptive_rules, chat_tree, common, importance, mixing, nra, packing, token_counts, url_trie
from geograph.llm.queries import tokenizer_file

from .brute import WORD, rule_measures


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# importance resampling


def test_resample_keeps_what_is_like_the_target(spark):
    rng = np.random.default_rng(1)
    good = [" ".join(rng.choice(["river", "stone", "light", "wind", "tree"], 30)) for _ in range(60)]
    bad = [" ".join(rng.choice(["$$$", "buy***", "NOW!!", "##"], 30)) for _ in range(20)]
    rows = [(i, t, "x") for i, t in enumerate([*good, *bad, None, "", " \n"])] + [(0, good[0], "x")]
    labels = frame(spark, [(i, i < 60) for i in range(80) if i % 2] + [(1, True), (None, True), (5, None)], "doc_id long, good boolean")
    df = frame(spark, rows, "doc_id long, text string, n_features string")
    out = importance.resample(df, labels).collect()
    kept = {r.doc_id for r in out if r.kept}
    assert len(out) == len(rows) and kept <= set(range(60)) and len(kept) >= 55
    assert not any(r.kept for r in out if r.doc_id in (80, 81, 82))
    again = {r.doc_id for r in importance.resample(df, labels).where("kept").collect()}
    stage = importance.keep_best(df, labels)
    assert again == kept and stage.columns == df.columns and {r.doc_id for r in stage.collect()} == kept
    assert sum(r.kept for r in importance.resample(df, labels, share=0.25).collect()) == 21


def test_resample_against_a_plain_version(spark):
    """Weights, keys, threshold and k computed again in plain Python; the noise decides near the edge."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").selectExpr("doc_id", "quality = 1 AS good")
    F, seed = common.F, 17
    rows = docs.select("doc_id", "text", (-F.log(-F.log(common.unit_noise(F.col("doc_id"), F.xxhash64("text"), F.lit(seed))))).alias("noise")).collect()
    half = {r.doc_id: (r.good, r.half) for r in labels.select("doc_id", "good", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2)).alias("half")).collect()}
    raw, target, found = [0.0] * importance.BUCKETS, [0.0] * importance.BUCKETS, {}
    for r in rows:
        found[r.doc_id] = f = importance.features(r.text).tolist()
        for x in f:
            raw[x] += 1 / len(f)
            target[x] += (1 / len(f)) * (half.get(r.doc_id) == (True, 0))
    share, prior = sum(target) / sum(raw), importance.PRIOR
    ratio = [np.log(t + prior) - np.log(r * share + prior) for t, r in zip(target, raw, strict=True)]
    weight = {i: importance.TEMPER * sum(ratio[x] for x in f) / len(f) for i, f in found.items() if f}
    held = [(weight[i], good) for i, (good, h) in half.items() if h == 1 and i in weight]
    n_good, n_bad = sum(g for _, g in held), sum(not g for _, g in held)

    def error(edge):
        return importance.GOOD_LOSS * sum(g and w < edge for w, g in held) / n_good + sum(not g and w >= edge for w, g in held) / n_bad

    out = {r.doc_id: r for r in importance.resample(docs, labels).collect()}
    assert all(abs(out[i].log_weight - w) < 1e-4 for i, w in weight.items())
    noise = {r.doc_id: r.noise for r in rows}
    assert all(abs(out[i].sample_key - weight[i] - noise[i]) < 1e-4 for i in weight)
    kept = {i for i, r in out.items() if r.kept}
    keys = sorted((r.sample_key for i, r in out.items() if i in weight), reverse=True)
    assert kept == {i for i in weight if out[i].sample_key >= keys[len(kept) - 1]}
    edge = sorted(weight.values(), reverse=True)[len(kept) - 1]  # k documents reach the threshold, which is as good as any other
    assert error(edge) <= min(error(e / 20) for e in range(-400, 100)) + 1e-9


def test_noise_decides_near_the_edge(spark):
    """Of alike documents the noise picks some; of unlike ones the weight does; the target's share rises."""
    rng = np.random.default_rng(6)
    words = np.array(["river", "stone", "light", "wind", "tree", "sand", "hill", "road"])
    near = lambda p: " ".join(rng.choice(words, 60, p=p))
    good, alike, junk = [0.2] * 4 + [0.05] * 4, [0.18] * 4 + [0.07] * 4, [0.01] * 4 + [0.24] * 4
    rows = [(i, near((good, alike, junk)[i % 3])) for i in range(600)]
    labels = frame(spark, [(i, i % 3 == 0) for i in range(600) if i % 3 != 1], "doc_id long, good boolean")
    out = {r.doc_id: r for r in importance.resample(frame(spark, rows, "doc_id long, text string"), labels, share=0.4).collect()}
    kept = {i for i, r in out.items() if r.kept}
    plain = set(sorted(out, key=lambda i: -out[i].log_weight)[: len(kept)])
    assert len(kept) == 240 and 20 < len(kept - plain) < 120
    assert sum(i % 3 == 0 for i in kept) / 240 > 0.5 and sum(i % 3 == 2 for i in kept) / 240 < 0.15


def test_resample_without_rows_or_labels(spark):
    none = frame(spark, [], "doc_id long, good boolean")
    empty = frame(spark, [], "doc_id long, text string")
    assert importance.resample(empty, none).collect() == []
    assert len(importance.resample(frame(spark, [(1, "a b")], "doc_id long, text string"), none).collect()) == 1


def test_radix_selection(spark):
    values = [0.5, -3.25, 7.0, 7.0, 1e4, -1e4, 0.0]
    df = frame(spark, [(v,) for v in values], "key double")
    assert [importance.largest(df, "key", k) for k in range(1, 8)] == sorted(values, reverse=True)
    assert importance.largest(df, "key", 0) is None and importance.largest(df.limit(0), "key", 3) is None


# no-random-access search


def plain_top_k(rows, k, scale, every):
    fine = [(i, np.floor(np.array(v, float) * scale).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, qv in {(i, tuple(v)) for i, v in fine if i % every == 0}:
        width = lambda v, n: np.pad(np.array(v), (0, n - len(v)))
        scored = sorted((-int(width(qv, 9) @ width(v, 9)), i) for i, v in fine if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("big", [1, 1 << 20, 1 << 27])
def test_top_k_is_exact(spark, monkeypatch, big):
    monkeypatch.setattr(nra, "CANDIDATES", 64)
    monkeypatch.setattr(nra, "RUN", 2)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-6, 7, 8) / 4 * big]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None] + [0.0] * 6), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, [1.0] * 8), rows[40], rows[7], (304, [2.0 * big])]
    df = frame(spark, rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nra.top_k(df, 7, 4, 20).collect())
    assert got == plain_top_k(rows, 7, 4, 20)


def test_top_k_of_few_or_no_rows(spark):
    df = frame(spark, [(0, [1.0, 2.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.score) for r in nra.top_k(df).collect()] == [(0, 1, 64 * 32 + 128 * 32)]
    assert nra.top_k(df.limit(0)).collect() == []


def test_huge_components_take_part(spark):
    rows = [(0, [3e10, 1.0]), (1, [3e10, 0.0]), (2, [1e300, 0.0]), (3, [-1e300, 2.0]), (4, [1.7e308, 0.0]), (5, [0.5, 0.5]), (6, None)]
    out = nra.top_k(frame(spark, rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in out] == [(0, 4), (0, 2), (0, 1), (0, 5), (0, 3)]
    assert [r.score for r in out] == [nra.LONG, nra.LONG, nra.LONG, 64 * int(3e10) * 32 + 64 * 32, -nra.LONG - 1]
    some = [-(10**40), -(1 << 64), -1, 0, 5, 1 << 63, 10**40]
    assert sorted(some) == sorted(some, key=nra.order_key)


def plain_scores(m, q):
    return sorted((-int(s), i) for i, s in enumerate((m @ q).tolist()))


@pytest.mark.parametrize("kind", [np.float64, object])
def test_lists_against_all_scores(kind):
    rng = np.random.default_rng(3)
    m, qs = rng.integers(-20, 20, (300, 16)).astype(float), rng.integers(-20, 20, (12, 16)).astype(float)
    qs[3] = 0
    lists = nra.Lists.of(np.arange(300), m.astype(int).astype(object) if kind is object else m)
    want = [plain_scores(m, q) for q in qs]
    barred = np.zeros((300, 12), bool)
    barred[want[5][0][1], 5] = True
    for nth in (None, 4, 40):
        least = None if nth is None else np.array([-w[nth][0] for w in want], kind)
        answers, _ = nra.read_lists(lists, qs, 5, least, barred)
        for i, (found, score) in enumerate(answers):
            got = sorted(zip((-score).tolist(), found.tolist(), strict=True))
            assert got[:4] == want[i][i == 5 :][:4] and (i == 5 or got[:5] == want[i][:5])


def test_reading_stops_early_on_skewed_data():
    """Rows of falling norm: later blocks are left at their heads, and others before their ends."""
    rng = np.random.default_rng(4)
    m = np.floor(64 * rng.normal(size=(2000, 8)) * (1 / np.arange(1, 2001))[:, None] * 100)
    blocks = [nra.Lists.of(np.arange(low, low + 200), m[low : low + 200]) for low in range(0, 2000, 200)]
    qs = np.floor(64 * rng.normal(size=(10, 8)))
    best, read = [[] for _ in qs], []
    for b in blocks:
        least = np.array([-x[-1][0] if len(x) == 5 else -np.inf for x in best])
        answers, n = nra.read_lists(b, qs, 5, least)
        read.append(n)
        for i, (found, score) in enumerate(answers):
            best[i] = sorted(best[i] + list(zip((-score).tolist(), b.ids[found].tolist(), strict=True)))[:5]
    assert best == [plain_scores(m, q)[:5] for q in qs]
    assert sum(read) < m.size * len(qs) / 4 and read[-1] == 0


# chat tree


@pytest.mark.parametrize("hot", [2000, 8])
def test_chat_tree_reads_back(spark, monkeypatch, hot):
    """hot 8: nodes with over an eighth of the turns are dealt to several keys."""
    monkeypatch.setattr(chat_tree, "HOT", hot)
    nasty = ["<|im_end|><|im_start|>assistant ok", "long " * 20000, "<\\|im_end|>", "a\\b <\\\\| <|", "", None, "naïve 😀\n"]
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo"), (2, 0, "system", "be brief"), (2, 1, "user", "hi"), (2, 2, "assistant", "hey"), (2, 3, "user", "x"), (3, 0, "system", "be brief"), (4, 0, "system", "be brief"), (4, 1, "user", "hi"), (4, 2, "assistant", "yo")]
    rows += [(30 + i, t, "user", "the same") for i in range(20) for t in range(i % 3 + 1)]
    rows += [(10 + i, t, ("user", "assistant")[t % 2], nasty[(i + t) % 7]) for i in range(6) for t in range(4)]
    rows += [(None, 0, "user", "no id"), (20, None, None, "no role"), (20, None, "r\n\\n|<|", "odd role"), (21, 0, "assistant", "twice"), (21, 0, "assistant", "twice")]
    df = frame(spark, [(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, node string")
    import public_tokenizers

    tokens_of = (tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    tree = chat_tree.build_tree(df, *tokens_of)
    tokenizer, _ = token_counts.encoding(*tokens_of)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat_tree.read_back(tree, *tokens_of).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        own = sorted((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == c)
        said = "".join(t for _, role, t in own if role == "assistant")
        want[c] = (len(own), hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in own).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), sum(len(chat_tree.format_turn(role, t)[0]) for _, role, t in own))
    assert got == want
    nodes = tree["nodes"].collect()
    assert len({bytes(n.node) for n in nodes}) == len(nodes) < len(rows)
    paths = {}
    for m in sorted(tree["members"].collect(), key=lambda m: (m.conv, m.nth)):
        paths.setdefault(m.conv, []).append(bytes(m.node))
    by_node = {bytes(n.node): n for n in nodes}
    for root in {n.tree for n in nodes}:
        laid = sorted((n for n in nodes if n.tree == root), key=lambda n: n.offset)
        assert [n.offset for n in laid] == [sum(m.length for m in laid[:i]) for i in range(len(laid))]
        stream = [x for n in laid for x in n.tokens]
        for n in laid:  # what a node attends to is the conversation before it
            path = next(p for p in paths.values() if bytes(n.node) in p)
            above = [x for node in path[: path.index(bytes(n.node))] for x in by_node[node].tokens]
            assert [x for a in n.ancestors for x in stream[a.begin : a.end]] == above and n.position == len(above)
            assert all(a.end < b.begin for a, b in zip(n.ancestors, n.ancestors[1:], strict=False))
            assert len(n.tokens) == n.length and n.tokens[0] == tokenizer.n_vocab


def test_escape_is_reversible_and_clean():
    for t in ("<|", "<\\|", "<\\\\|a<|b", "<<||>", "plain"):
        assert chat_tree.unescape(chat_tree.escape(t)) == t and "<|" not in chat_tree.escape(t)


def test_chat_tree_of_nothing(spark):
    df = frame(spark, [], "conv_id long, turn long, role string, text string")
    import public_tokenizers

    tokens_of = (tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert chat_tree.read_back(chat_tree.build_tree(df, *tokens_of), *tokens_of).collect() == []


# adaptive rules


def test_measures_and_verdicts(spark):
    plain = " ".join(f"w{i}" for i in range(80))
    texts = [plain, plain.replace("w1", "v1"), "a b c " * 40, "$ " * 80, None, "", " \n\x0b", "x\nx\ny\n\nx", "one two one two one two three", "$$ **" + plain, "w " + "\n".join([plain[:50]] * 9), "é 😀 é 😀 é"]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i == 4 else "s", "z") for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", "z")]
    df = frame(spark, rows, "doc_id long, text string, lang string, source string, n_words string")
    out = adaptive_rules.judge(df).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for i, t, *_ in rows:
        r = by[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == rule_measures(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and (not r.base_failed or not r.kept)
    assert by[0].kept and not by[3].kept
    assert adaptive_rules.judge(df.limit(0)).collect() == []


def test_sketch_buckets(spark):
    values = [*range(200), 1000, 65535, 65536, 10**9]
    df = frame(spark, [(v,) for v in values], "v long")
    rows = df.select("v", adaptive_rules.bucket(df.v).alias("b")).withColumn("low", adaptive_rules.bucket_low(common.F.col("b"))).collect()
    assert all(r.low <= r.v <= r.low * 33 / 32 for r in rows) and [r.b for r in rows] == sorted(r.b for r in rows)


def test_a_source_far_from_its_own_habit_fails(spark):
    rows = [(i, " ".join(f"w{j}x{i}" for j in range(60)), "en", "s") for i in range(150)]
    rows.append((999, " ".join(f"w{j} $$$$$$" for j in range(60)), "en", "s"))
    out = {r.doc_id: r for r in adaptive_rules.judge(frame(spark, rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [i for i, r in out.items() if not r.kept] == [999] and out[999].failed == ["symbols"]


# mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    assert mixing.targets([10, 1000], [2, 1]) == [30, 980]
    assert mixing.targets([0, 5], [1, 2]) == [0, 5] and mixing.targets([], []) == [] and mixing.targets([0], [1]) == [0]
    assert sum(mixing.targets([7, 70, 3, 1], [1, 2, 3, 1])) == 81 and isinstance(mixing.targets([7], [1])[0], Fraction)


def test_permutations_and_draws():
    for n in (1, 2, 3, 100, 1000):
        at = np.arange(n)
        assert sorted(mixing.permute(at, np.full(n, n), np.full(n, 5, np.uint64))) == list(range(n))
    quotas = np.array([5000, 0, 17, 2983])
    counts = np.array([mixing.shard_counts(quotas, s, 1000, 3) for s in range(8)])
    assert (counts.sum(1) == 1000).all() and not counts[:, 1].any()
    totals = counts.sum(0)
    nth = np.repeat(np.arange(4), totals)
    source, at = mixing.hand_on(nth, np.concatenate([np.arange(n) for n in totals]), quotas, totals)
    for i, n in enumerate(quotas):  # every index of each quota, once
        assert sorted(at[source == i]) == list(range(n))
    assert (source != nth).sum() == np.maximum(totals - quotas, 0).sum() > 0


def test_slots_against_a_plain_replay(spark, monkeypatch):
    """The mix shard by shard: multinomial counts, indices in order, what is beyond a quota to who lacks, permuted blocks."""
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 50)
    sizes = {"a": 4000, "b": 300, None: 90, "c": 2500}
    rows = spark.createDataFrame([(i, n, i, s) for i, (s, n) in enumerate(sizes.items())], "row long, size long, order long, source string")
    _, slots, _ = mixing.plan(rows, "source", block_words=10, seed=5)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    n = [sizes[s] for s in names]
    share = mixing.targets(n, [1, 2, 3, 1])
    quota = [min(3 * (x // 10), round(t * (x // 10) / x)) for t, x in zip(share, n, strict=True)]
    draws, left = [], sum(quota)
    for shard in range(-(-sum(quota) // 50)):
        counts = np.random.Generator(np.random.Philox(key=[5, shard])).multinomial(min(50, left), np.array(quota) / sum(quota))
        left -= counts.sum()
        draws += [(shard, i) for i, c in enumerate(counts) for _ in range(c)]
    met, beyond, want = [0] * 4, [[] for _ in quota], []
    for shard, i in draws:
        if met[i] < quota[i]:
            want.append((shard, i, met[i]))
            met[i] += 1
        else:
            beyond[i].append(shard)
    lacking = [(i, m) for i, q in enumerate(quota) for m in range(met[i], q)]
    want += [(shard, *to) for shard, to in zip([s for x in beyond for s in x], lacking, strict=True)]
    got = slots.collect()
    assert len({(r.shard, r.slot) for r in got}) == len(got) and {r.slot for r in got if r.shard == 0} == set(range(50))
    salt = mixing.mix(np.full(1, 5, np.uint64))
    plain = []
    for shard, i, at in want:
        size = n[i] // 10
        key = mixing.mix(np.array([(i << 8) + at // size], np.uint64) + salt)
        plain.append((shard, i, at // size, int(mixing.permute(np.array([at % size]), np.array([size]), key)[0])))
    assert sorted((r.shard, r.nth, r.times, r.block) for r in got) == sorted(plain)


@pytest.mark.parametrize("few", [100_000, 1])
def test_mix(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(rng.integers(0, 400))), ["a", "b", None, "c"][min(3, i % 7)], 0) for i in range(120)] + [(500, None, "b", 0), (501, "", None, 0), (700, "x y", "a", 0), (700, "x y", "a", 0)]
    df = frame(spark, rows, "doc_id long, text string, source string, n_chars long")
    out = mixing.mix_counts(df, block_words=16).collect()
    assert len(out) == len(rows)
    sources = {}
    for r in out:
        assert r.taken <= 3 * r.size
        total = sources.setdefault((r.source_size, r.target), [0, 0])
        total[0], total[1] = total[0] + r.size, total[1] + r.taken
    assert all(size == s[0] and abs(s[1] - target) <= 32 for (size, target), s in sources.items())
    again = sorted((r.doc_id, r.taken) for r in mixing.mix_counts(df, block_words=16).collect())
    assert again == sorted((r.doc_id, r.taken) for r in out)
    texts = mixing.mix_texts(df, block_words=16)
    assert texts.columns == df.columns
    words, whole = {}, {i: t or "" for i, t, *_ in rows}
    for r in texts.collect():
        assert r.text in whole[r.doc_id] and r.n_chars == len(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text))
    taken = {}
    for r in out:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    assert words == {i: n for i, n in taken.items() if n}
    assert mixing.mix_counts(df.limit(0)).collect() == [] and mixing.mix_texts(df.limit(0)).collect() == []


def test_blocks_are_not_broadcast(spark):
    """Drawn blocks grow with the words; only the table of sources, a row each, is broadcast."""
    df = frame(spark, [(i, "a b c " * 40, f"s{i % 3}") for i in range(20)], "doc_id long, text string, source string")
    for out in (mixing.mix_counts(df, block_words=16), mixing.mix_texts(df, block_words=16)):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join [" in line and "nth#" in line and "block#" in line]
        assert joins and all("SortMergeJoin" in line for line in joins), plan


# packing


def test_pack(spark):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    texts = ["a small text", None, "", "Long Text, ünï😀 <|endoftext|> <|ENDOFTEXT|> it's 12,5!! " * 300, "a small text", "x" * 3000, "İ ΣΑΣ x́ nb sp"]
    df = frame(spark, [(i, t, 0, 0) for i, t in enumerate(texts)] + [(0, texts[0], 0, 0)], "doc_id long, text string, start int, tokens int")
    rows = packing.pack(df, path, sequence=256).collect()
    direct = Tokenizer.from_file(path)
    own, filled = {}, {}
    for r in rows:
        ids = np.array(r.ids, "<u4")
        assert len(ids) == r.length and r.offset + r.length <= 256 and zlib.crc32(ids.tobytes()) == r.ids_crc32
        own.setdefault(r.doc_id, []).append(r)
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(texts):
        want = [*direct.encode(t or "", add_special_tokens=False).ids, 1]
        pieces = sorted(own[i], key=lambda r: (r.start, r.sequence_id))
        got = [x for r in (pieces[::2] if i == 0 and len(pieces) > 1 and pieces[0].start == pieces[1].start else pieces) for x in r.ids]
        assert got == want and pieces[0].doc_tokens == len(want)
    for n, parts in filled.items():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 256 or n == max(filled)
    assert packing.pack(df.limit(0), path).collect() == []


def test_documents_follow_the_curve(spark):
    """Order of the streams: curve key of the plain ids, then id, then place in the table."""
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    rng = np.random.default_rng(9)
    words = ["river", "stone", "light", "wind", "tree,", "Sea", "$$$", "12"]
    rows = [(int(i), " ".join(rng.choice(words, rng.integers(0, 12)))) for i in rng.permutation(80)] + [(None, "no id"), (3, None), (900, "wind " * 5000)]
    direct = Tokenizer.from_file(path)
    table = packing.directions(direct.get_vocab_size())
    keyed = []
    for place, (i, t) in enumerate(rows):
        ids = direct.encode(t or "", add_special_tokens=False).ids
        mean = np.array([table[x].astype(int) for x in ids]).mean(0) if ids else np.zeros(packing.DIMS)
        point = np.minimum((mean + 1) / 2 * (1 << packing.BITS), (1 << packing.BITS) - 1).astype(np.uint64)
        keyed.append((int(packing.hilbert_key(point[None])[0]), i if i is not None else -1, place, len(ids) + 1))
    got = packing.pack(frame(spark, rows, "doc_id long, text string").coalesce(1), path, sequence=64).collect()
    order = [(r.doc_id if r.doc_id is not None else -1, r.doc_tokens) for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    assert order == [(i, n) for _, i, _, n in sorted(keyed)]


def test_other_tokenizers_encode_whole_texts():
    """A tokenizer that keeps case and white space is told by its probe."""
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    enc, direct = packing.WordEncoder(path), Tokenizer.from_file(path)
    texts = ["A text,  with\nCase and spaces ", "", "x"]
    ids, counts = enc.encode([t.encode() for t in texts])
    assert not enc.by_words
    assert ids.tolist() == [i for t in texts for i in direct.encode(t, add_special_tokens=False).ids] and counts.sum() == len(ids)


def test_words_of_odd_texts(monkeypatch):
    """Small chunks and a small memory of words give the ids of whole texts."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CHUNK", 64)
    monkeypatch.setattr(packing, "CACHE_WORDS", 40)
    path = tokenizer_file("word_bpe_49k.json")
    enc, direct = packing.WordEncoder(path), Tokenizer.from_file(path)
    rng = np.random.default_rng(8)
    signs = [*"aAzZ019.,;:!?*$%&#<|>'()- \n\t\x0b\x1c\u00e9\u00c9\u00df\u03a3\u03c2\u0130\u0301\u00a0\u2028\u00aa\u4e2d\U0001f600", "<|endoftext|>", "'s", " "]
    texts = ["".join(rng.choice(signs, rng.integers(0, 90))) for _ in range(400)] + ["a" * 500, "$" * 300, " " * 200, "ab, " * 100]
    ids, counts = enc.encode([t.encode() for t in texts])
    assert enc.by_words
    for t, part in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert part.tolist() == direct.encode(t, add_special_tokens=False).ids, repr(t)


def test_hilbert_curve_visits_neighbours():
    side = np.arange(8)
    points = np.array(np.meshgrid(side, side, side)).reshape(3, -1).T
    key = packing.hilbert_key(points, 3)
    assert sorted(key) == list(range(512))
    path = points[np.argsort(key)].astype(int)
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


# token counts


def test_attribution_against_a_loop(spark):
    """Two fields in one encoding, by a loop over the tokens' places."""
    import public_tokenizers

    path = tokenizer_file("byte_bpe_50k.tiktoken")
    tokenizer, lengths = token_counts.encoding(path, public_tokenizers.PATTERN)
    texts = ["one two\n\n\nthree 😀😀é\nx", "", None, "no end", "\n", "日本語のテキスト\n終わり", "a " * 500, "long line " * 30000 + "\nend"]
    titles = ["A title", None, "only a title", "", "x", "題", "t", "t"]
    spans = lambda t: [(0, len(t)), (1, 3), (2, 2), *token_counts.lines(t), (len(t) // 2, len(t))]
    rows = [(i, t, title, 1) for i, (t, title) in enumerate(zip(texts, titles, strict=True))] + [(0, texts[0], titles[0], 1)]
    df = frame(spark, rows, "doc_id long, text string, title string, field int")
    for rule in token_counts.RULES:
        fields = {"title": token_counts.whole, "text": spans}
        got = sorted({tuple(r) for r in token_counts.attribute(df, path, public_tokenizers.PATTERN, fields, " ", rule).collect()})
        want = []
        for i, t, title, _ in rows[:-1]:
            record = " ".join(x for x in (title, t) if x)
            owner = [k for k, c in enumerate(record) for _ in c.encode()]  # the character of each byte
            ids, at, places = tokenizer.encode_ordinary(record), 0, []
            for x in ids:
                places.append((owner[at], owner[at + lengths[x] - 1]))
                at += lengths[x]
            start = 0
            for name, value, sections in (("title", title, token_counts.whole), ("text", t, spans)):
                if not value:
                    continue
                for n, (b, e) in enumerate(sections(value)):
                    b, e = b + start, e + start
                    counted = sum(b <= p[0 if rule == "first" else 1] < e for p in places)
                    crossing = sum(p[0] < e and p[1] >= b and not (b <= p[0] and p[1] < e) for p in places) if e > b else 0
                    want.append((i, name, n, b, e, counted, crossing, len(ids)))
                start += len(value) + 1
        assert got == sorted(want)
    every = token_counts.attribute(df, path, public_tokenizers.PATTERN).groupBy("doc_id").agg({"n_tokens": "sum", "doc_tokens": "sum", "section": "count"}).collect()
    assert len(every) == 6 and all(r["sum(n_tokens)"] == r["sum(doc_tokens)"] / r["count(section)"] * (2 if r.doc_id == 0 else 1) for r in every)
    assert token_counts.attribute(df.limit(0), path, public_tokenizers.PATTERN).collect() == []


# URL filters


def plain_match(rules, host, path):
    fits = [(h.count(".") + 1, len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else None


@pytest.mark.parametrize("most", [64_000_000, 3])
def test_trie_against_all_rules(spark, monkeypatch, most):
    """Both ways, the broadcast trie and the join beyond its bound."""
    monkeypatch.setattr(url_trie, "MAX_TRIE_BYTES", most)
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr", "allow"), ("a.org", "", "block"), ("b.a.org", "/x/y", "allow"), ("b.a.org", "/x/yz/", "block"), ("b.a.org", "/x/", "allow")]
    hosts = ["net", "x.net", "Example.NET", "www.example.net", "notexample.net", "org", "a.org", "b.a.org", "c.b.a.org", "", "com", "xa.org", ".net"]
    paths = ["", "/", "/en", "/en/", "/en/1", "/fr", "/french", "/x/y", "/x/yz", "/x/yz/1", "/x/", "//", "/x/yzz/"]
    urls = [f"http://{h}{p}{end}" for h in hosts for p in paths for end in ("", "?a=/en/", "#/fr")] + ["no scheme", None, "", "://", "a://b://c/d", "http://É.net/", "http://host:80/x", "http://b.a.org/x/" + "y" * 5000, "http://" + "b." * 300 + "a.org/" + "z/" * 50]
    df = frame(spark, [(i, u, "x") for i, u in enumerate(urls)] + [(0, urls[0], "x")], "page_id long, url string, host string")
    out = url_trie.filter_urls(df, frame(spark, rules, "host string, path string, verdict string")).collect()
    assert len(out) == len(urls) + 1
    for r in out:
        host, path = url_trie.split_url(urls[r.page_id])
        want = plain_match(rules, host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, want and want[0], want[1] if want else "allow")
    assert url_trie.split_url("HTTP://WWW.É.Net?x") == ("www.É.net", "") and url_trie.split_url("a://b://c/d") == ("b:", "//c/d")


def test_urls_of_any_length(spark, monkeypatch):
    """A segment of a million letters, 100,000 segments and 10,000 labels, in time, on both ways."""
    import time

    rules = frame(spark, [("org", "/fr/", "block"), ("host.org", "/fr/" + "a" * 50, "allow"), ("org", "/x/" * 20, "block")], "host string, path string, verdict string")
    urls = ["http://host.org/fr/" + "a" * 1_000_000, "http://host.org/fr/" + "b" * 1_000_000, "http://org/fr" + "/s" * 100_000, "http://" + "l." * 10_000 + "org/fr/", "http://org/" + "x/" * 30]
    df = frame(spark, [*enumerate(urls)], "page_id long, url string").coalesce(1)
    for most in (64_000_000, 0):
        monkeypatch.setattr(url_trie, "MAX_TRIE_BYTES", most)
        url_trie.filter_urls(df.limit(1), rules).collect()
        began = time.time()
        out = {r.page_id: r.rule for r in url_trie.filter_urls(df, rules).collect()}
        assert out == {0: "host.org/fr/" + "a" * 50, 1: "org/fr/", 2: "org/fr/", 3: "org/fr/", 4: None} and time.time() - began < 20
    trie = url_trie.build_trie([(r.host, r.path, r.verdict) for r in rules.collect()])
    for u in urls:
        began = time.time()
        url_trie.match(trie, *url_trie.split_url(u))
        assert time.time() - began < 1


def test_bytes_of_a_trie(spark):
    import tracemalloc

    listed = [(f"h{i}.{'x' * (i % 30)}{i % 97}.net", f"/a{i % 11}/{'é' * (i % 40)}/{i}", "block") for i in range(5000)]
    tracemalloc.start()
    trie = url_trie.build_trie(listed)
    took = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert trie and took <= url_trie.trie_bytes(frame(spark, listed, "host string, path string, verdict string")) < 6 * took


# white space of any length


def test_long_white_space_in_tokens(monkeypatch):
    import random

    import public_tokenizers

    names = (tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    tokenizer, _ = token_counts.encoding(*names)
    joins, _ = token_counts.encoding(names[0], r" ?[^\s\p{L}\p{N}]+[\r\n]*|\p{L}+|\p{N}|\s+(?!\S)|\s+")
    assert token_counts.parts_at_space(names[1]) and not token_counts.parts_at_space(joins._pat_str)
    monkeypatch.setattr(token_counts, "LONG_SPACE", 4)
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", "Éb", "1", "!", "'s", " ", "  ", "\n\n", "\r\n", "\t", "\u2003\u00a0", " " * 9, "\x1f" * 5, "\n" * 7]) for _ in range(rng.randint(0, 25)))
        assert token_counts.encode_whole(tokenizer, text) == tokenizer.encode_ordinary(text)
        assert token_counts.encode_whole(joins, text) == joins.encode_ordinary(text)


def test_two_million_characters_of_one_kind(spark):
    import public_tokenizers

    names = (tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    n = 2_000_000
    texts = [" " * n, "\n" * n, "a" + " \n" * (n // 2) + "b", "w" * n]
    df = frame(spark, [(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    counts = {r.doc_id: (r.n, r.doc_tokens) for r in token_counts.attribute(df, *names, {"text": token_counts.whole}).groupBy("doc_id").agg({"n_tokens": "sum", "doc_tokens": "max"}).toDF("doc_id", "doc_tokens", "n").select("doc_id", "n", "doc_tokens").collect()}
    tokenizer, _ = token_counts.encoding(*names)
    assert counts[3][0] == len(tokenizer.encode_ordinary(texts[3])) and all(a == b for a, b in counts.values()) and counts[0][0] == n
    talk = frame(spark, [(i, k, "assistant", t) for i, t in enumerate(texts) for k in (0, 1)], "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in chat_tree.read_back(chat_tree.build_tree(talk, *names), *names).collect()}
    for i, t in enumerate(texts):
        assert back[i].turns_sha256 == hashlib.sha256(f"assistant\n{t}\n".encode() * 2).hexdigest() and back[i].loss_chars == 2 * len(t)


# helpers


def test_running_total(spark):
    rows = [(g, i, (i * 7) % 5) for g in ("a", None, "b") for i in range(50)]
    df = frame(spark, rows, "g string, i int, v long")
    for r in common.running_total(df, "v", ["i"], ["g"]).collect():
        assert r.start == sum(v for g, i, v in rows if g == r.g and i < r.i)
    assert common.running_total(df.limit(0), "v", ["i"], ["g"]).collect() == []
