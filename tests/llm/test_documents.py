"""Packing, mixing and passages: invariants, round trips and held-out accuracy."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessitura.llm import mixing, packing, tokens, toxicity

DOCS = "doc_id long, source string, text string"


def documents(n=400, seed=0):
    r = random.Random(seed)
    words = "valve body spring 压力腔 chamber Ventil naïve ﬁ 😀 seal".split()
    text = lambda: " ".join(r.choice(words) for _ in range(int(r.paretovariate(0.8)) * 4 % 3000))
    rows = [(i, r.choice(["big"] * 6 + ["mid", "mid", "small", None]), r.choice([None, "", *[text()] * 12])) for i in range(n)]
    return rows + [(n, "big", "word " * 30_000), (n + 1, "small", "x")]


def test_token_counts_are_exact(spark):
    rows = documents(80)
    enc = tokens.encoding(tokens.vocabulary_path())
    got = {r.doc_id: r.n_tokens for r in tokens.with_token_counts(spark.createDataFrame(rows, DOCS), ["doc_id"]).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, _, t in rows}
    for t in ("a <|endoftext|> b", "aé" * 50_000):
        assert enc.decode(enc.encode_ordinary(t)) == t


def check_packing(sizes, packed, capacity):
    bins, pieces = defaultdict(int), defaultdict(list)
    length = {}
    for r in packed:
        bins[r.bin] += r.n_tokens
        length[r.bin] = r.bin_length
        pieces[r.doc_id].append((r.piece, r.start_token, r.n_tokens))
    assert set(pieces) == set(sizes)
    for d, n in sizes.items():
        own = sorted(pieces[d])
        assert [p for p, _, _ in own] == list(range(len(own)))
        at = 0
        for _, start, k in own:
            assert start == at and k <= capacity
            at += k
        assert at == n and (len(own) == 1 or n > capacity)
    assert all(bins[b] <= length[b] <= capacity for b in bins)
    return bins, length


def test_packing(spark, monkeypatch):
    rows = documents(600)
    df = spark.createDataFrame(rows, DOCS)
    cont = spark.createDataFrame([("a", 64), ("b", 777), ("c", 100_000), ("bad", 0), ("null", None)], "container string, capacity_tokens int")
    sizes = {r.doc_id: r.n_tokens for r in tokens.with_token_counts(df, ["doc_id"]).collect()}
    for shard in (32_000, 50):
        monkeypatch.setattr(packing, "SHARD_ITEMS", shard)
        got = packing.pack_documents(df, cont).collect()
        assert {r.container for r in got} == {"a", "b", "c"}
        for name, cap in (("a", 64), ("b", 777), ("c", 100_000)):
            check_packing(sizes, [r for r in got if r.container == name], cap)
    report = {r.container: r for r in packing.pack_report(packing.pack_documents(df, cont), cont).collect()}
    assert set(report) == {"a", "b", "c"} and report["b"].used_of_length <= 1
    assert packing.pack_documents(df.limit(0), cont).count() == 0 and packing.pack_documents(df, cont.limit(0)).count() == 0


def test_best_fit_wastes_little_and_fits():
    r = random.Random(3)
    sizes = [min(2048, int(r.lognormvariate(5.5, 1))) for _ in range(20_000)]
    lengths = packing.permitted(2048)
    bins, length = packing.best_fit(sizes, lengths)
    used = np.bincount(bins, sizes)
    assert (used <= np.array(length)).all() and set(length) <= set(lengths)
    assert sum(sizes) / sum(length) > 0.99
    assert packing.best_fit([], lengths) == ([], [])
    assert packing.best_fit([0, 0], lengths)[1] == [256]


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_mixture_meets_shares_and_repeats(spark):
    rows = documents(3000, 1)
    df = spark.createDataFrame([x for x in rows if x[0] != 3000], DOCS)
    m = mixing.Mixture(df, targets(spark, [("big", 0.5, 1), ("mid", 0.3, 3), ("small", 0.2, 2), ("absent", 0.4, 1), ("mid", 0.1, 9), (None, 0.2, 1)]))
    got = m.rows.collect()
    uses = Counter((r.source, r.doc_id) for r in got)
    assert max(v for (s, _), v in uses.items() if s == "big") == 1
    assert max(v for (s, _), v in uses.items() if s == "small") <= 2 and max(v for (s, _), v in uses.items() if s == "mid") <= 3
    assert len({(r.doc_id, r.repeat) for r in got}) == len(got)
    total = sum(r.n_tokens for r in got)
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(sum(r.n_tokens for r in got if r.source == s) / total - share) < 0.02
    for shard in {r.shard for r in got}:
        pos = sorted(r.position for r in got if r.shard == shard)
        assert pos == list(range(1, len(pos) + 1))
    assert {r.source for r in m.report().collect()} == {"big", "mid", "small"}
    again = mixing.Mixture(df, targets(spark, [("big", 0.5, 1), ("mid", 0.3, 3), ("small", 0.2, 2)])).rows.collect()
    assert sorted(again) == sorted(got)


def test_larger_total_gives_what_repeats_allow(spark):
    df = spark.createDataFrame(documents(500), DOCS)
    m = mixing.Mixture(df, targets(spark, [("small", 0.9, 2), ("big", 0.1, 1)]), total_tokens=1e9)
    uses = Counter(r.doc_id for r in m.rows.where("source = 'small'").collect())
    assert set(uses.values()) == {2}
    assert mixing.Mixture(df, targets(spark, [("none", 1.0, 1)])).rows.count() == 0
    assert mixing.Mixture(df.limit(0), targets(spark, [("big", 1.0, 1)])).rows.count() == 0


@pytest.mark.parametrize("shards", [1, 2, 5, 16])
def test_split_tree_partitions_exactly(shards):
    counts = np.array([1000, 37, 0, 5])
    parts = mixing.split_tree(counts, shards, 3)
    assert len(parts) == shards and (np.sum(parts, axis=0) == counts).all()
    assert max(p.sum() for p in parts) - min(p.sum() for p in parts) <= 2 + np.log2(shards)


@pytest.mark.parametrize("shards,limit", [(1, 4), (5, 4), (37, 8)])
def test_subtrees_go_on_as_the_whole_tree(shards, limit):
    counts = np.array([1000, 370, 0, 50])
    nodes = mixing.subtrees(counts, shards, 3, limit)
    assert len(nodes) <= limit and sum(n for _, n, _ in nodes) == shards
    parts = [leaf for path, n, c in nodes for leaf in mixing.split_tree(c, n, 3, path)]
    assert np.array_equal(parts, mixing.split_tree(counts, shards, 3))
    big = mixing.split_tree(np.array([10**10, 3 * 10**9 + 1]), 3, 1)
    assert np.sum(big, axis=0).tolist() == [10**10, 3 * 10**9 + 1]


def test_shards_hold_the_mixture_however_many_there_are(spark, monkeypatch):
    df = spark.createDataFrame(documents(6000), DOCS)
    want = targets(spark, [("big", 0.5, 1), ("mid", 0.3, 3), ("small", 0.2, 2)])
    shares = []
    for tokens in (mixing.SHARD_TOKENS, 20_000):
        monkeypatch.setattr(mixing, "SHARD_TOKENS", tokens)
        m = mixing.Mixture(df, want)
        rows = m.rows.toPandas()
        per = rows.pivot_table(index="shard", columns="source", values="n_tokens", aggfunc="sum").fillna(0)
        per = per.div(per.sum(1), axis=0)
        random_ = rows.assign(shard=np.random.default_rng(0).permutation(rows["shard"].to_numpy())).pivot_table(index="shard", columns="source", values="n_tokens", aggfunc="sum").fillna(0)
        shares.append((m.shards, len(per), per, random_.div(random_.sum(1), axis=0)))
        got = rows.groupby("source")["n_tokens"].sum() / rows["n_tokens"].sum()
        assert abs(got["big"] - 0.5) < 0.02 and abs(got["mid"] - 0.3) < 0.02
        most = rows.groupby(["source", "doc_id"]).size().groupby("source").max()
        assert most["big"] == 1 and most["mid"] <= 3 and most["small"] <= 2
    assert shares[0][0] == 8 and shares[1][0] > 20
    for _, filled, per, random_ in shares:
        assert filled >= 8 and np.abs(per.mean() - [0.5, 0.3, 0.2]).max() < 0.05
        assert per.std().max() < 1.4 * random_.std().max()  # as even as if every document were dealt by itself


def test_checks_find_nothing_and_what_is_wrong(spark):
    df = spark.createDataFrame(documents(800), DOCS)
    want = targets(spark, [("big", 0.5, 1), ("mid", 0.3, 3), ("small", 0.2, 2)])
    drawn = mixing.Mixture(df, want).rows
    assert tuple(mixing.mixture_check(drawn, want, 0.03).first()) == (0, 0, 0)
    wrong = drawn.unionByName(drawn.where("source = 'big'").limit(1)).withColumn("repeat", F.lit(0))
    assert mixing.mixture_check(wrong, want, 0.03).first().over_repeats >= 1
    cont = spark.createDataFrame([("a", 64), ("b", 777)], "container string, capacity_tokens int")
    packed = packing.pack_documents(df, cont)
    assert tuple(packing.pack_check(df, packed, cont).first()) == (0, 0, 0)
    first = packed.orderBy("container", F.desc("n_tokens"), "doc_id", "piece").first()
    lost = packed.where((F.col("container") != first.container) | (F.col("doc_id") != first.doc_id))
    assert packing.pack_check(df, lost, cont).first().not_covered == 1
    heavy = packed.withColumn("bin", F.lit("one"))
    assert packing.pack_check(df, heavy, cont).first().overfull == 2


INSULTS = ["you are a stupid idiot and a liar", "go to hell you worthless moron", "all strangers are vermin and must be driven out", "hot naked girls want sex tonight"]


def patents(n, toxic, seed):
    r = random.Random(seed)
    plain = ["the {a} valve is connected to the {b} by a spring", "exposing the naked fibre to the {a} beam", "the {b} file is made of steel", "killing weeds with the {a} blade"]
    words = ["upper", "lower", "flexible", "rigid", "central"]
    out = []
    for i in range(n):
        s = [r.choice(plain).format(a=r.choice(words), b=r.choice(words)) for _ in range(r.randrange(4, 25))]
        if i in toxic:
            s.insert(r.randrange(len(s)), r.choice(INSULTS))
        out.append(". ".join(s) + ".")
    return out


def test_fit_finds_held_out_passages(spark):
    toxic = set(range(0, 1500, 12))
    texts = patents(1500, toxic, 0)
    labels = [(i, "rev", "abusive") for i in sorted(toxic)[:60]] + [(i, "rev", "clean") for i in range(1, 200, 7)] + [(0, "b", "clean"), (0, "c", "clean")]
    df = spark.createDataFrame([(i, None if i % 3 else "s", t) for i, t in enumerate(texts)] + [(9001, "s", None), (9002, "s", "")], DOCS)
    lab = spark.createDataFrame(labels, "doc_id long, reviewer string, label string")
    got = toxicity.toxic_documents(df, lab)
    found = {r.doc_id for r in got.where("toxic").collect()}
    assert got.count() == 1502
    held = toxic - {i for i, *_ in labels}
    assert len(found & held) / len(held) > 0.9 and len(found - toxic) <= 5
    assert {r.doc_id: r.score for r in got.where("doc_id > 9000").collect()} == {9001: 0.0, 9002: 0.0}
    rates = {r.source: r for r in toxicity.toxicity_rates(got).collect()}
    assert set(rates) == {"s", None} and sum(r.n_documents for r in rates.values()) == 1502


def test_without_positives_nothing_is_toxic(spark):
    df = spark.createDataFrame([(1, "s", INSULTS[0])], DOCS)
    lab = spark.createDataFrame([], "doc_id long, reviewer string, label string")
    assert toxicity.toxic_documents(df, lab).where("toxic").count() == 0
    assert toxicity.toxic_documents(df.limit(0), lab).count() == 0


def test_disguises_are_undone():
    v = toxicity.Vocabulary(["idiot", "naked", "moron", "spring"])
    plain = toxicity.Tokens.of(["idiot"], v).ids.tolist()
    for x in ("i d i o t", "I D I O T", "1d10t", "idi0t", "i.d.i.o.t", "i-d-i-o-t", "i​d​i​o​t", "idiiiot", "id&ot", "іdіot", "ídíot"):
        assert toxicity.Tokens.of([x], v).ids.tolist() == plain, x
    assert toxicity.Tokens.of(["m***n"], v).ids[0] == toxicity.MASK
    assert toxicity.Tokens.of([None, "", "12 345"], v).ids.tolist() == [toxicity.END] * 3


def test_scores_do_not_depend_on_the_batch():
    texts = patents(40, {3, 9}, 1) + [None, "", "。。", "naked " * 5000]
    m = toxicity.fit(patents(200, set(range(200)), 2), patents(300, set(), 3), np.zeros(300, dtype=bool))
    together = m.scores(texts)
    assert np.allclose(together, [m.scores([t])[0] for t in texts])
    assert together[3] > 0.5 and together[9] > 0.5 and together[-4] == 0


def test_document_frequencies_cover_all_texts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "COUNTED", 3)
    texts = ["The valve, the spring. 12", "valve valve a", None, "", "Spring 弹簧"]
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], DOCS)
    got = {r.word: r.n for r in toxicity.document_frequencies(df).collect()}
    assert got == {"the": 1, "valve": 2, "spring": 2, "弹": 1, "簧": 1}


def test_texts_of_the_fit_are_weighed_before_they_are_read(spark):
    df = spark.createDataFrame([(i, "x" * (5000 if i == 3 else 10)) for i in range(20)], "doc_id long, text string")
    got = toxicity._bounded(df.select("doc_id"), df, 100)
    assert got.num_rows == 10 and 3 not in got["doc_id"].to_pylist()
    assert toxicity._bounded(df.select("doc_id").limit(0), df, 100).num_rows == 0


def test_a_fitted_model_is_kept(spark, tmp_path):
    m = toxicity.fit(patents(60, set(range(60)), 2), patents(90, set(), 3), np.zeros(90, dtype=bool))
    m.to_table(spark).write.parquet(f"{tmp_path}/model")
    back = toxicity.ToxicityModel.from_table(spark.read.parquet(f"{tmp_path}/model"))
    texts = patents(20, {3}, 1)
    assert np.allclose(back.scores(texts), m.scores(texts)) and back.prior == m.prior
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], DOCS)
    got = toxicity.toxic_documents(df, spark.createDataFrame([], "doc_id long, reviewer string, label string"), model=back)
    assert np.allclose([r.score for r in got.orderBy("doc_id").collect()], m.scores(texts))
    with pytest.raises(ValueError):
        toxicity.ToxicityModel.from_table(spark.read.parquet(f"{tmp_path}/model").limit(0))
