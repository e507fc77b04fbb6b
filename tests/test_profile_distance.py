"""Profiles and distances on corpora small enough to work out on paper."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgap.functions.fixed_values import ENGLISH_STOP_WORDS, EPSILON
from corpusgap.operators import distance, profile, tfidf
from corpusgap.runtime import pin

TEXTS = [
    ("a", "test", 1, "cat dog bird"), ("a", "test", 2, "cat cat dog"),
    ("b", "test", 3, "cat dog bird"), ("b", "test", 4, "dog cat cat"),
    ("c", "test", 5, "stone metal stone"), ("d", "test", 6, "The , ."), ("d", "test", 7, ""),
    ("e", "test", 8, "cat stone fish"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(TEXTS, "domain string, split string, doc_id bigint, text string")


def pairs_of(spark, *names):
    rows = [(s, "test", t, "test") for s, t in names]
    return spark.createDataFrame(rows, "source string, source_split string, target string, target_split string")


def by_pair(df):
    return {(r["source"], r["target"]): r for r in df.collect()}


def brute_force(texts_s, texts_t):
    """KL divergence and Jensen-Shannon distance over the union of terms."""
    counts = [{}, {}]
    for side, texts in enumerate((texts_s, texts_t)):
        for text in texts:
            for w in text.split():
                counts[side][w] = counts[side].get(w, 0) + 1
    terms = sorted(set(counts[0]) | set(counts[1]))
    p, q = (np.array([c.get(w, 0) / sum(c.values()) or EPSILON for w in terms]) for c in counts)
    kl = np.sum(p * np.log(p / q) - p + q)
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    return kl, math.sqrt(np.sum(p * np.log(p / m) + q * np.log(q / m)) / 2)


def test_profile_counts_and_empty_domain(corpus):
    rows = {r["domain"]: r for r in profile.domain_profile(corpus).collect()}
    assert (rows["a"]["dataset_size"], rows["a"]["word_count"], rows["a"]["vocab_size"]) == (2, 6, 3)
    assert (rows["d"]["dataset_size"], rows["d"]["word_count"]) == (2, 0)
    assert rows["d"]["shannon_entropy"] == 0.0
    assert rows["e"]["shannon_entropy"] == pytest.approx(math.log(3))


def test_probabilities_sum_to_one(corpus):
    p = profile.term_probability(profile.term_counts(corpus), True)
    sums = p.groupBy("domain").agg(F.sum("p").alias("p")).collect()
    assert all(r["p"] == pytest.approx(1.0) for r in sums)


def test_identical_disjoint_and_empty_pairs(spark, corpus):
    wanted = pairs_of(spark, ("a", "b"), ("a", "c"), ("a", "d"), ("d", "a"), ("a", "a"))
    found = by_pair(distance.distribution_distances(profile.term_counts(corpus), wanted, True))
    same = found["a", "b"]
    assert same["kl-divergence"] == pytest.approx(0, abs=1e-9)
    assert same["js-divergence"] == pytest.approx(0, abs=1e-7)
    assert same["vocab-overlap"] == 100
    apart = found["a", "c"]
    assert apart["vocab-overlap"] == 0
    assert apart["js-divergence"] == pytest.approx(math.sqrt(math.log(2)), abs=1e-6)
    assert found["a", "d"]["vocab-overlap"] == 0 and found["a", "d"]["kl-divergence"] is None
    assert found["d", "a"]["vocab-overlap"] == 0
    assert found["a", "a"]["kl-divergence"] == 0 and found["a", "a"]["vocab-overlap"] == 100


@pytest.mark.parametrize("few", [True, False])
def test_divergences_equal_brute_force_and_are_symmetric(spark, corpus, few):
    names = [(s, t) for s in "abce" for t in "abce" if s != t]
    found = by_pair(distance.distribution_distances(
        profile.term_counts(corpus), pairs_of(spark, *names), few))
    texts = {d: [x for dom, _, _, x in TEXTS if dom == d] for d in "abce"}
    for s, t in names:
        kl, js = brute_force(texts[s], texts[t])
        assert found[s, t]["kl-divergence"] == pytest.approx(kl, rel=1e-9, abs=1e-9)
        assert found[s, t]["js-divergence"] == pytest.approx(js, abs=1e-7)
        assert found[s, t]["js-divergence"] == pytest.approx(found[t, s]["js-divergence"])


def test_long_form_has_the_union_of_terms(spark, corpus):
    rows = distance.global_distribution(profile.term_counts(corpus), pairs_of(spark, ("a", "e")), True).collect()
    assert {r["term"] for r in rows} == {"cat", "dog", "bird", "stone", "fish"}
    assert {r["term"] for r in rows if r["q"] == EPSILON} == {"dog", "bird"}


def test_tfidf_rows_have_unit_length_and_ties_are_ordered(corpus):
    weights = tfidf.document_weights(corpus, True)
    norms = weights.groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert {r["doc_id"] for r in norms} == {1, 2, 3, 4, 5, 6, 8} - {6}
    assert all(r["n"] == pytest.approx(1.0) for r in norms)
    top = tfidf.top_terms(corpus.where("domain = 'e'"), True, 2).orderBy("rank").collect()
    assert [r["term"] for r in top] == ["stone", "fish"]
    counted = tfidf.document_terms(corpus).where("doc_id = 2").collect()
    assert {(r["term"], r["tf"]) for r in counted} == {("cat", 2), ("dog", 1)}


@pytest.mark.parametrize("few", [True, False])
def test_contextual_overlap_equals_full_matrix(spark, few):
    rng = np.random.default_rng(7)
    vectors = {d: rng.normal(size=(n, 5)) for d, n in (("a", 7), ("b", 3), ("c", 12))}
    vectors["b"][1] = 0.0
    rows = [(d, "test", 10 * i + ord(d), v.tolist()) for d, m in vectors.items() for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "domain string, split string, doc_id bigint, embedding array<float>")
    names = [(s, t) for s in "abc" for t in "abc" if s != t]
    found = by_pair(distance.contextual_overlap(df, pairs_of(spark, *names), few))

    def unit(m):
        m = m.astype(np.float32).astype(float)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    for s, t in names:
        k = min(len(vectors[s]), len(vectors[t]))
        want = np.mean(unit(vectors[s][:k]) @ unit(vectors[t][:k]).T)
        assert found[s, t]["contextual-overlap"] == pytest.approx(want, abs=1e-9)


def test_stop_words_are_those_of_spark(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert ENGLISH_STOP_WORDS == StopWordsRemover.loadDefaultStopWords("english")


def test_no_python_and_no_cartesian_product_on_the_token_path(spark, corpus):
    wanted = pairs_of(spark, ("a", "b"))
    frames = [
        profile.term_counts(corpus), tfidf.top_terms(corpus, True),
        distance.distribution_distances(profile.term_counts(corpus), wanted, True),
        distance.overlap_share(profile.term_counts(corpus), wanted, False, "x"),
    ]
    for df in frames:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_made_without_a_join_on_terms(spark):
    rng = np.random.default_rng(1)
    rows = [(f"d{i}", "test", f"t{int(x)}", int(rng.integers(1, 9))) for i in range(9) for x in set(rng.geometric(0.05, 60))]
    terms = pin(spark.createDataFrame(rows, "domain string, split string, term string, n long"))
    asked = [("d0", "d1"), ("d1", "d0"), ("d3", "d3"), ("d8", "d2"), ("d4", "none")]
    wanted = spark.createDataFrame([(a, "test", b, "test") for a, b in asked], distance.PAIR)
    sets, counts = {}, {}
    for d, _, t, n in rows:
        sets.setdefault(d, set()).add(t)
        counts.setdefault(d, {})[t] = n
    shares = distance.overlap_share(terms, wanted, True, "share")
    got = {(r["source"], r["target"]): r["share"] for r in shares.collect()}
    assert set(got) == set(asked)
    for (a, b), share in got.items():
        assert share == pytest.approx(100 * len(sets[a] & sets.get(b, set())) / len(sets[b]) if b in sets else 0)
    found = distance.distribution_distances(terms, wanted, True)
    for df in (shares, found):
        joins = [line for line in plan_of(df).splitlines() if "Join" in line]
        assert joins and not any("term" in line for line in joins)
    for r in found.collect():
        if r["target"] == "none":
            assert r["kl-divergence"] is None
            continue
        p, q = ({t: n / sum(counts[x].values()) for t, n in counts[x].items()} for x in (r["source"], r["target"]))
        union = sorted({*p, *q})
        eps = 2.220446049250313e-16
        kl = sum(p.get(t, eps) * math.log(p.get(t, eps) / q.get(t, eps)) - p.get(t, eps) + q.get(t, eps) for t in union)
        assert r["kl-divergence"] == pytest.approx(kl, abs=1e-9)
    long = distance.global_distribution(terms, wanted, True).collect()
    for a, b in asked:
        own = {r["term"]: (r["p"], r["q"]) for r in long if (r["source"], r["target"]) == (a, b)}
        assert set(own) == sets[a] | sets.get(b, set())
        for t, (x, y) in own.items():
            assert x == pytest.approx(counts[a].get(t, 0) / sum(counts[a].values()), abs=1e-12)
            assert y == pytest.approx(counts[b].get(t, 0) / sum(counts[b].values()) if b in counts else 0, abs=1e-12)


def test_heavy_terms_are_looked_up_and_not_shuffled(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = [" ".join(f"w{min(int(x), 400)}x" for x in rng.zipf(1.3, 80)) for _ in range(60)]
    corpus = pin(spark.createDataFrame([("a" if i % 3 else "b", "test", i, t) for i, t in enumerate(words)],
                                       "domain string, split string, doc_id long, text string"))
    want = {(r["doc_id"], r["term"]): r["weight"] for r in tfidf.document_weights(corpus, True, []).collect()}
    for name, value in (("MOST_HEAVY", 10), ("MOST_HEAVY", 1), ("MAX_HEAVY_BYTES", 0)):
        with monkeypatch.context() as m:
            m.setattr(tfidf, name, value)
            m.setattr(tfidf, "heavy_limit", lambda rows, most=tfidf.MOST_HEAVY: max(2, -(-rows // most)))
            got = {(r["doc_id"], r["term"]): r["weight"] for r in tfidf.document_weights(corpus, True, []).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())
    pairs = pin(tfidf.document_terms(corpus, []))
    idf = pin(pairs.groupBy("domain", "split", "term").agg(F.count("*").alias("_df")).withColumn("_idf", F.lit(1.0)))
    most = 100
    limit = tfidf.heavy_limit(pairs.count(), most)
    assert 0 < idf.where(F.col("_df") >= limit).count() <= most
    joined = tfidf.with_idf(pairs, idf, limit)
    assert joined.count() == pairs.count()
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2 and plan.count("Join") == 3


def test_tokens_of_odd_texts(spark):
    from corpusgap.functions import text as tx

    texts = ["𝒜b 𝒜😀b😀😀 c", "a\u00a0b\u2003c\u0085d", "", None, "x_y-z..  \n\tq$1\\2", "İ é É ß K", " a bc ", "😀", "a\x1cb\x0bcc"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select(tx.tokens(F.col("text")).alias("t"), tx.long_words(F.col("text")).alias("w")).collect()
    every = df.select(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"), F.lit(0)).alias("t"),
                      F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)).alias("w")).collect()
    assert got == every and got[0]["t"] == ["𝒜b", "𝒜", "😀", "b", "😀", "😀", "c"]


def test_low_scores_go_before_terms_are_ranked(spark, monkeypatch):
    from corpusgap.operators import ranking

    rng = np.random.default_rng(6)
    rows = [(g, "test", f"t{i}", float(s)) for g in "ab" for i, s in enumerate(np.round(rng.zipf(1.4, 400) * 0.1, 3))]
    df = pin(spark.createDataFrame(rows, "domain string, split string, term string, score double"))
    level = F.floor(F.log2(F.greatest("score", F.lit(1e-6))) * 16).cast("int")
    kept = {(r["domain"], r["term"]) for r in ranking.without_low(df, ["domain", "split"], level, 20, True).collect()}
    best = {(g, r[2]) for g in "ab" for r in sorted((x for x in rows if x[0] == g), key=lambda x: (x[3], x[2]))[-20:]}
    assert best <= kept and len(kept) < len(rows) / 2
    seen = []
    monkeypatch.setattr(tfidf, "top_n", lambda df, *rest: seen.append(df.count()) or ranking.top_n(df, *rest))
    texts = [" ".join(f"w{i}x" for i in range(k, 300)) for k in range(0, 300, 20)]
    corpus = pin(spark.createDataFrame([("a", "test", i, t) for i, t in enumerate(texts)], "domain string, split string, doc_id long, text string"))
    every = tfidf.term_scores(corpus, True).collect()
    top = {r["term"] for r in tfidf.top_terms(corpus, True, 10).collect()}
    assert top == {r["term"] for r in sorted(every, key=lambda r: (round(r["score"], 9), r["term"]))[-10:]}
    assert seen[0] < len(every)


def test_scores_move_lists_of_terms_and_not_rows_per_document(spark):
    from corpusgap.operators import term_blocks

    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{min(int(x), 300)}é the" for x in rng.zipf(1.3, rng.integers(0, 60))) for _ in range(40)] + [None, "", "the a"]
    rows = [("abc"[i % 3], "test" if i % 5 else "train", i, t) for i, t in enumerate(texts)] + [(None, "test", 99, "w1é w2é")]
    kind = "domain string, split string, doc_id long, text string"
    corpus = pin(spark.createDataFrame(rows, kind).repartition(3))
    sums = lambda df: {(r[0], r[1], r[2]): r[3] for r in df.collect()}
    by_rows = lambda df: sums(tfidf.document_weights(df, True).groupBy("domain", "split", "term").agg(F.sum("weight")))
    want = by_rows(corpus)
    found = tfidf.term_scores(corpus, True)
    got = sums(found)
    assert got.keys() == want.keys() and len(want) > 100 and all(got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    # blocks of a few words, several parts of each group
    words = corpus.where("domain is not null").select("domain", "split", tfidf.tx.long_words(F.col("text")).alias("words"))
    blocks = pin(term_blocks.blocks(words, ENGLISH_STOP_WORDS, 3, most_words=50))
    assert blocks.select("block").distinct().count() > 20 and {r[0] for r in blocks.select("part").distinct().collect()} == {None, 0, 1, 2}
    assert blocks.agg(F.max(F.octet_length("codes")) <= 4 * 60).first()[0]
    sizes = corpus.groupBy("domain", "split").agg(F.count("*").alias("docs"))
    lists = term_blocks.with_frequency(blocks.where("part is not null").drop("codes", "tf").join(sizes, ["domain", "split"]))
    got = sums(term_blocks.merged(term_blocks.weighed(blocks.where("part is null").select("block", "codes", "tf"), lists)))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())
    # documents that share an id share a norm
    twice = pin(spark.createDataFrame([("a", "test", 1, "cat dog"), ("a", "test", 1, "cat bird"), ("a", "test", 2, "fish"),
                                       ("a", "test", None, "cat"), ("a", "test", None, "stone fish")], kind))
    got, want = sums(tfidf.term_scores(twice, True)), by_rows(twice)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())
    assert tfidf.term_scores(corpus.limit(0), True).count() == 0
