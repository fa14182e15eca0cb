"""Hand-computed sequences for the operators' finer points, and invariants."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import arrays as A
from helixframe.functions import tables as T
from helixframe.operators import analysis, bow, compose, evaluate, learn, residue, score, syntax, weighting, words
from helixframe.sources import formats


def seqs(spark, *items):
    return spark.createDataFrame(list(enumerate(items)), "seq_id long, seq string")


def as_dict(df, value="value", key="word"):
    return {r[key]: r[value] for r in df.collect() if r[value]}


def test_kmer_bow_counts_overlapping_windows(spark):
    got = as_dict(bow.kmer_bow(seqs(spark, "AACA"), 2, T.DNA))
    assert got == pytest.approx({"AA": 1 / 3, "AC": 1 / 3, "CA": 1 / 3}, abs=1e-8)
    assert bow.kmer_bow(seqs(spark, "AACA"), 2, T.DNA).count() == 16


def test_bow_of_short_and_empty_sequences_is_zero(spark):
    rows = bow.kmer_bow(seqs(spark, "", "A", None), 2, T.DNA).collect()
    assert len(rows) == 48 and all(r.value == 0 for r in rows)


def test_revkmer_folds_strands(spark):
    assert as_dict(bow.kmer_bow(seqs(spark, "ACGT"), 2, T.DNA, reverse=True)) == pytest.approx({"AC": 2 / 3, "CG": 1 / 3}, abs=1e-7)
    a, b = ("AACGTTGCA", "TGCAACGTT")
    got = [as_dict(bow.kmer_bow(seqs(spark, x), 2, T.DNA, reverse=True)) for x in (a, b)]
    assert got[0] == got[1]


def test_mismatch_bow(spark):
    got = as_dict(bow.mismatch_bow(seqs(spark, "AC"), 2, T.DNA))
    assert got == {w: 1 for w in ["AC", "CC", "GC", "TC", "AA", "AG", "AT"]}
    assert as_dict(bow.mismatch_bow(seqs(spark, "AC"), 2, T.DNA, m=0)) == {"AC": 1}


def brute_subsequence(seq, k, delta):
    from collections import Counter
    from itertools import combinations

    out = Counter()
    for at in combinations(range(len(seq)), k):
        out["".join(seq[i] for i in at)] += 1 if at[-1] - at[0] == k - 1 else delta ** (at[-1] - at[0] + 1)
    return out


@pytest.mark.parametrize("k", [1, 2, 3])
def test_subsequence_bow_against_all_combinations(spark, k):
    for seq in ("ACA", "ACGTTGCAAC", "A"):
        got = as_dict(bow.subsequence_bow(seqs(spark, seq), k, T.DNA, 0.5))
        assert got == pytest.approx(dict(brute_subsequence(seq, k, 0.5)))


def test_dr_bow(spark):
    rows = {(r.dist, r.word): r.n for r in bow.dr_bow(seqs(spark, "ACA"), 2).collect()}
    assert rows == {(0, "A"): 2, (0, "C"): 1, (1, "AC"): 1, (1, "CA"): 1, (2, "AA"): 1}


def test_subsequence_words_stay_within_four_letters(spark):
    got = [r.word for r in words.subsequence_words(seqs(spark, "ACGTAC"), 2).where("pos = 0").collect()]
    assert sorted(got) == ["AA", "AC", "AG", "AT"]
    assert words.subsequence_words(seqs(spark, "ACGTACGTAC"), 6).count() == 0


def test_top_n_gram_prefers_the_profile(spark):
    profile = spark.createDataFrame([(0, 0, [0.0] * 19 + [9.0])], "seq_id long, pos int, scores array<double>")
    assert words.top_n_gram(seqs(spark, "A"), 1, profile).first().seq == "V"
    assert words.top_n_gram(seqs(spark, "AW"), 1).first().seq == "AW"


def test_nd_is_cumulative_density(spark):
    got = [r.value for r in syntax.nd(seqs(spark, "ACGA")).orderBy("pos").collect()]
    assert got == [1.0, 0.5, 0.333, 0.5]


def test_zcpseknc_phases(spark):
    rows = {r.feature: r.value for r in syntax.zcpseknc(seqs(spark, "AAAA"), 1, 1, 0.0).collect()}
    # starts 0 to 3 are in phases 2, 3, 1, 2
    x = [rows[f"x||{p}"] for p in (1, 2, 3)]
    assert x[1] == pytest.approx(2 * x[0]) and x[0] == pytest.approx(x[2])


def test_window_pads_at_the_end_on_both_edges(spark):
    rows = spark.createDataFrame([(0, i, [float(i + 1)]) for i in range(6)], "seq_id long, pos int, vec array<double>")
    got = {r.pos: r.features for r in residue.sliding(rows, 3).collect()}
    assert got[0] == [1, 2, 0] and got[1] == [1, 2, 3] and got[5] == [5, 6, 0]
    with pytest.raises(ValueError):
        residue.sliding(rows, 4)


def test_scores(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0, 2.0]), (2, [0.0, 1.0, 3.0])], "id long, x array<double>")
    get = lambda m: {(r.query_id, r.id): r.score for r in score.pairs(rows, rows, m).collect()}
    assert get("JSC")[1, 2] == 0.5 and get("HD")[1, 2] == 1 and get("ED")[1, 2] == 1.0
    assert get("CS")[1, 1] == 1.0 and get("PCC")[2, 2] == 1.0
    assert get("MD")[1, 2] >= get("ED")[1, 2] >= get("CD")[1, 2]


def test_binary_metrics(spark):
    rows = spark.createDataFrame([(1, 1, 0.9), (1, -1, 0.4), (-1, -1, 0.3), (-1, -1, 0.4)], "y int, p int, score double")
    r = evaluate.binary_metrics(rows).first()
    assert (r.Sn, r.Sp, r.Acc, r.BAcc, r.Pr, r.F1, r.MCC) == (0.5, 1.0, 0.75, 0.75, 1.0, 0.6667, 0.5774)
    assert r.AUC == 0.875
    assert evaluate.binary_metrics(rows.where("y = 5")).first().Acc in (0.0, None)


def test_tfidf_rows_have_length_one(spark):
    t = weighting.tf_idf(words.kmer_words(seqs(spark, "ACGTAC", "ACCA", "GG"), 2), digits=-1)
    for r in t.groupBy("seq_id").agg(F.sum(F.col("value") * F.col("value")).alias("n")).collect():
        assert r.n == pytest.approx(1)
    assert weighting.tf_idf(words.kmer_words(seqs(spark, "ACG"), 1)).count() == 0


def test_text_rank_equals_the_dense_graph(spark):
    t = weighting.tf_idf(words.kmer_words(seqs(spark, "ACGTAC", "ACCA", "GGT", "TTTT"), 2), digits=-1)
    rows = t.collect()
    vocabulary = sorted({r.word for r in rows})
    x = np.zeros((4, len(vocabulary)))
    for r in rows:
        x[r.seq_id, vocabulary.index(r.word)] = r.value
    a = x @ x.T
    rank = np.full(4, 0.25)
    for _ in range(10):
        rank = 0.15 / 4 + 0.85 * (a / a.sum(0)) @ rank
    got = {r.seq_id: r["rank"] for r in weighting.text_rank(t, 0.85, 10).collect()}
    assert [got[i] for i in range(4)] == pytest.approx(rank.tolist())


def test_psfm_ignores_gaps(spark):
    rows = spark.createDataFrame([(1, "A-"), (1, "AC"), (1, "CC")], "seq_id long, aligned string")
    got = {(r.pos, r.letter): r.share for r in residue.psfm(rows).collect()}
    assert got == {(0, "A"): 0.666667, (0, "C"): 0.333333, (1, "C"): 1.0}


def test_pssm_dt_agrees_with_letter_pairs(spark):
    s = seqs(spark, "ACDEFGHIK", "WWYAC")
    key = lambda df: {(r.seq_id, r.lag, r.i, r.j): r.value for r in df.collect()}
    a, b = key(syntax.pssm_dt(residue.pssm_rows(s), 2)), key(syntax.letter_pair_dt(s, 2))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 2e-6


def test_pssm_rt_doubles_the_first_pair(spark):
    rows = spark.createDataFrame([(0, i, [float(i)] * 20) for i in range(4)], "seq_id long, pos int, vec array<double>")
    got = {(r.part, r.a, r.b): r.value for r in syntax.pssm_rt(rows, 4).collect()}
    s = [1 / (1 + math.exp(i)) for i in range(4)]
    assert got["pair", 0, 0] == pytest.approx((2 * s[0] + s[1] + s[3]) * s[2], abs=1e-6)
    assert got["multi", 0, 0] == pytest.approx(s[0], abs=1e-6) and got["multi", 1, 0] == pytest.approx(s[2] + s[3], abs=1e-6)


def test_motif_scores(spark):
    rows = spark.createDataFrame([(0, i, [float(x)] + [0.0] * 19) for i, x in enumerate([1, -2, 3])], "seq_id long, pos int, vec array<double>")
    r = syntax.motif_scores(rows, {"m": [[1.0] + [0.0] * 19]}).first()
    assert (r["mean"], r.peak) == (2.0, 3.0)  # pairs (1, 0) and (3)
    assert [round(x, 3) for x in formats.motif_from_pattern("[AC]")[0][:2]] == [0.6, 0.4]


def test_autocovariance_keeps_its_definition(spark):
    v = [T.HYDROPHOBICITY[c] for c in "ACDEW"]
    mean = sum(v[:-1]) / 4
    expected = sum((v[i] - mean) * v[i + 1] for i in range(4)) / 4
    got = syntax.covariance(seqs(spark, "ACDEW"), "ac", 1, 1, {"H": T.HYDROPHOBICITY}).first()
    assert got.value == pytest.approx(expected, abs=1e-8)
    with pytest.raises(ValueError):
        syntax.autocorrelation(seqs(spark, "ACDEW"), "moran", 16, 1, {"H": T.HYDROPHOBICITY})


def test_scalers_and_selection(spark):
    wide = spark.createDataFrame([(i, [float(i), 5.0]) for i in range(4)], "id long, x array<double>")
    got = {(r.id, r.feature): r.value for r in analysis.min_max(analysis.to_long(wide)).collect()}
    assert got[3, 0] == 1.0 and got[2, 1] == 0.0
    scaler = analysis.fit_scaler(analysis.to_long(wide.where("id < 2")), "min-max")
    assert {(r.id, r.feature): r.value for r in analysis.apply_scaler(analysis.to_long(wide), scaler).collect()}[3, 0] == 3.0
    y = spark.createDataFrame([(i, int(i > 1)) for i in range(4)], "id long, y int")
    best = analysis.select_best(analysis.f_value(analysis.to_long(wide), y), 1).first()
    assert best.feature == 0 and best["rank"] == 1


def test_grid_and_pick(spark):
    assert evaluate.number_range([0.1, 0.3, 0.1]) == [0.1, 0.2, 0.3] and evaluate.number_range([2]) == [2]
    g = evaluate.grid(spark, {"k": [1, 2], "c": ["a", "b"]})
    assert [(r.k, r.c) for r in g.orderBy("idx").collect()] == [("1", "a"), ("1", "b"), ("2", "a"), ("2", "b")]
    assert evaluate.pick(g.select("idx", F.lit(1).alias("m")), "m").first().idx == 0


def test_crf_gradient_and_viterbi():
    rng = np.random.default_rng(0)
    crf = learn.Crf(3)
    x, y = rng.normal(size=(6, 3)), np.array([0, 1, 1, 0, 1, 0])
    p, _, _ = crf.marginals(x)
    grad = x.T @ (np.eye(2)[y] - p)
    eps = 1e-5
    crf.w[1, 0] += eps
    up = crf.log_likelihood(x, y)
    crf.w[1, 0] -= 2 * eps
    assert grad[1, 0] == pytest.approx((up - crf.log_likelihood(x, y)) / (2 * eps), rel=1e-4)
    crf.w[1, 0] += eps
    crf.fit([(x, y)], epochs=500, rate=0.3)
    assert (crf.decode(x) == y).mean() >= 5 / 6
    every = [np.array([int(b) for b in f"{i:06b}"]) for i in range(64)]
    best = max(every, key=lambda s: crf.log_likelihood(x, s))
    assert (crf.decode(x) == best).all()


def test_glove_and_embedding(spark):
    w = words.kmer_words(seqs(spark, "ACGTACGTAC", "GGTTACA"), 2)
    t = {(r.a, r.b): r.weight for r in weighting.co_occurrence(words.kmer_words(seqs(spark, "ACG"), 1), 2).collect()}
    assert t == {("A", "C"): 1.0, ("C", "A"): 1.0, ("C", "G"): 1.0, ("G", "C"): 1.0, ("A", "G"): 0.5, ("G", "A"): 0.5}
    v = weighting.glove(weighting.co_occurrence(w, 3), dim=4, rounds=3)
    assert all(np.linalg.norm(r.vector) == pytest.approx(1) for r in v.collect())
    assert all(len(r.features) % 4 == 0 for r in weighting.embed(w, v, 4).collect())


def test_nearest_neighbours_are_exact(spark, monkeypatch):
    """Also where first coordinates are far apart, and over many blocks."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(90, 6)), rng.integers(0, 3, 90)
    x[:, 0] *= 0.8
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    np.fill_diagonal(d, np.inf)
    rows = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "id long, x array<double>, y int")
    monkeypatch.setattr(evaluate, "BLOCK", 20)
    got = {(r.id, r.other) for r in evaluate.nearest(rows, 3).collect()}
    assert got == {(i, int(j)) for i in range(90) for j in np.argsort(d[i], kind="stable")[:3]}
    one = d.argmin(1)
    want = {(i, int(one[i])) for i in range(90) if one[one[i]] == i and i < one[i] and y[i] != y[one[i]]}
    assert want and {(r.a, r.b) for r in evaluate.tomek_links(rows).collect()} == want


def test_smote_fills_every_class(spark):
    rng = np.random.default_rng(2)
    y = np.array([0] * 40 + [1] * 9 + [2] * 4 + [3])
    x = rng.normal(size=(len(y), 3)) + y[:, None]
    rows = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "id long, x array<double>, y int")
    got = evaluate.smote(rows).collect()
    assert collections.Counter(r.y for r in got) == {1: 31, 2: 36} and len({r.id for r in got}) == len(got)
    for r in got:
        a, b, _ = map(int, r.id.split("~"))
        assert y[a] == y[b] == r.y and a != b
        d = np.linalg.norm(x - x[a], axis=1)
        assert b in [j for j in np.argsort(d) if y[j] == r.y and j != a][:5]
        t = (np.array(r.x) - x[a]) / (x[b] - x[a])
        assert t == pytest.approx(np.full(3, t[0])) and 0 <= t[0] <= 1
    over = evaluate.balanced(rows, "over").collect()
    assert collections.Counter(r.y for r in over) == {0: 40, 1: 40, 2: 40, 3: 1}
    under = {r.id for r in evaluate.balanced(rows, "under").collect()}
    links = evaluate.tomek_links(rows).collect()
    assert under == {str(i) for i in range(len(y))} - {str(i) for l in links for i in (l.a, l.b) if y[i] != 3}
    assert evaluate.balanced(rows, "combine").count() <= len(over)
    assert evaluate.smote(rows.limit(0)).count() == 0


def test_dbscan_equals_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(analysis, "BLOCK", 25)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(40, 2)) * 0.25, rng.normal(size=(30, 2)) * 0.2 + 2, rng.uniform(-4, 6, (30, 2))])
    x = x[rng.permutation(len(x))]
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= 0.25
    core = near.sum(1) >= 5
    want, label = np.full(len(x), -1), 0
    for i in range(len(x)):  # as published: grow each cluster from its first core row
        if core[i] and want[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if want[j] < 0:
                    want[j] = label
                    todo += [k for k in np.flatnonzero(near[j]) if want[k] < 0] if core[j] else []
            label += 1
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    got = {r.id: (r.n, r.core, r.cluster) for r in analysis.dbscan(rows, 0.5, 5, scale=False).collect()}
    assert got == {i: (int(near[i].sum()), bool(core[i]), int(want[i])) for i in range(len(x))} and label > 1
    z = (x - x.mean(0)) / x.std(0)
    scaled = {r.id: r.n for r in analysis.dbscan(rows, 0.5, 5).collect()}
    assert scaled == {i: int((((z - z[i]) ** 2).sum(1) <= 0.25).sum()) for i in range(len(x))}


def plain_ward(x, k):
    """Ward's agglomeration over all pairs, one merge after the other."""
    clusters = [[i] for i in range(len(x))]
    while len(clusters) > k:
        best = min((2 * len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum(), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters[:i]))
        clusters[best[2]] += clusters.pop(best[1])
    return {frozenset(c) for c in clusters}


def test_agnes_equals_ward(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(12, 3)) + 6 * np.eye(3)[i] for i in range(3)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    for k in (2, 3, 6):
        got = {}
        for r in analysis.agnes(rows, k, neighbours=len(x) - 1).collect():  # the whole graph: plain Ward
            got.setdefault(r.cluster, set()).add(r.id)
        assert {frozenset(c) for c in got.values()} == plain_ward(x, k)
    apart = spark.createDataFrame([(i, [float(i // 3 * 100), float(i % 3)]) for i in range(9)], "id long, x array<double>")
    assert len({r.cluster for r in analysis.agnes(apart, 2, neighbours=2).collect()}) == 3
    assert analysis.agnes(rows.limit(1), 2).first().cluster is not None


def test_affinity_propagation_groups_like_columns(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(200, 3)) * 3
    x = np.concatenate([base[:, [i]] + rng.normal(size=(200, 4)) * 0.1 for i in range(3)], 1)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    got = {r.feature: r.exemplar for r in analysis.affinity_propagation(rows).collect()}
    assert len(set(got.values())) == 3 and all(len({got[4 * i + j] for j in range(4)}) == 1 for i in range(3))


def test_scores_of_degenerate_vectors(spark):
    rows = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 3.0]), (3, [0.0, 1.0])], "id long, x array<double>")
    got = lambda m: {(r.query_id, r.id): r.score for r in score.pairs(rows, rows, m).collect()}
    cs, pcc, kld = got("CS"), got("PCC"), got("KLD")
    assert cs[0, 1] is None and cs[1, 1] == 1.0 and pcc[1, 2] is None and pcc[2, 3] == 1.0
    assert kld[0, 1] is None and kld[1, 3] == math.inf and kld[1, 1] == 0.0
    p, q = np.array([0.5, 0.5]), np.array([0.25, 0.75])
    assert kld[1, 2] == pytest.approx(round(((p * np.log(p / q)).sum() + (q * np.log(q / p)).sum()) / 2, 4))


def test_compositions_by_name(spark):
    rows = seqs(spark, *["ACGTACGTTGCA", "AACCGGTTACGT", "ACACACACACGT", "GGGTTTAAACCC"] * 3)
    for kind in ("Kmer", "RevKmer", "Mismatch", "Subsequence"):
        assert compose.sentence(rows, kind, 2, T.DNA).count() > 0
    w = compose.sentence(rows, "Kmer", 2, T.DNA)
    for source in compose.SOURCES:
        assert compose.weighted(w, source).count() > 0
    x = {r.id: np.array(r.x) for r in compose.wide(compose.weighted(w, "BOW")).collect()}
    assert len(x) == 12 and all(v.sum() == 11 for v in x.values())
    for method in ("LSA", "PLSA", "LDA", "Labeled-LDA"):
        got = compose.topic_features(w, "BOW", method, 2, rounds=2).collect()
        assert len(got) == 12 and all(len(r.topics) == 2 for r in got)
    for method in ("word2vec", "Glove", "fastText"):
        assert compose.word_vectors(w, method, 4).count() > 0
    for bad in (lambda: compose.sentence(rows, "x", 2, T.DNA), lambda: compose.weighted(w, "x"), lambda: compose.topic_features(w, "BOW", "x", 2), lambda: compose.word_vectors(w, "x", 2)):
        with pytest.raises(ValueError):
            bad()


def test_tables_hold_the_published_values():
    """Values looked up in the publications, not in the tables."""
    b = lambda m, x, y: m[x][T.MATRIX_ORDER.index(y)]
    assert [b(T.BLOSUM62, *p) for p in ("WW", "CC", "AA", "WP", "IV", "DE", "KR", "GI")] == [11, 9, 4, -4, 3, 2, 2, -4]
    assert [b(T.PAM250, *p) for p in ("WW", "CC", "AA", "FY", "WR", "DE", "IV")] == [17, 12, 2, 7, 2, 3, 4]
    assert all(b(m, x, y) == b(m, y, x) for m in (T.BLOSUM62, T.PAM250) for x in T.PROTEIN for y in T.PROTEIN)
    assert T.MASS["G"] < T.MASS["A"] < T.MASS["W"] and max(T.MASS, key=T.MASS.get) == "W"


def test_ranks_and_running_sums(spark):
    from helixframe.operators.scale import ranked, running

    rng = np.random.default_rng(7)
    rows = [(["a", "a", "a", "b", None][i % 5], int(v), i) for i, v in enumerate(rng.integers(0, 40, 300))]
    df = spark.createDataFrame(rows, "g string, v int, i long").repartition(6)
    for group in ([], ["g"]):
        got = running(df, [F.asc("v"), F.asc("i")], {"sofar": "v"}, tuple(group)).collect()
        at = {(r.i): r["rank"] for r in ranked(df, group, ["v", "i"]).collect()}
        for r in got:
            before = sorted((v, i) for g, v, i in rows if (not group or g == r.g) and (v, i) <= (r.v, r.i))
            assert r.sofar == sum(v for v, _ in before) and at[r.i] == len(before) - 1


def test_written_tables_are_swept(spark):
    import os

    from helixframe.sources.lineage import stash, swept

    kept = stash(spark.range(3).toDF("a"), "kept")
    with swept(spark):
        gone = stash(spark.range(3).toDF("a"), "gone")
        path = gone.inputFiles()[0].removeprefix("file://").removeprefix("file:")
        assert os.path.exists(path) and kept.count() == 3
    assert not os.path.exists(path) and kept.count() == 3


def test_covariances_of_a_profile_of_one_row(spark):
    rows = residue.pssm_rows(seqs(spark, "A", "ACDEF"))
    assert {r.seq_id for r in syntax.acc_pssm(rows, 2).collect()} == {1}


def test_letter_covariances_equal_those_of_the_profile(spark):
    s = seqs(spark, "A", "", None, "WK", "ACDEFGHIKLMNPQRSTVWY", "AAAA", "MKVLAAGIVMKV")
    rows = residue.pssm_rows(s)
    whole = {(r.seq_id, r.kind, r.lag, r.i, r.j): r.value for r in syntax.acc_pssm(rows, 3).collect()}
    for kind in ("ac", "cc", "acc"):
        got = {(r.seq_id, r.kind, r.lag, r.i, r.j): r.value for r in syntax.letter_acc(s, 3, kind).collect()}
        assert got == pytest.approx({k: v for k, v in whole.items() if kind in (k[1], "acc")}, abs=1e-9)
    with pytest.raises(Exception, match="BLOSUM62"):
        syntax.letter_acc(seqs(spark, "AJA"), 1).count()


def test_letter_motif_scores_equal_those_of_the_profile(spark):
    s = seqs(spark, "A", "", None, "WKL", "ACDEFGHIKLMNPQRSTVWY", "MKVLAAGIVMKV", "ACE")
    rng = np.random.default_rng(3)
    motifs = {"a": rng.normal(size=(3, 20)).tolist(), "b": rng.normal(size=(4, 20)).tolist(), "c": rng.normal(size=(1, 20)).tolist()}
    get = lambda df: {(r.seq_id, r.motif): (r["mean"], r.peak) for r in df.collect()}
    old, new = get(syntax.motif_scores(residue.pssm_rows(s), motifs)), get(syntax.letter_motif_scores(s, motifs))
    assert old.keys() == new.keys() and len(new) == 11 and all(new[k] == pytest.approx(old[k], abs=2e-6) for k in old)
    plan = syntax.letter_motif_scores(s, motifs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_scores_equal_their_definitions_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.round(np.abs(rng.normal(size=(40, 6))) + 0.05, 1)
    x[3, 2] = x[4, 2] = x[5, 0] = 0.0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(40, None), (41, [1.0, None, 1.0, 1.0, 1.0, 1.0])], "id long, x array<double>")

    def plain(method, a, b):
        with np.errstate(all="ignore"):
            p, q = a / a.sum(), b / b.sum()
            both = np.where((p > 0) & (q > 0), (p - q) * np.log(p / q), np.where((p == 0) & (q == 0), 0, np.inf)).sum() / 2
        active = ((a != 0) | (b != 0)).sum()
        return {"ED": np.linalg.norm(a - b), "MD": abs(a - b).sum(), "CD": abs(a - b).max(), "HD": (a != b).sum(), "JSC": (a != b).sum() / active, "CS": a @ b / np.sqrt(a @ a * (b @ b)), "PCC": np.corrcoef(a, b)[0, 1], "KLD": both}[method]

    monkeypatch.setattr(score, "PART_BYTES", 300)  # several passes
    monkeypatch.setattr(score, "CELLS", 7)
    for method in score.METHODS:
        got = {(r.query_id, r.id): r.score for r in score.pairs(rows.where("id % 4 = 0"), rows, method).collect()}
        assert len(got) == 11 * 42 and got[0, 40] is None and got[40, 0] is None and got[8, 41] is None
        for (a, b), v in got.items():
            if a < 40 and b < 40:
                assert v == pytest.approx(plain(method, x[a], x[b]), abs=6e-5)
    assert "zip_with" not in score.pairs(rows, rows, "JSC")._jdf.queryExecution().toString()


@pytest.mark.parametrize("method", ["CS", "PCC"])
def test_queries_are_made_ready_once(monkeypatch, method):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(30, 5)), rng.normal(size=(7, 5))
    seen, sums = [], score._sums
    monkeypatch.setattr(score, "_sums", lambda v: seen.append(len(v)) or sums(v))
    made = score.METHODS[method](y)
    got = np.concatenate([made(x[i : i + 3]) for i in range(0, 30, 3)])
    assert 0 < seen.count(7) <= 2 and got.shape == (30, 7)
    want = np.corrcoef(x, y)[:30, 30:] if method == "PCC" else x @ y.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
    assert np.allclose(got, want, atol=1e-12)


def test_places_that_differ_among_many_numbers_and_places():
    rng = np.random.default_rng(7)
    for numbers, places in ((4, 6), (700, 300)):  # more than a byte holds
        x, y = (rng.integers(0, numbers, (n, places)).astype(float) for n in (12, 9))
        x[0, 0], x[1, 1], x[2, 2], x[3, 3], y[0, 0], y[1, 1], y[2, 2] = np.nan, np.inf, -0.0, numbers + 5, np.nan, np.inf, 0.0
        gap = np.array([[sum(not (p == q or (p != p and q != q)) for p, q in zip(a, b)) for b in y] for a in x])
        active = np.array([[sum(p != 0 or q != 0 for p, q in zip(a, b)) for b in y] for a in x])
        assert (score.METHODS["HD"](y)(x) == gap).all() and (score.METHODS["JSC"](y)(x) == gap / np.maximum(active, 1)).all()


def test_a_number_that_stands_often_is_rounded_by_its_digits_once(monkeypatch):
    import decimal

    seen, real = [], decimal.Decimal
    monkeypatch.setattr(decimal, "Decimal", lambda v: seen.append(v) or real(v))
    got = A.half_up(np.array([[1 / 32, -1 / 32, 3 / 32, 0.1]] * 500), 4)  # 0.03125 and 0.09375 are halves
    assert (got == [0.0313, -0.0313, 0.0938, 0.1]).all() and len(seen) <= 3


def test_divergence_of_zero_and_null_vectors_is_that_of_its_sql(spark, tmp_path):
    import duckdb

    from helixframe.plans.catalogue import ORACLES, QUERIES

    rows = [(0, [0.0, 0.01]), (1, [0.0, 0.0]), (2, [1.0, 2.0]), (3, [2.0, 1.0]), (20, [1.0, 2.0]), (40, None), (60, [1.0, None]), (80, [float("nan"), 1.0]), (100, [0.0, 3.0])]
    spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(map(str, con.sql(ORACLES["sim_kld"]).fetchall()))
    assert sorted(str(tuple(r)) for r in QUERIES["sim_kld"](spark, str(tmp_path)).collect()) == want


def test_subsequence_counts_equal_the_words(spark):
    s = seqs(spark, "ACGTAC", "", None, "A", "ACNGT", "TTTTTTTT")
    for k in (1, 2, 3, 5, 6):
        old = words.word_counts(words.subsequence_words(s, k)).where("word not like '%N%'")
        got = bow.subsequence_counts(s, k, T.DNA)
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in old.collect()} and (k < 6) == (got.count() > 0)
    plan = bow.subsequence_counts(s, 2, T.DNA)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan


def test_kmer_neighbours_equal_those_of_the_words(spark):
    s = seqs(spark, "ACGTACGGT", "", None, "ACG", "ACNGTAC", "TTTTTTT")
    old = {tuple(r) for r in weighting.near_words(words.kmer_words(s, 2), 3).where("a not like '%N%' and b not like '%N%'").collect()}
    assert {tuple(r) for r in bow.kmer_neighbours(s, 2, T.DNA, 3).collect()} == old and ("TT", "TT", 3, 3) in old


def test_skip_gram_learns_from_every_pair():
    """Words of a ring of 8 and its neighbours: the fit reaches nearly the pairs' own entropy, and doesn't hang on the corpus' size."""
    a = np.repeat(np.arange(8), 2)
    b = (a + np.tile([1, 7], 8)) % 8
    nodes, sides, _ = weighting._tree(np.ones(8, int))
    assert all(len(p) == 3 for p in nodes) and len({tuple(zip(p, s)) for p, s in zip(nodes, sides)}) == 8
    x, y = (weighting.fit_skip_gram(a, b, np.full(16, w), np.full(8, 9), 10, 200, 0.05, 42) for w in (1.0, 1e6))
    assert np.allclose(x, y)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    like = x @ x.T
    assert min(like[i, (i + 2) % 8] for i in range(8)) > max(like[i, (i + 1) % 8] for i in range(8)) - 0.5
    assert np.mean([like[i, (i + 2) % 8] for i in range(8)]) > np.mean([like[i, (i + 1) % 8] for i in range(8)]) + 0.3


def test_kmer_word2vec_equals_that_of_the_words(spark):
    rng = np.random.default_rng(2)
    s = seqs(spark, *["".join(rng.choice(list("ACGT"), 60)) for _ in range(12)], "", "AC")
    get = lambda df: {r.word: r.vector for r in df.collect()}
    for old, new in ((weighting.word2vec(words.kmer_words(s, 2), 4), weighting.skip_gram(bow.kmer_neighbours(s, 2, T.DNA, 5), 4)), (weighting.subword_vectors(words.kmer_words(s, 2), 4), weighting.kmer_subword_vectors(s, 2, T.DNA, 4))):
        old, new = get(old), get(new)
        assert len(old) == 16 and old.keys() == new.keys() and all(new[w] == pytest.approx(old[w], abs=1e-6) for w in old)
    folds = evaluate.folds(s, 3, "seq_id", None)
    old = weighting.out_of_fold(words.kmer_words(s, 2), folds.select("seq_id", "fold"), lambda w: weighting.word2vec(w, dim=4), 4)
    old, new = ({r.seq_id: (r.fold, r.features) for r in df.collect()} for df in (old, weighting.kmer_out_of_fold(folds, 2, T.DNA, 4)))
    assert len(old) == 13 and old.keys() == new.keys() and all(new[i][0] == old[i][0] and new[i][1] == pytest.approx(old[i][1], abs=1e-6) for i in old)


def test_divergence_of_vectors_of_several_lengths_is_that_of_its_sql(spark, tmp_path):
    import duckdb

    from helixframe.plans.catalogue import _SCORES, ORACLES, QUERIES

    rows = [(0, [1.0, 2.0]), (20, [1.0]), (40, [2.0, 1.0]), (60, []), (80, [1.0, 2.0, 0.0]), (100, None), (120, [3.0]), (140, [1.0, None]), (160, [4.0, 1.0, 0.0]), (180, [float("nan"), 1.0]), (200, [float("inf"), 1.0, 2.0]), (3, [1.0, 3.0])]
    spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(map(str, con.sql(ORACLES["sim_kld"]).fetchall()))
    assert sorted(str(tuple(r)) for r in QUERIES["sim_kld"](spark, str(tmp_path)).collect()) == want
    # before it is rounded, a score is the SQL's to the last bit
    x = np.random.default_rng(1).integers(1, 40, (60, 64)) / 10
    con.sql("CREATE TABLE v (i INT, x DOUBLE[])")
    con.executemany("INSERT INTO v VALUES (?, ?)", [(i, v.tolist()) for i, v in enumerate(x)])
    got = score.divergence(x, x)
    assert all(got[i, j] == s for i, j, s in con.sql(f"SELECT a.i, b.i, {_SCORES['KLD']} FROM v a, v b").fetchall())


def test_sequences_are_embedded_by_their_words_vectors(spark, tmp_path):
    from helixframe.plans.catalogue import QUERIES

    made = {"AA": [1.0, 2.0], "AC": [3.0, -2.0]}
    got = {r.seq_id: (r.features, r["mean"]) for r in weighting.embed_kmers(seqs(spark, "AAACA", "CACG", "GG", "A"), 2, T.DNA, made, 2).collect()}
    assert [got[i] for i in sorted(got)] == [([1.0, 2.0, 1.0, 2.0, 3.0, -2.0, 0.0, 0.0], [5 / 3, 2 / 3]), ([0.0, 0.0, 3.0, -2.0, 0.0, 0.0], [3.0, -2.0]), ([0.0, 0.0], [0.0, 0.0])]
    rng = np.random.default_rng(4)
    spark.createDataFrame([(i, "".join(rng.choice(list("ACGT"), 80))) for i in range(30)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["word2vec_out_of_fold"](spark, str(tmp_path)).collect()
    assert len(rows) == 30 and all(r["size"] == len(r.features) == 78 * 6 for r in rows)
    assert all(r["mean"] == pytest.approx(np.reshape(r.features, (78, 6)).mean(0)) and np.abs(r["mean"]).max() > 0 for r in rows)
