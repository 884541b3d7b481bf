import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evisets.operators import align, ordered, prune, sets
from evisets.sources import profile, scans


def text(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_set_lines(spark):
    df = scans.parse_set_lines(text(spark, ["A g1 g2:0.5 g2:0.5 NA g3:x", "A g9", "B", "C g1:-1"]))
    assert rows(df, "set_id", "entity_id", "weight") == [("A", "g1", 1.0), ("A", "g2", 0.5), ("C", "g1", -1.0)]


def test_input_plan():
    plan = scans.plan_inputs(["mouse:a.txt@m", "b.txt", "c.txt"])
    assert plan[0] == {"path": "a.txt", "label": "mouse", "batch": "m", "is_dense": False}
    assert plan[1]["label"] is None and len({p["batch"] for p in plan}) == 3


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "x.txt").write_text("S1 a b:2\nS2 b\n")
    (tmp_path / "y.txt").write_text("S1 c\n")
    got = scans.read_inputs(spark, [f"t:{tmp_path}/x.txt@one", f"{tmp_path}/y.txt"])
    assert rows(got, "set_id", "entity_id", "weight") == [("S1", "c", 1.0), ("t_S1", "a", 1.0), ("t_S1", "b", 2.0), ("t_S2", "b", 1.0)]
    scans.save_tables({"m": got}, str(tmp_path / "out"), {"m": ["batch"]})
    assert scans.load_tables(spark, str(tmp_path / "out"), ["m"])["m"].count() == got.count()
    scans.write_tsv(got.select("set_id", "entity_id"), str(tmp_path / "tsv"))
    assert spark.read.csv(str(tmp_path / "tsv"), sep="\t", header=True).count() == 4
    (tmp_path / "k.tsv").write_text("id\tv\na\t1\na\t2\n")
    with pytest.raises(ValueError):
        scans.read_keyed(spark, str(tmp_path / "k.tsv"), "id")
    (tmp_path / "loc.txt").write_text("e1 chr1 100 200 + g1\ne2 chr1 300 250 - g2\ne3 chr2 5 6 + g1\n")
    assert rows(scans.read_intervals(spark, str(tmp_path / "loc.txt")), "entity_id", "chrom", "start_pos") == [("g1", "1", 100), ("g2", "1", 250)]


def test_roles(spark):
    df = spark.createDataFrame([("1", "1000", "0.5", "-1.0", "0.2"), ("X", "2000", "0.1", "2.0", "NA")], ["CHR", "BP", "P", "BETA", "SE"])
    assert profile.resolve_roles_dict(df) == {"chrom": "CHR", "pos": "BP", "p": "P", "beta": "BETA", "se": "SE"}


def test_weight_normalisation_matches_a_direct_form(spark):
    rng = random.Random(1)
    data = [(s, e, round(rng.uniform(-3, 3), 3)) for s in range(6) for e in range(8) if rng.random() < 0.7]
    got = {(r.set_id, r.entity_id): r.weight for r in sets.normalize_weights(spark.createDataFrame(data, "set_id long, entity_id long, weight double")).collect()}
    want = {}
    for s, grp in itertools.groupby(data, key=lambda t: t[0]):
        grp = list(grp)
        a = [abs(w) for *_, w in grp]
        scale = round(sum(a) / len(a), 10) if max(a) > 1 or any(x < 0.5 for x in a) else 1.0
        for _, e, w in grp:
            if abs(w / scale) >= 0.5:
                want[(s, e)] = max(-1.0, min(1.0, w / scale))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("signed", [False, True])
def test_pair_search_is_exact(spark, signed):
    rng = np.random.default_rng(3)
    n, data, mat = 60, [], {}
    for s in range(70):
        base = rng.choice(8) * 6
        members = set(range(base, base + 6)) ^ set(rng.choice(60, 2).tolist()) | ({59} if s % 3 else set())  # 59 is a hub
        x = np.zeros(n)
        for e in members:
            x[e] = rng.uniform(0.5, 1) * (-1 if signed and rng.random() < 0.3 else 1)
            data.append((s, e, float(x[e])))
        mat[s] = x
    df = spark.createDataFrame(data, "set_id long, entity_id long, weight double")
    got = {(r.set_a, r.set_b): r.v for r in prune.correlated_pairs(df, F.lit(float(n)), 0.5).collect()}
    want = {(a, b): np.corrcoef(mat[a], mat[b])[0, 1] for a, b in itertools.combinations(range(70), 2)}
    want = {k: v for k, v in want.items() if abs(v) > 0.5}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_pruning_is_the_sequential_greedy_result(spark):
    rng = random.Random(5)
    data, members = [], {}
    for s in range(60):
        base = rng.randrange(6) * 5
        members[s] = set(range(base, base + 5)) ^ set(rng.sample(range(40), 1))
        data += [(s, e, 1.0) for e in members[s]]
    df = spark.createDataFrame(data, "set_id long, entity_id long, weight double")
    got = {r.set_id for r in prune.prune_correlated(df, F.lit(40.0), 0.6).collect()}
    vec = {s: np.array([1.0 if e in m else 0.0 for e in range(40)]) for s, m in members.items()}
    kept = []
    for s in sorted(members, key=lambda k: (len(members[k]), k)):
        if all(abs(np.corrcoef(vec[s], vec[t])[0, 1]) <= 0.6 for t in kept):
            kept.append(s)
    assert got == set(kept)
    again = {r.set_id for r in prune.prune_correlated(df.repartition(7), F.lit(40.0), 0.6).collect()}
    assert again == got


def test_batches_hold_no_correlated_pair(spark):
    rng = random.Random(2)
    data = [(s, e, 1.0) for s in range(9) for e in rng.sample(range(15), 5)]
    df = spark.createDataFrame(data, "set_id long, entity_id long, weight double")
    order = df.select("set_id").distinct().withColumn("rank", F.col("set_id"))
    b = {r.set_id: r.batch for r in prune.uncorrelated_batches(df, F.lit(15.0), order, 0.3).collect()}
    assert len(b) == 9
    for r in prune.correlated_pairs(df, F.lit(15.0), 0.3).collect():
        assert b[r.set_a] != b[r.set_b]


def test_sparsify_matches_quantile_tails(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=40)
    df = spark.createDataFrame([(i, "d", float(x)) for i, x in enumerate(v)] + [(i, "flag", 1.0 if i < 3 else 0.0) for i in range(40)],
                               "entity_id long, name string, value double")
    got = prune.sparsify(df, [5, 10], F.lit(40.0), tails=("top", "bot"))
    z = (v - v.mean()) / v.std()
    for k in (5, 10):
        top = {r.entity_id for r in got.where(F.col("set_id") == f"d_top{k}").collect()}
        assert top == set(np.flatnonzero(v >= np.quantile(v, 1 - k / 40)).tolist())
        bot = {r.entity_id: r.weight for r in got.where(F.col("set_id") == f"d_bot{k}").collect()}
        assert bot.keys() == set(np.argsort(v)[:k].tolist()) and all(abs(w + z[e]) < 1e-9 for e, w in bot.items())  # negative sets turn
    assert got.where("set_id = 'flag'").count() == 3


def test_permutation_is_one_to_one_and_repeatable(spark):
    u = spark.range(50).select(F.col("id").alias("entity_id"))
    m = u.select(F.lit(1).alias("set_id"), "entity_id", F.lit(1.0).alias("weight"))
    a = rows(sets.permute_members(m, u, 9), "entity_id")
    assert a == [(i,) for i in range(50)] and a == rows(sets.permute_members(m.repartition(5), u, 9), "entity_id")


def test_q_values_with_ties(spark):
    p = [0.01, 0.01, 0.2, 0.5, 0.5, 0.5, 1.0, 1.0]
    df = spark.createDataFrame(list(enumerate(p)), "i long, p double")
    got = {r.i: r.q for r in ordered.bh_q(df, "p", buckets=3).collect()}
    srt = sorted(p)
    for i, x in enumerate(p):
        want = min(1.0, min(y * len(p) / (sum(t <= y for t in srt)) for y in srt if y >= x))
        assert abs(got[i] - want) < 1e-12


def test_running_totals_on_a_hot_value(spark):
    df = spark.createDataFrame([(1, 5.0)] * 500 + [(1, float(i)) for i in range(100)], "g long, v double").withColumn("n", F.lit(1))
    got = {r.v: r.running for r in ordered.running_totals(df, ["g"], "v", "n", buckets=4).collect()}
    assert got[4.0] == 5 and got[5.0] == 506 and got[99.0] == 600


def test_overlap_join_against_all_pairs(spark):
    rng = random.Random(4)
    v = [(i, str(rng.randrange(2)), rng.randrange(5000)) for i in range(80)]
    iv = [(i, str(rng.randrange(2)), s, s + rng.randrange(900)) for i in range(40) for s in [rng.randrange(5000)]]
    got = rows(align.overlap_join(spark.createDataFrame(v, "vid long, chrom string, pos long"),
                                  spark.createDataFrame(iv, "eid long, chrom string, start_pos long, end_pos long"), pad=50, bin_width=300), "vid", "eid")
    assert got == sorted((a, b) for a, c, p in v for b, d, s, e in iv if c == d and s - 50 <= p <= e + 50)


def test_inputs_match_whole_paths_and_keep_their_labels(spark, tmp_path):
    (tmp_path / "a.txt").write_text("S1 a\nS2 b\n")
    (tmp_path / "ba.txt").write_text("S1 c\nS9 d\n")
    got = scans.read_inputs(spark, [f"{tmp_path}/a.txt@p", f"x:{tmp_path}/ba.txt@q"])
    assert rows(got, "set_id", "entity_id", "label", "batch") == [("S1", "a", None, "p"), ("S2", "b", None, "p"), ("x_S1", "c", "x", "q"), ("x_S9", "d", "x", "q")]


def test_line_numbers_are_consecutive_over_splits_and_files(spark, tmp_path):
    n = 3000
    names = [f"e{i}" for i in range(n)]
    (tmp_path / "z.txt").write_text("".join(f"{names[i]} {0.5}" + (" 0.25\n" if i > 1 else "\n") for i in range(n)))
    (tmp_path / "b.txt").write_text("last\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        text = scans.lines(spark, [f"{tmp_path}/z.txt", f"{tmp_path}/b.txt"])
        got = text.collect()
        edges = scans.parse_corr_lines(text.where("value <> 'last'"), first_value=2).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.value.split()[0] for r in sorted(got, key=lambda r: r.line_no)] == [*names, "last"]
    assert sorted(r.line_no for r in got) == list(range(n + 1))
    assert edges == 2 * ((n - 1) + (n - 2))  # every line names its one or two predecessors, across all splits


def test_list_files_are_read_whole(spark, tmp_path):
    (tmp_path / "many.list").write_text("".join(f"p{i}\n" for i in range(100_500)))
    specs = scans.expand_lists(spark, [f"{tmp_path}/many.list"])
    assert len(specs) == 100_500 and specs[-1] == "p100499"


def test_disjoint_halves_are_correlated_and_never_share_a_batch(spark):
    half = [("a", f"e{i}", 1.0) for i in range(50)] + [("b", f"e{i}", 1.0) for i in range(50, 100)] + [("c", f"e{i}", 1.0) for i in range(0, 100, 2)]
    df = spark.createDataFrame(half, "set_id string, entity_id string, weight double")
    pairs = [(r.set_a, r.set_b, round(r.v, 9)) for r in prune.correlated_pairs(df, F.lit(100.0), 0.8).collect()]
    assert pairs == [("a", "b", -1.0)]
    order = df.groupBy("set_id").agg(F.min("set_id").alias("rank"))
    b = {r.set_id: r.batch for r in prune.uncorrelated_batches(df, F.lit(100.0), order, 0.1).collect()}
    assert b["a"] != b["b"]


def test_many_equal_sets_get_a_batch_each(spark):
    df = spark.createDataFrame([(f"s{k}", f"e{i}", 1.0) for k in range(4) for i in range(5)], "set_id string, entity_id string, weight double")
    order = df.groupBy("set_id").agg(F.min("set_id").alias("rank"))
    b = {r.set_id: r.batch for r in prune.uncorrelated_batches(df, F.lit(50.0), order, 0.5).collect()}
    assert b == {"s0": 0, "s1": 1, "s2": 2, "s3": 3}


def test_null_p_keeps_its_row(spark):
    df = spark.createDataFrame([(1, 0.01), (2, None), (3, 0.5), (4, 0.5)], "i int, p double")
    got = {r.i: r.q for r in ordered.bh_q(df, "p").collect()}
    assert got[2] is None and abs(got[1] - 0.03) < 1e-12 and abs(got[3] - 0.5) < 1e-12 and len(got) == 4


def test_filters_by_p_survive_a_p_that_is_summed_again(spark):
    # every evaluation gives another last digit, as sums in another order do
    noisy = spark.range(40).select(F.col("id").alias("set_id"), (F.col("id") % 2).alias("trait"), ((F.col("id") + 1) * 0.01 + F.rand() * 1e-9).alias("p"))
    kept = lambda df: [r["count"] for r in df.where("status = 'kept'").groupBy("trait").count().collect()]
    assert kept(sets.refilter_corrected(noisy.repartition(3), 0.0)) == [1, 1]
    assert kept(sets.limit_by_p(noisy.repartition(3), 5)) == [5, 5]
    copies = spark.createDataFrame([(1, 1, 0.1 + 0.2), (2, 1, 0.3), (3, 1, 0.5)], "set_id long, trait long, p double")
    assert kept(sets.refilter_corrected(copies, 0.0)) == kept(sets.limit_by_p(copies, 1)) == [2]


def test_nearest_entities_against_all_pairs(spark):
    rng = random.Random(5)
    var = [(i, str(rng.randrange(2)), rng.randrange(-300, 300)) for i in range(150)]
    ivl = []
    for j in range(60):
        a = rng.randrange(-300, 300)
        ivl.append((100 - j % 50, str(rng.randrange(2)), a, a + rng.choice([-30, 0, 5, 40, 200])))
    v = spark.createDataFrame(var, "variant_id long, chrom string, pos long")
    i = spark.createDataFrame(ivl, "entity_id long, chrom string, start_pos long, end_pos long")
    for k, far in ((1, 25), (2, 25), (3, 0), (2, 1000)):
        got = {}
        for r in align.nearest_entities(v, i, "variant_id", k, far).orderBy("rank").collect():
            got.setdefault(r.variant_id, []).append((r.dist, r.entity_id, r.n_near))
        for key, chrom, pos in var:
            all_ = sorted((max(0, min(a, b) - pos, pos - max(a, b)), e) for e, c, a, b in ivl if c == chrom)
            near = [x for x in all_ if x[0] <= far]
            assert got.get(key, []) == [(*x, len(near)) for x in near[:k]]


def test_nearest_entity_forms_no_pairs(spark):
    v = spark.range(10).select(F.col("id").alias("variant_id"), F.lit("1").alias("chrom"), (F.col("id") * 7).alias("pos"))
    i = v.select(F.col("variant_id").alias("entity_id"), "chrom", F.col("pos").alias("start_pos"), F.col("pos").alias("end_pos"))
    assert "between" not in (plan := align.nearest_entity(v, i, "variant_id", 20)._jdf.queryExecution().optimizedPlan().toString()) and "Join" not in plan


def test_overlap_report_lists_pairs_without_correlation(spark):
    from evisets.operators import reports

    m = spark.createDataFrame([(s, e, 1.0) for s, es in ((1, (0, 1)), (2, (0, 2))) for e in es], "set_id long, entity_id long, weight double")
    stats = spark.createDataFrame([(1, 0.5, 1.0), (2, 0.5, 1.0)], "set_id long, beta double, beta_uncorrected double")
    got = reports.set_overlap_report(m, stats, sets.set_moments(m, F.lit(4.0))).collect()  # V = 1/4 - 1/2 * 1/2
    assert sorted((r.set_a, r.set_b, r.v) for r in got) == [(1, 2, 0.0), (2, 1, 0.0)]


def test_correlated_pairs_read_whole_sets_only_where_the_prefix_leaves_it_open(spark):
    rng = np.random.default_rng(8)
    x = (rng.random((30, 200)) < 0.3) * 1.0
    x[7] = x[3]
    m = spark.createDataFrame([(s, e, 1.0) for s in range(30) for e in range(200) if x[s, e]], "set_id long, entity_id long, weight double")
    v = np.corrcoef(x)
    want = {(a, b) for a in range(30) for b in range(a + 1, 30) if abs(v[a, b]) > 0.3}
    got = {(r.set_a, r.set_b): r.v for r in prune.correlated_pairs(m, F.lit(200.0), 0.3).collect()}
    assert got.keys() == want and abs(got[3, 7] - 1) < 1e-9
    moments = sets.set_moments(m, F.lit(200.0)).withColumn("rs", F.col("mean") / F.col("scale")).withColumn("r", F.abs("rs"))
    assert prune.candidate_pairs(m, moments, moments.agg(F.max("r")).scalar(), F.lit(0.3)).count() < 40  # of 435 pairs that share members
