"""Alignment and set algebra."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from evisets.functions import scalar
from evisets.operators import align, prune, sets
from evisets.operators.assoc import marginal_linear
from evisets.queries.roles import (
    binary, covariates, dense, evidence, evidence_y, intervals, marginal_sql, membership, moments_sql, n_entities, order_sets, r, sql_z, table, tidy,
    trait_y, universe, variants, with_, _positions,
)

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = lambda spark, sf: tidy(fn(spark, sf))
        if sql:
            SQL[name] = sql
        return fn
    return add


# ---- alignment ------------------------------------------------------------------------------------------------------

@query("universe_from_sets", "SELECT DISTINCT l_partkey AS entity_id FROM lineitem")
def universe_from_sets(spark, sf):
    return align.resolve_universe(membership=membership(spark, sf))


def _listed(spark, sf):
    """Evidence of parts with a positive returned balance, with prior and combined."""
    e = evidence(spark, sf).where("log_bf > 0")
    return e.withColumn("prior", F.col("log_bf") / 2).withColumn("combined", F.col("log_bf") * 1.5)


@query("extend_universe", with_("evid") + f"""SELECT entity_id, {r('log_bf', 'log_bf')}, {r('log_bf / 2', 'prior')}, {r('log_bf * 1.5', 'combined')} FROM evid WHERE log_bf > 0
    UNION ALL SELECT DISTINCT l_partkey, 0.0::DOUBLE, 0.0::DOUBLE, NULL::DOUBLE FROM lineitem WHERE l_partkey NOT IN (SELECT entity_id FROM evid WHERE log_bf > 0)""")
def extend_universe(spark, sf):
    return align.extend_universe(_listed(spark, sf), membership(spark, sf))


@query("align_values", with_("uni", "evid") + f"SELECT u.entity_id, {r('coalesce(log_bf, 0)', 'log_bf')} FROM uni u LEFT JOIN evid e ON e.entity_id = u.entity_id AND log_bf > 0")
def align_values(spark, sf):
    return align.align(universe(spark, sf), _listed(spark, sf), ["log_bf"], 0.0)[0]


@query("align_extra", with_("evid") + f"SELECT entity_id, {r('log_bf', 'log_bf')} FROM evid WHERE entity_id NOT IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY')")
def align_extra(spark, sf):
    economy = table(spark, sf, "part").where("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("entity_id"))
    return align.align(economy, evidence(spark, sf), ["log_bf"])[1]


COMBINE_SQL = with_("evid", extra="""a AS (SELECT entity_id, log_bf FROM evid WHERE log_bf > 0),
b AS (SELECT p_partkey AS entity_id, ln(p_size) AS log_bf FROM part WHERE p_size > 5),
c AS (SELECT p_partkey AS entity_id, 1.5::DOUBLE AS log_bf FROM part WHERE p_type = 'ECONOMY'),
k AS (SELECT entity_id FROM a UNION SELECT entity_id FROM b UNION SELECT entity_id FROM c),
j AS (SELECT k.entity_id, coalesce(a.log_bf, (SELECT avg(log_bf) FROM a)) AS main, coalesce(b.log_bf, 0) AS size, coalesce(c.log_bf, 0) AS list
      FROM k LEFT JOIN a USING (entity_id) LEFT JOIN b USING (entity_id) LEFT JOIN c USING (entity_id))""")


@query("combine_evidence", COMBINE_SQL + f"SELECT entity_id, {r('main', 'main')}, {r('size', 'size')}, {r('list', 'list')}, {r('main + size + list', 'log_bf')} FROM j")
def combine_evidence(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("entity_id"), "p_size", "p_type")
    return align.combine_evidence({
        "main": _listed(spark, sf), "size": p.where("p_size > 5").select("entity_id", F.log(F.col("p_size").cast("double")).alias("log_bf")),
        "list": p.where("p_type = 'ECONOMY'").select("entity_id", F.lit(1.5).alias("log_bf"))}, "main")


@query("split_members", """WITH m AS (SELECT DISTINCT l_orderkey AS set_id, l_partkey AS entity_id, p_type = 'ECONOMY' AS k FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT set_id, entity_id, CASE WHEN k THEN 'kept' ELSE 'missing' END AS status FROM m WHERE set_id IN (SELECT set_id FROM m WHERE k)""")
def split_members(spark, sf):
    economy = table(spark, sf, "part").where("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("entity_id"))
    return align.split_members(order_sets(spark, sf), economy).select("set_id", "entity_id", "status")


@query("hold_out", with_("iy", "ivl") + f"SELECT i.entity_id, {r('CASE WHEN chrom <> ' + chr(39) + '7' + chr(39) + ' THEN value END', 'value')}, chrom = '7' AS held_out FROM iy i JOIN ivl v ON v.entity_id = i.entity_id")
def hold_out(spark, sf):
    from evisets.queries.roles import interval_y

    return align.hold_out(interval_y(spark, sf), intervals(spark, sf), "7", ["value"])


@query("map_ids", "SELECT CASE WHEN p_size > 25 THEN p_brand ELSE p_partkey::VARCHAR END AS entity_id, p_size::BIGINT AS p_size FROM part")
def map_ids(spark, sf):
    p = table(spark, sf, "part")
    m = p.where("p_size > 25").select(F.col("p_partkey").cast("string").alias("old_id"), F.col("p_brand").alias("new_id"))
    return align.map_ids(p.select(F.col("p_partkey").cast("string").alias("entity_id"), "p_size"), m)


@query("align_covariates", f"""WITH c AS (SELECT p_partkey, p_size::DOUBLE AS s, p_retailprice AS q FROM part WHERE p_type <> 'ECONOMY')
SELECT p.p_partkey AS entity_id, {r('coalesce(s, (SELECT avg(s) FROM c))', 'p_size')}, {r('coalesce(q, (SELECT avg(q) FROM c))', 'price')} FROM part p LEFT JOIN c ON c.p_partkey = p.p_partkey""")
def align_covariates(spark, sf):
    other = table(spark, sf, "part").where("p_type <> 'ECONOMY'").select(F.col("p_partkey").alias("entity_id"))
    cov = covariates(spark, sf).join(other, "entity_id", "left_semi")
    return align.fill_with_mean(universe(spark, sf), cov, ["p_size", "price"])


@query("overlap_join", with_("vars", "ivl") + "SELECT variant_id, entity_id FROM vars v JOIN ivl i ON v.chrom = i.chrom AND pos BETWEEN start_pos AND end_pos")
def overlap_join(spark, sf):
    return align.overlap_join(variants(spark, sf), intervals(spark, sf)).select("variant_id", "entity_id")


NEAR_SQL = with_("vars", "ivl", extra="""near AS (SELECT variant_id, entity_id, greatest(0, start_pos - pos, pos - end_pos)::BIGINT AS dist
    FROM vars v JOIN ivl i ON v.chrom = i.chrom AND pos BETWEEN start_pos - 20000 AND end_pos + 20000)""")


@query("near_join", NEAR_SQL + "SELECT * FROM near")
def near_join(spark, sf):
    return align.near_join(variants(spark, sf), intervals(spark, sf), 20_000).select("variant_id", "entity_id", "dist")


@query("nearest_entity", NEAR_SQL + "SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY dist, entity_id) = 1")
def nearest_entity(spark, sf):
    return align.nearest_entity(variants(spark, sf), intervals(spark, sf), "variant_id", 20_000)


@query("link_join", with_("vars", "ev") + f"SELECT variant_id, e.event_id AS entity_id, {r('e.value / 400', 'prob')} FROM vars v JOIN ev e ON e.chrom = v.chrom AND e.pos = v.pos")
def link_join(spark, sf):
    links = _positions(spark, sf).select("chrom", "pos", F.col("event_id").alias("entity_id"), (F.col("value") / 400).alias("prob"))
    return align.link_join(variants(spark, sf), links).select("variant_id", "entity_id", "prob")


@query("require_keys", "SELECT p_partkey AS entity_id, p_size::BIGINT AS p_size FROM part WHERE p_type = 'PROMO'")
def require_keys(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("entity_id"), "p_size", "p_type")
    return align.require_keys(p.where("p_type = 'PROMO'"), p.drop("p_type"), "entity_id")


@query("align_features", with_("load") + f"""SELECT axis, key, factor, {r('value', 'value')}, {r('p_size::DOUBLE', 'profile_value')} FROM load JOIN part ON p_partkey::VARCHAR = key AND axis = 'entity'""")
def align_features(spark, sf):
    from evisets.queries.roles import loadings

    prof = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_size").cast("double").alias("profile_value"))
    return align.align_features(loadings(spark, sf).where("axis = 'entity'"), prof)


@query("order_by_location", with_("ivl") + "SELECT entity_id, chrom, start_pos, end_pos, row_number() OVER (ORDER BY chrom, start_pos, end_pos, entity_id) - 1 AS position FROM ivl")
def order_by_location(spark, sf):
    return align.order_by_location(intervals(spark, sf), 200_000)


# ---- set algebra ----------------------------------------------------------------------------------------------------

@query("set_sizes", with_("memb") + f"SELECT set_id, count(*) AS size, {r('sum(abs(weight))', 'abs_weight')} FROM memb GROUP BY 1")
def set_sizes(spark, sf):
    return sets.set_sizes(membership(spark, sf))


@query("entity_degree", with_("memb") + f"SELECT entity_id, count(*) AS n_sets, {r('sum(abs(weight))', 'abs_weight')} FROM memb GROUP BY 1")
def entity_degree(spark, sf):
    return sets.entity_degree(membership(spark, sf))


@query("set_moments", with_("memb", "n", extra=moments_sql()) + f"SELECT set_id, size, {r('mean', 'mean')}, {r('scale', 'scale')} FROM xm")
def set_moments(spark, sf):
    return sets.set_moments(membership(spark, sf), n_entities(spark, sf)).select("set_id", "size", "mean", "scale")


@query("normalize_weights", with_("osets", extra="""nm AS (SELECT set_id, round(avg(abs(weight)), 10) AS a, (max(abs(weight)) > 1 OR count(*) FILTER (abs(weight) >= 0.5) <> count(*)) AS rs FROM osets GROUP BY 1),
w AS (SELECT set_id, entity_id, weight / CASE WHEN rs AND a <> 0 THEN a ELSE 1 END AS w FROM osets JOIN nm USING (set_id))""") +
       f"SELECT set_id, entity_id, {r('least(w, 1.0::DOUBLE)', 'weight')} FROM w WHERE abs(w) >= 0.5")
def normalize_weights(spark, sf):
    return sets.normalize_weights(order_sets(spark, sf), 0.5, True)


def _stats(spark, sf):
    return marginal_linear(binary(spark, sf), evidence_y(spark, sf), n_entities(spark, sf))


STATS = with_("bin", "n", "y1", extra=marginal_sql("bin", "y1"))


@query("filter_size", with_("osets") + """SELECT set_id, count(*) AS size, CASE WHEN count(*) BETWEEN 3 AND 6 THEN 'kept' ELSE 'ignored' END AS status,
    CASE WHEN count(*) < 3 THEN 'too_small' WHEN count(*) > 6 THEN 'too_large' END AS filter_reason FROM osets GROUP BY 1""")
def filter_size(spark, sf):
    return sets.filter_size(sets.set_sizes(order_sets(spark, sf)).drop("abs_weight"), 3, 6)


TRAIT_STATS = with_("bin", "n", "y", extra=marginal_sql("bin", "y"))


def _trait_stats(spark, sf):
    return marginal_linear(binary(spark, sf), trait_y(spark, sf), n_entities(spark, sf))


@query("filter_qc", with_("osets", "cov", extra="q AS (SELECT set_id, sum(weight * price) / sum(abs(weight)) AS mean_qc FROM osets JOIN cov USING (entity_id) GROUP BY 1), z AS (SELECT set_id, (mean_qc - avg(mean_qc) OVER ()) / stddev_pop(mean_qc) OVER () AS qc_z FROM q)") +
       f"SELECT set_id, {r('qc_z', 'qc_z')}, CASE WHEN abs(qc_z) <= 2.0 THEN 'kept' ELSE 'ignored' END AS status, CASE WHEN abs(qc_z) > 2.0 THEN 'qc' END AS filter_reason FROM z")
def filter_qc(spark, sf):
    from evisets.operators.assoc import set_qc

    q = set_qc(order_sets(spark, sf), covariates(spark, sf), ["price"]).withColumnRenamed("price", "mean_qc")
    return sets.filter_qc(q, "mean_qc", 2.0).drop("mean_qc")


@query("prefilter", TRAIT_STATS + f"""SELECT set_id, trait, {r('p', 'p')}, CASE WHEN p <= lim AND beta_tilde >= 0 THEN 'kept' ELSE 'ignored' END AS status,
    CASE WHEN p > lim THEN 'p' WHEN beta_tilde < 0 THEN 'negative' END AS filter_reason
    FROM st JOIN (SELECT trait, CASE WHEN avg(CASE WHEN p <= 0.01 THEN 1.0 ELSE 0 END) < 0.3 THEN quantile_cont(p, 0.3) ELSE 0.01 END AS lim FROM st GROUP BY 1) USING (trait)""")
def prefilter(spark, sf):
    return sets.prefilter(_trait_stats(spark, sf), 0.01, 0.3).select("set_id", "trait", "p", "status", "filter_reason")


@query("prefilter_any_trait", with_("bin", "n", "y", extra=marginal_sql("bin", "y")) +
       f"SELECT set_id, bool_or(p <= 0.01 AND beta_tilde >= 0) AS keep, {r('min(p)', 'min_p')}, {r('max(beta_tilde)', 'max_beta_tilde')} FROM st GROUP BY 1")
def prefilter_any_trait(spark, sf):
    return sets.prefilter_any_trait(marginal_linear(binary(spark, sf), trait_y(spark, sf), n_entities(spark, sf)), 0.01)


SIGNED = ("sg AS (SELECT l_suppkey AS set_id, l_partkey AS entity_id, max(CASE WHEN l_suppkey % 2 = 0 THEN 0.05::DOUBLE - l_discount ELSE 1.0::DOUBLE - l_discount END) AS weight "
          "FROM lineitem GROUP BY 1, 2)")


def _signed(spark, sf):
    w = F.when(F.col("l_suppkey") % 2 == 0, F.lit(0.05) - F.col("l_discount")).otherwise(F.lit(1.0) - F.col("l_discount"))
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("entity_id")).agg(F.max(w).alias("weight"))


@query("flip_signs", with_("n", "y1", extra=SIGNED + ",\n" + marginal_sql("sg", "y1")) +
       f"SELECT set_id, {r('CASE WHEN f THEN -beta_tilde ELSE beta_tilde END', 'beta_tilde')}, {r('CASE WHEN f THEN -z ELSE z END', 'z')}, f AS flipped FROM "
       "(SELECT *, beta_tilde < 0 AND set_id IN (SELECT set_id FROM sg WHERE weight < 0) AS f FROM st)")
def flip_signs(spark, sf):
    m = _signed(spark, sf)
    return sets.flip_signs(m, marginal_linear(m, evidence_y(spark, sf), n_entities(spark, sf)))[1].select("set_id", "beta_tilde", "z", "flipped")


@query("limit_by_p", TRAIT_STATS + f"SELECT set_id, trait, {r('p', 'p')}, CASE WHEN rank() OVER (PARTITION BY trait ORDER BY p) <= 20 THEN 'kept' ELSE 'ignored' END AS status FROM st")
def limit_by_p(spark, sf):
    return sets.limit_by_p(_trait_stats(spark, sf), 20).select("set_id", "trait", "p", "status")


@query("refilter_corrected", TRAIT_STATS + f"SELECT set_id, trait, {r('p', 'p')}, CASE WHEN p <= 1e-6 OR p = min(p) OVER (PARTITION BY trait) THEN 'kept' ELSE 'ignored' END AS status FROM st")
def refilter_corrected(spark, sf):
    return sets.refilter_corrected(_trait_stats(spark, sf), 1e-6).select("set_id", "trait", "p", "status")


@query("drop_zero", STATS + f"SELECT set_id, {r('b', 'beta_uncorrected')}, CASE WHEN b <> 0 THEN 'kept' ELSE 'ignored' END AS status FROM (SELECT set_id, CASE WHEN p < 0.3 THEN beta_tilde ELSE 0 END AS b FROM st)")
def drop_zero(spark, sf):
    s = _stats(spark, sf).select("set_id", F.when(F.col("p") < 0.3, F.col("beta_tilde")).otherwise(F.lit(0.0)).alias("beta_uncorrected"))
    return sets.drop_zero(s).select("set_id", "beta_uncorrected", "status")


@query("union_sets", with_("memb", "osets") + f"""SELECT 'supplier_' || set_id AS set_id, entity_id, {r('weight', 'weight')}, 'supplier' AS batch FROM memb
    UNION ALL SELECT 'order_' || set_id, entity_id, {r('weight', 'weight')}, 'order' FROM osets""")
def union_sets(spark, sf):
    return sets.union_sets({"supplier": membership(spark, sf), "order": order_sets(spark, sf)})


@query("only_included", """WITH m AS (SELECT DISTINCT l_orderkey AS set_id, l_partkey AS entity_id, p_size > 20 AS k FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT set_id, entity_id FROM m WHERE set_id IN (SELECT set_id FROM m GROUP BY 1 HAVING avg(CASE WHEN k THEN 1.0::DOUBLE ELSE 0 END) >= 0.75)""")
def only_included(spark, sf):
    inc = table(spark, sf, "part").where("p_size > 20").select(F.col("p_partkey").alias("entity_id"))
    return sets.only_inc(order_sets(spark, sf), inc, 0.75).select("set_id", "entity_id")


@query("sets_for_anchors", with_("bin", extra="a AS (SELECT p_partkey AS entity_id FROM part WHERE p_brand = 'Brand#7' AND p_type = 'PROMO')") +
       "SELECT set_id, entity_id FROM bin WHERE set_id IN (SELECT set_id FROM bin JOIN a USING (entity_id) GROUP BY 1 HAVING count(*) >= 0.25 * (SELECT count(*) FROM a))")
def sets_for_anchors(spark, sf):
    a = table(spark, sf, "part").where("p_brand = 'Brand#7' and p_type = 'PROMO'").select(F.col("p_partkey").alias("entity_id"))
    return sets.sets_for_anchors(binary(spark, sf), a, 0.25).select("set_id", "entity_id")


@query("rank_for_prune", with_("bin", "n", "y", extra=marginal_sql("bin", "y")) + f"SELECT set_id, {r('avg(beta_tilde)', 'mean_beta')} FROM st GROUP BY 1")
def rank_for_prune(spark, sf):
    s = marginal_linear(binary(spark, sf), trait_y(spark, sf), n_entities(spark, sf)).withColumnRenamed("beta_tilde", "beta_uncorrected")
    return sets.rank_for_prune(s)


@query("filter_anchor", with_("et") + f"SELECT entity_id, trait, {r('combined', 'value')} FROM et WHERE entity_id IN (SELECT entity_id FROM et GROUP BY 1 HAVING max(combined) >= 2.0)")
def filter_anchor(spark, sf):
    from evisets.queries.roles import entity_trait

    v = entity_trait(spark, sf).select("entity_id", "trait", F.col("combined").alias("value"))
    return sets.filter_anchor(v, "entity_id", 2.0)


@query("subset_sets", STATS + f"SELECT set_id, {r('z', 'z')}, CASE WHEN z > 0 THEN 'kept' ELSE 'missing' END AS status, CASE WHEN z <= 0 THEN 'below' END AS filter_reason FROM st")
def subset_sets(spark, sf):
    return sets.subset_sets(_stats(spark, sf), F.col("z") > 0, "missing", "below").select("set_id", "z", "status", "filter_reason")


@query("subset_entities", with_("bin", "evid") + f"SELECT set_id, count(*) AS size, {r('sum(weight)', 'abs_weight')} FROM bin WHERE entity_id IN (SELECT entity_id FROM evid WHERE log_bf > 0) GROUP BY 1")
def subset_entities(spark, sf):
    return sets.subset_entities(binary(spark, sf), evidence(spark, sf).where("log_bf > 0"))[1]


@query("dedupe_rows", "SELECT p_brand, arg_min(p_name, p_partkey) AS p_name, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
def dedupe_rows(spark, sf):
    return sets.dedupe_rows(table(spark, sf, "part").select("p_brand", "p_name", "p_partkey"), "p_brand", "p_partkey")


@query("sample_sets")
def sample_sets(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("set_id"), F.col("p_brand").alias("batch"))
    return sets.sample_sets(p, 5, 11)


@query("permute_members")
def permute_members(spark, sf):
    return sets.permute_members(membership(spark, sf), universe(spark, sf), 3)


@query("set_overlap", with_("bin", "n", extra=moments_sql("bin") + """,
d AS (SELECT a.set_id AS set_a, b.set_id AS set_b, sum(a.weight * b.weight) AS dot FROM bin a JOIN bin b ON a.entity_id = b.entity_id AND a.set_id <> b.set_id GROUP BY 1, 2)""") +
       f"SELECT set_a, set_b, {r('dot', 'dot')}, {r('(dot / x.n - x.mean * z.mean) / (x.scale * z.scale)', 'v')} FROM d JOIN xm x ON x.set_id = set_a JOIN xm z ON z.set_id = set_b")
def set_overlap(spark, sf):
    b = binary(spark, sf)
    return sets.set_overlap(b, b, sets.set_moments(b, n_entities(spark, sf)))


PAIRS = with_("osets", "n", extra=moments_sql("osets") + """,
d AS (SELECT a.set_id AS set_a, b.set_id AS set_b, sum(a.weight * b.weight) AS dot FROM osets a JOIN osets b ON a.entity_id = b.entity_id AND a.set_id < b.set_id GROUP BY 1, 2),
big AS (SELECT *, abs(mean / scale) AS ratio FROM xm WHERE scale > 0),
apart AS (SELECT x.set_id AS set_a, z.set_id AS set_b, -x.mean * z.mean / (x.scale * z.scale) AS v FROM big x JOIN big z ON x.set_id < z.set_id AND x.ratio * z.ratio > 0.5 AND x.ratio > 0.5 / (SELECT max(ratio) FROM big)
  WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.set_a = x.set_id AND d.set_b = z.set_id)),
v AS (SELECT * FROM apart UNION ALL SELECT set_a, set_b, (dot / x.n - x.mean * z.mean) / (x.scale * z.scale) AS v FROM d JOIN xm x ON x.set_id = set_a JOIN xm z ON z.set_id = set_b)""")


@query("correlated_pairs", PAIRS + f"SELECT set_a, set_b, {r('v', 'v')} FROM v WHERE abs(v) > 0.5")
def correlated_pairs(spark, sf):
    return prune.correlated_pairs(order_sets(spark, sf), n_entities(spark, sf), 0.5)


@query("prune_correlated")
def prune_correlated(spark, sf):
    return prune.prune_correlated(order_sets(spark, sf), n_entities(spark, sf), 0.5)


def _set_order(spark, sf):
    return prune.position_order(_stats(spark, sf), "z")


@query("position_order", STATS + "SELECT set_id, row_number() OVER (ORDER BY -z, set_id) - 1 AS rank FROM st")
def position_order(spark, sf):
    return _set_order(spark, sf)


@query("uncorrelated_batches")
def uncorrelated_batches(spark, sf):
    return prune.uncorrelated_batches(binary(spark, sf), n_entities(spark, sf), _set_order(spark, sf), 0.1)


@query("cap_sets", STATS + """, o AS (SELECT set_id, row_number() OVER (ORDER BY -z, set_id) - 1 AS rank FROM st), b AS (SELECT *, set_id % 5 AS batch FROM o),
c AS (SELECT batch, sum(count(*)) OVER (ORDER BY batch) - count(*) AS before FROM b GROUP BY 1)
SELECT set_id, batch, rank FROM b JOIN c USING (batch) WHERE before <= 25 ORDER BY rank, set_id LIMIT 25""".replace(", o AS", ",\no AS", 1))
def cap_sets(spark, sf):
    o = _set_order(spark, sf)
    return prune.cap_sets(o.select("set_id", (F.col("set_id") % 5).alias("batch")), o, 25).select("set_id", "batch", "rank")


SPARSE = with_("dense", extra="""s AS (SELECT *, avg(value) OVER (PARTITION BY name) AS m, stddev_pop(value) OVER (PARTITION BY name) AS sd,
    rank() OVER (PARTITION BY name ORDER BY value DESC) AS ru, rank() OVER (PARTITION BY name ORDER BY value) AS rl FROM dense), k AS (SELECT unnest([50, 100]) AS k),
h AS (SELECT name || '_top' || k AS set_id, entity_id, (value - m) / sd AS w FROM s, k WHERE ru <= k UNION ALL
      SELECT name || '_bot' || k, entity_id, (value - m) / sd FROM s, k WHERE rl <= k UNION ALL
      SELECT name || '_ext' || k, entity_id, (value - m) / sd FROM s, k WHERE ru <= k OR rl <= k)""")


@query("sparsify", SPARSE + f"SELECT set_id, entity_id, {r('CASE WHEN max(w) OVER (PARTITION BY set_id) < 0 THEN -w ELSE w END', 'weight')} FROM h WHERE w <> 0")
def sparsify(spark, sf):
    d = dense(spark, sf)
    n = table(spark, sf, "embeddings").agg(F.count("*")).scalar()
    return prune.sparsify(d, [50, 100], n, tails=("top", "bot", "ext"))


TARGET = math.log(0.8 / 0.2) - scalar.background_log_odds()


@query("sigma2_target", TRAIT_STATS + f"""SELECT trait, n_sets, {r(f"0.05::DOUBLE * pow({TARGET!r}::DOUBLE / {sql_z('tail')}, 2)", 'sigma2')}
    FROM (SELECT trait, count(*) AS n_sets, greatest(least(1.0::DOUBLE / count(*), 0.999::DOUBLE), 1e-12::DOUBLE) AS tail FROM st WHERE beta_tilde > 0 GROUP BY 1)""")
def sigma2_target(spark, sf):
    """Slab variance at which the strongest of a trait's sets with a positive effect reaches a prior of 0.8."""
    n = _trait_stats(spark, sf).where("beta_tilde > 0").groupBy("trait").agg(F.count("*").alias("n_sets"))
    return n.withColumn("sigma2", scalar.sigma2_for_target(0.8, F.col("n_sets"), F.lit(0.05)))
