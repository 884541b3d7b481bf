"""Result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evisets.operators import assoc, factors as fx, reports, sets, shrink
from evisets.queries import factors as fq
from evisets.queries import shrink as sq
from evisets.queries.roles import (
    binary, covariates, entity_trait, evidence, evidence_y, intervals, loadings, marginal_sql, membership, moments_sql, n_entities, r, sql_p, table,
    tidy, trait_y, universe, with_, _positions,
)

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = lambda spark, sf: tidy(fn(spark, sf))
        if sql:
            SQL[name] = sql
        return fn
    return add


def scores(spark, sf):
    e = evidence(spark, sf)
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("entity_id"), (F.col("p_size") / 25.0 - 1).alias("prior"))
    return e.join(p, "entity_id").withColumn("combined", F.col("prior") + F.col("log_bf"))


SC = with_("memb", "evid", "n", extra="""sc AS (SELECT entity_id, log_bf, p_size / 25.0::DOUBLE - 1 AS prior, log_bf + (p_size / 25.0::DOUBLE - 1) AS combined FROM evid JOIN part ON p_partkey = entity_id),
dg AS (SELECT entity_id, count(*) AS "N" FROM memb GROUP BY 1)""")


@query("entity_report", SC + f"""SELECT s.entity_id, {r('log_bf', 'log_bf')}, {r('prior', 'prior')}, {r('combined', 'combined')}, {r('p_retailprice', 'price')}, coalesce("N", 0)::DOUBLE AS "N" FROM sc s JOIN part ON p_partkey = s.entity_id LEFT JOIN dg ON dg.entity_id = s.entity_id WHERE abs(combined) > 0.2
    UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL FROM part WHERE p_partkey NOT IN (SELECT entity_id FROM sc)""")
def entity_report(spark, sf):
    src = table(spark, sf, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_retailprice").alias("price"))
    return reports.entity_report(scores(spark, sf), src, membership(spark, sf), outside=universe(spark, sf), min_abs_combined=0.2).withColumn("N", F.col("N").cast("double"))


@query("entity_report_located", with_("ivl", "iy", "ev") + f"""SELECT i.entity_id, {r('value', 'log_bf')}, chrom, start_pos, end_pos FROM iy i JOIN ivl v USING (entity_id)""")
def entity_report_located(spark, sf):
    from evisets.queries.roles import interval_y

    return reports.entity_report(interval_y(spark, sf).withColumnRenamed("value", "log_bf"), locations=intervals(spark, sf))


@query("set_report", with_("bin", "n", "y1", extra=marginal_sql("bin", "y1")) + f"""SELECT set_id, trait, size, {r('mean', 'mean')}, {r('scale', 'scale')}, {r('z', 'z')}, {r('p', 'p')},
    CASE WHEN p <= 0.5 THEN 'kept' ELSE 'ignored' END AS status, CASE WHEN p > 0.5 THEN 'p' END AS filter_reason, {r('beta_tilde / scale', 'beta_tilde')}, {r('beta_tilde', 'beta_tilde_internal')}, {r('se / scale', 'se')}, {r('se', 'se_internal')} FROM st""")
def set_report(spark, sf):
    s = assoc.marginal_linear(binary(spark, sf), evidence_y(spark, sf), n_entities(spark, sf))
    return reports.set_report(sets.flag(s, F.col("p") <= 0.5, "p"))


EXPL = with_("bin", "n", "y1", "evid", extra=marginal_sql("bin", "y1") + ",\nb AS (SELECT set_id, beta_tilde / scale AS beta FROM st WHERE abs(beta_tilde / scale) > 0.05)")


@query("explain_entities", EXPL + f"SELECT b.set_id, e.entity_id, {r('beta', 'beta')}, {r('log_bf', 'log_bf')}, row_number() OVER (PARTITION BY e.entity_id ORDER BY beta DESC, b.set_id) AS set_rank FROM bin JOIN b USING (set_id) JOIN evid e ON e.entity_id = bin.entity_id")
def explain(spark, sf):
    s = assoc.marginal_linear(binary(spark, sf), evidence_y(spark, sf), n_entities(spark, sf)).withColumnRenamed("beta_tilde", "beta")
    return reports.explain(evidence(spark, sf), binary(spark, sf), s, 0.05).select("set_id", "entity_id", "beta", "log_bf", "set_rank")


@query("set_trait_report", sq.BASE + f"SELECT set_id, trait, {r('beta_uncorrected / scale', 'beta_uncorrected')}, {r('beta_uncorrected', 'beta_uncorrected_internal')} FROM sh")
def set_trait_report(spark, sf):
    s = shrink.shrink_independent(sq.stats(spark, sf))
    return reports.set_trait_report(s).select("set_id", "trait", "beta_uncorrected", "beta_uncorrected_internal")


@query("top_sets_per_trait", with_("bin", "n", "y", extra=marginal_sql("bin", "y")) + f"SELECT set_id, trait, {r('p', 'p')}, row_number() OVER (PARTITION BY trait ORDER BY p, set_id) AS rank FROM st QUALIFY rank <= 3")
def top_sets(spark, sf):
    s = assoc.marginal_linear(binary(spark, sf), trait_y(spark, sf), n_entities(spark, sf))
    return reports.top_sets_per_trait(s, 3).select("set_id", "trait", "p", "rank")


@query("trait_report", with_("et") + " UNION ALL ".join(
    f"SELECT trait, '{a}' AS analysis, {r(f'avg({c})', 'beta_tilde')}, {r(f'stddev_pop({c})', 'se')}, {r(f'avg({c}) / stddev_pop({c})', 'z')}, {r(f'max({c})', 'p')}, {r(f'min({c})', 'beta')} FROM et GROUP BY 1" for a, c in (("direct", "log_bf"), ("total", "combined"))))
def trait_report(spark, sf):
    e = entity_trait(spark, sf)
    aggs = []
    for a, c in (("direct", "log_bf"), ("total", "combined")):
        aggs += [F.avg(c).alias(f"{a}_beta_tilde"), F.stddev_pop(c).alias(f"{a}_se"), (F.avg(c) / F.stddev_pop(c)).alias(f"{a}_z"), F.max(c).alias(f"{a}_p"), F.min(c).alias(f"{a}_beta")]
    return reports.trait_report(e.groupBy("trait").agg(*aggs), ["direct", "total"])


FTR = fq.HITS + ", lb AS (SELECT unnest([1, 2, 3])::BIGINT AS factor, unnest(['size', 'key', 'price']) AS label)\n"


@query("factor_trait_report", FTR + f"""SELECT factor, trait, 'marginal_unconditional_binary' AS analysis, 'marginal_unconditional_binary' AS mode, 'marginal_unconditional_binary:direct' AS model_name, 'single' AS factor_model_scope,
    'thresholded_combined' AS outcome_surface, 'none' AS anchor_covariate, 1.0::DOUBLE AS threshold_cutoff, 'robust' AS se_type, {r('beta', 'beta')}, {r(sql_p('z'), 'p')}, {r('CASE WHEN z >= 0 THEN ' + sql_p('z') + ' / 2 ELSE 1 - ' + sql_p('z') + ' / 2 END', 'p_onesided')}, {r('z', 'z')}, {r('se', 'se')}, label FROM zz JOIN lb USING (factor)""")
def factor_trait_report(spark, sf):
    block = fx.factor_trait_marginal(fq.dense_loadings(spark, sf), fq.hits(spark, sf), None)
    labels = fq.dense_loadings(spark, sf).select("factor").distinct().withColumn("label", F.element_at(F.array(F.lit("size"), F.lit("key"), F.lit("price")), F.col("factor")))
    return reports.factor_trait_report({"marginal_unconditional_binary": block}, labels)


@query("set_overlap_report", with_("bin", "n", "y1", extra=marginal_sql("bin", "y1") + """,
lv AS (SELECT set_id, beta_tilde * 0.5 AS beta, beta_tilde AS bu FROM st WHERE p < 0.3), d AS (SELECT a.set_id AS set_a, b.set_id AS set_b, sum(a.weight * b.weight) AS dot FROM bin a JOIN bin b ON a.entity_id = b.entity_id AND a.set_id <> b.set_id
  WHERE a.set_id IN (SELECT set_id FROM lv) AND b.set_id IN (SELECT set_id FROM lv) GROUP BY 1, 2)""") +
       f"SELECT set_a, {r('x.beta / a.scale', 'beta')}, {r('x.bu / a.scale', 'beta_uncorrected')}, set_b, {r('(dot / a.n - a.mean * b.mean) / (a.scale * b.scale) * z.beta / a.scale', 'v_beta')}, {r('(dot / a.n - a.mean * b.mean) / (a.scale * b.scale)', 'v')}, "
       f"{r('z.beta / b.scale', 'beta_overlap')}, {r('z.bu / b.scale', 'beta_uncorrected_overlap')} FROM d JOIN xm a ON a.set_id = set_a JOIN xm b ON b.set_id = set_b JOIN lv x ON x.set_id = set_a JOIN lv z ON z.set_id = set_b")
def set_overlap_report(spark, sf):
    b = binary(spark, sf)
    n = n_entities(spark, sf)
    s = assoc.marginal_linear(b, evidence_y(spark, sf), n).where("p < 0.3").select(
        "set_id", (F.col("beta_tilde") * 0.5).alias("beta"), F.col("beta_tilde").alias("beta_uncorrected"))
    return reports.set_overlap_report(b, s, sets.set_moments(b, n))


@query("covariate_report", with_("cov") + f"SELECT entity_id, {r('p_size', 'p_size')}, {r('price', 'price')}, {r('n_lines', 'n_lines')}, n_lines > 20 AS in_regression FROM cov")
def covariate_report(spark, sf):
    return reports.covariate_report(covariates(spark, sf), F.col("n_lines") > 20)


@query("effector_report", with_("et", extra="""g AS (SELECT trait AS signal_id, entity_id, exp(log_bf) AS bf FROM et WHERE log_bf > 1),
s AS (SELECT l_partkey AS entity_id, sum(l_tax) * 5 AS combined, sum(l_discount) AS prior, avg(l_tax) AS combined_D FROM lineitem GROUP BY 1),
j AS (SELECT signal_id, entity_id, bf, exp(least(combined, 10)) AS t, exp(least(prior, 10)) AS p, combined_D FROM g JOIN s USING (entity_id))""") +
       f"SELECT signal_id, entity_id, {r('t / sum(t) OVER w', 'cond_prob_total')}, {r('bf * p / sum(bf * p) OVER w', 'cond_prob_signal')}, {r('p / sum(p) OVER w', 'cond_prob_prior')}, {r('bf / sum(bf) OVER w', 'cond_prob_huge')}, {r('combined_D', '\"combined_D\"')} FROM j WINDOW w AS (PARTITION BY signal_id)")
def effector_report(spark, sf):
    g = entity_trait(spark, sf).where("log_bf > 1").select(F.col("trait").alias("signal_id"), "entity_id", F.exp("log_bf").alias("bf"))
    s = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("entity_id")).agg(
        (F.sum("l_tax") * 5).alias("combined"), F.sum("l_discount").alias("prior"), F.avg("l_tax").alias("combined_D"))
    return reports.effector_report(g, s)


@query("factor_report", fq.TOPS + f"""SELECT l.factor, {r('l.v', '\"lambda\"')}, b.label, e.k AS top_entities, s.k AS top_sets, '' AS top_traits FROM (SELECT factor, sum(value) / 1000 AS v FROM load GROUP BY 1) l
    JOIN (SELECT factor, string_agg(key, ', ' ORDER BY rank) AS label FROM tp WHERE axis = 'set' AND rank <= 3 GROUP BY 1) b USING (factor) JOIN (SELECT factor, string_agg(key, ',' ORDER BY rank) AS k FROM tp WHERE axis = 'entity' GROUP BY 1) e USING (factor)
    JOIN (SELECT factor, string_agg(key, ',' ORDER BY rank) AS k FROM tp WHERE axis = 'set' GROUP BY 1) s USING (factor)""")
def factor_report(spark, sf):
    t = fq.tops(spark, sf)
    return reports.factor_report(fq.lambdas(spark, sf), t, fx.default_label(t))


@query("cluster_report", with_("load", extra="s AS (SELECT * FROM load WHERE axis = 'set')") + f"""SELECT key, arg_max(factor, (value, -factor)) AS cluster, {r('sum(value)', 'total')}, {", ".join(r(f'sum(value) FILTER (factor = {i})', f'"Factor{i}"') for i in range(1, 12))} FROM s GROUP BY 1""")
def cluster_report(spark, sf):
    return reports.cluster_report(loadings(spark, sf), "set", list(range(1, 12)))


@query("consensus_report", fq.CONS.rstrip() + f""", {fq.RUNSUM} SELECT run::DOUBLE AS run, phi_no::DOUBLE AS phi_no, num_factors::DOUBLE AS num_factors, {r('error', 'error')}, {r('evidence', 'evidence')}, 'run' AS row_type,
    NULL::DOUBLE AS factor, NULL::DOUBLE AS support_runs, NULL::DOUBLE AS support_fraction, NULL::VARCHAR AS kept FROM rs
    UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 'factor', factor, support_runs, {r('support_fraction', 'support_fraction')}, (support_fraction >= 0.6)::VARCHAR FROM sup""")
def consensus_report(spark, sf):
    _, support = fx.consensus(fq.run_loadings(spark, sf), fq.fixed_matches(spark, sf), 7, 0.7, 0.6)
    out = reports.consensus_report(fq.run_summaries(spark, sf), support)
    nums = {c: F.col(c).cast("double") for c in ("run", "phi_no", "num_factors", "factor", "support_runs")}
    return out.withColumns(nums | {"kept": F.col("kept").cast("string")})


@query("entity_trait_report", with_("et") + f"SELECT entity_id, trait, {r('log_bf', 'log_bf')}, {r('combined', 'combined')}, {r('prior', 'prior')}, {r('max(combined) OVER (PARTITION BY entity_id)', 'entity_max')} FROM et WHERE greatest(log_bf, combined, prior) >= 1")
def entity_trait_report(spark, sf):
    return reports.entity_trait_report(entity_trait(spark, sf), 1.0)


@query("params_report", "SELECT c_mktsegment || c_nationkey AS parameter, row_number() OVER (PARTITION BY c_mktsegment || c_nationkey ORDER BY c_custkey) AS version, c_name AS value FROM customer")
def params_report(spark, sf):
    c = table(spark, sf, "customer").select(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("parameter"), F.col("c_name").alias("value"), F.col("c_custkey").alias("recorded_at"))
    return reports.params_report(c)


@query("phi_report", fq.PHI + f"SELECT {fq.PSEL}, CASE WHEN phi = (SELECT max(phi) FROM ps) THEN 'given' END AS reason, phi = (SELECT max(phi) FROM ps) AS selected FROM ps")
def phi_report(spark, sf):
    s = fx.phi_summary(*fq.phi_tables(spark, sf), max_factors=11)
    return reports.phi_report(s, s.agg(F.max("phi").alias("phi")).withColumn("reason", F.lit("given")))


@query("append_trait", with_("evid") + f"""SELECT entity_id, {r('log_bf', 'log_bf')}, 'returns' AS trait FROM evid UNION ALL SELECT p_partkey, {r('ln(p_size)', 'log_bf')}, 'size' FROM part""")
def append_trait(spark, sf):
    size = table(spark, sf, "part").select(F.col("p_partkey").alias("entity_id"), F.log(F.col("p_size").cast("double")).alias("log_bf"))
    return reports.append_trait({"returns": evidence(spark, sf), "size": size})
