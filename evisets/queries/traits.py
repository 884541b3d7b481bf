"""Many-trait operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from evisets.operators import traits
from evisets.operators.sets import set_moments
from evisets.queries.roles import entity_trait, evidence, marginal_sql, membership, n_entities, order_sets, r, spike_sql, sql_p, table, tidy, universe, with_

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = lambda spark, sf: tidy(fn(spark, sf))
        if sql:
            SQL[name] = sql
        return fn
    return add


@query("resolve_multi_cols", with_("et") + f"SELECT entity_id, trait, {r('log_bf', 'log_bf')}, {r('combined', 'combined')}, {r('prior', 'prior')} FROM et")
def resolve_multi(spark, sf):
    e = entity_trait(spark, sf)
    return traits.resolve_multi_cols(e.select(F.col("entity_id").alias("Gene"), F.col("trait").alias("Pheno"), F.col("log_bf").alias("Direct"),
                                              F.col("combined").alias("Combined"), F.col("prior").alias("Prior")))


@query("trait_list", with_("et") + "SELECT DISTINCT trait FROM et WHERE entity_id IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO')")
def trait_list(spark, sf):
    u = table(spark, sf, "part").where("p_type = 'PROMO'").select(F.col("p_partkey").alias("entity_id"))
    return traits.trait_list(entity_trait(spark, sf), u)


@query("trait_slice", with_("et") + f"SELECT entity_id, trait, {r('log_bf', 'log_bf')} FROM et WHERE trait >= 5 AND trait < 10")
def trait_slice(spark, sf):
    return traits.trait_slice(entity_trait(spark, sf), 5, 10).select("entity_id", "trait", "log_bf")


M, P, C = spike_sql("0.2::DOUBLE", "(0.001::DOUBLE * pow(scale, -1.0::DOUBLE))")


@query("trait_set_betas", with_("memb", "n", "et", extra="yc AS (SELECT entity_id, trait, combined AS value FROM et WHERE combined <> 0),\n" + marginal_sql("memb", "yc")) +
       f"SELECT set_id, trait, {r('beta_tilde', 'beta_tilde')}, {r('p', 'p')}, {r(f'CASE WHEN scale > 0 AND se > 0 THEN {M} ELSE 0 END', 'beta_uncorrected')} FROM st")
def trait_set_betas(spark, sf):
    return traits.trait_set_betas(membership(spark, sf), entity_trait(spark, sf), n_entities(spark, sf), "combined", 0.2, 0.001, -1.0).select(
        "set_id", "trait", "beta_tilde", "p", "beta_uncorrected")


def inputs(spark, sf):
    e = evidence(spark, sf)
    prior = table(spark, sf, "part").select(F.col("p_partkey").alias("entity_id"), (F.col("p_size") / 25.0 - 1).alias("prior"))
    j = prior.join(e, "entity_id", "left").withColumn("combined", F.col("log_bf") + F.col("prior"))
    return j.select("entity_id", "log_bf", "combined", "prior")


INPUT = """inp AS (SELECT p_partkey AS entity_id, log_bf, log_bf + (p_size / 25.0::DOUBLE - 1) AS combined, p_size / 25.0::DOUBLE - 1 AS prior FROM part LEFT JOIN evid ON evid.entity_id = p_partkey),
ax AS (SELECT entity_id, axis AS set_id, 1 / (1 + exp(-(coalesce(CASE axis WHEN 'log_bf' THEN log_bf WHEN 'combined' THEN combined ELSE prior END, log_bf, combined, prior) + ln(0.05::DOUBLE / 0.95)))) AS weight FROM inp, (SELECT unnest(['log_bf', 'combined', 'prior']) AS axis))"""


@query("compare_inputs", with_("evid", extra=INPUT) + f"SELECT set_id, entity_id, {r('weight', 'weight')} FROM ax")
def compare_inputs(spark, sf):
    return traits.compare_inputs(inputs(spark, sf))


TM, _, _ = spike_sql("0.5::DOUBLE", "0.01::DOUBLE")
COMPARE = with_("evid", "et", "n", extra=INPUT + """,
yy AS (SELECT entity_id, 'log_bf|' || trait AS trait, log_bf AS value FROM et WHERE log_bf <> 0 UNION ALL SELECT entity_id, 'combined|' || trait, combined FROM et WHERE combined <> 0),
""" + marginal_sql("ax", "yy"))


def compare_sql(pairs):
    cond = " OR ".join(f"(trait LIKE '{o}|%' AND set_id = '{a}')" for o, a in pairs)
    return COMPARE + (f"SELECT split_part(trait, '|', 2)::BIGINT AS trait, split_part(trait, '|', 1) || '_vs_' || set_id AS analysis, {r('beta_tilde', 'beta_tilde')}, {r('se', 'se')}, {r('z', 'z')}, {r('p', 'p')}, "
                      f"{r('CASE WHEN z >= 0 THEN p / 2 ELSE 1 - p / 2 END', 'p_onesided')}, {r(TM, 'beta')} FROM st WHERE {cond}")


@query("trait_compare_matched", compare_sql([("log_bf", "log_bf"), ("combined", "combined")]))
def compare_matched(spark, sf):
    return traits.trait_compare(inputs(spark, sf), entity_trait(spark, sf), n_entities(spark, sf))


@query("trait_compare_diagnostic", compare_sql([(o, a) for o in ("log_bf", "combined") for a in ("log_bf", "combined", "prior")]))
def compare_diagnostic(spark, sf):
    return traits.trait_compare(inputs(spark, sf), entity_trait(spark, sf), n_entities(spark, sf), "diagnostic")


SHARE = with_("evid", "osets", "n", extra=INPUT + """,
b AS (SELECT l_orderkey AS set_id, c_nationkey::BIGINT AS trait, max(l_extendedprice) / 1e5 AS beta FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
m AS (SELECT count(DISTINCT l_orderkey)::DOUBLE AS m FROM lineitem),
s AS (SELECT o.set_id AS k, o.entity_id, trait, weight * beta AS s FROM osets o JOIN b ON b.set_id = o.set_id WHERE beta <> 0),
per AS (SELECT entity_id, trait, sum(s) / max(m) AS e, sqrt(greatest(sum(s * s) / max(m) - (sum(s) / max(m)) * (sum(s) / max(m)), 0)) AS sd FROM s, m GROUP BY 1, 2 HAVING sum(s) > 0.1),
ok AS (SELECT * FROM per WHERE sd > 0),
pp AS (SELECT x.entity_id AS a, y.entity_id AS b, x.trait, sum(x.s * y.s) AS d FROM s x JOIN s y ON x.k = y.k AND x.trait = y.trait GROUP BY 1, 2, 3),
gr AS (SELECT i.trait, i.entity_id AS a, j.entity_id AS b, (coalesce(d, 0) / m - i.e * j.e) / (i.sd * j.sd) AS r FROM ok i JOIN ok j ON i.trait = j.trait LEFT JOIN pp ON pp.trait = i.trait AND pp.a = i.entity_id AND pp.b = j.entity_id, m),
qa AS (SELECT x.set_id, trait, sum(x.weight * r * z.weight) AS q FROM gr JOIN ax x ON x.entity_id = gr.a JOIN ax z ON z.entity_id = gr.b AND z.set_id = x.set_id GROUP BY 1, 2),
own AS (SELECT set_id, trait, sum(weight * weight) AS o FROM ok JOIN ax USING (entity_id) GROUP BY 1, 2),
tot AS (SELECT set_id, sum(weight) AS w, sum(weight * weight) AS w2 FROM ax GROUP BY 1),
f AS (SELECT set_id, trait, (q + w2 - o) / n AS sh, w2 / n - (w / n) * (w / n) AS var FROM qa JOIN own USING (set_id, trait) JOIN tot USING (set_id), n)""")


@query("shared_set_inflation", SHARE + f"SELECT set_id, trait, {r('sqrt(greatest(sh - sh * sh, var) / var)', 'factor')} FROM f")
def shared_inflation(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("set_id")).agg((F.max("l_extendedprice") / 1e5).alias("beta"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("set_id"), "o_custkey")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("trait"))
    st = li.join(o, "set_id").join(c, "o_custkey").select("set_id", "trait", "beta")
    m = table(spark, sf, "lineitem").agg(F.countDistinct("l_orderkey")).scalar()
    return traits.shared_set_inflation(traits.compare_inputs(inputs(spark, sf)), order_sets(spark, sf), st, n_entities(spark, sf), m)
