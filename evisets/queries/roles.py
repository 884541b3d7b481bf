"""Roles of the given tables in the data model, as DataFrames and as SQL common table expressions.

set = supplier, entity = part, trait = nation of the customer, chromosome / position = user class and second of an event.
Every role reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: doubles to 6 places (no negative zero), all integers 64 bit."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def r(expr: str, alias: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {alias}"


# ---- DataFrames -----------------------------------------------------------------------------------------------------

def universe(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("entity_id"))


def n_entities(spark, sf):
    return universe(spark, sf).agg(F.count("*")).scalar()


def membership(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("entity_id")).agg(
        F.max(F.lit(1.0) - F.col("l_discount")).alias("weight"))


def binary(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("entity_id")).distinct().withColumn(
        "weight", F.lit(1.0))


def order_sets(spark, sf):
    """Thin sets: the parts of an order (at most seven lines), weight = quantity / 25."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("set_id"), F.col("l_partkey").alias("entity_id")).agg(
        F.max(F.col("l_quantity") / 25.0).alias("weight"))


def evidence(spark, sf):
    """Log odds of a returned line per part."""
    back = F.sum(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0))
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("entity_id")).agg(
        F.log((back + 0.5) / (F.count("*") - back + 0.5)).alias("log_bf"))


def evidence_y(spark, sf):
    return evidence(spark, sf).select("entity_id", F.lit("returns").alias("trait"), F.col("log_bf").alias("value"))


def entity_trait(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("trait"))
    g = li.join(o, "l_orderkey").join(c, "o_custkey").groupBy(F.col("l_partkey").alias("entity_id"), "trait").agg(
        (F.log(F.sum("l_quantity")) - 3.0).alias("log_bf"), (F.avg("l_discount") * 10.0 - 0.5).alias("prior"))
    return g.select("entity_id", "trait", "log_bf", (F.col("log_bf") + F.col("prior")).alias("combined"), "prior")


def trait_y(spark, sf, col="log_bf"):
    return entity_trait(spark, sf).select("entity_id", "trait", F.col(col).alias("value"))


def covariates(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("entity_id")).agg(F.count("*").cast("double").alias("n_lines"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_size").cast("double").alias("p_size"),
                                        F.col("p_retailprice").alias("price"))
    return p.join(lines, "entity_id", "left").fillna(0.0, ["n_lines"])


def _positions(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", "event_type", "value", (F.col("user_id") % 22).cast("string").alias("chrom"),
        F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)").alias("pos"))


def variants(spark, sf):
    e = _positions(spark, sf).where("event_type <> 'signup'")
    return e.select(F.col("event_id").alias("variant_id"), "chrom", "pos", F.exp(-F.col("value") / 20.0).alias("p"),
                    (F.col("value") / 100.0).alias("beta"), (F.lit(0.5) + F.col("value") / (F.col("value") + 50.0)).alias("se"),
                    (F.col("value") / (F.col("value") + 20.0)).alias("freq"))


def intervals(spark, sf):
    e = _positions(spark, sf).where("event_type = 'signup'")
    return e.select(F.col("event_id").alias("entity_id"), "chrom", F.col("pos").alias("start_pos"), (F.col("pos") + 3600).alias("end_pos"))


def interval_y(spark, sf):
    e = _positions(spark, sf).where("event_type = 'signup'")
    return e.select(F.col("event_id").alias("entity_id"), F.log(F.col("value") + 1.0).alias("value"))


def dense(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("entity_id"), F.posexplode("embedding").alias("_i", "_v")).select(
        "entity_id", F.concat(F.lit("dim"), F.col("_i").cast("string")).alias("name"), F.col("_v").cast("double").alias("value"))


def draws(spark, sf):
    """Chain = user class, parameter = event type, iteration = event order."""
    return table(spark, sf, "events").select((F.col("user_id") % 4).alias("chain"), F.col("event_id").alias("iteration"),
                                             F.col("event_type").alias("param"), F.col("value"))


def loadings(spark, sf):
    """Non-negative loadings: keys of three axes on the discount class of the line (eleven factors)."""
    li = table(spark, sf, "lineitem").select(
        (F.round(F.col("l_discount") * 100) + 1).cast("int").alias("factor"), "l_partkey", "l_suppkey", "l_quantity")
    e = li.groupBy(F.col("l_partkey").cast("string").alias("key"), "factor").agg((F.sqrt(F.sum("l_quantity")) / 10.0).alias("value")).withColumn("axis", F.lit("entity"))
    s = li.groupBy(F.col("l_suppkey").cast("string").alias("key"), "factor").agg((F.sqrt(F.sum("l_quantity")) / 30.0).alias("value")).withColumn("axis", F.lit("set"))
    return e.select("axis", "key", "factor", "value").unionByName(s.select("axis", "key", "factor", "value"))


def run_loadings(spark, sf):
    """The same on the set axis for several runs: run = line number."""
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_linenumber").cast("int").alias("run"), F.col("l_suppkey").cast("string").alias("key"),
                      (F.round(F.col("l_discount") * 100) + 1).cast("int").alias("factor")).agg((F.sum("l_quantity") / 100.0).alias("value")).withColumn(
        "axis", F.lit("set")).select("run", "axis", "key", "factor", "value")


# ---- SQL ------------------------------------------------------------------------------------------------------------

CTE = {
    "memb": "memb AS (SELECT l_suppkey AS set_id, l_partkey AS entity_id, max(1.0::DOUBLE - l_discount) AS weight FROM lineitem GROUP BY 1, 2)",
    "bin": "bin AS (SELECT DISTINCT l_suppkey AS set_id, l_partkey AS entity_id, 1.0::DOUBLE AS weight FROM lineitem)",
    "osets": "osets AS (SELECT l_orderkey AS set_id, l_partkey AS entity_id, max(l_quantity / 25.0::DOUBLE) AS weight FROM lineitem GROUP BY 1, 2)",
    "uni": "uni AS (SELECT p_partkey AS entity_id FROM part)",
    "n": "n AS (SELECT count(*)::DOUBLE AS n FROM part)",
    "evid": "evid AS (SELECT l_partkey AS entity_id, ln((sum(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END) + 0.5) / "
            "(count(*) - sum(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END) + 0.5)) AS log_bf FROM lineitem GROUP BY 1)",
    "et0": "et0 AS (SELECT l_partkey AS entity_id, c_nationkey::BIGINT AS trait, ln(sum(l_quantity)) - 3.0::DOUBLE AS log_bf, "
           "avg(l_discount) * 10.0::DOUBLE - 0.5::DOUBLE AS prior FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)",
    "et": "et AS (SELECT entity_id, trait, log_bf, log_bf + prior AS combined, prior FROM et0)",
    "y": "y AS (SELECT entity_id, trait, log_bf AS value FROM et0)",
    "y1": "y1 AS (SELECT entity_id, 'returns' AS trait, log_bf AS value FROM evid)",
    "cov": "cov AS (SELECT p_partkey AS entity_id, p_size::DOUBLE AS p_size, p_retailprice AS price, coalesce(c, 0)::DOUBLE AS n_lines FROM part "
           "LEFT JOIN (SELECT l_partkey, count(*) AS c FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)",
    "ev": "ev AS (SELECT event_id, event_type, value, (user_id % 22)::VARCHAR AS chrom, "
          "floor(epoch(ts) - epoch(TIMESTAMP '2024-01-01 00:00:00'))::BIGINT AS pos FROM events)",
    "vars": "vars AS (SELECT event_id AS variant_id, chrom, pos, exp(-value / 20.0::DOUBLE) AS p, value / 100.0::DOUBLE AS beta, "
            "0.5::DOUBLE + value / (value + 50.0::DOUBLE) AS se, value / (value + 20.0::DOUBLE) AS freq FROM ev WHERE event_type <> 'signup')",
    "ivl": "ivl AS (SELECT event_id AS entity_id, chrom, pos AS start_pos, pos + 3600 AS end_pos FROM ev WHERE event_type = 'signup')",
    "iy": "iy AS (SELECT event_id AS entity_id, ln(value + 1.0::DOUBLE) AS value FROM ev WHERE event_type = 'signup')",
    "dense": "dense AS (SELECT vec_id AS entity_id, 'dim' || (i - 1)::VARCHAR AS name, embedding[i]::DOUBLE AS value FROM "
             "(SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))",
    "draws": "draws AS (SELECT user_id % 4 AS chain, event_id AS iteration, event_type AS param, value FROM events)",
    "load": "load AS (SELECT 'entity' AS axis, l_partkey::VARCHAR AS key, (round(l_discount * 100) + 1)::BIGINT AS factor, sqrt(sum(l_quantity)) / 10.0::DOUBLE AS value "
            "FROM lineitem GROUP BY 2, 3 UNION ALL SELECT 'set', l_suppkey::VARCHAR, (round(l_discount * 100) + 1)::BIGINT, sqrt(sum(l_quantity)) / 30.0::DOUBLE FROM lineitem GROUP BY 2, 3)",
    "rload": "rload AS (SELECT l_linenumber::BIGINT AS run, 'set' AS axis, l_suppkey::VARCHAR AS key, (round(l_discount * 100) + 1)::BIGINT AS factor, "
             "sum(l_quantity) / 100.0::DOUBLE AS value FROM lineitem GROUP BY 1, 3, 4)",
}

NEEDS = {"et": ["et0"], "y": ["et0"], "y1": ["evid"], "vars": ["ev"], "ivl": ["ev"], "iy": ["ev"]}


def with_(*names: str, extra: str = "") -> str:
    """WITH clause of roles (and what they need), then ``extra`` expressions."""
    order: list[str] = []
    for name in names:
        for n in [*NEEDS.get(name, []), name]:
            if n not in order:
                order.append(n)
    parts = [CTE[n] for n in order] + ([extra] if extra else [])
    return "WITH " + ",\n".join(parts) + "\n"


def sql_p(z: str) -> str:
    """Two-sided normal p in SQL, with the same polynomial as the Column form."""
    from evisets.functions.special import ERFC_CHEBYSHEV

    t = f"(1.0::DOUBLE / (1.0::DOUBLE + 0.5 * abs({z}) / sqrt(2.0::DOUBLE)))"
    poly = f"({ERFC_CHEBYSHEV[-1]}::DOUBLE)"
    for c in ERFC_CHEBYSHEV[-2::-1]:
        poly = f"({poly} * {t} + ({c}::DOUBLE))"
    return f"({t} * exp(-(({z}) * ({z})) / 2.0::DOUBLE + {poly}))"


def sql_z(p: str) -> str:
    """abs(z) of a two-sided p in SQL."""
    from evisets.functions import special as s

    def horner(x, coefs):
        acc = f"({coefs[0]!r}::DOUBLE)"
        for c in coefs[1:]:
            acc = f"({acc} * {x} + ({c!r}::DOUBLE))"
        return acc

    half = f"(greatest(least({p}, 1.0::DOUBLE), 1e-300::DOUBLE) * 0.5::DOUBLE)"
    rt = f"sqrt(-2.0::DOUBLE * ln({half}))"
    q = f"({half} - 0.5::DOUBLE)"
    tail = f"(-({horner(rt, s.QUANTILE_TAIL_NUM)} / {horner(rt, s.QUANTILE_TAIL_DEN)}))"
    centre = f"(-({horner(f'({q} * {q})', s.QUANTILE_CENTRE_NUM)} * {q} / {horner(f'({q} * {q})', s.QUANTILE_CENTRE_DEN)}))"
    return f"(CASE WHEN {half} < {s.QUANTILE_SPLIT}::DOUBLE THEN {tail} ELSE {centre} END)"


def moments_sql(memb: str = "memb", n: str = "n") -> str:
    return (f"xm AS (SELECT set_id, count(*) AS size, sum(weight) AS sw, sum(weight * weight) AS sw2, sum(weight) / max(n) AS mean, "
            f"sqrt(greatest(sum(weight * weight) / max(n) - (sum(weight) / max(n)) * (sum(weight) / max(n)), 0)) AS scale, max(n) AS n FROM {memb}, {n} GROUP BY 1)")


def marginal_sql(memb: str = "memb", y: str = "y", n: str = "n") -> str:
    """CTEs xm, ym, dot, st (set_id, trait, size, mean, scale, beta_tilde, se, z, p)."""
    return ",\n".join([
        moments_sql(memb, n),
        f"ym AS (SELECT trait, sum(value) / max(n) AS y_mean, sum(value * value) / max(n) - (sum(value) / max(n)) * (sum(value) / max(n)) AS y_var FROM {y}, {n} GROUP BY 1)",
        f"dot AS (SELECT set_id, trait, sum(weight * value) AS xy FROM {memb} JOIN {y} USING (entity_id) GROUP BY 1, 2)",
        "st0 AS (SELECT set_id, trait, size, mean, scale, CASE WHEN scale = 0 THEN 0 ELSE (xy - sw * y_mean) / n / scale END AS beta_tilde, "
        "CASE WHEN scale = 0 THEN 0 ELSE sqrt(y_var) / sqrt(n - 1) END AS se FROM dot JOIN xm USING (set_id) JOIN ym USING (trait))",
        f"st AS (SELECT *, {sql_p('z')} AS p FROM (SELECT *, CASE WHEN se > 0 THEN beta_tilde / se ELSE 0 END AS z FROM st0))",
    ])


def bh_sql(src: str, groups: str = "", out: str = "bh") -> str:
    """CTE with q over p in ``src``."""
    part = f"PARTITION BY {groups} " if groups else ""
    return (f"{out}0 AS (SELECT *, p * count(*) OVER ({f'PARTITION BY {groups}' if groups else ''}) / count(*) OVER ({part}ORDER BY p RANGE UNBOUNDED PRECEDING) AS raw FROM {src}),\n"
            f"{out} AS (SELECT * EXCLUDE raw, least(1.0::DOUBLE, min(raw) OVER ({part}ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS q FROM {out}0)")


def spike_sql(p: str, s2: str, b: str = "beta_tilde", s: str = "se") -> tuple[str, str, str]:
    """(mean, postp, conditional mean) in SQL."""
    h = f"(({s2}) / ({p}))"
    tot = f"({h} + {s} * {s})"
    odds = (f"(ln(({p}) / sqrt({tot})) - ln((1.0::DOUBLE - ({p})) / {s}) - {b} * {b} * 0.5 / {tot} + {b} * {b} * 0.5 / ({s} * {s}))")
    post = f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-{odds})))"
    cond = f"({h} / {tot} * {b})"
    return f"({cond} * {post})", post, cond
