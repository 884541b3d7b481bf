"""Scans and parsers. The text they parse is rendered by Spark from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evisets.operators import align
from evisets.queries.roles import CTE, evidence_y, binary, membership, n_entities, r, table, tidy, variants, with_, _positions
from evisets.operators.assoc import marginal_linear
from evisets.queries.roles import marginal_sql
from evisets.sources import profile, scans

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = lambda spark, sf: tidy(fn(spark, sf))
        if sql:
            SQL[name] = sql
        return fn
    return add


def set_lines(spark, sf):
    """One line per order: the customer's id, then its parts, some weighted, some unusable."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    p = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    tok = F.when(F.col("l_linenumber") == 7, F.lit("NA")).when(F.col("l_linenumber") == 6, F.concat(p, F.lit(":bad"))).when(
        F.col("l_linenumber") % 2 == 1, p).otherwise(F.concat(p, F.lit(":"), F.col("l_quantity").cast("long").cast("string")))
    per_order = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(tok)).alias("_t"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return per_order.join(o, "l_orderkey").select(
        F.col("l_orderkey").alias("line_no"), F.concat_ws(" ", F.concat(F.lit("C"), F.col("o_custkey").cast("string")), F.array_join("_t", " ")).alias("value"))


SET_LINES_SQL = """first AS (SELECT o_custkey, min(o_orderkey) AS ok FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1)
SELECT 'C' || o_custkey AS set_id, ok AS line_no, 'P' || l_partkey AS entity_id,
       max(CASE WHEN l_linenumber % 2 = 1 THEN 1.0::DOUBLE ELSE l_quantity END) + 0.0 AS weight
FROM first JOIN lineitem ON l_orderkey = ok {where} GROUP BY 1, 2, 3"""


@query("scan_set_lists", "WITH " + SET_LINES_SQL.format(where="WHERE l_linenumber < 6"))
def scan_set_lists(spark, sf):
    return scans.parse_set_lines(set_lines(spark, sf))


@query("scan_only_ids", "WITH " + SET_LINES_SQL.format(
    where="WHERE l_linenumber < 6 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"))
def scan_only_ids(spark, sf):
    ids = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("set_id"))
    return scans.parse_set_lines(set_lines(spark, sf), ids)


@query("read_inputs", """WITH t AS (SELECT l_orderkey AS line_no, 'dir/' || (l_orderkey % 5) AS path, 'P' || l_partkey AS entity_id, max(CASE WHEN l_linenumber % 2 = 1 THEN 1.0::DOUBLE ELSE l_quantity END) AS weight
    FROM lineitem WHERE l_linenumber < 6 GROUP BY 1, 2, 3),
f AS (SELECT 'dir/' || r_regionkey AS path, CASE WHEN r_regionkey % 2 = 0 THEN replace(r_name, ' ', '-') END AS label, r_name AS batch FROM region),
s AS (SELECT coalesce(label || '_', '') || 'C' || o_custkey AS set_id, line_no, entity_id, label, batch, weight FROM t JOIN f USING (path) JOIN orders ON o_orderkey = line_no),
o AS (SELECT coalesce(label || '_', '') || 'C' || o_custkey AS set_id, min(o_orderkey) AS line_no FROM orders JOIN f ON path = 'dir/' || (o_orderkey % 5) WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1)
SELECT s.* FROM s JOIN o USING (set_id, line_no)""")
def read_inputs(spark, sf):
    text = set_lines(spark, sf).withColumn("path", F.concat(F.lit("dir/"), (F.col("line_no") % 5).cast("string")))
    files = table(spark, sf, "region").select(F.concat(F.lit("dir/"), F.col("r_regionkey").cast("string")).alias("path"),
                                              F.when(F.col("r_regionkey") % 2 == 0, F.translate("r_name", " ", "-")).alias("label"), F.col("r_name").alias("batch"))
    return scans.parse_inputs(text, files)


@query("scan_dense_annotations", f"""SELECT p_partkey::VARCHAR AS entity_id, name, {r('value', 'value')} FROM (
    SELECT p_partkey, 'p_size' AS name, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part)""")
def scan_dense(spark, sf):
    wide = table(spark, sf, "part").select(F.col("p_partkey").alias("line_no"), *[F.col(c).cast("string").alias(c) for c in ("p_partkey", "p_size", "p_retailprice", "p_name")])
    return scans.parse_dense(wide, "p_partkey", only=["p_size", "p_retailprice"])


@query("plan_inputs", """SELECT spec, CASE WHEN p_size % 3 = 0 THEN 'dir/' || p_partkey ELSE 'dir/' || p_partkey END AS path,
    CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type END AS label, CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_brand END AS batch FROM (
    SELECT *, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type || ':' END || 'dir/' || p_partkey || CASE WHEN p_size % 2 = 0 THEN '' ELSE '@' || p_brand END AS spec FROM part)""")
def plan_inputs(spark, sf):
    p = table(spark, sf, "part")
    spec = F.concat(F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat("p_type", F.lit(":"))), F.lit("dir/"), F.col("p_partkey").cast("string"),
                    F.when(F.col("p_size") % 2 == 0, "").otherwise(F.concat(F.lit("@"), "p_brand")))
    return scans.parse_input_specs(p.select(spec.alias("spec")))


def event_table(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("line_no"), F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("type"),
                    F.col("value").cast("string").alias("value"), (F.col("value") / (F.col("value") + 20.0)).cast("string").alias("prob"),
                    F.exp(-F.col("value") / 20.0).cast("string").alias("p"), (F.col("value") - 10.0).cast("string").alias("effect"))


@query("scan_entity_stats", f"""WITH t AS (SELECT user_id::VARCHAR AS entity_id, event_id, value / (value + 20.0::DOUBLE) AS pr, value, value - 10.0::DOUBLE AS eff FROM events)
SELECT entity_id, {r("ln(pr / (1 - pr)) - ln(0.05 / 0.95)", "log_bf")}, {r('value', 'combined')}, {r('eff', 'prior')}
FROM t WHERE pr > 0 AND pr < 1 QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY event_id DESC) = 1""")
def scan_entity_stats(spark, sf):
    return scans.parse_entity_stats(event_table(spark, sf), "id", prob_col="prob", combined_col="value", prior_col="effect")


@query("scan_set_stats", None)
def scan_set_stats(spark, sf):
    return scans.parse_set_stats(event_table(spark, sf), "id", beta_col="effect", p_col="p", max_p=0.5).select("set_id", "beta_tilde", "p", "se", "z")


from evisets.queries.roles import sql_z  # noqa: E402

SQL["scan_set_stats"] = f"""WITH f AS (SELECT user_id::VARCHAR AS set_id, value - 10.0::DOUBLE AS beta_tilde, exp(-value / 20.0::DOUBLE) AS p FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1),
g AS (SELECT *, {sql_z('p')} AS z0 FROM f), h AS (SELECT *, abs(beta_tilde / CASE WHEN z0 = 0 THEN 1 ELSE z0 END) AS se FROM g)
SELECT set_id, {r('beta_tilde', 'beta_tilde')}, {r('p', 'p')}, {r('se', 'se')}, {r('CASE WHEN se > 0 THEN beta_tilde / se ELSE 0 END', 'z')} FROM h WHERE p <= 0.5"""


def role_table(spark, sf):
    v = variants(spark, sf)
    return v.select(F.col("chrom").alias("CHR"), (F.col("pos") + 100).alias("POS"), F.col("p").alias("P"), F.col("beta").alias("BETA"), F.col("se").alias("SE"),
                    (F.col("freq") * 2).alias("MAF"), F.col("variant_id").alias("N"), F.col("p").alias("P_VALUE"))


PROFILE_SQL = with_("vars") + """SELECT * FROM (
    SELECT 'CHR' AS "column", 'chrom' AS role, bool_and(chrom::INT BETWEEN 1 AND 26) AS ok FROM vars
    UNION ALL SELECT 'POS', 'pos', bool_and(length((pos + 100)::VARCHAR) >= 3) FROM vars
    UNION ALL SELECT 'P_VALUE', 'p', bool_and(p BETWEEN 0 AND 1) FROM vars
    UNION ALL SELECT 'BETA', 'beta', true
    UNION ALL SELECT 'SE', 'se', bool_and(se >= 0) FROM vars
    UNION ALL SELECT 'MAF', 'freq', bool_and(freq * 2 BETWEEN 0 AND 1) FROM vars
    UNION ALL SELECT 'N', 'n', bool_and(length(variant_id::VARCHAR) >= 3) FROM vars)"""


@query("profile_columns", PROFILE_SQL)
def profile_columns(spark, sf):
    return profile.profile_columns(role_table(spark, sf))


@query("resolve_roles", f"""SELECT role, min("column") AS "column" FROM ({PROFILE_SQL}) WHERE ok GROUP BY role HAVING count(*) = 1""")
def resolve_roles(spark, sf):
    return profile.resolve_roles(profile.profile_columns(role_table(spark, sf)))


@query("scan_entity_trait", f"""SELECT 'G' || user_id AS entity_id, event_type AS trait, {r('value - 10', 'log_bf')}, {r('value', 'combined')} FROM events WHERE value >= 1
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1""")
def scan_entity_trait(spark, sf):
    names = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("old_id"), F.concat(F.lit("G"), F.col("user_id").cast("string")).alias("new_id")).distinct()
    return scans.parse_entity_trait(event_table(spark, sf), "id", "type", log_bf_col="effect", combined_col="value", min_value=1.0, id_map=names)


@query("scan_set_trait", f"""SELECT user_id::VARCHAR AS set_id, event_type AS trait, {r('value', 'beta')}, {r('value - 10', 'beta_uncorrected')} FROM events
    WHERE value - 10 >= 0.5 AND event_type IN ('click', 'purchase') QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1""")
def scan_set_trait(spark, sf):
    wanted = spark.createDataFrame([("click",), ("purchase",)], "trait string")
    return scans.parse_set_trait(event_table(spark, sf), "id", "type", beta_col="value", beta_uncorrected_col="effect", min_beta_uncorrected=0.5, traits=wanted)


@query("scan_set_trait_ids", "SELECT DISTINCT user_id::VARCHAR AS set_id FROM events WHERE value - 10 >= 0.5")
def scan_set_trait_ids(spark, sf):
    return scans.set_ids(scans.parse_set_trait(event_table(spark, sf), "id", "type", beta_uncorrected_col="effect", min_beta_uncorrected=0.5))


def part_lines(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("line_no"), "p_brand", "p_name", F.col("p_size").cast("string").alias("p_size"),
                                           F.col("p_retailprice").cast("string").alias("price"))


@query("scan_covariates", f"""SELECT p_brand AS entity_id, {r('p_size::DOUBLE', 'p_size')}, {r('p_retailprice', 'price')} FROM part
    QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1""")
def scan_covariates(spark, sf):
    return scans.parse_covariates(part_lines(spark, sf), "p_brand", ["p_size", "price"])


@query("scan_universe", "SELECT p_brand AS entity_id, min(p_partkey) AS line_no FROM part GROUP BY 1")
def scan_universe(spark, sf):
    return scans.parse_universe(part_lines(spark, sf), 2)


@query("scan_id_map", "SELECT p_name AS old_id, arg_max(p_brand, p_partkey) AS new_id FROM part GROUP BY 1")
def scan_id_map(spark, sf):
    return scans.parse_id_map(part_lines(spark, sf), "p_name", "p_brand")


@query("scan_id_map_multi", "SELECT DISTINCT p_name AS old_id, p_brand AS new_id FROM part")
def scan_id_map_multi(spark, sf):
    return scans.parse_id_map(part_lines(spark, sf), "p_name", "p_brand", multi=True)


@query("scan_locations", f"""WITH {CTE['ev']}, e AS (SELECT event_id, 'G' || event_type || (event_id % 500) AS g, (event_id % 3)::VARCHAR AS chrom, pos * 10 AS s, pos * 10 + 3600 AS t FROM ev),
f AS (SELECT g, arg_min(chrom, event_id) AS fc, arg_min(s, event_id) AS fs, arg_min(t, event_id) AS ft FROM e GROUP BY 1)
SELECT g AS entity_id, chrom, s AS start_pos, t AS end_pos FROM e JOIN f USING (g) WHERE chrom = fc AND abs((s + t) / 2.0::DOUBLE - (fs + ft) / 2.0::DOUBLE) <= 1e7""")
def scan_locations(spark, sf):
    e = _positions(spark, sf)
    g = F.concat(F.lit("G"), F.col("event_type"), (F.col("event_id") % 500).cast("string"))
    s = (F.col("pos") * 10)
    text = e.select(F.col("event_id").alias("line_no"), F.concat_ws(
        "\t", F.col("event_id").cast("string"), F.concat(F.lit("chr"), (F.col("event_id") % 3).cast("string")), s.cast("string"), (s + 3600).cast("string"), F.lit("+"), g).alias("value"))
    return scans.parse_location_lines(text)


@query("interval_points", with_("ivl") + """SELECT DISTINCT entity_id, chrom, pos FROM (SELECT entity_id, chrom, unnest([start_pos, end_pos, start_pos + 1000, start_pos + 2000, start_pos + 3000]) AS pos FROM ivl)""")
def interval_points(spark, sf):
    from evisets.queries.roles import intervals

    return scans.interval_points(intervals(spark, sf), 1000)


@query("scan_links", with_("ev", extra="""l AS (SELECT chrom, pos, event_id AS entity_id, least(value / 100.0::DOUBLE, 0.95::DOUBLE) AS prob FROM ev
    WHERE event_type IN ('click', 'error') AND (chrom, pos) IN (SELECT (chrom, pos) FROM ev WHERE event_type = 'click'))""") +
       f"SELECT chrom, pos, entity_id, {r('prob / sum(prob) OVER (PARTITION BY chrom, pos)', 'prob')} FROM l")
def scan_links(spark, sf):
    from evisets.operators.locus import read_links

    e = _positions(spark, sf)
    links = e.where("event_type in ('click', 'error')").select("chrom", "pos", F.col("event_id").alias("entity_id"), (F.col("value") / 100.0).alias("prob"))
    return read_links(links, e.where("event_type = 'click'"), normalise_to=1.0)


def _credible(spark, sf):
    from evisets.operators.locus import credible_sets

    e = _positions(spark, sf)
    cs = e.where("event_type in ('purchase', 'view')").select(
        "chrom", "pos", F.when(F.col("event_type") == "view", F.col("event_id").cast("string")).alias("cs_id"), (F.col("value") / 10.0).alias("ppa"))
    v = variants(spark, sf).join(e.where("event_type = 'purchase'").select(F.col("event_id").alias("variant_id")), "variant_id", "left_anti")
    return credible_sets(cs, v.select("variant_id", "chrom", "pos", "p", "beta", "se"), 1e-5)


@query("scan_credible_sets", with_("ev") + f"""SELECT chrom, pos, CASE WHEN event_type = 'view' THEN event_id::VARCHAR ELSE chrom || ':' || pos END AS cs_id,
    {r('CASE WHEN value / 10 > 1 THEN 0.99 ELSE value / 10 END', 'ppa')} FROM ev WHERE event_type IN ('purchase', 'view')""")
def scan_credible_sets(spark, sf):
    return _credible(spark, sf)[0]


@query("credible_set_variants", with_("vars", extra="kept AS (SELECT v.* FROM vars v WHERE variant_id NOT IN (SELECT event_id FROM ev WHERE event_type = 'purchase'))") + f"""
SELECT variant_id::VARCHAR AS variant_id, chrom, pos, {r('p', 'p')}, {r('beta', 'beta')}, {r('se', 'se')} FROM kept
UNION ALL SELECT DISTINCT chrom || ':' || pos, chrom, pos, {r('1e-5::DOUBLE', 'p')}, 1.0::DOUBLE, NULL::DOUBLE FROM ev WHERE event_type IN ('purchase', 'view') AND (chrom, pos) NOT IN (SELECT (chrom, pos) FROM kept)""")
def credible_set_variants(spark, sf):
    return _credible(spark, sf)[1]


@query("scan_entity_list", "SELECT p_name AS entity_id, min(p_partkey) AS line_no FROM part GROUP BY 1")
def scan_entity_list(spark, sf):
    return scans.parse_entity_list(part_lines(spark, sf), "p_name")


@query("scan_counts", f"""SELECT o_custkey::VARCHAR AS entity_id, CASE WHEN o_orderstatus = 'F' THEN 'case' ELSE 'control' END AS arm, {r('substr(o_orderpriority, 1, 1)::DOUBLE / 5', 'score')},
    {r('1.0::DOUBLE', '"count"')}, {r('1000.0::DOUBLE', 'total')}, {r('o_totalprice / 1e6', 'max_freq')} FROM orders""")
def scan_counts(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("id"), "o_orderstatus", (F.substring("o_orderpriority", 1, 1).cast("double") / 5).alias("s"),
        F.lit("1").alias("c"), F.lit("1000").alias("t"), (F.col("o_totalprice") / 1e6).alias("f"))
    cols = {"entity_id": "id", "score": "s", "count": "c", "total": "t", "max_freq": "f"}
    return scans.parse_counts(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"), cols)


@query("scan_entity_corr", f"""WITH e AS (SELECT 'E' || s_suppkey AS a, 'E' || (s_suppkey - k) AS b, ((s_suppkey * k) % 7) / 10.0::DOUBLE AS r FROM supplier, (SELECT unnest([1, 2, 3]) AS k) WHERE s_suppkey >= k)
SELECT a AS entity_a, b AS entity_b, {r('r', 'r')} FROM e UNION ALL SELECT b, a, {r('r', 'r')} FROM e""")
def scan_entity_corr(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey")
    v = lambda k: F.when(F.col("s_suppkey") >= k, (((F.col("s_suppkey") * k) % 7) / 10.0).cast("string"))
    text = s.select(F.col("s_suppkey").alias("line_no"), F.concat_ws(
        " ", F.concat(F.lit("E"), F.col("s_suppkey").cast("string")), F.lit("a b c d e f g h"), v(3), v(2), v(1)).alias("value"))
    return scans.parse_corr_lines(text)


@query("scan_loadings", f"""SELECT 'set' AS axis, l_suppkey::VARCHAR AS key, factor::BIGINT AS factor, {r('coalesce(v, 0)', 'value')} FROM (SELECT DISTINCT l_suppkey FROM lineitem),
    (SELECT unnest([1, 2, 3]) AS factor) LEFT JOIN (SELECT l_suppkey AS sk, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS fk, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) ON sk = l_suppkey AND fk = factor""")
def scan_loadings(spark, sf):
    wide = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("Gene_Set")).agg(
        *[F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))).cast("string").alias(f"Factor{i}") for i, f in ((1, "A"), (2, "N"), (3, "R"))])
    return scans.parse_loadings(wide, "Gene_Set", "set")


@query("only_listed_sets", with_("memb") + f"SELECT set_id, entity_id, {r('weight', 'weight')} FROM memb WHERE set_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def only_listed_sets(spark, sf):
    listed = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("set_id"))
    return scans.only_listed_sets(membership(spark, sf), listed).select("set_id", "entity_id", "weight")


def shared(spark, name):
    """A new place in the folder the session shares."""
    return f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("hand_off_tables", with_("memb") + f"SELECT set_id, entity_id, {r('weight', 'weight')}, s_name AS name FROM memb LEFT JOIN supplier ON s_suppkey = set_id")
def hand_off_tables(spark, sf):
    path = shared(spark, "hand-off")
    scans.save_tables({"membership": membership(spark, sf).select("set_id", "entity_id", "weight"),
                       "names": table(spark, sf, "supplier").select(F.col("s_suppkey").alias("set_id"), F.col("s_name").alias("name"))}, path)
    back = scans.load_tables(spark, path, ["membership", "names"])
    return back["membership"].join(back["names"], "set_id", "left").select("set_id", "entity_id", "weight", "name")


@query("tsv_round_trip", "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer")
def tsv_round_trip(spark, sf):
    path = shared(spark, "tsv")
    scans.write_tsv(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), path)
    return scans.table(spark, path).drop("line_no")


@query("scan_keyed", f"SELECT p_partkey, p_name, {r('p_retailprice', 'p_retailprice')} FROM part")
def scan_keyed(spark, sf):
    return scans.require_unique(table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice"), ["p_partkey"])


@query("scan_set_betas", with_("bin", "n", "y1", extra=marginal_sql("bin", "y1")) +
       f"SELECT set_id, trait, {r('beta_tilde', 'beta_tilde')}, {r('coalesce(s_acctbal / 1e4, 0)', 'beta')} FROM st LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = set_id")
def scan_set_betas(spark, sf):
    stats = marginal_linear(binary(spark, sf), evidence_y(spark, sf), n_entities(spark, sf)).select("set_id", "trait", "beta_tilde")
    betas = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("set_id"), (F.col("s_acctbal") / 1e4).alias("beta"))
    return scans.apply_set_betas(stats, betas)


@query("semi_reduce", "SELECT DISTINCT l_suppkey AS set_id, l_partkey AS entity_id, 1.0::DOUBLE AS weight FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def semi_reduce(spark, sf):
    stats = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("set_id"))
    return scans.only_listed_sets(binary(spark, sf), stats)
