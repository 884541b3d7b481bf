"""The queries of this subpackage on the given tables, with SQL where one can be written."""

from __future__ import annotations

from pyspark.sql import functions as F

from evisets.llm import bpe, ctw, decision_list, langid, lloyd, mixing, ordinal, pii, simhash, topk, vamana, variants, warc
from evisets.llm.common import remainder, stored, table

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op4_bpe_prefix_dp")
def op4(spark, sf):
    e = bpe.encode(table(spark, sf, "documents"), word_vocabulary())
    return e.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query("op10_simhash_gray_index")
def op10(spark, sf):
    d = simhash.near_duplicates(table(spark, sf, "documents"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op6_language_viterbi")
def op6(spark, sf):
    docs = table(spark, sf, "documents").withColumn("held_out", remainder(F.col("doc_id"), 3) == 1)
    model = langid.fit(docs.where("not held_out"))
    p = langid.predict(docs, model)
    return p.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "spans")


@query("op3_pii_bootstrap")
def op3(spark, sf):
    s = pii.spans(table(spark, sf, "documents"))
    counts = [F.expr(f"bigint(size(filter(base, x -> x.kind = '{k}')))").alias(f"n_{k}") for k in pii.KINDS]
    return s.select("doc_id", *counts, F.sha2(F.encode(pii.joined("base"), "UTF-8"), 256).alias("base_sha256"),
                    pii.joined("concat(base, added)").alias("spans"), F.size("added").cast("long").alias("n_added"))


@query("op1_context_tree_weighting")
def op1(spark, sf):
    s = ctw.score(table(spark, sf, "documents"), remainder(F.col("doc_id"), 10) != 0, files=True)
    return s.select("doc_id", (~F.col("learns")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


@query("op9_warc_capture_index", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM s WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM s LEFT JOIN f USING (payload_digest)""")
def op9(spark, sf):
    return warc.archived(table(spark, sf, "pages"))


@query("op8_vamana_graph")
def op8(spark, sf):
    e = table(spark, sf, "embeddings")
    return vamana.nearest(e, e.where("vec_id % 20 = 0"))


@query("op5_decision_list")
def op5(spark, sf):
    m = stored(decision_list.measure(table(spark, sf, "documents")), "quality-counts")
    rules = decision_list.fit(m, table(spark, sf, "labels"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                    F.when(failed, False).otherwise(decision_list.verdict(rules)).alias("kept"))


@query("op7_toxicity_ordinal")
def op7(spark, sf):
    docs = table(spark, sf, "documents")
    return ordinal.predict(docs, ordinal.fit(docs, table(spark, sf, "labels")))


DOMAIN = "CASE WHEN try_cast(substring(source, 4) AS int) < 8 THEN 'web' WHEN try_cast(substring(source, 4) AS int) < 14 THEN 'books' ELSE 'code' END"
WEIGHTS = {"domain": {"web": 5.0, "books": 3.0, "code": 2.0}, "lang": {"en": 6.0, "de": 2.0, "fr": 2.0, "es": 1.0}}


def mixture(spark):
    """Arguments of the mixer: weights per level, all tokens as target, the domain of a source."""
    values = lambda level, names: ", ".join(f"('{k}', {v}d)" for k, v in names.items())
    weights = {level: spark.sql(f"SELECT * FROM VALUES {values(level, names)} AS t({level}, weight)") for level, names in WEIGHTS.items()}
    return weights, F.sum("tokens"), F.expr(DOMAIN)


def fill_sql(i: int, child: str, given: str) -> str:
    """SQL of one level of the budget tree: children fill in order of room by weight."""
    keys, parent, w = ", ".join(mixing.LEVELS[: i + 1]), ", ".join(mixing.LEVELS[:i]), f"{mixing.LEVELS[i]}_weight"
    over = f"PARTITION BY {parent}" if parent else ""
    return f"""(WITH a AS (SELECT c.*, g.given AS whole_given, room / {w} AS ratio FROM {child} c JOIN {given} g {f'USING ({parent})' if parent else 'ON true'}),
b AS (SELECT *, (whole_given - coalesce(sum(room) OVER ({over} ORDER BY ratio, {keys} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum({w}) OVER ({over} ORDER BY ratio, {keys} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit FROM a),
d AS (SELECT *, min(CASE WHEN ratio > unit THEN struct_pack(ratio, {', '.join(f'{k} := {k}' for k in mixing.LEVELS[: i + 1])}, unit) END) OVER ({over}) AS rest FROM b)
SELECT {keys}, CASE WHEN ratio <= unit THEN room ELSE greatest(rest.unit, 0) * {w} END AS given{', tokens' if i == 2 else ''} FROM d)""".replace("struct_pack(ratio,", "struct_pack(ratio := ratio,").replace(", unit) END", ", unit := unit) END")


def case_sql(level: str) -> str:
    return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in WEIGHTS.get(level, {"": 1.0}).items()) + " ELSE 1::DOUBLE END"


MIX_SQL = f"""
WITH t AS (SELECT doc_id, {DOMAIN} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM documents),
n2 AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, {mixing.EPOCHS} * sum(tokens)::DOUBLE AS room, 1::DOUBLE AS source_weight FROM t GROUP BY ALL),
n1 AS (SELECT domain, lang, {case_sql('lang')} AS lang_weight, sum(room) AS room FROM n2 GROUP BY ALL),
n0 AS (SELECT domain, {case_sql('domain')} AS domain_weight, sum(room) AS room FROM n1 GROUP BY ALL),
r AS (SELECT least(sum(room), (SELECT sum(tokens) FROM t))::DOUBLE AS given FROM n0),
g0 AS {fill_sql(0, 'n0', 'r')},
g1 AS {fill_sql(1, 'n1', 'g0')},
g2 AS {fill_sql(2, 'n2', 'g1')},
p AS (SELECT domain, lang, source, least(floor(given + 1e-6)::BIGINT, {mixing.EPOCHS} * tokens) AS budget, tokens AS held FROM g2),
q AS (SELECT *, CASE WHEN held > 0 THEN budget // held ELSE 0 END AS whole FROM p),
o AS (SELECT t.*, q.whole, q.budget - q.whole * q.held AS rest, md5(concat('{mixing.SEED}:', q.whole, ':', doc_id)) AS key FROM t JOIN q USING (domain, lang, source)),
s AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM o)
SELECT doc_id, domain, lang, source, tokens, (whole + CASE WHEN begins < rest THEN 1 ELSE 0 END)::INT AS copies,
       (whole * tokens + CASE WHEN begins < rest THEN least(tokens, rest - begins) ELSE 0 END)::BIGINT AS taken
FROM s WHERE whole > 0 OR begins < rest"""


@query("op2_hierarchical_mix", MIX_SQL)
def op2(spark, sf):
    m = mixing.mix(table(spark, sf, "documents"), *mixture(spark))
    names = {"domain": "_domain", "lang": "lang", "source": "source", "tokens": "_tokens", "copies": "_copies", "taken": "_taken"}
    return m.where("_copies > 0").select("doc_id", *(F.col(c).alias(k) for k, c in names.items()))


KEPT = """k AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS (SELECT vec_id, x, unnest(x) AS value, unnest(range(64)) AS pos FROM k),
c0 AS (SELECT cluster, unnest(x) AS value, unnest(range(64)) AS pos FROM (SELECT x, row_number() OVER (ORDER BY h, x) - 1 AS cluster FROM (SELECT x, sha256('2:' || vec_id) AS h FROM k) ORDER BY h, x LIMIT 40))"""


def lloyd_sql(rounds: int) -> str:
    """The rounds unrolled: assignments d_i to the centroids c_i."""
    parts = [KEPT]
    for i in range(rounds + 1):
        parts.append(f"""d{i} AS MATERIALIZED (SELECT vec_id, cluster, distance FROM (SELECT vec_id, cluster, distance, row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) AS i
  FROM (SELECT vec_id, cluster, sum((v.value - c.value) * (v.value - c.value)) AS distance FROM v JOIN c{i} c USING (pos) GROUP BY vec_id, cluster)) WHERE i = 1)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT cluster, pos, coalesce(m, value) AS value FROM c{i} LEFT JOIN (SELECT cluster, pos,
  CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END AS m FROM (SELECT cluster, pos, sum(value)::BIGINT AS s, count(*) AS n FROM v JOIN d{i} USING (vec_id) GROUP BY cluster, pos)) USING (cluster, pos))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, cluster::INT AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM d{rounds} JOIN (SELECT cluster, sha256(string_agg(value::BIGINT::VARCHAR, ',' ORDER BY pos)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster) USING (cluster)"""


@query("op11_lloyd_dimension_shards", lloyd_sql(5))
def op11(spark, sf):
    return lloyd.report(*lloyd.cluster(table(spark, sf, "embeddings")))


@query("op12_spelling_variants")
def op12(spark, sf):
    return variants.group(table(spark, sf, "documents"))


@query("op13_norm_sorted_topk", """
WITH k AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
v AS (SELECT vec_id, unnest(x) AS value, unnest(range(len(x))) AS pos FROM k),
s AS (SELECT q.vec_id AS query_id, v.vec_id, sum(q.value * v.value)::BIGINT AS score FROM v JOIN v q USING (pos) WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id GROUP BY 1, 2)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def op13(spark, sf):
    e = table(spark, sf, "embeddings")
    return topk.top_products(e, e.where("vec_id % 50 = 0"))
