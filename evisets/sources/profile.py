"""Column roles of an unknown statistics table, inferred from header words and the values of the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Header words of each role (lower case, outer underscores and quotes stripped), first choice before second.
HEADER_WORDS = {
    "entity_id": (("gene", "id"), ()),
    "variant_id": (("var", "id", "rs", "varid"), ()),
    "chrom": (("chr", "chrom", "chromosome", "#chrom"), ()),
    "pos": (("pos", "bp", "position", "base_pair_location"), ()),
    "locus": (("variant",), ()),
    "p": (("p-val", "p_val", "pval", "p.value", "p-value", "p_value"), ("p",)),
    "beta": (("beta", "effect"), ()),
    "se": (("se", "std", "stderr", "standard_error"), ()),
    "freq": (("maf", "freq"), ("af", "effect_allele_frequency")),
    "n": (("sample", "neff", "totalsamplesize", "n_samples"), ("n",)),
}
MISSING_TOKENS = ("", ".", "-", "na")


def header_roles(columns: list[str]) -> dict[str, list[str]]:
    """Candidate columns of each role from the header alone."""
    clean = {c: c.lower().strip("_\"'") for c in columns}
    out = {}
    for role, (first, second) in HEADER_WORDS.items():
        found = [c for c in columns if clean[c] in first]
        out[role] = found or [c for c in columns if c.lower() in second]
    return out


def _fits(role: str, token):
    """Predicate: the token may be a value of the role."""
    v, size = token.try_cast("double"), F.length(token)
    num = v.isNotNull()
    whole = num & (v == F.floor(v))
    low = F.lower(token)
    chrom_like = low.rlike("chr|x|y|m")
    return {
        "entity_id": ~num | whole,
        "variant_id": (size >= 4) & low.rlike("chr|:|rs|_|-|var"),
        "chrom": chrom_like | (token.try_cast("int").isNotNull() & token.try_cast("int").between(1, 26)),
        "pos": whole & (size >= 3),
        "locus": chrom_like | ~low.rlike("[:_]") | low.rlike("^([1-9]|1[0-9]|2[0-6])[:_][0-9]+"),
        "p": num & (v >= 0) & (v <= 1),
        "beta": num,
        "se": num & (v >= 0),
        "freq": num & (v >= 0) & (v <= 1),
        "n": num & (v >= 0) & (size >= 3),
    }[role]


def profile_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """profile(column, role, ok): header candidates whose every present value fits, over the whole table.

    One aggregation of bool_and flags per candidate (column, role); nothing is unpivoted or sampled.
    """
    columns = columns or df.columns
    cands = [(c, r) for r, cs in header_roles(columns).items() for c in cs]
    if not cands:
        return df.sparkSession.createDataFrame([], "column string, role string, ok boolean")
    aggs = []
    for i, (c, r) in enumerate(cands):
        tok = F.trim(F.col(f"`{c}`").cast("string"))
        present = tok.isNotNull() & ~F.lower(tok).isin(*MISSING_TOKENS)
        aggs.append(F.coalesce(F.bool_and(F.when(present, F.coalesce(_fits(r, tok), F.lit(False)))), F.lit(True)).alias(f"c{i}"))
    one = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(r).alias("role"), F.col(f"c{i}").alias("ok"))
                               for i, (c, r) in enumerate(cands)]))
    return one.select(rows.alias("_r")).select("_r.*")


def resolve_roles(profile: DataFrame) -> DataFrame:
    """role -> column where exactly one column fits and that column has no other role (a locus column may have one)."""
    good = profile.where("ok")
    # an effect column that also passes as p, se or position is not an effect
    taken = good.where(F.col("role").isin("p", "se", "pos")).select("column").distinct()
    beta = good.where("role = 'beta'").join(taken, "column", "left_anti")
    good = good.where("role <> 'beta'").unionByName(beta.select(*good.columns))
    clash = good.where("role <> 'locus'").groupBy("column").agg(F.count("*").alias("_n")).where("_n > 1")
    left = good.join(clash, "column", "left_anti").unionByName(good.where("role = 'locus'").join(clash, "column", "left_semi").select(*good.columns))
    return left.groupBy("role").agg(F.count("*").alias("_n"), F.min("column").alias("column")).where("_n = 1").select("role", "column")


def resolve_roles_dict(df: DataFrame) -> dict[str, str]:
    """Resolved roles as a dictionary, or an error when the table cannot give p, effect and error."""
    got = {r["role"]: r["column"] for r in resolve_roles(profile_columns(df)).collect()}  # at most ten rows
    if not ({"chrom", "pos"} <= got.keys() or "locus" in got):
        raise ValueError("could not determine chromosome and position columns")
    has = got.keys()
    if not ({"p", "beta"} <= has or ("p" in has and ("se" in has or "n" in has)) or {"beta", "se"} <= has):
        raise ValueError("need p and (effect, error or sample size), or effect and error")
    return got
