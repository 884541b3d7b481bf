"""Readers of the text inputs, split into a scan and a parse of lines so that any line source can be parsed.

A text file has no order after a shuffle: ``lines`` and ``table`` number the rows of all files in turn, and every first-wins / last-wins rule
names that number.
Parsers turn rows that cannot be used into no row; they never guess.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evisets.functions.scalar import BACKGROUND, background_log_odds, clean_chrom, complete_p_beta_se

MISSING = "NA"


def files_of(spark: SparkSession, paths: list[str]) -> list[str]:
    """Files that the paths, folders and patterns name, in the order named; each once."""
    return list(dict.fromkeys(f for p in paths for f in sorted(spark.read.text(p).inputFiles())))


def numbered(df: DataFrame, files: list[str]) -> DataFrame:
    """A scan of files with path and line_no: consecutive numbers in the order of ``files``, however the scan was split or packed.

    A row's number is that of its split plus its place in the split. Splits are counted first; they are as few as the scan's blocks.
    """
    spark = df.sparkSession
    own = df.columns
    df = df.select("*", F.input_file_name().alias("path"), F.input_file_block_start().alias("_start"), F.monotonically_increasing_id().alias("_id"))
    splits = df.groupBy("path", "_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    order = spark.createDataFrame(list(enumerate(files)), "_file long, path string")
    sizes = splits.groupBy("path").agg(F.sum("_n").alias("_size")).join(order, "path")
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("path", before(Window.partitionBy(F.lit(0)).orderBy("_file"), "_size").alias("_before"))  # a row per file
    splits = splits.withColumn("_in", before(Window.partitionBy("path").orderBy("_start"), "_n")).join(sizes, "path")
    splits = splits.select("path", "_start", (F.col("_before") + F.col("_in") - F.col("_first")).alias("_shift"))
    return df.join(splits, ["path", "_start"]).select(*own, "path", (F.col("_id") + F.col("_shift")).alias("line_no"))


def lines(spark: SparkSession, paths) -> DataFrame:
    """(line_no, value, path) of text files; gzip and directories work as in any Spark text scan."""
    files = files_of(spark, paths if isinstance(paths, list) else [paths])
    return numbered(spark.read.text(files), files).select("line_no", "value", "path")


def table(spark: SparkSession, path, header: bool = True, sep: str = "\t") -> DataFrame:
    """Delimited table, all strings, with a line number."""
    files = files_of(spark, path if isinstance(path, list) else [path])
    df = spark.read.csv(files, sep=sep, header=header, quote="", mode="PERMISSIVE", nullValue=MISSING)
    return numbered(df, files).drop("path")


def pick(df: DataFrame, col) -> Column:
    """Column by name or 1-based position."""
    if isinstance(col, int):
        return F.col(f"`{df.columns[col - 1]}`")
    if col not in df.columns:
        raise ValueError(f"column {col!r} not in {df.columns}")
    return F.col(f"`{col}`")


def number(c: Column) -> Column:
    """Double, or null where the token is not a number."""
    return c.try_cast("double")


def parse_set_lines(text: DataFrame, only_ids: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines ``set_id member member:weight ...`` -> membership(set_id, entity_id, weight, line_no).

    Members are de-duplicated within a line, a weight defaults to 1, unparsable weights and NA members are skipped, lines with
    fewer than two tokens too. The first line of a set id wins. ``only_ids`` keeps the requested sets before the explode; columns ``keep``
    of the lines go along.
    """
    tok = F.split(F.trim("value"), r"\s+")
    split = text.select("line_no", *keep, tok[0].alias("set_id"), F.slice(tok, 2, F.greatest(F.size(tok) - 1, F.lit(0))).alias("_m"), F.size(tok).alias("_k"))
    good = split.where("_k >= 2 and set_id <> ''")
    if only_ids is not None:
        good = good.join(only_ids.select("set_id").distinct(), "set_id", "left_semi")
    first = good.groupBy("set_id").agg(F.min("line_no").alias("line_no"))
    chosen = good.join(first, ["set_id", "line_no"], "left_semi")
    one = chosen.select("set_id", "line_no", *keep, F.explode(F.array_distinct("_m")).alias("_t"))
    part = F.split("_t", ":")
    weight = F.when(F.size(part) > 1, number(part[1])).otherwise(F.lit(1.0))
    parsed = one.select("set_id", "line_no", *keep, part[0].alias("entity_id"), weight.alias("weight")).where(
        (F.col("entity_id") != MISSING) & F.col("weight").isNotNull() & ~F.isnan("weight") & (F.col("weight") != 0))
    # the same member with two different weights in a line: the larger weight stays
    return parsed.groupBy("set_id", "line_no", "entity_id", *keep).agg(F.max("weight").alias("weight"))


def read_set_lists(spark: SparkSession, paths, only_ids: DataFrame | None = None) -> DataFrame:
    return parse_set_lines(lines(spark, paths), only_ids)


def parse_dense(df: DataFrame, id_col, only: list[str] | None = None, prefix: str | None = None) -> DataFrame:
    """Wide annotation table -> (entity_id, name, value); the first row of an entity wins. ``only`` prunes columns at the scan."""
    ident = pick(df, id_col)
    skip = {"line_no", "path", df.columns[id_col - 1] if isinstance(id_col, int) else id_col}
    names = [c for c in df.columns if c not in skip and (only is None or c in only)]
    wide = df.select(ident.alias("entity_id"), "line_no", *[number(F.col(f"`{c}`")).alias(c) for c in names])
    first = wide.groupBy("entity_id").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in names]), "line_no").alias("_r")).select("entity_id", "_r.*")
    tall = first.unpivot("entity_id", [F.col(f"`{c}`") for c in names], "name", "value")
    if prefix:
        tall = tall.withColumn("name", F.concat(F.lit(prefix + "_"), "name"))
    return tall.where("value is not null")


def read_dense_annotations(spark: SparkSession, path, id_col=1, only: list[str] | None = None) -> DataFrame:
    return parse_dense(table(spark, path), id_col, only)


def plan_inputs(specs: list[str], dense: bool = False) -> list[dict]:
    """``label:path@batch`` specs -> rows (path, label, batch, is_dense); a batch-less input gets its own batch."""
    from evisets.operators.sets import assign_batches

    parsed = []
    for spec in specs:
        body, _, batch = spec.rpartition("@") if "@" in spec else (spec, "", None)
        label, sep, path = body.partition(":")
        parsed.append((path if sep else body, label if sep else None, batch))
    batches = assign_batches([(p, b) for p, _, b in parsed])
    return [{"path": p, "label": lab, "batch": b, "is_dense": dense} for (p, lab, _), (_, b) in zip(parsed, batches)]


def expand_lists(spark: SparkSession, list_paths: list[str]) -> list[str]:
    """Specs named in list files, one per line, all of them. A list file names input files, whose listing the driver holds anyway."""
    rows = lines(spark, list_paths).where(F.trim("value") != "").orderBy("line_no").collect()
    return [r["value"].strip() for r in rows]


def parse_input_specs(specs: DataFrame) -> DataFrame:
    """The same as ``plan_inputs`` over a table of spec strings: (spec) -> (path, label, batch)."""
    s = F.col("spec")
    body = F.regexp_replace(s, "@[^@]*$", "")
    batch = F.regexp_extract(s, "@([^@]*)$", 1)
    label = F.regexp_extract(body, "^([^:]*):", 1)
    return specs.select("spec", F.regexp_replace(body, "^[^:]*:", "").alias("path"), F.nullif(label, F.lit("")).alias("label"),
                        F.nullif(batch, F.lit("")).alias("batch"))


def parse_inputs(text: DataFrame, files: DataFrame, only_ids: DataFrame | None = None) -> DataFrame:
    """Set lines of many files -> membership with label and batch of the file; a label prefixes the set id.

    text(line_no, value, path) and files(path, label, batch) meet by equal path; a file named twice is parsed for both.
    """
    tagged = text.join(files.select("path", "label", "batch"), "path")
    tagged = tagged.withColumn("value", F.when(F.col("label").isNotNull(), F.concat("label", F.lit("_"), F.ltrim("value"))).otherwise(F.col("value")))
    return parse_set_lines(tagged, only_ids, ("label", "batch"))


def read_inputs(spark: SparkSession, specs: list[str], only_ids: DataFrame | None = None) -> DataFrame:
    """Union of several set lists with label (prefixes the set id) and batch, from one multi-file scan."""
    plan = plan_inputs(specs)
    rows = [(f, p["label"], p["batch"]) for p in plan for f in files_of(spark, [p["path"]])]
    return parse_inputs(lines(spark, [p["path"] for p in plan]), spark.createDataFrame(rows, "path string, label string, batch string"), only_ids)


def parse_entity_stats(df: DataFrame, id_col, log_bf_col=None, prob_col=None, combined_col=None, prior_col=None,
                       background: float = BACKGROUND) -> DataFrame:
    """Entity statistics: log_bf given, or from a probability in (0, 1); the last row of an entity wins."""
    if (log_bf_col is None) == (prob_col is None):
        raise ValueError("give exactly one of log_bf_col, prob_col")
    if log_bf_col is not None:
        value = number(pick(df, log_bf_col))
    else:
        p = number(pick(df, prob_col))
        value = F.when((p > 0) & (p < 1), F.log(p / (F.lit(1.0) - p)) - F.lit(background_log_odds(background)))
    extra = {"combined": combined_col, "prior": prior_col}
    cols = [value.alias("log_bf"), *[number(pick(df, c)).alias(n) for n, c in extra.items() if c is not None]]
    rows = df.select(pick(df, id_col).alias("entity_id"), "line_no", *cols).where("log_bf is not null")
    names = ["log_bf", *[n for n, c in extra.items() if c is not None]]
    return rows.groupBy("entity_id").agg(F.max_by(F.struct(*names), "line_no").alias("_r")).select("entity_id", "_r.*")


def parse_set_stats(df: DataFrame, id_col, beta_col=None, exp_beta_col=None, p_col=None, se_col=None, beta_joint_col=None,
                    beta_uncorrected_col=None, max_p: float | None = None, min_beta: float | None = None,
                    min_beta_uncorrected: float | None = None) -> DataFrame:
    """Set statistics with completed p / se / z and thresholds; the first row of a set wins."""
    beta = number(pick(df, beta_col)) if beta_col is not None else None
    if exp_beta_col is not None:
        e = number(pick(df, exp_beta_col))
        beta = F.when(e > 0, F.log(e))
    null = F.lit(None).cast("double")
    get = lambda c: number(pick(df, c)) if c is not None else null
    rows = df.select(pick(df, id_col).alias("set_id"), "line_no", (beta if beta is not None else null).alias("beta_tilde"),
                     get(p_col).alias("p"), get(se_col).alias("se"), get(beta_joint_col).alias("beta"),
                     get(beta_uncorrected_col).alias("beta_uncorrected"))
    known = rows.where("beta_tilde is not null or p is not null or se is not null or beta is not null or beta_uncorrected is not null")
    cols = ["beta_tilde", "p", "se", "beta", "beta_uncorrected"]
    first = known.groupBy("set_id").agg(F.min_by(F.struct(*cols), "line_no").alias("_r")).select("set_id", "_r.*")
    full = complete_p_beta_se(first, "p", "beta_tilde", "se").withColumn(
        "z", F.when(F.col("se") > 0, F.col("beta_tilde") / F.col("se")).otherwise(F.lit(0.0)))
    for limit, cond in ((max_p, F.col("p") <= max_p if max_p is not None else None),
                        (min_beta, F.col("beta") >= min_beta if min_beta is not None else None),
                        (min_beta_uncorrected, F.col("beta_uncorrected") >= min_beta_uncorrected if min_beta_uncorrected is not None else None)):
        if limit is not None:
            full = full.where(cond)
    return full


def parse_entity_trait(df: DataFrame, id_col, trait_col, log_bf_col=None, combined_col=None, prior_col=None, min_value: float | None = 1.0,
                       id_map: DataFrame | None = None) -> DataFrame:
    """Entity x trait evidence: minimum on combined, else log_bf, else prior; ids may map to several; first duplicate wins."""
    given = {n: c for n, c in (("log_bf", log_bf_col), ("combined", combined_col), ("prior", prior_col)) if c is not None}
    if not given:
        raise ValueError("need at least one value column")
    rows = df.select(pick(df, id_col).alias("entity_id"), pick(df, trait_col).alias("trait"), "line_no",
                     *[number(pick(df, c)).alias(n) for n, c in given.items()])
    if min_value is not None:
        gate = next(n for n in ("combined", "log_bf", "prior") if n in given)
        rows = rows.where(F.col(gate) >= min_value)
    if id_map is not None:
        m = id_map.select(F.col("old_id").alias("entity_id"), "new_id")
        rows = rows.join(m, "entity_id").drop("entity_id").withColumnRenamed("new_id", "entity_id")
    rows = rows.where("entity_id is not null and trait is not null")
    return rows.groupBy("entity_id", "trait").agg(F.min_by(F.struct(*given), "line_no").alias("_r")).select("entity_id", "trait", "_r.*")


def parse_set_trait(df: DataFrame, set_col, trait_col, beta_col=None, beta_uncorrected_col=None, min_beta_uncorrected: float | None = None,
                    traits: DataFrame | None = None) -> DataFrame:
    """Set x trait effects, optionally for some traits only; first duplicate wins."""
    null = F.lit(None).cast("double")
    get = lambda c: number(pick(df, c)) if c is not None else null
    rows = df.select(pick(df, set_col).alias("set_id"), pick(df, trait_col).alias("trait"), "line_no", get(beta_col).alias("beta"),
                     get(beta_uncorrected_col).alias("beta_uncorrected")).where("beta is not null or beta_uncorrected is not null")
    if min_beta_uncorrected is not None:
        rows = rows.where(F.coalesce("beta_uncorrected", "beta") >= min_beta_uncorrected)
    if traits is not None:
        rows = rows.join(traits.select("trait").distinct(), "trait", "left_semi")
    return rows.groupBy("set_id", "trait").agg(F.min_by(F.struct("beta", "beta_uncorrected"), "line_no").alias("_r")).select(
        "set_id", "trait", "_r.*")


def set_ids(set_trait: DataFrame) -> DataFrame:
    """Ids-only variant of the set x trait scan."""
    return set_trait.select("set_id").distinct()


def parse_covariates(df: DataFrame, id_col, cols: list[str]) -> DataFrame:
    """Wide numeric covariates; first row of an entity wins."""
    rows = df.select(pick(df, id_col).alias("entity_id"), "line_no", *[number(F.col(f"`{c}`")).alias(c) for c in cols])
    return rows.groupBy("entity_id").agg(F.min_by(F.struct(*cols), "line_no").alias("_r")).select("entity_id", "_r.*")


def parse_universe(df: DataFrame, id_col) -> DataFrame:
    """Distinct ids with the line of their first appearance (keeps the file's order as data)."""
    rows = df.select(pick(df, id_col).cast("string").alias("entity_id"), "line_no").where("entity_id is not null and entity_id <> ''")
    return rows.groupBy("entity_id").agg(F.min("line_no").alias("line_no"))


def parse_id_map(df: DataFrame, old_col, new_col, multi: bool = False) -> DataFrame:
    """map(old_id, new_id): the last line wins, or every distinct target in the multi form."""
    rows = df.select(pick(df, old_col).alias("old_id"), pick(df, new_col).alias("new_id"), "line_no").where("old_id is not null and new_id is not null")
    if multi:
        return rows.select("old_id", "new_id").distinct()
    return rows.groupBy("old_id").agg(F.max_by("new_id", "line_no").alias("new_id"))


def parse_location_lines(text: DataFrame, id_map: DataFrame | None = None, hold_out: str | None = None, max_shift: float = 1e7) -> DataFrame:
    """Six whitespace columns (id chrom start end strand name) -> intervals(entity_id, chrom, start_pos, end_pos).

    A name on a second chromosome, or more than 10 Mb from its first place, keeps only the rows that agree with the first.
    """
    t = F.split(F.trim("value"), r"\s+")
    rows = text.where(F.size(t) == 6).select(
        "line_no", t[5].alias("entity_id"), clean_chrom(t[1]).alias("chrom"), t[2].try_cast("long").alias("start_pos"),
        t[3].try_cast("long").alias("end_pos")).where("start_pos is not null and end_pos is not null")
    if hold_out is not None:
        rows = rows.where(F.col("chrom") != hold_out)
    if id_map is not None:
        from evisets.operators.align import map_ids

        rows = map_ids(rows, id_map)
    first = rows.groupBy("entity_id").agg(F.min_by(F.struct("chrom", "start_pos", "end_pos"), "line_no").alias("_f"))
    near = F.abs((F.col("start_pos") + F.col("end_pos")) / 2 - (F.col("_f.start_pos") + F.col("_f.end_pos")) / 2) <= max_shift
    kept = rows.join(first, "entity_id").where((F.col("chrom") == F.col("_f.chrom")) & near)
    return kept.select("entity_id", "chrom", F.least("start_pos", "end_pos").alias("start_pos"), F.greatest("start_pos", "end_pos").alias("end_pos"))


def read_intervals(spark: SparkSession, path, **options) -> DataFrame:
    return parse_location_lines(lines(spark, path), **options)


def interval_points(intervals: DataFrame, step: int = 1_000_000) -> DataFrame:
    """Start, end and, inside long intervals, a point every ``step``."""
    inner = F.when(F.col("end_pos") > F.col("start_pos"), F.sequence("start_pos", F.col("end_pos") - 1, F.lit(step).cast("long"))).otherwise(
        F.array().cast("array<bigint>"))
    return intervals.select("entity_id", "chrom", F.explode(F.array_distinct(F.concat(F.array("start_pos", "end_pos"), inner))).alias("pos")).distinct()


def load_locus_frames(spark: SparkSession, gene_path, exon_path) -> tuple[DataFrame, DataFrame]:
    """(entity intervals, exon intervals): the same scan twice."""
    return read_intervals(spark, gene_path), read_intervals(spark, exon_path)


def parse_entity_list(df: DataFrame, id_col=1, inline: list[str] | None = None) -> DataFrame:
    """Listed ids plus inline ids, distinct; a header row that names the column is not an id."""
    ids = df.select(F.trim(pick(df, id_col).cast("string")).alias("entity_id"), "line_no").where("entity_id is not null and entity_id <> ''")
    ids = ids.where(~((F.col("line_no") == 0) & F.lower("entity_id").isin("gene", "genes", "gene_id", "entity_id", "id")))
    out = ids.groupBy("entity_id").agg(F.min("line_no").alias("line_no"))
    if inline:
        extra = df.sparkSession.createDataFrame([(x, -len(inline) + i) for i, x in enumerate(dict.fromkeys(inline))], "entity_id string, line_no long")
        out = extra.unionByName(out).groupBy("entity_id").agg(F.min("line_no").alias("line_no"))
    return out


def parse_counts(case: DataFrame, control: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Case and control count tables -> counts(entity_id, arm, score, count, total, max_freq)."""
    def one(df, arm):
        return df.select(pick(df, cols["entity_id"]).alias("entity_id"), F.lit(arm).alias("arm"),
                         *[number(pick(df, cols[c])).alias(c) for c in ("score", "count", "total", "max_freq")])
    return one(case, "case").unionByName(one(control, "control")).where("entity_id is not null and count is not null and total is not null")


def parse_corr_lines(text: DataFrame, first_value: int = 10, id_pos: int = 1) -> DataFrame:
    """Ragged correlation lines -> edges(entity_a, entity_b, r), both directions.

    Line i holds, from position ``first_value`` on, the correlations of its entity with the preceding entities, nearest last. Lines
    must carry consecutive line numbers.
    """
    t = F.split(F.trim("value"), r"\s+")
    rows = text.select("line_no", t[id_pos - 1].alias("entity_a"), F.slice(t, first_value, F.greatest(F.size(t) - first_value + 1, F.lit(0))).alias("_v"))
    back = rows.select("line_no", "entity_a", F.posexplode(F.reverse("_v")).alias("_k", "_r"))
    edge = back.select("entity_a", (F.col("line_no") - F.col("_k") - 1).alias("line_b"), number(F.col("_r")).alias("r")).where("r is not null")
    names = rows.select(F.col("line_no").alias("line_b"), F.col("entity_a").alias("entity_b"))
    one = edge.join(names, "line_b").select("entity_a", "entity_b", "r")
    return one.unionByName(one.select(F.col("entity_b").alias("entity_a"), F.col("entity_a").alias("entity_b"), "r"))


def parse_loadings(df: DataFrame, key_col, axis: str) -> DataFrame:
    """Saved wide loadings (FactorN columns) -> loadings(axis, key, factor, value); a repeated key is an error."""
    cols = [c for c in df.columns if c.startswith("Factor") and c[6:].isdigit()]
    rows = df.select(pick(df, key_col).cast("string").alias("key"), *[number(F.col(f"`{c}`")).alias(c) for c in cols])
    require_unique(rows, ["key"])
    tall = rows.unpivot("key", cols, "factor", "value")
    return tall.select(F.lit(axis).alias("axis"), "key", F.regexp_replace("factor", "^Factor", "").cast("int").alias("factor"),
                       F.coalesce("value", F.lit(0.0)).alias("value"))


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The table itself, or an error that shows repeated keys."""
    bad = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").limit(5).collect()
    if bad:
        raise ValueError(f"duplicate keys: {[tuple(r[k] for k in keys) for r in bad]}")
    return df


def read_keyed(spark: SparkSession, path, key: str, required: list[str] | None = None) -> DataFrame:
    """Keyed table with required columns and a unique key."""
    df = table(spark, path)
    missing = [c for c in [key, *(required or [])] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return require_unique(df, [key])


def apply_set_betas(stats: DataFrame, betas: DataFrame) -> DataFrame:
    """Precomputed joint effects replace the joint stage; sets without one get 0."""
    return stats.join(betas.select("set_id", F.col("beta").cast("double").alias("beta")), "set_id", "left").fillna(0.0, ["beta"])


def only_listed_sets(membership: DataFrame, set_stats: DataFrame) -> DataFrame:
    """Membership of sets that appear in the statistics; on Parquet the semi-join reaches the scan as a runtime filter."""
    return membership.join(set_stats.select("set_id").distinct(), "set_id", "left_semi")


def save_tables(tables: dict[str, DataFrame], path: str, partition_by: dict[str, list[str]] | None = None) -> None:
    """One Parquet dataset per table (locus cache, hand-off to the factor layer)."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        cols = (partition_by or {}).get(name)
        (w.partitionBy(*cols) if cols else w).parquet(f"{path.rstrip('/')}/{name}")


def load_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in names}


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text with header, gzip parts."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True, compression="gzip", nullValue=MISSING)
