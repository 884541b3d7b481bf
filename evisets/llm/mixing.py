"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations only.

Leaves are (domain, language, source). Weights say how a node's tokens are divided among its children. A node can take what its leaves hold times the
allowed epochs. From the root down each node's budget is filled into its children in proportion to their weights; what a full child can't take goes
to its siblings, and a node gets more than it can hold only if all its siblings are full, so ancestors share a shortage last. A leaf takes whole
seeded epochs and then, in the seeded order of the next one, documents until its budget ends.

That order is found without sorting a leaf: documents are counted in narrow ranges of their order key, running sums over the ranges find the one
range in which the budget ends, and only its documents are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evisets.llm.common import WORD, stored

LEVELS = ("domain", "lang", "source")
EPOCHS, SEED = 4, 17
RANGE_DIGITS = 4  # hex digits of the order key that name a range


def tokens_of(text: str) -> Column:
    """Words of a text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def order_key(doc_id: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def budgets(leaves: DataFrame, weights: dict[str, DataFrame], target: Column, epochs: int = EPOCHS) -> DataFrame:
    """Token budget of each leaf. ``leaves``: LEVELS and tokens, a row each. ``weights``: per level a table of the level's name and weight; missing
    names weigh 1, negative and null weights 0. ``target`` is an aggregate over the leaves, such as a literal or a share of sum(tokens).

    Budgets are whole tokens, at most tokens times ``epochs``; a weight of 0 gives nothing, in a node whose children all weigh 0 too. A target
    above what all leaves can take gives each leaf all it can take.
    """
    tree = leaves.select(*LEVELS, "tokens")
    for level in LEVELS:
        w = weights.get(level)
        if w is not None:
            w = w.groupBy(F.col(level).alias("_name")).agg(F.max("weight").alias("_weight")).withColumn("_known", F.lit(True))
            tree = tree.join(w, F.col(level) == F.col("_name"), "left").withColumn(
                f"{level}_weight", F.when(F.col("_known"), F.greatest(F.coalesce("_weight", F.lit(0.0)), F.lit(0.0))).otherwise(1.0)).drop("_name", "_weight", "_known")
        else:
            tree = tree.withColumn(f"{level}_weight", F.lit(1.0))
    # what a node can hold: children of weight 0 hold nothing
    room = F.when(F.col("source_weight") > 0, F.col("tokens") * epochs).otherwise(0)
    nodes = {"source": tree.withColumn("room", room)}
    for i in (1, 0):
        level, w = LEVELS[i], f"{LEVELS[i]}_weight"
        nodes[level] = nodes[LEVELS[i + 1]].groupBy(*LEVELS[: i + 1]).agg(*[F.first(f"{x}_weight").alias(f"{x}_weight") for x in LEVELS[: i + 1]], F.sum("room").alias("held")).withColumn(
            "room", F.when(F.col(w) > 0, F.col("held")).otherwise(0)).drop("held")
    up = nodes["domain"].agg(F.sum("room").alias("room")).join(leaves.agg(target.alias("target")), F.lit(True), "left")
    given = up.select(F.least(F.col("room").cast("double"), F.col("target").cast("double")).alias("given"))
    for i, level in enumerate(LEVELS):
        parent, w = LEVELS[:i], f"{level}_weight"
        child = nodes[level].join(given, [*parent]) if parent else nodes[level].join(F.broadcast(given), F.lit(True))
        by = Window.partitionBy(*(parent or [F.lit(0)])).orderBy("ratio", *LEVELS[: i + 1])
        child = child.withColumn("ratio", F.when(F.col(w) > 0, F.col("room") / F.col(w)).otherwise(F.lit(float("inf"))))
        before = F.coalesce(F.sum("room").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        onward = F.sum(w).over(by.rowsBetween(0, Window.unboundedFollowing))
        # children fill up in order of room by weight; the first that doesn't sets what a unit of weight gets
        child = child.withColumn("unit", F.when(onward > 0, (F.col("given") - before) / F.greatest(onward, F.lit(1e-300))).otherwise(0.0))
        child = child.withColumn("full", F.col("ratio") <= F.col("unit"))
        rest = F.min(F.when(~F.col("full"), F.struct("ratio", *LEVELS[: i + 1], "unit"))).over(Window.partitionBy(*(parent or [F.lit(0)])))
        child = child.withColumn("rest", rest["unit"])
        child = child.withColumn("given", F.when(F.col("full"), F.col("room").cast("double")).otherwise(F.greatest(F.col("rest"), F.lit(0.0)) * F.col(w)))
        given = child.select(*LEVELS[: i + 1], "given", *(["tokens"] if level == "source" else []))
    return given.select(*LEVELS, "tokens", F.least(F.floor(F.col("given") + 1e-6), F.col("tokens") * epochs).cast("long").alias("budget"))


def mix(docs: DataFrame, weights: dict[str, DataFrame], target: Column, domain: Column | None = None, epochs: int = EPOCHS, seed: int = SEED, text: str = "text") -> DataFrame:
    """``docs`` and, per row: _domain, _tokens, _copies (epochs that take it) and _taken (its tokens in the mix).

    A row is taken by every whole epoch of its leaf and by the last, partial one if it begins before the budget ends; there only the tokens up to
    the budget count as taken, while its text stays whole. A null domain, language or source is the name ''. Rows without tokens go along where
    they begin within the budget. Rows with one doc_id have one place in the order, the shorter first. An empty table gives an empty one;
    columns of ``docs`` with these names are replaced. The tree has a row per leaf; it is joined by its size.
    """
    own = docs.columns
    df = docs.withColumn("_domain", F.coalesce(domain if domain is not None else F.lit(""), F.lit("")))
    df = df.withColumn("_mix_lang", F.coalesce(F.col("lang").cast("string"), F.lit(""))).withColumn("_mix_source", F.coalesce(F.col("source").cast("string"), F.lit("")))
    df = df.withColumn("_tokens", tokens_of(text))
    narrow = stored(df.select("doc_id", F.col("_domain").alias("domain"), F.col("_mix_lang").alias("lang"), F.col("_mix_source").alias("source"), F.col("_tokens").alias("tokens")), "mix-tokens")
    leaves = stored(narrow.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "mix-leaves")
    plan = budgets(leaves, weights, target, epochs)
    plan = stored(plan.withColumn("whole", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).cast("int")).withColumn(
        "left", F.col("budget") - F.col("whole") * F.col("tokens")), "mix-plan")
    small = plan.count() <= 100_000  # a row is a few names and numbers: some MB at most
    held = F.broadcast(plan) if small else plan
    keyed = narrow.join(held.drop("tokens"), [*LEVELS]).withColumn("key", order_key(F.col("doc_id"), F.col("whole"), seed)).withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    sums = keyed.groupBy(*LEVELS, "range").agg(F.sum("tokens").alias("n"), F.first("left").alias("left"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # ranges that begin within the budget; the last of them may reach over its end
    inside = sums.withColumn("start", before).where(F.col("start") < F.col("left"))
    edge = inside.groupBy(*LEVELS).agg(F.max(F.struct("range", "start")).alias("edge")).select(*LEVELS, "edge.range", "edge.start")
    ordered = Window.partitionBy(*LEVELS).orderBy("key", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    last = keyed.join(edge, [*LEVELS, "range"]).withColumn("begin", F.col("start") + F.coalesce(F.sum("tokens").over(ordered), F.lit(0)))
    last = last.groupBy(*LEVELS).agg(F.max(F.when(F.col("begin") < F.col("left"), F.struct("key", "tokens", "begin"))).alias("stop"))
    ends = stored(plan.join(last, [*LEVELS], "left").select(F.col("domain").alias("_mix_d"), F.col("lang").alias("_mix_l"), F.col("source").alias("_mix_s"), F.col("whole").alias("_mix_whole"),
                                                           F.col("left").alias("_mix_left"), F.col("stop").alias("_mix_stop")), "mix-ends")
    ends = F.broadcast(ends) if small else ends
    df = df.join(ends, (F.col("_domain") == F.col("_mix_d")) & (F.col("_mix_lang") == F.col("_mix_l")) & (F.col("_mix_source") == F.col("_mix_s")))
    place = F.struct(order_key(F.col("doc_id"), F.col("_mix_whole"), seed).alias("key"), F.col("_tokens").alias("tokens"))
    stop = F.struct(F.col("_mix_stop.key").alias("key"), F.col("_mix_stop.tokens").alias("tokens"))
    df = df.withColumn("_mix_more", F.when(F.col("_mix_stop").isNotNull() & (place <= stop), F.when(place == stop, F.least(F.col("_tokens"), F.col("_mix_left") - F.col("_mix_stop.begin"))).otherwise(F.col("_tokens"))))
    df = df.withColumn("_copies", F.col("_mix_whole") + F.col("_mix_more").isNotNull().cast("int")).withColumn("_taken", F.col("_mix_whole") * F.col("_tokens") + F.coalesce("_mix_more", F.lit(0)))
    return df.select(*[c for c in own if c not in ("_domain", "_tokens", "_copies", "_taken")], "_domain", "_tokens", "_copies", "_taken")


def mixed(docs: DataFrame, *args, **kwargs) -> DataFrame:
    """The rows of ``docs`` as ``mix`` selects them, each as often as epochs take it, with the columns of ``docs``."""
    return mix(docs, *args, **kwargs).withColumn("_copy", F.explode(F.expr("if(_copies > 0, sequence(1, _copies), cast(array() as array<int>))"))).select(docs.columns)
