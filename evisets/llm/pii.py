"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base matches of four kinds seed the method. The words around a seed are its lexical patterns. Every other identifier-like token, and every run of
digit groups over several tokens, is a candidate for the kinds its characters allow; pattern-instance edges join both. Rounds score a pattern by the share of its distinct instances that are
believed, and an instance by the patterns that point at it (noisy or), until nothing rises; a pattern takes part as soon as enough of its instances
are seeds or believed. Believed candidates become spans; base spans always stay.

The base patterns are written with possessive quantifiers and anchored starts: the same matches as the plain patterns, in linear time and
without deep recursion on endless runs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisets.llm.common import stored

BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: kind: (test that a text may hold one, pattern, test of a match m), in the order of the output.
KINDS = {
    "email": ("instr(text, '@') > 0", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true"),
    "ip": (r"text rlike '[0-9]\\.[0-9]++\\.[0-9]++\\.[0-9]'", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", rf"m rlike '^{BYTE}(?:\\.{BYTE}){{3}}$'"),
    "card": (r"text rlike '[0-9](?:[\\x20-]?[0-9]){12}'", r"[0-9]++(?:[\x20-][0-9]++)*+",
             "length(translate(m, ' -', '')) between 13 and 19 and aggregate(sequence(1, length(translate(m, ' -', ''))), 0, (s, i) -> "
             "s + element_at(array(int(substring(reverse(translate(m, ' -', '')), i, 1)), int(substring('0246813579', int(substring(reverse(translate(m, ' -', '')), i, 1)) + 1, 1))), 2 - i % 2)) % 10 = 0"),
    "phone": (r"text rlike '\\+[0-9]'", r"\+[0-9][\x20().0-9-]+[0-9]", r"length(regexp_replace(m, '[^0-9]', '')) between 9 and 15"),
}
#: A token with a digit or an at sign, as candidate.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Whole tokens of digit groups joined by single blanks, dots, hyphens or brackets, as candidate: the longest run of 7 to 19 digits from its first
#: group on. A dotted quad, as of an address, is no group.
RUN = (r"(?<![^\x20\x09-\x0D])(?![0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.]))[+(]{0,2}[0-9](?:(?:[.-]|\x20?\(|\)[.-]|(?:\)?\x20)(?![0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.]))|\))?[0-9]){6,18}"
       r"(?=[^\x20\x09-\x0D0-9A-Za-z@]*+(?:[\x20\x09-\x0D]|\z))")
#: Which characters a candidate of a kind may consist of.
FITS = {
    "email": r"core rlike '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+$' and length(core) > 4",
    "ip": r"core rlike '^[0-9A-Fa-f]{1,4}(?:[.:]{1,2}[0-9A-Fa-f]{1,4}){3,7}$'",
    "card": r"core rlike '^[ 0-9-]+$' and length(translate(core, ' -', '')) between 12 and 19",
    "phone": r"core rlike '^[ 0-9().+-]+$' and length(regexp_replace(core, '[^0-9]', '')) between 7 and 15",
}
BLOCK = 256
SEEDS, BELIEVE, DAMP, TOL = 3, 0.7, 0.9, 1e-4
STRIDE = 4  # rounds between two looks at how far beliefs moved


def sql_text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def before_each(df: DataFrame, values: str, out: str, zero: str, step: str) -> DataFrame:
    """Add array ``out``: for each entry of the array ``values``, the entries before it folded by ``step`` of s and x.

    Blocks are folded first, then the entries before a block, then those inside it: little more than linear in the array's length.
    """
    fold = f"{zero}, (s, x) -> {step}"
    df = df.withColumn("_v", F.expr(values))
    df = df.withColumn("_b", F.expr(f"transform(sequence(0, (greatest(size(_v), 1) - 1) div {BLOCK}), b -> aggregate(slice(_v, b * {BLOCK} + 1, {BLOCK}), {fold}))"))
    df = df.withColumn("_o", F.expr(f"transform(_b, (y, b) -> aggregate(slice(_b, 1, b), {fold}))"))
    inside = f"transform(slice(_v, b * {BLOCK} + 1, {BLOCK}), (y, i) -> aggregate(slice(_v, b * {BLOCK} + 1, i), o, (s, x) -> {step}))"
    return df.withColumn(out, F.expr(f"flatten(transform(_o, (o, b) -> {inside}))")).drop("_v", "_b", "_o")


SPACE, INK = r"[\\x20\\x09-\\x0D]", r"[^\\x20\\x09-\\x0D]"
BACK = 16  # matches; a word that holds more of them counts from there
NEAR = 256  # code points of a gap that are looked at first; the whole gap where they don't hold the words asked for


def near_words(string: str) -> str:
    return f"filter(split({string}, '{SPACE}+'), w -> w <> '')"


def matches(df: DataFrame, guard: str, pattern: str, out: str) -> DataFrame:
    """Add array ``out`` of (start, end, m, before, after): matches with code point offsets, the two words before and the word behind.

    Gaps between matches and the matches' lengths give the offsets: running sums in blocks, so that long arrays cost little more than linear.
    The words beside a match are those of the text, whether or not they are matches themselves: the gap at its side, the match beyond it, and so on,
    until two words are sure.
    """
    p = sql_text(pattern)
    df = df.withColumn("_m", F.expr(f"if({guard}, regexp_extract_all(text, {p}, 0), cast(array() as array<string>))"))
    df = df.withColumn("_g", F.expr(f"if(size(_m) > 0, split(text, {p}, -1), array(''))"))
    df = df.withColumn("_n", F.expr("zip_with(slice(_g, 1, size(_m)), _m, (g, m) -> bigint(length(g) + length(m)))"))
    df = df.withColumn("_b", F.expr(f"if(size(_m) > 0, transform(sequence(0, (size(_n) - 1) div {BLOCK}), b -> aggregate(slice(_n, b * {BLOCK} + 1, {BLOCK}), 0L, (s, x) -> s + x)), array(0L))"))
    df = df.withColumn("_o", F.expr("transform(_b, (x, b) -> aggregate(slice(_b, 1, b), 0L, (s, y) -> s + y))"))
    df = df.withColumn("_s", F.expr(f"if(size(_m) > 0, flatten(transform(_o, (o, b) -> transform(slice(_n, b * {BLOCK} + 1, {BLOCK}), (x, i) -> o + x + aggregate(slice(_n, b * {BLOCK} + 1, i), 0L, (s, y) -> s + y)))), array(0L))"))
    # the ends of the gaps, as far as they hold two words, and their beginnings, as far as they hold one
    df = df.withColumn("_t", F.expr(f"transform(_g, g -> if(length(g) > {NEAR} and right(g, {NEAR}) rlike '{SPACE}{INK}+{SPACE}+{INK}+{SPACE}*$', right(g, {NEAR}), g))"))
    df = df.withColumn("_h", F.expr(f"transform(_g, g -> if(length(g) > {NEAR} and left(g, {NEAR}) rlike '^{SPACE}*{INK}+{SPACE}', left(g, {NEAR}), g))"))
    before = near_words("concat(coalesce(get(_t, i - 2), ''), coalesce(get(_m, i - 2), ''), coalesce(get(_t, i - 1), ''), coalesce(get(_m, i - 1), ''), _t[i])")
    # fewer than three words, so the first may be a part: further back, where one word holds several matches
    back = f"greatest(1, i + 1 - {BACK})"
    further = near_words(f"concat(array_join(zip_with(slice(_t, {back}, i + 1 - {back}), slice(_m, {back}, i + 1 - {back}), (t, y) -> concat(t, y)), ''), _t[i])")
    before = f"transform(array({before}), w -> if(size(w) > 2 or i < 3, w, {further}))[0]"
    after = near_words("concat(_h[i + 1], coalesce(get(_m, i + 1), ''), coalesce(get(_h, i + 2), ''))")
    ahead = near_words(f"concat(array_join(zip_with(slice(_h, i + 2, {BACK}), slice(_m, i + 2, {BACK}), (h, y) -> concat(h, coalesce(y, ''))), ''), coalesce(get(_h, i + 1 + {BACK}), ''))")
    after = f"transform(array({after}), w -> if(size(w) > 1 or i + 3 > size(_m), w, {ahead}))[0]"
    last = f"transform(array({before}), w -> if(size(w) > 2, slice(w, -2, 2), w))[0]"
    found = (f"if(size(_m) > 0, transform(_m, (m, i) -> named_struct('start', _s[i] - length(m), 'end', _s[i], 'm', m, 'before', {last}, 'after', coalesce(get({after}, 0), ''))), "
             "cast(array() as array<struct<start: bigint, end: bigint, m: string, before: array<string>, after: string>>))")
    return df.withColumn(out, F.expr(found)).drop("_m", "_g", "_n", "_b", "_o", "_s", "_t", "_h")


def based(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text_key, an array of valid base matches per kind, and ``token`` and ``run``: the tokens and runs of them that may be identifiers.

    Stored, without the text: matching runs once, and filters on the arrays are not pushed into it.
    """
    df = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    for kind, (guard, pattern, valid) in KINDS.items():
        df = matches(df, guard, pattern, kind)
        df = df.withColumn(kind, F.expr(f"filter({kind}, x -> {re.sub(r'\bm\b', 'x.m', valid)})") if valid != "true" else F.col(kind))
    df = matches(df, r"text rlike '[0-9]\\)?\\x20\\(?[0-9]'", RUN, "run").withColumn("run", F.expr("filter(run, x -> instr(x.m, ' ') > 0)"))
    return stored(matches(df, "text rlike '[0-9@]'", TOKEN, "token").drop("text"), "pii-matches")


WORD = 64  # code points; a longer word beside a match is known by its hash, so that patterns stay short


def contexts(found: str) -> Column:
    """Patterns of a match: the word before it, the two words before, the words before and after. Case and digits are levelled."""
    level = f"transform({{}}, w -> if(length(w) > {WORD}, hex(xxhash64(lower(regexp_replace(w, '[0-9]', '0')))), lower(regexp_replace(w, '[0-9]', '0'))))"
    words, after = level.format(found + ".before"), level.format(f"array({found}.after)")
    patterns = "array_distinct(array(concat('1 ', element_at(b, -1)), concat('2 ', array_join(b, ' ')), concat('r ', element_at(b, -1), ' ', a[0])))"
    both = f"zip_with(array({words}), array({after}), (b, a) -> if(size(b) = 0, cast(array() as array<string>), {patterns}))[0]"
    return F.expr(both)


def free(df: DataFrame, found: str, bases: list[str], out: str) -> DataFrame:
    """Add array ``out``: the entries of ``found`` that overlap none of ``bases``, by one sorted array of both and two running bounds."""
    df = df.withColumn("_x", F.expr(found))
    none = f"cast(null as {df.schema['_x'].dataType.elementType.simpleString()})"
    marks = [f"transform({k}, x -> named_struct('start', x.start, 'tag', 0, 'end', x.end, 'x', {none}))" for k in bases]
    df = df.withColumn("_i", F.expr(f"sort_array(concat(transform(_x, x -> named_struct('start', x.start, 'tag', 1, 'end', x.end, 'x', x)), {', '.join(marks)}))"))
    df = before_each(df, "transform(_i, x -> if(x.tag = 0, x.end, 0L))", "_ended", "0L", "greatest(s, x)")
    far = f"{2 ** 62}L"
    df = before_each(df, f"transform(reverse(_i), x -> if(x.tag = 0, x.start, {far}))", "_begins", far, "least(s, x)")
    # zipped, as an array that a lambda looks into once may be computed again for each entry
    df = df.withColumn("_begins", F.reverse("_begins"))
    clear = "filter(arrays_zip(_i, _ended, _begins), y -> y._i.tag = 1 and y._ended <= y._i.start and y._begins >= y._i.end)"
    return df.withColumn(out, F.expr(f"transform({clear}, y -> y._i.x)")).drop("_x", "_i", "_ended", "_begins")


def occurrences(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seeds (kind, instance, patterns) and candidates (doc_id, text_key, kind, instance, start, end, patterns)."""
    seeds = None
    for kind in KINDS:
        s = df.where(F.size(kind) > 0).select(F.explode(kind).alias("x")).select(F.lit(kind).alias("kind"), F.col("x.m").alias("instance"), contexts("x").alias("patterns"))
        seeds = s if seeds is None else seeds.union(s)
    c = free(df.where(F.size("token") > 0), "concat(token, run)", list(KINDS), "open")
    # the outer form, as the plain one lets Spark filter by the array's size below, where its steps would be computed anew inside each other
    c = c.select("doc_id", "text_key", F.explode_outer("open").alias("x")).where("x is not null")
    c = c.withColumn("core", F.expr("regexp_extract(x.m, '[A-Za-z0-9+(](?:.*[A-Za-z0-9])?', 0)"))
    c = c.withColumn("start", F.expr("x.start + instr(x.m, core) - 1"))
    kinds = F.filter(F.array(*[F.when(F.expr(test), F.lit(k)) for k, test in FITS.items()]), lambda k: k.isNotNull())
    c = c.withColumn("kind", F.explode(kinds)).select("doc_id", "text_key", "kind", F.col("core").alias("instance"), "start",
                                                      F.expr("start + length(core)").alias("end"), contexts("x").alias("patterns"))
    return seeds, c


def believed(seeds: DataFrame, candidates: DataFrame, least_seeds: int = SEEDS, believe: float = BELIEVE, tol: float = TOL) -> DataFrame:
    """(kind, instance, belief) of the candidates that the patterns discover.

    Beliefs start at 0 and only rise. Rounds go on until in one no belief rose by more than ``tol`` and no instance came to be believed, as its
    patterns may take part from then on: those with ``least_seeds`` instances that are seeds or believed.
    """
    known = seeds.select("kind", "instance", F.explode("patterns").alias("pattern")).distinct()
    counts = known.groupBy("kind", "pattern").agg(F.count("*").alias("seeds"))
    unknown = candidates.select("kind", "instance", F.explode("patterns").alias("pattern")).distinct().join(
        known.select("kind", "instance").distinct(), ["kind", "instance"], "left_anti")
    sizes = unknown.groupBy("kind", "pattern").agg(F.count("*").alias("others")).join(counts, ["kind", "pattern"], "left").fillna(0, ["seeds"])
    # a pattern with too few instances of either sort can never take part
    edges = stored(unknown.join(sizes.where(F.col("seeds") + F.col("others") >= least_seeds), ["kind", "pattern"]), "pii-edges")
    belief = edges.select("kind", "instance", F.lit(0.0).alias("belief"), F.lit(0.0).alias("before")).limit(0)
    while True:
        for _ in range(STRIDE):
            e = edges.join(belief.select("kind", "instance", "belief"), ["kind", "instance"], "left").fillna(0.0, ["belief"])
            score = e.groupBy("kind", "pattern").agg(((F.first("seeds") + F.sum("belief")) / (F.first("seeds") + F.count("*"))).alias("score"),
                                                     (F.first("seeds") + F.sum((F.col("belief") >= believe).cast("int"))).alias("support"))
            e = e.join(score.where(F.col("support") >= least_seeds), ["kind", "pattern"])
            belief = e.groupBy("kind", "instance").agg((1 - F.exp(F.sum(F.log(1 - DAMP * F.col("score"))))).alias("belief"), F.first("belief").alias("before"))
        belief = stored(belief, "pii-belief")
        rising = (F.col("belief") - F.col("before") > tol) | ((F.col("belief") >= believe) & (F.col("before") < believe))
        if belief.where(rising).isEmpty():
            return belief.where(F.col("belief") >= believe).drop("before")


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key (hash of the text), base and added: arrays of (kind, start, end), code points, end exclusive.

    ``base`` is by kind in the order of KINDS, then start; ``added`` by start. A null text counts as empty and has no spans. Added spans never
    overlap base ones; of kinds that fit one place the most believed is taken, ties by name, and a token's span inside that of a run is dropped. Repeated rows each get their spans; other columns
    are ignored; an empty table gives an empty one. Positions never leave the row; only candidates and their patterns are shuffled.
    """
    df = based(docs, text)
    seeds, candidates = occurrences(df)
    seeds, candidates = stored(seeds, "pii-seeds"), stored(candidates, "pii-candidates")
    found = candidates.join(believed(seeds, candidates), ["kind", "instance"]).groupBy("doc_id", "text_key", "start", "end").agg(
        F.min(F.struct((-F.col("belief")).alias("rank"), "kind")).alias("best"))
    found = found.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end", F.col("best.kind").alias("kind")))).alias("more"))
    # runs are whole tokens and never overlap each other: by start and the longer first, what begins before the end of one before is in it
    found = found.withColumn("more", F.expr("sort_array(transform(more, x -> struct(x.start as start, -x.end as back, x.kind as kind)))"))
    found = before_each(found, "transform(more, x -> -x.back)", "at", "0L", "greatest(s, x)")
    found = found.withColumn("more", F.expr("transform(filter(arrays_zip(more, at), y -> y.more.start >= y.at), "
                                            "y -> named_struct('start', y.more.start, 'end', -y.more.back, 'kind', y.more.kind))")).drop("at")
    found = found.withColumnRenamed("doc_id", "_id").withColumnRenamed("text_key", "_key")
    base = F.concat(*[F.expr(f"transform({k}, x -> named_struct('kind', '{k}', 'start', x.start, 'end', x.end))") for k in KINDS])
    df = df.select("doc_id", "text_key", base.alias("base"))
    df = df.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    added = F.coalesce(F.expr("transform(more, x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end))"), F.expr("cast(array() as array<struct<kind: string, start: bigint, end: bigint>>)"))
    return df.select("doc_id", "text_key", "base", added.alias("added"))


def joined(column: str) -> Column:
    """Spans as kind:start:end by kind in the order of KINDS, then start, comma between."""
    parts = ", ".join(f"filter({column}, x -> x.kind = '{k}')" for k in KINDS)
    return F.expr(f"concat_ws(',', transform(concat({parts}), x -> concat(x.kind, ':', x.start, ':', x.end)))")


def redacted(df: DataFrame, text: str, column: str) -> DataFrame:
    """``df`` with each span of the array ``column``, or run of overlapping spans, replaced in the text by the first one's kind in angle brackets.

    A block of spans first takes the stretch of text that it lies in, so that no span searches the whole text for its place.
    """
    t = f"`{text}`"
    df = df.withColumn("_r", F.expr(f"sort_array(transform({column}, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind)))"))
    df = before_each(df, "transform(_r, x -> x.end)", "_at", "0L", "greatest(s, x)")
    first = f"_at[b * {BLOCK}]"
    stretch = f"substring({t}, int({first} + 1), int(greatest(0L, _r[least(size(_r), (b + 1) * {BLOCK}) - 1].start - {first})))"
    piece = (f"if(x.start >= _at[b * {BLOCK} + i], concat(substring(r, int(_at[b * {BLOCK} + i] - {first} + 1), int(x.start - _at[b * {BLOCK} + i])), "
             "'<', upper(x.kind), '>'), '')")
    blocks = (f"transform(sequence(0, (greatest(size(_r), 1) - 1) div {BLOCK}), b -> transform(array({stretch}), "
              f"r -> array_join(transform(slice(_r, b * {BLOCK} + 1, {BLOCK}), (x, i) -> {piece}), ''))[0])")
    rest = f"substring({t}, int(greatest(element_at(_at, -1), element_at(_r, -1).end) + 1))"
    return df.withColumn(text, F.expr(f"if(size({column}) > 0, concat(array_join({blocks}, ''), {rest}), {t})")).drop("_r", "_at")


def redact(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the spans of ``found`` (the result of ``spans`` on them) replaced in the text; a null text stays null."""
    own = found.select(F.col("doc_id").alias("_pii_id"), F.col("text_key").alias("_pii_key"), F.concat("base", "added").alias("_pii_spans")).where(F.size("_pii_spans") > 0)
    own = own.dropDuplicates(["_pii_id", "_pii_key"])
    key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    df = docs.join(own, F.col("doc_id").eqNullSafe(F.col("_pii_id")) & (key == F.col("_pii_key")), "left")
    df = df.withColumn("_pii_spans", F.coalesce("_pii_spans", F.expr("cast(array() as array<struct<kind: string, start: bigint, end: bigint>>)")))
    return redacted(df, text, "_pii_spans").select(docs.columns)
