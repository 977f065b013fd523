"""Mixing sources by temperature (DataFrame and SQL functions only).

Source s with token share p_s gets weight p_s^t / sum p^t.  The exponent t is bisected until the weights reach a target
entropy, or until the most repeated source reaches a repetition limit.  Weights become token budgets, and budgets
become whole passes over a source plus one partial pass: a permutation by hash, cut at the budget.  The cut is found
from token sums of hash blocks, so only the one block in which the budget ends is ever sorted, never a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import WORD, read, saved, unused, written

#: Rows of a source in one hash block, about: what one task sorts where a budget ends.
BLOCK_ROWS = 2000
#: Times that a source is passed at most while the largest is passed once; seed of the permutation.
REPEATS, SEED = 2.0, 17
#: Bisection steps; 2^-60 of the exponent's range.
STEPS = 60


def _bisect(p: str, ok: str) -> str:
    """SQL for the smallest exponent in [0, 1] with ok(t); ok holds at 1 and, once it holds, for all larger t."""
    mid = "(b.lo + b.hi) / 2"
    test = ok.replace("{t}", mid).replace("{p}", p)
    return f"aggregate(sequence(1, {STEPS}), named_struct('lo', 0D, 'hi', 1D), (b, i) -> if({test}, named_struct('lo', b.lo, 'hi', {mid}), named_struct('lo', {mid}, 'hi', b.hi)), b -> b.hi)"


def temperature(totals: DataFrame, entropy: float | None = None, repeats: float | None = None) -> DataFrame:
    """(source, tokens, docs) -> source, tokens, docs, share, exponent, weight, passes.

    repeats: the largest exponent range in which no source is repeated more often than this while the largest source
    is passed once.  entropy: the weights' entropy in nats is lowered to it at most (1 if the shares' own is above).
    The exponent is the smallest in [0, 1] that meets the limits.  passes counts how often the source is read when the
    largest is read once.  Sources without tokens get weight 0 and one pass.  The table has one row a source; its
    shares are gathered into one row, which grows with the number of sources alone.
    """
    if entropy is None and repeats is None:
        raise ValueError("give an entropy or a repetition limit")
    limits = []
    if entropy is not None:
        z = "aggregate(transform({p}, x -> pow(x, {t})), 0D, (a, x) -> a + x)"
        limits.append(f"({{t}} >= 1 OR ln({z}) - {{t}} * aggregate(transform({{p}}, x -> pow(x, {{t}}) * ln(x)), 0D, (a, x) -> a + x) / {z} <= {float(entropy)!r}D)")
    if repeats is not None:
        limits.append(f"pow(array_max({{p}}) / array_min({{p}}), 1 - {{t}}) <= {float(max(1.0, repeats))!r}D")
    shares = totals.filter("tokens > 0").agg(F.array_sort(F.collect_list(F.col("tokens").cast("double"))).alias("n"))
    shares = shares.withColumn("p", F.expr("transform(n, x -> x / aggregate(n, 0D, (a, y) -> a + y))"))
    exponent = shares.filter("size(p) > 0").select(F.expr(_bisect("p", " AND ".join(limits))).alias("exponent"), F.expr("aggregate(n, 0D, (a, x) -> a + x)").alias("all_tokens"), F.expr("array_max(n)").alias("most"), "p")
    exponent = exponent.withColumn("z", F.expr("aggregate(transform(p, x -> pow(x, exponent)), 0D, (a, x) -> a + x)")).drop("p")
    out = totals.join(F.broadcast(exponent), F.lit(True), "left")
    some = F.col("tokens") > 0
    return out.select(
        "source", "tokens", "docs",
        F.when(some, F.col("tokens") / F.col("all_tokens")).otherwise(0.0).alias("share"),
        "exponent",
        F.when(some, F.pow(F.col("tokens") / F.col("all_tokens"), "exponent") / F.col("z")).otherwise(0.0).alias("weight"),
        F.when(some, F.pow(F.col("tokens") / F.col("most"), F.col("exponent") - 1)).otherwise(1.0).alias("passes"),
    )


def counted(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, tokens): tokens are words between ASCII white space; a null source is a source of its own."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("tokens"))


def plan(docs: DataFrame, entropy: float | None = None, repeats: float | None = REPEATS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, source, n_tokens, weight, passes (of its source), copies (of this row).

    copies is floor(passes), and one more for the rows that the last, partial pass reaches: rows of the source in hash
    order while the running token sum stays within the pass's budget.  Every row gets one copy at least, since the
    largest source is passed once.  Null texts count 0 tokens; null sources form one source; repeated ids share one place
    in the permutation and get the same copies; an empty table gives no rows.
    """
    rows = written(counted(docs, id_col, text_col, source_col).withColumn("key", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f":{seed}")))))
    totals = rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    mixed = temperature(totals, entropy, repeats).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK_ROWS)).cast("long"))
    mixed = saved(mixed.withColumn("whole", F.floor(F.col("passes") + 1e-9)).withColumn("budget", F.floor((F.col("passes") - F.col("whole")) * F.col("tokens") + 1e-6)))
    # Skewed sources: the join is with one row a source, so Spark may broadcast it or split the hot side.
    with_source = rows.join(mixed.select("source", "weight", "passes", "whole", "budget", "blocks").withColumnRenamed("source", "s"), F.expr("source <=> s")).drop("s")
    placed = with_source.withColumn("block", F.coalesce(F.expr("cast(conv(substr(key, 1, 8), 16, 10) AS bigint) % blocks"), F.lit(0)))
    sums = placed.groupBy("source", "block").agg(F.sum("tokens").alias("n"), F.first("budget").alias("budget"))
    running = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    cuts = sums.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0)))
    cuts = cuts.select(F.col("source").alias("cs"), F.col("block").alias("cb"), "before", F.expr("CASE WHEN before >= budget THEN 0 WHEN before + n <= budget THEN 1 ELSE -1 END").alias("fits"))
    cuts = saved(cuts)
    judged = placed.join(cuts, F.expr("source <=> cs AND block = cb")).drop("cs", "cb")
    inner = W.partitionBy("source", "block").orderBy("key", "doc_id").rangeBetween(W.unboundedPreceding, W.currentRow)
    cut = judged.filter("fits < 0").withColumn("more", (F.col("before") + F.sum("tokens").over(inner) <= F.col("budget")).cast("int"))
    rest = judged.filter("fits >= 0").withColumn("more", F.col("fits"))
    return cut.unionByName(rest).select("doc_id", "source", F.col("tokens").alias("n_tokens"), "weight", "passes", (F.col("whole") + F.col("more")).cast("int").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as plan() says, all columns untouched; rows with a null id once."""
    id_col = options.get("id_col", "doc_id")
    name, count = unused(docs.columns, "mixed_id"), unused(docs.columns, "mixed_copies")
    copies = plan(docs, **options).filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(name)).agg(F.max("copies").alias(count))
    joined = docs.join(copies, docs[id_col] == copies[name], "left")
    return joined.withColumn(name, F.explode(F.sequence(F.lit(1), F.coalesce(F.col(count), F.lit(1))))).select(*[joined[f"`{c}`"] for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = plan(read(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("weight", "passes")})
