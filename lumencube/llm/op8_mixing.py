"""Mixing sources to target weights, in DataFrame expressions alone.

Each source's share p of all tokens (white-space-separated words) becomes a weight in proportion to p^a. The exponent a
is found by bisection on a grid of 2^-20: the smallest one (the most even mix) for which no source has to be repeated
more than `max_repeats` times, or, if a target entropy is given, the largest one whose mix has at least that entropy.
A source's budget is its weight times `budget_ratio` times all tokens. It is spent on whole copies of the source, then
on a permutation of its blocks: documents are dealt into blocks of about `block_docs` by a hash, blocks are taken in hash
order while they fit, and the block that the budget ends in is taken document by document, in hash order, up to the budget.
Where a budget ends is looked for in 1024 ranges of the blocks' hashes first, then among the blocks of one range, then
among the documents of one block, so no window holds more than a thousandth of a large source's blocks.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

PARTS = 1024


def _hash(*parts: str) -> Column:
    """48 bits of the MD5 of the parts."""
    joined = F.concat_ws(":", *[F.lit(p) if p.startswith("#") else F.col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 12), 16, 10).cast("long")


def _as_id(key: str) -> Column:
    return F.col(key).try_cast("long")


def exponent(logs: DataFrame, total: int, max_repeats: float, entropy: float | None, budget_ratio: float) -> tuple[float, float]:
    """The exponent a, and the sum of the powers p^a; logs: (l, tokens), a row a source, l being the logarithm of its share.

    Bisection needs 20 evaluations over all sources. One aggregation evaluates the 1025 exponents that ten halvings choose
    from, and a second one those of the next ten; only these figures come to the driver, where the halving goes on.
    """
    def halved(low: float, step: float) -> tuple[int, list]:
        """The first of the exponents low + i * step at which the mix is good (with an entropy: no longer good), and the figures."""
        each = logs.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(PARTS)))).withColumn("a", F.lit(low) + F.col("i") * F.lit(step))
        power = F.exp(F.col("l") * F.col("a"))
        sums = each.groupBy("i", "a").agg(F.sum(power).alias("s"), F.max(power / F.col("tokens")).alias("most"), F.sum(power * F.col("l")).alias("pl"))
        if entropy is not None:
            passed = F.ln("s") - F.col("a") * F.col("pl") / F.col("s") < entropy
        else:
            passed = F.col("most") / F.col("s") * budget_ratio * total <= max_repeats
        figures = sums.select("i", "a", "s", passed.alias("passed")).orderBy("i").collect()
        return bisect_left(figures, True, key=lambda r: r["passed"]), figures

    fine = 1.0 / PARTS**2
    i, figures = halved(0.0, 1.0 / PARTS)
    if not figures:
        return 0.0, 1.0
    if i == 0:  # even shares: the most even mix that there is
        return figures[0]["a"], figures[0]["s"]
    j, figures = halved(figures[min(i, PARTS) - 1]["a"], fine)
    best = figures[min(j, PARTS) - (entropy is not None)]
    return best["a"], best["s"]


def source_weights(sizes: DataFrame, max_repeats: float, entropy: float | None, budget_ratio: float) -> DataFrame:
    """sizes: (source, tokens, documents), a row a source. Adds exponent, weight, budget, copies and rest (of the last copy)."""
    total = sizes.agg(F.sum("tokens")).first()[0] or 1
    logs = materialise(sizes.withColumn("l", F.ln(F.col("tokens") / F.lit(float(total)))), "mix-sources")
    a, s = exponent(logs, total, max_repeats, entropy, budget_ratio)
    row = logs.withColumn("exponent", F.lit(a)).withColumn("weight", F.round(F.exp(F.col("l") * a) / F.lit(s), 9)).drop("l")
    row = row.withColumn("budget", F.floor(F.col("weight") * budget_ratio * F.lit(float(total))))
    row = row.withColumn("copies", F.floor(F.col("budget") / F.col("tokens")))
    return row.withColumn("rest", F.col("budget") - F.col("copies") * F.col("tokens"))


def dealt_by(doc_id: Column, text: Column) -> Column:
    """What a document is dealt by: its id, or where it has none, a hash of its text."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("#"), F.xxhash64(F.coalesce(text, F.lit(""))).cast("string")))


def deal(docs: DataFrame, max_repeats: float = 4.0, entropy: float | None = None, budget_ratio: float = 1.0, block_docs: int = 64) -> DataFrame:
    """choose(), plus key, by which documents are dealt: rows of one source and key are taken alike."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", dealt_by(F.col("doc_id"), F.col("text")).alias("key"), F.coalesce("source", F.lit("")).alias("source"),
        F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))).cast("long").alias("tokens"),
    )
    rows = materialise(rows, "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    weights = materialise(source_weights(sizes, max_repeats, entropy, budget_ratio), "mix-weights")
    few = weights.limit(10_001).count() <= 10_000
    small = (lambda d: F.broadcast(d)) if few else (lambda d: d)

    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("documents") / block_docs))
    w = weights.select("source", "exponent", "weight", "copies", "rest", n_blocks.alias("n_blocks"))
    rows = rows.join(small(w), "source").withColumn("block", _hash("#deal", "source", "key") % F.col("n_blocks"))
    blocks = rows.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"), F.first("rest").alias("rest"))
    blocks = blocks.withColumn("turn", _hash("#blocks", "source", "block"))
    blocks = materialise(blocks.withColumn("range", F.shiftright("turn", 38)), "mix-blocks")

    def left(tokens: str, in_turn) -> Column:
        """What is left of a source's last copy when a range's or block's turn comes."""
        return F.coalesce(F.sum(tokens).over(in_turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    ranges = blocks.groupBy("source", "range").agg(F.sum("block_tokens").alias("range_tokens"), F.first("rest").alias("rest"))
    ranges = ranges.withColumn("range_left", F.col("rest") - left("range_tokens", Window.partitionBy("source").orderBy("range"))).drop("rest")
    blocks = blocks.join(ranges, ["source", "range"])
    state = lambda rest, tokens: F.when(rest >= tokens, 1).when(rest > 0, 0).otherwise(-1)
    of_range = state(F.col("range_left"), F.col("range_tokens"))
    whole_ranges = blocks.where(of_range != 0).select("source", "block", of_range.alias("state"), F.lit(None).cast("long").alias("left"))
    ends = blocks.where(of_range == 0)
    ends = ends.withColumn("left", F.col("range_left") - left("block_tokens", Window.partitionBy("source", "range").orderBy("turn", "block")))
    ends = ends.select("source", "block", state(F.col("left"), F.col("block_tokens")).alias("state"), "left")
    blocks = materialise(whole_ranges.unionByName(ends), "mix-states")

    # Only the block in which a source's budget ends is looked at document by document.
    ends = blocks.where("state = 0").select("source", F.col("block").alias("end_block"), "left")
    inside = rows.join(small(ends), "source").where("block = end_block")
    # Rows of one key are taken together, so that a key of any number of rows is one row of the window.
    keys = inside.groupBy("source", "block", "key", "left").agg(F.sum("tokens").alias("key_tokens"))
    order = Window.partitionBy("source", "block").orderBy(_hash("#docs", "source", "key"), _as_id("key"), "key")
    keys = keys.withColumn("part", (F.sum("key_tokens").over(order) <= F.col("left")).cast("int")).select("source", "key", "part")
    cut = inside.join(small(keys), ["source", "key"]).select("doc_id", "key", "source", "tokens", "weight", "exponent", "block", "copies", "part")
    taken = blocks.where("state <> 0").select("source", "block", F.greatest("state", F.lit(0)).alias("part"))
    whole = rows.join(taken, ["source", "block"]).select(*cut.columns)
    return whole.unionByName(cut).select(
        "doc_id", "key", "source", "tokens", "weight", "exponent", "block", (F.col("copies") + F.col("part")).alias("times")
    )


def choose(docs: DataFrame, max_repeats: float = 4.0, entropy: float | None = None, budget_ratio: float = 1.0, block_docs: int = 64) -> DataFrame:
    """Per document: doc_id, source, tokens, weight, exponent, block, times (how often the mix has it; 0: not at all).

    Null sources form a source of their own, the empty name; texts without words count one token. Rows that repeat an id,
    and rows without one that repeat a text, are dealt alike. The table of sources is broadcast only up to 10,000 of them;
    beyond that it is joined.
    """
    return deal(docs, max_repeats, entropy, budget_ratio, block_docs).drop("key")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choose(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source,
    greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS tokens FROM documents),
sizes AS (SELECT source, sum(tokens)::BIGINT AS tokens, count(*) AS documents FROM d GROUP BY source),
total AS (SELECT sum(tokens)::DOUBLE AS total FROM sizes),
logs AS (SELECT source, tokens, documents, ln(tokens / total) AS l, total FROM sizes, total),
steps AS (
  SELECT 0 AS k, 0.0::DOUBLE AS a
  UNION ALL
  SELECT k + 1, CASE WHEN (SELECT max(exp(l * (a + pow(2.0, -(k + 1)))) / t.s * total / tokens)
      FROM logs, (SELECT sum(exp(l * (a + pow(2.0, -(k + 1))))) AS s FROM logs) t) > 4.0
    THEN a + pow(2.0, -(k + 1)) ELSE a END FROM steps WHERE k < 20),
expo AS (SELECT CASE WHEN (SELECT max(1.0 / n * total / tokens) FROM logs, (SELECT count(*) AS n FROM logs) c) <= 4.0
  THEN 0.0 ELSE (SELECT a FROM steps WHERE k = 20) + pow(2.0, -20) END AS a),
w AS (SELECT source, tokens AS all_tokens, documents, a AS exponent, round(exp(l * a) / (SELECT sum(exp(l * e2.a)) FROM logs, expo e2), 9) AS weight, total
  FROM logs, expo),
b AS (SELECT *, floor(weight * total)::BIGINT AS budget FROM w),
c AS (SELECT *, budget // all_tokens AS copies, budget % all_tokens AS rest, greatest(1, ceil(documents / 64))::BIGINT AS n_blocks FROM b),
r AS (SELECT d.*, exponent, weight, copies, rest,
  ('0x' || substr(md5('#deal:' || source || ':' || doc_id), 1, 12))::BIGINT % n_blocks AS block FROM d JOIN c USING (source)),
bl AS (SELECT source, block, sum(tokens) AS bt, any_value(rest) AS rest FROM r GROUP BY source, block),
bs AS (SELECT *, rest - coalesce(sum(bt) OVER (PARTITION BY source
  ORDER BY ('0x' || substr(md5('#blocks:' || source || ':' || block), 1, 12))::BIGINT, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft FROM bl),
f AS (SELECT r.*, bs.bt, bs.lft, sum(tokens) OVER (PARTITION BY source, block
  ORDER BY ('0x' || substr(md5('#docs:' || source || ':' || doc_id), 1, 12))::BIGINT, doc_id) AS run FROM r JOIN bs USING (source, block))
SELECT doc_id, source, tokens, weight, exponent, block,
  copies + CASE WHEN lft >= bt THEN 1 WHEN lft > 0 AND run <= lft THEN 1 ELSE 0 END AS times FROM f
"""
