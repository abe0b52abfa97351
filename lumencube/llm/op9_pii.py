"""PII: fixed patterns seed a bootstrapped extraction by context, in DataFrame expressions alone.

Base spans (e-mail addresses, IP addresses, card numbers, phone numbers) come from four regular expressions with checks.
They are the seeds. A pattern is the word before an item, the word after it, or both; what the item looks like is no part
of it. The confidence of a pattern for a kind is the share of its items that are of the kind; items that hold digits or
an @ but are no base spans (tokens without the marks at their ends, or groups of digits with single spaces between) are
scored by the patterns that they stand in, a little less where no seed of the kind has the same sorts of characters.
Each round makes its patterns anew, from the seeds and from the items that the round before gave a high score, these by
their scores; so an item may stand only in contexts that found items have. What has a high score in the last round is
added as a span of its kind wherever it stands in one of that round's patterns.

Positions are code points. split() gives what lies between the matches of a pattern, so running sums of lengths give
where each match starts. Quantifiers are possessive where that changes nothing, so no long run is scanned twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

KINDS = ("email", "ip", "card", "phone")
# The base patterns, in a form that Java's matcher runs without recursion or repeated scans.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MAY_HAVE = {"email": "@", "ip": ".", "card": None, "phone": "+"}
ITEM = r"(?<!\S)(?:[(+]?+[0-9][0-9().-]*+(?:\x20\(?+[0-9][0-9().-]*+(?!\S))++|[^\s0-9@]*+[0-9@]\S*+)"
# Marks at an item's ends; a + or @ before it and a whole group in brackets at its start belong to it.
HEAD, TAIL = r"^(?!\([0-9]+\))[^\p{L}\p{N}+@]++", r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$"
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})\.){3}0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"
FOUND = "array<struct<start:int,end:int,value:string,left:string,right:string>>"


def running(steps: Column) -> Column:
    """Running sums of an array of ints, in parts of 64 so that long arrays cost little."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    last = F.ceil(F.size(steps) / 64).cast("int") - 1
    parts = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(steps, c * 64 + 1, 64))
    sums = F.transform(parts, total)
    return F.flatten(F.transform(F.arrays_zip(parts.alias("p"), sums.alias("s")), lambda x, c: _inner(x, total(F.slice(sums, F.lit(1), c)), total)))


def _inner(x: Column, before: Column, total) -> Column:
    return F.transform(x.getField("p"), lambda _, i: before + total(F.slice(x.getField("p"), F.lit(1), i + 1)))


LEFT, RIGHT = r"(?<![\p{L}\p{M}])([\p{L}\p{M}]++)[^\p{L}\p{M}\p{N}]*+$", r"^[^\p{L}\p{M}\p{N}]*+([\p{L}\p{M}]++)"


def _context(gap: Column, side: str) -> Column:
    """The word, without marks, at the end (left) or start (right) of what lies between two matches.

    The 32 nearest characters are looked at first; all of the gap where these don't hold the word with what bounds it.
    """
    if side == "left":
        near = F.right(gap, F.lit(32))
        whole = near.rlike(r"[^\p{L}\p{M}][\p{L}\p{M}]++[^\p{L}\p{M}\p{N}]*+$") | near.rlike(r"\p{N}[^\p{L}\p{M}\p{N}]*+$")
    else:
        near = F.left(gap, F.lit(32))
        whole = near.rlike(r"^[^\p{L}\p{M}\p{N}]*+(?:[\p{L}\p{M}]++[^\p{L}\p{M}]|\p{N})")
    text = F.when((F.char_length(gap) <= 32) | whole, near).otherwise(gap)
    return F.lower(F.regexp_extract(text, LEFT if side == "left" else RIGHT, 1))


def with_matches(df: DataFrame, name: str, pattern: str, needs: str | None) -> DataFrame:
    """df plus column `name`: all matches of the pattern in text, with places and context words."""
    m, g, e = f"_{name}_m", f"_{name}_g", f"_{name}_e"
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    if needs:
        found = F.when(F.contains("text", F.lit(needs)), found).otherwise(F.array().cast("array<string>"))
    df = df.withColumn(m, found)
    df = df.withColumn(g, F.when(F.size(m) > 0, F.split("text", pattern, -1)))
    steps = F.zip_with(F.slice(F.col(g), F.lit(1), F.size(m)), m, lambda a, b: F.char_length(a) + F.char_length(b))
    df = df.withColumn("_steps", steps).withColumn(e, F.when(F.size(m) > 0, running(F.col("_steps"))))
    made = F.transform(m, lambda v, i: F.struct(
        (F.get(e, i) - F.char_length(v)).alias("start"), F.get(e, i).alias("end"), v.alias("value"),
        _context(F.get(g, i), "left").alias("left"), _context(F.get(g, i + 1), "right").alias("right"),
    ))
    df = df.withColumn(name, F.when(F.size(m) > 0, made).otherwise(F.array().cast(FOUND)).cast(FOUND))
    return df.drop(m, g, e, "_steps")


def _luhn(digits: Column) -> Column:
    """Whether the digits, the last one plain and each second one before it doubled, add up to a multiple of ten."""
    n = F.char_length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.char_length(digits)
    if kind == "ip":
        return value.rlike(OCTETS)
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(digits)).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, email, ip, card, phone, items): valid base matches of each kind, and other items, per row."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = df.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    for kind in KINDS:
        df = with_matches(df, kind, PATTERNS[kind], MAY_HAVE[kind])
        df = df.withColumn(kind, _filtered(kind))
    df = with_matches(df, "items", ITEM, None).drop("text")
    df = df.withColumn("items", F.filter(F.transform("items", _stripped), lambda i: i["value"].rlike(r"[\p{L}\p{N}]")))
    taken = F.concat(*KINDS)
    return df.withColumn("items", F.filter("items", lambda i: ~F.exists(taken, lambda b: (b["start"] < i["end"]) & (b["end"] > i["start"]))))


def _filtered(kind: str) -> Column:
    return F.filter(kind, lambda s: _valid(kind, s["value"]))


def _stripped(i: Column) -> Column:
    """An item without the marks at its ends."""
    bare = F.regexp_replace(i["value"], HEAD, "")
    start, value = i["end"] - F.char_length(bare), F.regexp_replace(bare, TAIL, "")
    return F.struct(start.alias("start"), (start + F.char_length(value)).alias("end"), value.alias("value"), i["left"].alias("left"), i["right"].alias("right"))


def _look(value: Column) -> Column:
    """Which sorts of characters a value has: @, letters, and no, few, some or many digits. A weak feature of its kind."""
    digits = F.least(F.lit(3), F.ceil(F.regexp_count(value, F.lit("[0-9]")) / 4))
    return F.concat_ws(",", F.contains(value, F.lit("@")).cast("string"), value.rlike(r"\p{L}").cast("string"), digits.cast("string"))


def discover(found: DataFrame, rounds: int = 2, support: int = 5, accept: float = 0.9, unusual: float = 0.91) -> DataFrame:
    """(doc_id, text_hash, kind, start, end): items that high-confidence patterns add; found: base_spans() rows."""
    of = lambda kind, column: found.select("doc_id", "text_hash", F.lit(kind).alias("kind"), F.explode(column).alias("s")).select("doc_id", "text_hash", "kind", "s.*")
    seeds = of("email", "email")
    for kind in KINDS[1:]:
        seeds = seeds.unionByName(of(kind, kind))
    items = of(None, "items").withColumn("kind", F.lit(None).cast("string"))
    every = seeds.unionByName(items)
    looks = F.broadcast(seeds.select("kind", _look(F.col("value")).alias("look")).distinct().withColumn("usual", F.lit(1.0)))
    has = {s: F.col(s) != "" for s in ("left", "right")}
    sides = [F.when(has[s], F.concat(F.lit(f"{s}:"), F.col(s))) for s in has]
    sides.append(F.when(has["left"] & has["right"], F.concat(F.lit("both:"), F.col("left"), F.lit(" "), F.col("right"))))
    sides = F.filter(F.array(*sides), lambda p: p.isNotNull())
    # The graph: one edge for each value and pattern, with how often it occurs.
    graph = every.select("kind", "value", F.explode(sides).alias("pattern")).groupBy("kind", "value", "pattern").agg(F.count("*").alias("n"))
    graph = materialise(graph, "graph")
    seed_edges = graph.where("kind is not null")
    seen = seed_edges.groupBy("pattern", "kind").agg(F.sum("n").alias("hits"), F.count("*").alias("values"))
    total = graph.groupBy("pattern").agg(F.sum("n").alias("total"))
    loose = graph.where("kind is null").select("value", "pattern", "n")
    support_of = seen.select("pattern", "kind", F.col("hits").cast("double"), F.col("values").cast("double"))
    for k in range(rounds):
        # No pattern is trusted beyond 0.95, so an item that looks unlike all seeds of the kind needs the words at both sides.
        # A round's patterns come from the seeds and from what the round before accepted, a score being a part of an item.
        trust = support_of.groupBy("pattern", "kind").agg(F.sum("hits").alias("hits"), F.sum("values").alias("values")).where(F.col("values") >= support)
        trust = trust.join(total, "pattern").select("pattern", "kind", F.least(F.lit(0.95), F.col("hits") / F.col("total")).alias("trust"))
        trust = materialise(trust.where("trust >= 0.5"), "trust")
        match = loose.join(trust, "pattern")
        # The words at both sides together are no evidence besides each side's: the stronger of the two counts.
        both = F.startswith("pattern", F.lit("both:"))
        apart = 1 - F.exp(F.sum(F.when(~both, F.ln(1 - F.col("trust"))).otherwise(0.0)))
        values = match.groupBy("value", "kind").agg(F.greatest(apart, F.max(F.when(both, F.col("trust")))).alias("score"))
        values = values.withColumn("look", _look(F.col("value"))).join(looks, ["kind", "look"], "left")
        values = values.select("value", "kind", (F.col("score") * F.coalesce("usual", F.lit(unusual))).alias("score"))
        best = values.where(F.col("score") >= accept).groupBy("value").agg(F.max(F.struct("score", "kind")).alias("m"))
        best = materialise(best.select("value", "m.kind", "m.score"), "accepted")
        if k + 1 < rounds:
            gained = loose.join(best, "value").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("hits"), F.sum("score").alias("values"))
            support_of = seen.select(*gained.columns).unionByName(gained)
    places = every.where("kind is null").drop("kind").withColumn("pattern", F.explode(sides)).join(best, "value").join(trust.select("pattern", "kind"), ["pattern", "kind"], "left_semi")
    return places.select("doc_id", "text_hash", "kind", "start", "end").distinct()


def pii(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, text_hash, n_email, n_ip, n_card, n_phone, base (spans) and all (spans), ordered by kind
    and start; a span is (kind_no, kind, start, end).

    A null text counts as empty. Repeated rows get the same spans each. Other columns of docs are not read. Of kinds whose
    scores for an item tie, the one that sorts last counts. An empty table gives no rows; long texts are read whole.
    """
    found = materialise(base_spans(docs), "pii")
    more = discover(found)
    number = lambda k: F.array_position(F.array(*[F.lit(x) for x in KINDS]), k).cast("int") - 1
    more = more.groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct(number(F.col("kind")).alias("kind_no"), "kind", "start", "end")).alias("added")
    ).withColumnsRenamed({"doc_id": "m_id", "text_hash": "m_hash"})
    row = found.join(more, found.doc_id.eqNullSafe(more.m_id) & (found.text_hash == more.m_hash), "left")

    def named(k: int) -> Column:
        return F.transform(KINDS[k], lambda s: F.struct(F.lit(k).alias("kind_no"), F.lit(KINDS[k]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    base = F.concat(*[named(k) for k in range(len(KINDS))])
    row = row.withColumn("base", base).withColumn("all", F.array_sort(F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_union("base", "added"))))
    return row.select("doc_id", "text_hash", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], "base", "all")


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every found span of text replaced by its kind in brackets (spans that touch or overlap by the first
    one's); where there is a column n_chars it is counted anew. Rows without spans stay as they are."""
    spans = pii(docs).where(F.size("all") > 0).select("doc_id", "text_hash", "all").dropDuplicates(["doc_id", "text_hash"])
    spans = spans.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash", "all": "_all"})
    row = docs.withColumn("_own", F.xxhash64("text"))
    row = row.join(spans, row.doc_id.eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")), "left")
    by_start = F.array_sort(F.transform("_all", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        tag = F.concat(F.substring("text", acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["parts"], F.array(tag))).otherwise(acc["parts"]).alias("parts"),
        )

    made = F.aggregate(by_start, zero, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring("text", a["at"] + 1, F.char_length("text"))))
    row = row.withColumn("text", F.when(F.col("_all").isNotNull(), made).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        row = row.withColumn("n_chars", F.when(F.col("_all").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return row.select(*docs.columns)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pii(table(spark, sf_dir, "documents"))
    return p.select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2(spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        spelled(F.col("all")).alias("spans"), F.size("all").cast("long").alias("n_spans"),
    )
