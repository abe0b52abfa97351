"""Document fingerprints: a canonical exact digest, in DataFrame expressions alone.

A text's canonical form has Unicode compatibility composition (NFKC, through the ICU library that Spark ships), full case
folding with composition after it, and each run of white space as one space, none at the ends. Its digest is 128 bits: xxhash64 of the form under two
seeds. Texts are grouped by the digest; where a group has several rows the forms themselves are compared (their smallest
and largest, which Spark takes first inside each task, so that a group of any size is small after it). Forms of edited
texts, which are no rows of the table, are compared with a group's by SHA-256. If two forms differ under one digest, their
fingerprints get the form's SHA-256 as well. So equal fingerprints mean equal forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

NULL_BUCKETS = -(1 << 60)  # rows without doc_id sort first; they are dealt into 2^20 buckets below all others


def canonical(text: Column) -> Column:
    icu = lambda name, method, value: F.call_function("java_method", F.lit(f"com.ibm.icu.{name}"), F.lit(method), value, F.lit(True))
    composed = icu("text.Normalizer", "compose", text)
    folded = icu("text.Normalizer", "compose", icu("lang.UCharacter", "foldCase", composed))  # a folded text may be no composed one
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def digest(form: Column) -> tuple[Column, Column]:
    """Two hashes of the whole form: under Spark's seed, and under the hash of a word as the seed."""
    return F.xxhash64(form), F.xxhash64(F.lit("wide"), form)


def spelled(*halves: str) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(h)), 16, "0") for h in halves])


def sha(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def clashes(forms: DataFrame) -> DataFrame:
    """forms: (d1, d2, form). The digests that different forms share; normally none."""
    g = forms.groupBy("d1", "d2").agg(F.min("form").alias("a"), F.max("form").alias("z"))
    return g.where("a <> z").select("d1", "d2")


def bucket_after(buckets: DataFrame) -> DataFrame:
    """buckets (bucket) plus after: the next larger one; after the largest, the smallest.

    Found in blocks of 4096 buckets, then among the blocks, and so on, so that no window holds more than some thousands.
    """
    b = buckets.distinct().withColumn("block", F.shiftright("bucket", 12))
    b = b.withColumn("after", F.lead("bucket").over(Window.partitionBy("block").orderBy("bucket")))
    blocks = b.groupBy("block").agg(F.min("bucket").alias("least")).withColumn("up", F.shiftright("block", 12))
    blocks = blocks.withColumn("after_block", F.lead("least").over(Window.partitionBy("up").orderBy("block")))
    ups = blocks.groupBy("up").agg(F.min("least").alias("up_least")).withColumn("zone", F.shiftright("up", 16))
    ups = ups.withColumn("after_up", F.lead("up_least").over(Window.partitionBy("zone").orderBy("up")))
    zones = ups.groupBy("zone").agg(F.min("up_least").alias("zone_least"))
    every = Window.partitionBy(F.lit(0))  # one row for 2^40 buckets
    zones = zones.withColumns({"after_zone": F.lead("zone_least").over(every.orderBy("zone")), "first": F.min("zone_least").over(every)})
    ups = ups.join(zones, "zone").withColumn("after_up", F.coalesce("after_up", "after_zone", "first"))
    blocks = blocks.join(ups.select("up", "after_up"), "up").withColumn("after_block", F.coalesce("after_block", "after_up"))
    return b.join(blocks.select("block", "after_block"), "block").select("bucket", F.coalesce("after", "after_block").alias("after"))


def rows_of(docs: DataFrame, bits: int = 8) -> DataFrame:
    """docs (doc_id, text): doc_id, h (hash of the text), n_chars, edited_sha, and digest and SHA-256 of the form (d1, d2,
    wide) and of the edited form (e1, e2, edited_wide), near_edited, near_next.

    The next document is that of the next larger doc_id (after the largest: the smallest; ties by h). Texts meet once, in
    buckets of 2^bits ids; of each bucket the first text alone goes to the end of the bucket before it.
    """
    h = F.xxhash64("text")
    bucket = F.coalesce(F.shiftright("doc_id", bits), F.lit(NULL_BUCKETS) + F.shiftrightunsigned(h, 44))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "text", h.alias("h"), bucket.alias("bucket"))
    own = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "h")
    first = dealt.withColumn("r", F.row_number().over(own)).where("r = 1").select(F.col("bucket").alias("after"), F.col("text").alias("first_text"))
    first = bucket_after(dealt.select("bucket")).join(first, "after").withColumn("first_form", canonical(F.col("first_text")))
    f1, f2 = digest(F.col("first_form"))
    first = first.select("bucket", "first_text", f1.alias("f1"), f2.alias("f2"), sha(F.col("first_form")).alias("f_wide"))

    df = dealt.withColumns({"next_text": F.lead("text").over(own), "last": F.lead(F.lit(1)).over(own).isNull()}).join(first, "bucket", "left")
    n = F.char_length("text")
    k = F.floor(n / 4).cast("int")
    following = F.when(F.col("last"), F.col("first_text")).otherwise(F.col("next_text"))
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - k), F.substring(following, F.lit(1), k)))
    df = df.select(
        "doc_id", "h", "bucket", "last", "f1", "f2", "f_wide", n.cast("long").alias("n_chars"), sha(F.col("edited")).alias("edited_sha"),
        canonical(F.col("text")).alias("form"), canonical(F.col("edited")).alias("edited_form"),
    )
    (d1, d2), (e1, e2) = digest(F.col("form")), digest(F.col("edited_form"))
    df = df.select(
        "doc_id", "h", "bucket", "last", "f1", "f2", "f_wide", "n_chars", "edited_sha", d1.alias("d1"), d2.alias("d2"), sha(F.col("form")).alias("wide"),
        e1.alias("e1"), e2.alias("e2"), sha(F.col("edited_form")).alias("edited_wide"), (F.col("form") == F.col("edited_form")).cast("double").alias("near_edited"),
    )
    after = [F.when(F.col("last"), F.col(f)).otherwise(F.lead(d).over(own)) == F.col(d) for f, d in (("f1", "d1"), ("f2", "d2"), ("f_wide", "wide"))]
    df = df.withColumn("near_next", (after[0] & after[1] & after[2]).cast("double"))
    return df.drop("bucket", "last", "f1", "f2", "f_wide")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The likeness of two exact fingerprints is 1 if they are equal, else 0. A null text counts as empty; rows without
    doc_id sort first, by a hash of the text. A single document is its own next one. Repeated rows follow one another.
    Other columns aren't read. An empty table gives no rows.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = materialise(rows_of(docs), "digests")
    every = rows.select("d1", "d2", "wide", F.lit(1).alias("own"))
    every = every.unionByName(rows.select(F.col("e1").alias("d1"), F.col("e2").alias("d2"), F.col("edited_wide").alias("wide"), F.lit(0).alias("own")))
    groups = every.groupBy("d1", "d2").agg(F.sum("own").alias("rows"), F.min("wide").alias("lo"), F.max("wide").alias("hi"))
    groups = materialise(groups.where("rows > 1 or lo <> hi"), "groups")
    # Only rows that share a digest bring their forms along.
    shared = rows.join(groups.where("rows > 1").select("d1", "d2"), ["d1", "d2"], "left_semi").select(F.col("doc_id").alias("s_id"), F.col("h").alias("s_h"))
    forms = docs.withColumn("h", F.xxhash64("text")).join(shared, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("h") == F.col("s_h")), "left_semi")
    forms = forms.select(canonical(F.col("text")).alias("form"))
    d1, d2 = digest(F.col("form"))
    clash = clashes(forms.select(d1.alias("d1"), d2.alias("d2"), "form")).unionByName(groups.where("lo <> hi").select("d1", "d2")).distinct()
    clash = materialise(clash, "clashes")

    def named(df: DataFrame, halves: tuple[str, str], wide: str, name: str) -> DataFrame:
        some = clash.select(F.col("d1").alias("c1"), F.col("d2").alias("c2"))
        df = df.join(some, (F.col(halves[0]) == F.col("c1")) & (F.col(halves[1]) == F.col("c2")), "left")
        longer = F.when(F.col("c1").isNotNull(), F.lower(F.hex(wide))).otherwise(F.lit(""))
        return df.withColumn(name, F.concat(spelled(*halves), longer)).drop("c1", "c2")

    out = named(named(rows, ("d1", "d2"), "wide", "fingerprint"), ("e1", "e2"), "edited_wide", "edited_fingerprint")
    return out.select("doc_id", "n_chars", F.lower(F.hex("edited_sha")).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
