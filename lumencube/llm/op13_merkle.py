"""Merkle manifest of a dataset by sibling-shift self-joins, in DataFrame functions alone.

Every row is a leaf: the SHA-256 of its fields. Leaves get their place inside their source from a range partition and the
counts of the partitions before. Every level joins its nodes with themselves on the computed index of each sibling
(XOR for two children, else the slot moved round by an offset); rows in slot zero then emit the parents, which are the
nodes of the next level. A level is written once, so a tree of depth d takes d small jobs, each a third as large as the one
before. Proofs come down the same way: a node's path is its siblings and its parent's path, so all proofs together need
one join a level. Groups (the sources) differ in depth; the tops of their trees are the leaves of a last tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3


def spelled(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def leaf(changed: dict[str, Column] | None = None) -> Column:
    """Digest of the fields, each with its length in bytes (a null one as '-'), so that no two rows spell alike."""
    values = [(changed or {}).get(c, F.col(c)).cast("string") for c in FIELDS]
    return digest(F.concat(*[F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values]))


def indexed(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows plus idx, a row's place (from 0) inside its grp in the order of `by`, and size, the rows of its grp."""
    order = ["grp", *by]
    own = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    own = materialise(own.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "ordered")
    runs = own.groupBy("grp", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    grp = Window.partitionBy("grp")  # a row a partition
    before = F.coalesce(F.sum("n").over(grp.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("grp", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(grp).alias("size"))
    return own.join(runs, ["grp", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift")


class Forest:
    """A tree of `arity` a grp over leaves (grp, h, row; by the columns `by`): levels with siblings, and the trees' tops."""

    def __init__(self, leaves: DataFrame, by: list[str], arity: int = ARITY):
        self.arity, self.levels, tops = arity, [], []
        self.leaves = materialise(indexed(leaves, by).select("grp", "idx", "size", "h", "row"), "leaves")
        most = self.leaves.agg(F.max("size")).first()[0] or 1
        nodes = self.leaves
        while True:
            tops.append(nodes.where("size = 1").select("grp", F.lit(len(self.levels)).alias("level"), "h"))
            if most == 1:
                break
            self.levels.append(materialise(self.with_siblings(nodes.where("size > 1")), "level"))
            nodes, most = self.parents(self.levels[-1]), -(-most // arity)
        every = tops[0]
        for t in tops[1:]:
            every = every.unionByName(t)
        self.tops = materialise(every, "tops")

    def with_siblings(self, nodes: DataFrame) -> DataFrame:
        """nodes plus before and after: the digests of the siblings to the left and to the right, one after the other."""
        run, slot, a = F.floor(F.col("idx") / self.arity), F.col("idx") % self.arity, self.arity
        out, before, after = nodes, [], []
        for shift in range(1, a):
            at = F.col("idx").bitwiseXOR(F.lit(1)) if a == 2 else run * a + (slot + shift) % a
            other = nodes.select(F.col("grp").alias("grp_"), F.col("idx").alias("idx_"), F.col("h").alias("h_"))
            out = out.join(other, (F.col("grp") == F.col("grp_")) & (at == F.col("idx_")), "left").drop("grp_", "idx_").withColumnRenamed("h_", f"h_{shift}")
            h = F.coalesce(f"h_{shift}", F.lit(b""))
            before.append(F.when(slot + shift >= a, h).otherwise(F.lit(b"")))
            after.append(F.when(slot + shift < a, h).otherwise(F.lit(b"")))
        return out.select(*nodes.columns, F.concat(*before).alias("before"), F.concat(*after).alias("after"))

    def parents(self, level: DataFrame) -> DataFrame:
        of = digest(spelled(F.concat("h", "after")))
        first = level.where(F.col("idx") % self.arity == 0)
        return first.select("grp", F.floor(F.col("idx") / self.arity).alias("idx"), F.ceil(F.col("size") / self.arity).alias("size"), of.alias("h"))

    def paths(self, above: DataFrame) -> DataFrame:
        """row, h, top (of its tree) and path of every leaf; above: (grp, path), what a tree's top has above itself.

        A path has the digests before and after the node, level by level.
        """
        tops = self.tops.join(above, "grp").select("grp", "level", F.lit(0).cast("long").alias("idx"), F.col("h").alias("top"), "path")
        upper = tops.where(F.col("level") == len(self.levels)).drop("level")
        for k in reversed(range(len(self.levels))):
            up = upper.select(F.col("grp").alias("grp_"), F.col("idx").alias("idx_"), "top", "path")
            on = (F.col("grp") == F.col("grp_")) & (F.floor(F.col("idx") / self.arity) == F.col("idx_"))
            path = F.concat(F.array(F.struct("before", "after")), F.col("path")).alias("path")
            here, own = self.levels[k].join(up, on), tops.where(F.col("level") == k)
            if k == 0:
                lone = own.join(self.leaves.where("size = 1").select("grp", "row", "h"), "grp")
                return here.select("row", "h", "top", path).unionByName(lone.select("row", "h", "top", "path"))
            upper = here.select("grp", "idx", "top", path).unionByName(own.drop("level"))
        return upper.join(self.leaves.select("grp", "row", "h"), "grp").select("row", "h", "top", "path")


def manifest(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """A row a document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Where crc32 of the doc_id as text is even, the text loses its line breaks before the proof is folded; so verified is
    false where that changes the leaf. Nulls: a null source is a source of its own, before all others; a null doc_id sorts
    first and counts as the empty text for crc32; null texts stay null. Rows that repeat a doc_id follow one another by
    leaf; equal rows are interchangeable. A lone row's proof is the digest of the empty text. An empty table gives no rows.
    Columns besides the five are not read.
    """
    edited = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    own = docs.select(*FIELDS)
    leaves = own.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("grp"), "doc_id", leaf().alias("h"),
        F.when(edited & F.contains("text", F.lit("\n")), leaf({"text": F.replace("text", F.lit("\n"), F.lit(""))})).alias("other"),
        F.monotonically_increasing_id().alias("nth"),  # so that a range ends between equal rows as well
    )
    leaves = materialise(leaves, "rows").select("*", F.struct("doc_id", "other").alias("row"))
    trees = Forest(leaves, ["doc_id", "h", "nth"], arity)
    sources = trees.tops.select(F.lit("").alias("grp"), "h", F.col("grp").alias("row"))
    last = Forest(sources, ["row"], arity)
    nothing = F.expr("cast(array() as array<struct<before: binary, after: binary>>)")
    above = last.paths(last.tops.select("grp", nothing.alias("path")))
    root = last.tops.select("h").first()  # one row, or none where there are no documents
    found = trees.paths(above.select(F.col("row").alias("grp"), "path"))

    start = spelled(F.coalesce("row.other", "h"))
    folded = F.aggregate("path", start, lambda node, p: F.sha2(F.concat(spelled(p["before"]), node, spelled(p["after"])), 256))
    proof = F.array_join(F.transform("path", lambda p: spelled(F.concat(p["before"], p["after"]))), "")
    out = found.select(
        F.col("row.doc_id").alias("doc_id"), spelled(F.col("h")).alias("leaf"), spelled(F.col("top")).alias("subroot"), F.lit(root and bytes(root[0]).hex()).cast("string").alias("root"),
        F.sha2(proof, 256).alias("proof_sha256"), folded.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def _spelled(text: str) -> str:
    fields = [f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(fields)})"


def _tree(leaves: str) -> str:
    return f"""SELECT grp, 0 AS lvl, idx, n, h FROM {leaves} UNION ALL
  SELECT grp, lvl + 1, idx // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM {{0}} WHERE n > 1 GROUP BY grp, lvl, idx // 3"""


def _siblings(tree: str) -> str:
    return f"""SELECT a.grp, a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
  coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM {tree} a JOIN {tree} b ON a.grp = b.grp AND a.lvl = b.lvl AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY ALL"""


# crc32 bit by bit; it is even where the register's last bit, which is inverted at the end, is 1.
_EVEN = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda s, b: list_reduce(list_prepend(xor(s, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) & 1 = 1"""

ORACLE = f"""
WITH RECURSIVE f AS (SELECT doc_id, coalesce('=' || source, '') AS grp, {_spelled("text")} AS h,
  CASE WHEN doc_id IS NULL OR {_EVEN} THEN {_spelled("replace(text, chr(10), '')")} ELSE {_spelled("text")} END AS other FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM f),
t AS ({_tree("d").format("t")}),
s AS (SELECT '' AS grp, grp AS src, h, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1),
u AS ({_tree("s").format("u")}),
ts AS ({_siblings("t")}), us AS ({_siblings("u")}),
steps AS (SELECT d.grp, d.idx, p.lvl, p.l, p.r FROM d JOIN ts p ON p.grp = d.grp AND p.idx = d.idx // (3 ** p.lvl)::BIGINT
  UNION ALL SELECT d.grp, d.idx, 1000 + p.lvl, p.l, p.r FROM d JOIN s ON s.src = d.grp JOIN us p ON p.idx = s.idx // (3 ** p.lvl)::BIGINT),
paths AS (SELECT grp, idx, list(l || '|' || r ORDER BY lvl) AS path, string_agg(l || r, '' ORDER BY lvl) AS proof FROM steps GROUP BY ALL),
o AS (SELECT d.doc_id, d.h AS leaf, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
  list_reduce(list_prepend(other, coalesce(path, [])), lambda node, p: sha256(split_part(p, '|', 1) || node || split_part(p, '|', 2))) AS folded_root
  FROM d JOIN s ON s.src = d.grp LEFT JOIN paths p ON p.grp = d.grp AND p.idx = d.idx)
SELECT *, folded_root = root AS verified FROM o
"""
