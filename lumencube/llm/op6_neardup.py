"""MinHash near-dedup: bottom-k sketches, inverted lists, union-sketch estimates, exact Jaccard, components.

Each text's distinct word shingles are hashed by one 64-bit function; the `k` smallest hashes are its sketch. Sets of one
size and 128-bit signature are one class, once their full sets have been compared. Two sets over the threshold (0.85) share far over half of their sketches, so only the rarest
half of a sketch goes into the inverted lists (the prefix filter; rarity over all documents): texts whose likeness is a
common passage don't meet. Members of short lists are paired. In long lists (large families of copies) sets that can't
reach the threshold with any member are left out (exact bound: hashes that no other member has), then every member is
compared with the one that is most like the rest; members that this leaves in different components are joined by the
rarest hashes of their full sets (prefix and positional filters, exact). So a family of n copies costs about n
comparisons, and no link between components is lost.
Of a pair, the union sketch estimates the similarity; unless it is far too low, both full sets are compared.

How often a pair at 0.85 shares less than half of 48 retained values: a binomial tail of about 1e-9.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, table, with_columns

K, SHARE, PERCENT, SHORT = 48, 0.5, 85, 32
_STEP, _SIGN = np.uint64(0x9E3779B97F4A7C15), np.uint64(1 << 63)
_words: dict[bytes, int] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _forget() -> None:
    _words.clear()


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; of all words as one if there are fewer; empty without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    if len(_words) > 100_000:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(size, len(words))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        s = _mix(s * _STEP + h[i : len(h) - n + 1 + i])
    return np.unique((s ^ _SIGN).view(np.int64))


def signature(x: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set."""
    u = x.view(np.uint64)
    one = int(_mix(u * _STEP + np.uint64(1)).sum(dtype=np.uint64).view(np.int64))
    return one, int(np.bitwise_xor.reduce(_mix(u * _STEP + np.uint64(2))).view(np.int64)) if len(x) else 0


def features(docs: DataFrame) -> DataFrame:
    """docs' doc_id with n, s1, s2, sketch: size of the set, its signature, the k smallest hashes."""

    def compute(texts: list[str | None]) -> list[list]:
        sets = [shingle_set(t) for t in texts]
        return [[len(x) for x in sets], *map(list, zip(*map(signature, sets), strict=True)), [x[:K] for x in sets]]

    added = T.StructType().add("n", "long").add("s1", "long").add("s2", "long").add("sketch", T.ArrayType(T.LongType()))
    return with_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), compute, added, drop=("text",), done=lambda: _forget())


def whole_sets(docs: DataFrame) -> DataFrame:
    """docs' columns but text, with n, s1, s2 and s, the whole set in order."""

    def compute(texts: list[str | None]) -> list[list]:
        sets = [shingle_set(t) for t in texts]
        return [[len(x) for x in sets], *map(list, zip(*map(signature, sets), strict=True)), sets]

    added = T.StructType().add("n", "long").add("s1", "long").add("s2", "long").add("s", T.ArrayType(T.LongType()))
    return with_columns(docs, compute, added, drop=("text",), done=lambda: _forget())


def one_row_an_id(feats: DataFrame) -> DataFrame:
    """feats with the n, s1, s2 of each doc_id's largest set (ties by signature) on all of its rows, and whether it's the row's own."""
    named = feats.where("doc_id IS NOT NULL")
    several = named.groupBy("doc_id").count().where("count > 1").select("doc_id")
    largest = named.join(several, "doc_id").groupBy("doc_id").agg(F.max(F.struct("n", "s1", "s2")).alias("m"))
    out = feats.join(materialise(largest, "repeated"), "doc_id", "left")
    own = F.col("m").isNull() | (F.struct("n", "s1", "s2") == F.col("m"))
    return out.select("doc_id", *[F.coalesce(f"m.{c}", c).alias(c) for c in ("n", "s1", "s2")], "sketch", own.alias("own"))


def unlike(sets: DataFrame) -> DataFrame:
    """(s1, s2, n) of the classes with members whose sets are not the same; normally none. sets: rows of whole_sets()."""
    both = sets.groupBy("s1", "s2", "n").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))  # first inside each task
    return both.where("lo <> hi").select("s1", "s2", "n")


def inverted_lists(classes: DataFrame) -> DataFrame:
    """(v, rep, n): of each sketch the values that may be its rarest shared one; lists of one member are left out."""
    each = classes.select("rep", "n", F.explode("sketch").alias("v"))
    shared = each.groupBy("v").count().where("count > 1")
    each = each.join(shared, "v")
    mine = Window.partitionBy("rep")
    size = F.least(F.lit(K), F.col("n"))
    single = size - F.count("*").over(mine)  # values that no other sketch has come first
    place = F.row_number().over(mine.orderBy("count", "v")) + single
    each = each.withColumn("place", place).where(F.col("place") <= size - F.ceil(size * SHARE) + 1)
    return each.select("v", "rep", "n")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets meet the threshold.

    First the union's sketch (its k smallest hashes) tells how many of them both have; few rule a pair out.
    """
    x, y = F.col("sa"), F.col("sb")
    near = [F.slice(c, 1, K) for c in (x, y)]
    union = F.slice(F.array_sort(F.array_union(*near)), 1, K)
    likely = (F.least(F.size(x), F.size(y)) <= K) | (F.size(F.array_intersect(union, F.array_intersect(*near))) >= SHARE * K)
    same = F.size(F.array_intersect(x, y))
    full = pairs.join(sets.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b")
    full = full.join(sets.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a")
    good = full.where(likely).withColumn("same", same).where(100 * F.col("same") >= PERCENT * (F.size(x) + F.size(y) - F.col("same")))
    return good.select("a", "b")


def reachable(n_a: str, own_a: str, n_b: str, own_b: str) -> Column:
    """Whether two sets of the long lists may meet the threshold: what only one of them has is outside of the other."""
    n_a, own_a, n_b, own_b = map(F.col, (n_a, own_a, n_b, own_b))
    return 100 * F.least(n_a - own_a, n_b - own_b) >= PERCENT * F.greatest(n_a + own_b, n_b + own_a)


def by_prefix(hashes: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) of members (rep, n, rep_l) with different labels whose full sets may meet the threshold.

    hashes: (h, rep, c), those that several members have, c being how many. A set's hashes are ordered by c, its own ones
    first; two sets over the threshold share one of the first n - o + 1 (o: the least overlap), and enough hashes must be
    left from it on in both (position). So texts that are alike, but less than the threshold, meet only where what tells
    them apart is shared.
    """
    mine = Window.partitionBy("rep")
    each = hashes.join(members, "rep")
    each = each.withColumn("at", F.row_number().over(mine.orderBy("c", "h")) - 1 + F.col("n") - F.count("*").over(mine))
    each = each.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100)).select("h", "rep", "n", "rep_l", "at")
    x, y = (each.select("h", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "n", "rep_l", "at")]) for s in ("x", "y"))
    both = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    fit = 100 * both >= PERCENT * (F.col("n_x") + F.col("n_y") - both)
    pair = x.join(y, "h").where((F.col("rep_x") < F.col("rep_y")) & (F.col("rep_l_x") != F.col("rep_l_y")) & fit)
    return pair.select(F.col("rep_x").alias("a"), F.col("rep_y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): of every node of an edge (a, b), the smallest node that it reaches. Labels spread and are then
    replaced by their own labels, so the number of rounds is about the logarithm of the longest path."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both, "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        low = labels.join(near, "node").select("node", F.least("label", "m").alias("low"), "label")
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("lower"))
        new = low.join(up, "low", "left").select("node", F.least("low", F.coalesce("lower", "low")).alias("label"), F.col("label").alias("old"))
        new = materialise(new, "labels")
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    Texts that are null, empty or without words have no shingles and are components of their own. Rows that repeat a
    doc_id count as one document, that of the largest set, and get the same answer each. A row without doc_id has no
    component and is kept. Other columns of docs are not read; doc_id is a long. An empty table gives no rows.
    """
    feats = one_row_an_id(materialise(features(docs), "features"))
    named = feats.where("own and n > 0 and doc_id is not null")
    classes = named.groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "sketch")).alias("m"), F.count("*").alias("members"))
    classes = materialise(classes.select("s1", "s2", "n", F.col("m.doc_id").alias("rep"), F.col("m.sketch").alias("sketch"), "members"), "classes")
    key = ["s1", "s2", "n"]

    def listed(classes: DataFrame) -> DataFrame:
        lists = materialise(inverted_lists(classes), "lists")
        return materialise(lists.join(lists.groupBy("v").count().where("count > 1"), "v"), "lists")

    def sets_of(ids: DataFrame) -> DataFrame:
        return whole_sets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi"))

    lists = listed(classes)
    # One more reading of texts: of those in the lists, and of those that share a class, which is confirmed on the full sets.
    sharing = named.join(classes.where("members > 1").select(*key), key, "left_semi").select("doc_id")
    sets = materialise(sets_of(lists.select(F.col("rep").alias("doc_id")).unionByName(sharing).distinct()), "sets")
    apart = materialise(unlike(sets), "apart")
    if not apart.isEmpty():
        # Members that their sets tell apart are classes of their own; their sets are there, those of new list members may not be.
        single = named.join(apart, key, "left_semi").groupBy("doc_id", *key).agg(F.first("sketch").alias("sketch"))
        single = single.select(*key, F.col("doc_id").alias("rep"), "sketch")
        classes = materialise(classes.join(apart, key, "left_anti").select(*key, "rep", "sketch").unionByName(single), "classes")
        lists = listed(classes)
        more = lists.select(F.col("rep").alias("doc_id")).distinct().join(sets.select("doc_id"), "doc_id", "left_anti")
        sets = materialise(sets.unionByName(sets_of(more)), "sets")
    wanted = lists.select("rep").distinct().join(classes.select("rep", *key), "rep")
    sets = sets.withColumnRenamed("doc_id", "rep").join(wanted, ["rep", *key], "left_semi").dropDuplicates(["rep"])
    sets = materialise(sets.select("rep", "s"), "sets")

    def paired(members: DataFrame) -> DataFrame:
        """Pairs of members of one list whose sizes allow the threshold."""
        x = members.select("v", *[F.col(c).alias(f"{c}_x") for c in members.columns if c != "v"])
        y = members.select("v", *[F.col(c).alias(f"{c}_y") for c in members.columns if c != "v"])
        fit = (F.col("n_x") * 100 >= F.col("n_y") * PERCENT) & (F.col("n_y") * 100 >= F.col("n_x") * PERCENT)
        xy = x.join(y, "v").where(F.col("rep_x") < F.col("rep_y")).where(fit)
        return xy.select(F.col("rep_x").alias("a"), F.col("rep_y").alias("b")).distinct()

    light = paired(lists.where(F.col("count") <= SHORT).select("v", "rep", "n"))

    # Long lists: leave out what has too many hashes of its own among the members of all long lists.
    heavy = lists.where(F.col("count") > SHORT).select("v", "rep", "n")
    inside = sets.join(heavy.select("rep").distinct(), "rep")

    hashes = lambda df: df.select(F.explode("s").alias("h"), "rep")
    once = hashes(inside).groupBy("h").agg(F.count("*").alias("c"), F.min("rep").alias("rep"))
    own = once.where("c = 1").groupBy("rep").agg(F.count("*").alias("own"))
    heavy = heavy.join(own, "rep", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    heavy = materialise(heavy.where((F.col("n") - F.col("own")) * 100 >= F.col("n") * PERCENT), "heavy")
    middle = heavy.groupBy("v").agg(F.min(F.struct((F.col("own") / F.col("n")).alias("r"), "rep", "n", "own")).alias("m"))
    star = heavy.join(middle.select("v", F.col("m.rep").alias("mid"), F.col("m.n").alias("mid_n"), F.col("m.own").alias("mid_own")), "v")
    star = star.where((F.col("rep") != F.col("mid")) & reachable("n", "own", "mid_n", "mid_own"))
    star = star.select(F.least("rep", "mid").alias("a"), F.greatest("rep", "mid").alias("b")).distinct()

    edges = materialise(verify(light.unionByName(star).distinct(), sets), "links")
    labels = components(edges)
    named_by = lambda d, c: d.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_l")), c, "left").withColumn(f"{c}_l", F.coalesce(f"{c}_l", c))
    members = named_by(heavy.select("v", "rep", "n"), "rep")
    mixed = members.groupBy("v").agg(F.min("rep_l").alias("lo"), F.max("rep_l").alias("hi")).where("lo <> hi").select("v")
    members = materialise(members.join(mixed, "v").select("rep", "n", "rep_l").distinct(), "mixed")
    rest = by_prefix(hashes(sets.join(members, "rep")).join(once.where("c > 1").select("h", "c"), "h"), members)
    more = materialise(verify(rest, sets), "links")
    if not more.isEmpty():
        joined = named_by(named_by(more, "a"), "b").select(F.col("a_l").alias("a"), F.col("b_l").alias("b"))
        over = components(joined).select(F.col("node").alias("label"), F.col("label").alias("top"))
        every = labels.unionByName(
            more.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
        ).groupBy("node").agg(F.min("label").alias("label"))
        labels = every.join(over, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    found = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(*key, "rep", F.coalesce("label", "rep").alias("found"))
    of_class, of_own = found.join(apart, key, "left_anti").drop("rep"), found.join(apart, key, "left_semi").select(F.col("rep").alias("doc_id"), F.col("found").alias("found_alone"))
    out = feats.select("doc_id", *key).join(of_class, key, "left").join(of_own, "doc_id", "left").withColumn("found", F.coalesce("found_alone", "found"))
    component = F.when(F.col("n") > 0, F.coalesce("found", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM t),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS v FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c, any_value(x.n) AS na, any_value(y.n) AS nb
  FROM e x JOIN e y ON x.v = y.v AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS top FROM documents UNION SELECT g.b, r.top FROM r JOIN g ON g.a = r.node),
c AS (SELECT node, min(top) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON c.node = s.doc_id
"""
