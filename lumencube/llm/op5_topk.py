"""Exact top-k search by inner product: M-trees, searched best first, in two rounds.

Vectors are made integer, shorter ones padded with zeros. Equal vectors are one entry, with their smallest ids. Routing
vectors are taken from a bounded sample; every entry goes to its nearest one, and each of these sets is cut into parts of
bounded size by a hash; every part is an M-tree (mtree.py), built in one task. Routing vectors cover their parts by one
radius each, so the table of them is the top of the tree, and its size is bounded by a parameter.
In the first round a block of queries searches one tree of each query's nearest routing vector, which gives a bound on
its k-th score. In the second it searches the trees of the routing vectors whose radius the bound allows; inside a tree
the bound shrinks while pages are read. Scores are exact integer products.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table
from .mtree import Tree

BLOCK = "block long, qids binary, q binary, least binary"
FOUND = "query_id long, vec_id long, score long"


def integer_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, v array<bigint>): floor(256 x) of each component as double; rows with null or non-finite parts are left out.

    A component whose integer form is no 64-bit number (2^55 or more) raises an error.
    """
    x = F.col("embedding")
    ok = x.isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = lambda e: F.when(F.abs(e) < 2.0**63, F.floor(e)).otherwise(F.raise_error(F.lit("256 times a component is no 64-bit number")).cast("long"))
    return rows.where(F.coalesce(ok, F.lit(False))).select("vec_id", F.transform(F.transform(x, lambda e: e.cast("double") * 256), whole).alias("v"))


def smallest_ids(vectors: DataFrame, most: int) -> DataFrame:
    """(v, ids): of each distinct vector, its `most` smallest vec_ids; a large group is first cut in 64 parts."""
    parts = vectors.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    first = Window.partitionBy("v", "part").orderBy("vec_id")
    parts = parts.withColumn("r", F.row_number().over(first)).where(F.col("r") <= most)
    parts = parts.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= most)
    return parts.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def dealt(near: DataFrame, most: int) -> DataFrame:
    """near plus salt: cuts each route of over `most` entries, by a hash of the vector, into parts of about as many."""
    parts = near.groupBy("route").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    near = near.join(F.broadcast(parts), "route")  # at most as many rows as there are routing vectors
    return near.withColumn("salt", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")).drop("parts")


class Space:
    """What all tasks share: the length of vectors, M, the routing vectors, and how products are made.

    They are exact: as floats below 2^53, as 64-bit integers below 2^63, else as Python's integers. top and q_top: the
    largest squared norms of entries and of queries, as doubles; no product is above the root of their product.
    """

    def __init__(self, dim: int, top: float, q_top: float, routes: list[list[int]]):
        self.dim, self.top = dim, max(top, q_top)
        most = np.sqrt(top) * np.sqrt(q_top) * (1 + 1e-9)
        self.kind = np.float64 if self.top * (1 + 1e-9) < 2.0**53 else np.int64
        self.wide = most >= 2.0**63
        self.routes = self.matrix(routes)
        self.lift = np.sqrt(np.maximum(0.0, self.top - (self.routes.astype(np.float64) ** 2).sum(1)))

    def matrix(self, column) -> np.ndarray:
        out = np.zeros((len(column), self.dim), self.kind)
        for i, v in enumerate(column):
            out[i, : len(v)] = v
        return out

    def to_routes(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Distances of entries, or of queries (whose lifted coordinate is 0), to the routing vectors."""
        norm = (x.astype(np.float64) ** 2).sum(1)
        lift = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.top - norm))
        dots = x.astype(np.float64) @ self.routes.T.astype(np.float64)
        return np.sqrt(np.maximum(0.0, (norm + lift**2)[:, None] + self.top - 2 * (dots + lift[:, None] * self.lift)))


def build_trees(entries: DataFrame, space: Space, shard_rows: int, page_rows: int) -> tuple[DataFrame, DataFrame]:
    """(route, salt, tree), a row a tree; and (route, radius), a row a routing vector that has entries."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = space.to_routes(space.matrix(b["v"]), query=False)
                near = d.argmin(1)
                yield b.assign(route=near.astype(np.int32), distance=d[np.arange(len(b)), near])

    near = materialise(entries.mapInPandas(assign, "v array<bigint>, ids array<bigint>, route int, distance double"), "near")

    def build(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("distance", kind="stable")
        tree = Tree(space.matrix(b["v"]), space.top, page_rows, wide=space.wide)
        content = pickle.dumps((tree, [np.asarray(i).tolist() for i in b["ids"]]))
        return pd.DataFrame({"route": [key[0]], "salt": [key[1]], "tree": [content]})

    trees = dealt(near, shard_rows).groupBy("route", "salt").applyInPandas(build, "route int, salt int, tree binary")
    return materialise(trees, "trees"), near.groupBy("route").agg(F.max("distance").alias("radius"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, page_rows: int = 256, block: int = 256, most_routes: int = 256, shard_rows: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other vectors, ties to the smaller vec_id.

    vectors and queries: (vec_id, embedding); a query's own vec_id is no candidate. Rows with null or non-finite parts take
    no part; a score that is no 64-bit number raises an error. Vectors that are shorter than the longest count as padded with zeros,
    empty ones as zeros. Repeated rows count once. An empty table gives no rows; with fewer than k others, a query has
    fewer rows. most_routes bounds the routing vectors, and so what each task gets of them; shard_rows is about the size
    of a tree (by default a fortieth of the entries, at least 256 and at most 8192).
    """
    spark = vectors.sparkSession
    entries = materialise(smallest_ids(integer_vectors(vectors).distinct(), k + 1), "entries")
    asked = materialise(integer_vectors(queries).distinct(), "asked")
    norm = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    measures = [F.count("*"), F.max(norm), F.max(F.size("v"))]
    (n, top, dim), (asks, q_top, q_dim) = entries.agg(*measures).first(), asked.agg(*measures).first()
    if not n or not asks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    want = int(min(most_routes, max(1, round(np.sqrt(n / 8)))))
    sample = entries.orderBy(F.xxhash64("v"), "v").limit(want).select("v").collect()
    space = Space(max(dim, q_dim, 1), top, q_top, [r["v"] for r in sample])
    trees, covers = build_trees(entries, space, shard_rows or int(min(8192, max(256, n // 40))), page_rows)
    radius = np.full(want, -np.inf)
    for r in covers.collect():  # at most most_routes rows
        radius[r["route"]] = r["radius"]

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                q = space.matrix(b["v"])
                order = np.lexsort((b["vec_id"].to_numpy(), np.where(radius < 0, np.inf, space.to_routes(q, query=True)).argmin(1)))
                for s in range(0, len(b), block):
                    ids, some = b["vec_id"].to_numpy()[order[s : s + block]], q[order[s : s + block]]
                    none = np.full(len(ids), -np.inf)
                    yield pd.DataFrame({"block": [int(ids.min())], "qids": [ids.astype(np.int64).tobytes()], "q": [some.tobytes()], "least": [none.tobytes()]})

    asked = materialise(asked.mapInPandas(blocks, BLOCK), "queries")

    def unpack(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(r.qids, np.int64), np.frombuffer(r.q, space.kind).reshape(-1, space.dim), np.frombuffer(r.least, np.float64)

    def wanted(q: np.ndarray, least: np.ndarray, nearest: bool) -> np.ndarray:
        """Which queries (rows) need the trees of which routing vectors."""
        d = space.to_routes(q, query=True)
        if nearest:
            return np.arange(d.shape[1]) == np.where(radius < 0, np.inf, d).argmin(1)[:, None]
        norm = (q.astype(np.float64) ** 2).sum(1)
        bound = np.sqrt(np.maximum(0.0, norm + space.top - 2 * np.where(np.isinf(least), 0, least))) + 1e-6 * (np.sqrt(norm + space.top) + 1)
        return d - radius <= np.where(np.isinf(least), np.inf, bound)[:, None]

    def visit(asking: DataFrame, nearest: bool) -> DataFrame:
        """FOUND rows of the trees that the blocks' queries need; nearest: of the first tree of each query's nearest route."""

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.itertuples():
                    qids, q, least = unpack(r)
                    need = wanted(q, least, nearest)
                    for k in np.flatnonzero(need.any(0)):  # the queries that want this route alone
                        some = need[:, k]
                        yield pd.DataFrame({"route": np.int32([k]), "block": [r.block], "qids": [qids[some].tobytes()], "q": [q[some].tobytes()], "least": [least[some].tobytes()]})

        def run(key: tuple, asked_here: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            out = []
            for t in held["tree"]:
                tree, ids = pickle.loads(t)
                for r in asked_here.itertuples():
                    for own, q, least in zip(*unpack(r), strict=True):
                        out += [(int(own), x, s) for s, x in tree.search(q, k, ids, int(own), float(least))]
            if any(abs(s) >= 1 << 63 for _, _, s in out):
                raise ArithmeticError("a score is no 64-bit number")
            return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype(np.int64)

        # A tree meets about 16 blocks at a time, so that it is copied for them once.
        own, parts = trees.where("salt = 0") if nearest else trees, max(1, -(-asks // (16 * block)))
        pairs = asking.mapInPandas(route, "route int, " + BLOCK).join(own.selectExpr("route", "salt AS of_salt"), "route")
        pairs = pairs.select(F.col("route").alias("of_route"), "of_salt", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("of_part"), "block", "qids", "q", "least")
        held = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return pairs.groupBy("of_route", "of_salt", "of_part").cogroup(held.groupBy("route", "salt", "part")).applyInPandas(run, FOUND)

    def best(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def with_least(found: DataFrame) -> DataFrame:
        """asked with each query's k-th best score so far (minus infinity before it has k)."""

        def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            r = left.iloc[0]
            # The next float below a score, so that one of over 53 bits isn't rounded up.
            by = dict(zip(right["query_id"], np.nextafter(right["score"].to_numpy(np.float64), -np.inf), strict=True))
            least = np.array([by.get(int(x), -np.inf) for x in np.frombuffer(r["qids"], np.int64)], np.float64)
            return pd.DataFrame({"block": [r["block"]], "qids": [r["qids"]], "q": [r["q"]], "least": [least.tobytes()]})

        ids = asked.select("block", "qids").mapInPandas(
            lambda bs: (pd.DataFrame({"block": r.block, "query_id": np.frombuffer(r.qids, np.int64)}) for b in bs for r in b.itertuples()),
            "block long, query_id long",
        )
        mine = found.where(F.col("rank") == k).join(ids, "query_id")  # a row a query
        return asked.groupBy("block").cogroup(mine.groupBy("block")).applyInPandas(run, BLOCK)

    first = materialise(best(visit(asked, True)), "first")
    rest = visit(with_least(first), False)
    final = best(rest.unionByName(first.select("query_id", "vec_id", "score")).distinct())
    return final.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 50 = 0"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
