"""Best-fit packing, whitening and the Merkle manifest against brute force, and on odd tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from lumencube.llm import op11_bestfit, op12_whitening, op13_merkle
from lumencube.llm.op3_packing import tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, grp string, idx int, part string, row int, length int, h string, size int, at int, path string"
EXTRA = ("x", 1, "y", 2, 3, "z", 4, 5, "p")


def table_of(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS)


# Best-fit packing


def best_fit_decreasing(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(size - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.choice([7, 16, 33, 100]))
    lengths = rng.integers(1, size + 1, 400) if seed % 3 else np.minimum(size, rng.geometric(0.1, 400))
    counts = Counter(lengths.tolist())
    held, seen = defaultdict(list), Counter()
    runs = op11_bestfit.plan(counts, size)
    for (n, rank, first, each, used), after in zip(runs, [*runs[1:], None], strict=True):
        end = after[1] if after is not None and after[0] == n else counts[n]
        for i in range(rank, end):
            held[first + (i - rank) // each].append((used + (i - rank) % each * n, n))
            seen[n] += 1
    assert seen == counts
    rooms = []
    for pieces in held.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        rooms.append(size - at)
    assert sorted(rooms) == best_fit_decreasing(lengths, size)
    assert len(runs) <= 4 * size * (np.log2(size) + 1)


def test_tightest_room():
    bins = op11_bestfit.OpenBins(10)
    assert bins.tightest(1) is None
    bins.add(4, 0, 1), bins.add(7, 1, 2), bins.add(0, 3, 1)
    assert [bins.tightest(n) for n in (1, 4, 5, 7, 8, 10)] == [4, 4, 7, 7, None, None]
    assert bins.take(7) == (1, 2) and bins.tightest(5) is None


def test_best_fit_pieces(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    rng = np.random.default_rng(3)
    texts = [None, "", "same words here", "same words here", "many words " * 5000, "İΣ 😀 <|endoftext|>"] + ["word " * int(n) for n in rng.integers(0, 300, 120)]
    rows = [(i if i != 7 else None, t, "en", "s", 0) for i, t in enumerate(texts)] + [(2, "again, with an id that is taken", "en", "s", 0)]
    size = 256
    got = op11_bestfit.pack(table_of(spark, rows).repartition(5), tokenizer_path(), size).collect()
    ids_of = lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 0]
    want = Counter()
    lengths = []
    for doc, text, *_ in rows:
        ids = ids_of(text)
        for piece, start in enumerate(range(0, len(ids), size)):
            part = ids[start : start + size]
            want[doc, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
            lengths.append(len(part))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    rooms = []
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        rooms.append(size - at)
    assert sorted(rooms) == best_fit_decreasing(lengths, size)
    assert op11_bestfit.pack(table_of(spark, []), tokenizer_path()).count() == 0


# Whitening


def covariance_of(vectors):
    x = np.floor(64 * np.array(vectors, np.float64)) + 1_000_000
    c = x - x.mean(0)
    return x.astype(np.int64), c, c.T @ c / len(c)


def whitened(out, k):
    return {c: {r.vec_id: r for r in out if r.component == c} for c in range(1, k + 1)}


def check_whitening(out, ids, vectors, k):
    x, c, v = covariance_of(vectors)
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    sums, n = x.sum(0), len(x)
    by = whitened(out, k)
    got = np.array([[by[j + 1][i].whitened for j in range(k)] for i in ids])
    for j in range(k):
        want = c @ w[:, j] / np.sqrt(e[j])
        sign = np.sign(want @ got[:, j])
        assert np.abs(sign * want - got[:, j]).max() < 1e-7
        assert abs(by[j + 1][ids[0]].explained - e[j] / np.trace(v)) < 1e-10
    for i, row in zip(ids, x, strict=True):
        r = by[1][i]
        assert (r.n, int(r.deviation)) == (n, sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)))
    assert len({r.identity_error for r in out}) == 1 and out[0].identity_error < 1e-9
    assert np.abs(got.T @ got / n - np.eye(k)).max() < 1e-9


def vectors_of(spark, ids, vectors):
    return spark.createDataFrame([(int(i), [float(a) for a in v], 1, 2.0, "x") for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>, label int, deviation double, w string")


@pytest.mark.parametrize("spread", [1.0, 1e-3])
def test_whitening_equals_eigh(spark, spread):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(300, 40)) @ rng.normal(size=(40, 40)) * np.linspace(1, spread, 40) * 30).astype(np.float32)
    out = op12_whitening.whiten(vectors_of(spark, range(300), vectors).repartition(3)).collect()
    assert len(out) == 300 * 32
    check_whitening(out, list(range(300)), vectors, 32)


def test_whitening_of_an_ill_conditioned_table(spark):
    rng = np.random.default_rng(2)
    vectors = np.round(rng.normal(size=(200, 6)) * [3e5, 1e4, 1e2, 10, 1, 1]) / 64
    out = op12_whitening.whiten(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")).collect()
    x, c, v = covariance_of(vectors)
    _, sigma, vt = np.linalg.svd(c, full_matrices=False)
    by = whitened(out, 6)
    for j in range(6):
        want = c @ vt[j] / (sigma[j] / np.sqrt(200))
        got = np.array([by[j + 1][i].whitened for i in range(200)])
        assert np.abs(np.sign(want @ got) * want - got).max() < 1e-6
        assert abs(by[j + 1][0].explained / (sigma[j] ** 2 / (sigma**2).sum()) - 1) < 1e-6
    assert out[0].identity_error < 1e-8


def test_whitening_without_some_variance(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(100, 3)) * 5
    vectors = np.round(np.c_[a, a[:, 0], np.full(100, 7.5), a[:, 1]] * 64) / 64  # two repeated dimensions, a constant one
    fit = op12_whitening.Whitening(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>"))
    assert fit.rank == 3
    out = op12_whitening.whiten(vectors_of(spark, range(100), vectors)).collect()
    assert len(out) == 600 and out[0].identity_error < 1e-9
    assert all((r.whitened is None) == (r.component > 3) and (r.explained == 0) == (r.component > 3) for r in out)
    check_whitening([r for r in out if r.component <= 3], list(range(100)), vectors, 3)
    same = op12_whitening.whiten(vectors_of(spark, range(4), [[1.0, 2.0]] * 4)).collect()
    assert len(same) == 8 and all(r.whitened is None and r.deviation == 0 and r.n == 4 for r in same)


def test_whitening_edges(spark):
    rng = np.random.default_rng(5)
    good = [rng.normal(size=4).tolist() for _ in range(30)]
    rows = [(i, v) for i, v in enumerate(good)] + [(3, good[3]), (None, good[4]), (40, None), (41, [1.0, None, 2.0, 3.0]), (42, [1.0, float("nan"), 0.0, 0.0]), (43, [float("inf")] * 4), (44, [1.0, 2.0]), (45, [])]
    out = op12_whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    assert {r.n for r in out} == {34} and Counter(r.vec_id for r in out)[3] == 8 and Counter(r.vec_id for r in out)[None] == 4
    assert {r.vec_id for r in out} == {None, *range(30), 44, 45}
    full = [*good, good[3], good[4], [1.0, 2.0, 0, 0], [0.0] * 4]
    _, c, v = covariance_of(full)
    assert abs(next(r.explained for r in out if r.component == 1) - np.linalg.eigvalsh(v)[-1] / np.trace(v)) < 1e-12
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert op12_whitening.whiten(none).count() == 0 and op12_whitening.whiten(spark.createDataFrame([(1, [])], "vec_id long, embedding array<float>")).count() == 0


def test_whitening_of_large_entries_is_exact(spark):
    vectors = [[3e12, 1.0], [-3e12, 2.0], [1e12, -5.0]]
    out = op12_whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).where("component = 1").collect()
    x = [[int(np.floor(64 * a)) + 1_000_000 for a in v] for v in vectors]
    for r in out:
        assert int(r.deviation) == sum((3 * a - sum(col)) ** 2 for a, col in zip(x[r.vec_id], zip(*x, strict=True), strict=True))
    with pytest.raises(Exception, match="exact integer form"):
        op12_whitening.whiten(spark.createDataFrame([(1, [1e30, 1.0])], "vec_id long, embedding array<double>"))


# Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def spelled(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def proofs(nodes, arity):
    """The top, and each node's path as (before, after) by level."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, at in zip(paths, place, strict=True):
            run = at - at % arity
            p.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + arity])))
        nodes = [sha("".join(nodes[k : k + arity])) for k in range(0, len(nodes), arity)]
        place = [p // arity for p in place]
    return nodes[0], paths


def plain_manifest(rows, arity=3):
    by = defaultdict(list)
    for doc, text, lang, source, n in rows:
        leaf = spelled(doc, source, lang, n, text)
        even = zlib.crc32(("" if doc is None else str(doc)).encode()) % 2 == 0
        other = spelled(doc, source, lang, n, text.replace("\n", "")) if even and text is not None else leaf
        by[source].append(((doc is not None, doc or 0), leaf, doc, other))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    tops = []
    for s in sources:
        by[s].sort()
        tops.append(proofs([r[1] for r in by[s]], arity))
    root, above = proofs([t for t, _ in tops], arity)
    out = []
    for s, (top, paths), up in zip(sources, tops, above, strict=True):
        for (_, leaf, doc, other), path in zip(by[s], paths, strict=True):
            node = other
            for a, b in path + up:
                node = sha(a + node + b)
            out.append((doc, leaf, top, root, sha("".join(a + b for a, b in path + up)), node, node == root))
    return out


def rows_of(out):
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in out)


@pytest.mark.parametrize("arity", [3, 2, 5])
def test_merkle_equals_a_plain_tree(spark, arity):
    rng = np.random.default_rng(6)
    rows = [(int(i), f"line {i}\nnext é{i}" if i % 3 else "no break", "en" if i % 2 else None, [None, "", "hot", "hot", "hot", "b"][i % 6], int(i)) for i in rng.permutation(200)]
    rows += [(500, None, None, "lone", None), (501, "", "de", "é", 0), (None, "no\nid", "en", "hot", 1), (7, "an id\nthat is taken", "en", "hot", 2), (7, "an id\nthat is taken", "en", "hot", 2)]
    rows += [(9, "copy\n", "en", "copies", 1)] * 40 + [(600, "long\n" * 50_000, "en", "b", 9)]
    got = op13_merkle.manifest(table_of(spark, rows).repartition(4), arity).collect()
    assert rows_of(got) == Counter(plain_manifest(rows, arity))
    assert 0 < sum(r.verified for r in got) < len(got)


@pytest.mark.parametrize("rows", [[], [(1, "a\nb", "en", "s", 3)], [(i, "a\nb", "en", "s", 3) for i in range(4)], [(i, "x", "en", f"s{i}", 3) for i in range(4)]])
def test_merkle_of_few_rows(spark, rows):
    got = op13_merkle.manifest(table_of(spark, rows)).collect()
    assert rows_of(got) == Counter(plain_manifest(rows) if rows else [])


def test_merkle_equals_sql(spark):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = db.execute(op13_merkle.ORACLE).df()
    got = op13_merkle.op13_merkle(spark, SF).toPandas()
    order = lambda x: x[sorted(x.columns)].astype(str).sort_values(["doc_id", "leaf"]).reset_index(drop=True)
    assert order(got).equals(order(want))
