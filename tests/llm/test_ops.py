"""The ten operators on small hand-made tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import re
import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from lumencube.llm import op1_license, op2_toxicity, op3_packing, op4_language, op5_topk, op6_neardup, op7_fingerprint, op8_mixing, op9_pii, op10_quality

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, found string, bucket int, label string"
LONG = "word " * 30_000 + "x" * 20_000 + " 1.2.3.4 " + "9" * 5_000 + " a@b.c" + ".d" * 3000
TEXTS = [
    None, "", " \n\t", LONG, "Released under the MIT License. MIT License", "Licensed under CC BY-NC 4.0.", "İSTANBUL ΣΑΣ 😀 é é <|endoftext|>",
    "Call +1 (988) 555-2485 or a.b@c.example.com, 10.0.0.256 10.0.0.1 4539 1488 0343 6467", "one two three four five six seven", "one two three four five six seven", "ONE TWO three four five six seven",
    "THIS   IS\ncanonical", "this is canonical", "you idiot", "word",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 7, t, "en" if i % 2 else None, None if i % 3 else f"s{i % 2}", None, 0.5, "x", 1, "y") for i, t in enumerate(TEXTS)]
    rows += [rows[8], (None, "no id here at all my friend", "en", "s1", 1, 0.1, "x", 1, "y")]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def same(a, b, key):
    a, b = (x[sorted(x.columns)].sort_values(key).reset_index(drop=True).astype(str) for x in (a, b))
    assert a.equals(b)


def test_license(spark, docs, none):
    out = {r.doc_id: r for r in op1_license.license_scan(docs).collect()}
    assert (out[28].n_base, out[28].first_word, out[28].last_word, out[28].base_labels) == (2, 3, 5, "mit")
    assert out[35].base_labels == "cc-by" and "cc-by-nc" in out[35].labels.split(",") and out[35].score == 1.0
    assert (out[0].n_words, out[0].n_base, out[0].first_word, out[0].labels, out[0].score) == (0, 0, None, "", 0.0)
    assert op1_license.license_scan(docs).count() == docs.count() and op1_license.license_scan(none).count() == 0


def test_license_near_template(spark, docs):
    words = "this work is licensed under the gnu general public licence version 3"  # one word differs
    texts = [words, "the work is under the version 3", "Licensed under CC BY 4.0.", "Licensed under CC BY-NC 4.0.", "licensed under cc by sa 4 0"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in op1_license.license_scan(df).collect()}
    assert got == {0: "gpl", 1: "", 2: "cc-by", 3: "cc-by,cc-by-nc", 4: "cc-by,cc-by-sa"}


def test_license_join_equals_all_blocks_with_all_templates(spark):
    rng = np.random.default_rng(5)
    long_one = " ".join(f"t{i}" for i in range(60))
    templates = [("a", long_one), ("b", "alpha beta gamma delta epsilon zeta eta"), ("b2", "alpha beta gamma delta epsilon zeta eta theta"), ("c", "one two one three")]
    texts = []
    for i in range(150):
        filler = [f"w{k}" for k in rng.integers(0, 30, rng.integers(0, 120))]
        words = [w for w in rng.choice([t for _, t in templates]).split() if rng.random() > 0.08]
        for _ in range(rng.integers(0, 4)):
            words.insert(int(rng.integers(0, len(words) + 1)), "x")
        at = int(rng.integers(0, len(filler) + 1))
        texts.append(" ".join(filler[:at] + words + filler[at:]))
    texts += [" ".join(["y"] * k) + " " + long_one for k in range(0, 40, 3)] + ["", "theta " * 50, "one two " * 30 + "three"]
    made = op1_license.Templates(templates, 0.85)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    scanned = op1_license.materialise(op1_license.scan(df, made), "scan")
    ids = {r.id: r.doc_id for r in scanned.collect()}
    got = {}
    for r in op1_license.template_join(scanned, made).collect():
        key = (ids[r.id], r.template)
        got[key] = max(got.get(key, 0), r.containment)
    want = {}
    for i, text in enumerate(texts):
        words = text.split()
        for t, (_, template) in enumerate(templates):
            of, span = set(template.split()), made.span[t]
            best = max((len(of & set(words[k : k + span])) for k in range(len(words))), default=0)
            if best >= made.need[t]:
                want[i, t] = best / len(of)
    assert got == want and len(want) > 60


def test_license_base_places_equal_a_plain_search(spark, docs):
    texts = ["mit license apache license MIT-License", "cc cc by by cc by", "gnu general public license " * 3, "ﬁ cc by ｃｃ by", "x\x7fmit license"] + TEXTS
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in op1_license.license_scan(df).collect():
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[r.doc_id] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
        hits = sorted((k, label) for p, label in op1_license.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        assert (r.n_words, r.n_base) == (len(words), len(hits))
        assert (r.first_word, r.last_word) == ((hits[0][0], hits[-1][0]) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in hits}))


def test_license_winners_equal_all_pairs():
    rng = np.random.default_rng(11)
    made = op1_license.Templates(op1_license.TEMPLATES, 0.85)
    finder = op1_license.Blocks(made, {})
    for _ in range(60):
        words = []
        for _ in range(rng.integers(1, 7)):
            own = op1_license.TEMPLATES[rng.integers(0, len(op1_license.TEMPLATES))][1].split()
            words += [w for w in own if rng.random() > 0.05] + ["x"] * int(rng.integers(0, 30))
        hits = [(i, made.number[w.encode()]) for i, w in enumerate(words) if w.encode() in made.number]
        blocks = finder.of(*(np.array(c, np.int64) for c in zip(*hits)))
        rows = [(made.labels[t], k / len(made.tokens[t]), k, a, z) for t, a, z, k in blocks.tolist()]
        beats = lambda y, x: y[0] != x[0] and y[1:3] > x[1:3] and 2 * (min(x[4], y[4]) - max(x[3], y[3]) + 1) >= x[4] - x[3] + 1
        want = sorted({x[0] for x in rows if not any(beats(y, x) for y in rows)})
        assert finder.winners(blocks) == (want, max((r[1] for r in rows), default=0.0))
        for t in {b[0] for b in blocks.tolist()}:  # the blocks of a template lie apart, and the best is among them
            starts = sorted(b[1] for b in blocks.tolist() if b[0] == t)
            assert all(b - a >= made.span[t] for a, b in zip(starts, starts[1:]))


def test_license_of_a_text_with_thousands_of_paragraphs(spark):
    gpl, bsd = op1_license.TEMPLATES[2][1], op1_license.TEMPLATES[18][1]
    df = spark.createDataFrame([(1, f"{gpl} x y {bsd} " * 3000), (2, "the of to " * 100_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in op1_license.license_scan(df).collect()}
    assert got[1].labels == "bsd,gpl" and got[1].n_base == 3000 and got[1].score == 1.0 and got[2].labels == "" and got[2].n_words == 300_000


def test_toxicity_learns_and_generalises():
    good = [f"the quiet river number {i} runs past the old mill and the green hill" for i in range(300)]
    bad = [g.replace("old", "stupid" if i % 2 else "idiotic") for i, g in enumerate(good)]
    s = op2_toxicity.Model().fit(good + bad, np.repeat([0, 1], 300)).scorer()
    got = s.score([good[3], bad[3], "past the stupidd mill and the green hill", "", None])
    assert got[0] < 0.5 < got[1] and got[2] > 0.5 and got[3] == got[4] == 0


def test_toxicity_edges(docs, none):
    model = op2_toxicity.train(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"))
    assert op2_toxicity.toxicity(docs, model).count() == docs.count() and op2_toxicity.toxicity(none, model).count() == 0
    assert op2_toxicity.toxicity(docs, op2_toxicity.train(none, none.selectExpr("doc_id", "1 as toxic"))).where("score between 0 and 1").count() == docs.count()


def test_toxicity_scores_equal_a_plain_average():
    texts = ["some quiet words", "some stupid words " * 5, "a", "ünïcode words " * 3, "stupid"] * 4
    model = op2_toxicity.Model(buckets=1 << 12).fit(texts, np.array([0, 1, 0, 0, 1] * 4), epochs=2)
    for text, score in zip(texts, model.scorer().score(texts), strict=True):
        vectors = []
        for w in op2_toxicity.tokens(text):
            ids, _ = op2_toxicity.bags([w], model.buckets)
            vectors.append(model.e[ids].mean(0))
        u = np.array(vectors, np.float64)
        weight = np.exp(u @ model.v)
        logits = (weight[:, None] * u).sum(0) / weight.sum() @ model.w + model.b
        assert abs(1 / (1 + np.exp(logits[0] - logits[1])) - score) < 1e-5


def test_toxicity_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(2)
    model = op2_toxicity.Model(buckets=64, dim=3)
    model.e = rng.normal(0, 1, model.e.shape).astype(np.float64)
    model.w, model.v, model.b = (rng.normal(0, 1, x.shape).astype(np.float64) for x in (model.w, model.v, model.b))
    rows, size = rng.integers(0, 64, 9), np.array([2, 3, 4])
    word, times, lengths, y = np.array([0, 1, 2, 0, 2]), np.array([1.0, 2, 1, 3, 1]), np.array([3, 2]), np.array([1, 0])

    def loss() -> float:
        u = np.stack([model.e[rows[a:z]].mean(0) for a, z in ((0, 2), (2, 5), (5, 9))])
        total, at = 0.0, 0
        for n, label in zip(lengths, y, strict=True):
            w = word[at : at + n]
            a = times[at : at + n] * np.exp(u[w] @ model.v)
            z = (a / a.sum()) @ u[w] @ model.w + model.b
            total, at = total - z[label] + np.log(np.exp(z).sum()), at + n
        return total

    def slope(x: np.ndarray, at: tuple) -> float:
        x[at] += 1e-5
        up = loss()
        x[at] -= 2e-5
        down = loss()
        x[at] += 1e-5
        return (up - down) / 2e-5

    want = [slope(model.v, (1,)), slope(model.w, (2, 0)), slope(model.e, (int(rows[4]), 1))]
    before = model.v.copy(), model.w.copy(), model.e.copy()
    one = [np.zeros(64), np.zeros(3), np.zeros((3, 2))]  # Adagrad's sums: a step is rate * gradient / sqrt(sum)
    model._step(rows, size, word, times, lengths, y, one, 1.0)
    assert np.allclose((before[0] - model.v)[1] * np.sqrt(one[1][1]), want[0], atol=1e-4) and np.allclose((before[1] - model.w)[2, 0] * np.sqrt(one[2][2, 0]), want[1], atol=1e-4)
    assert np.allclose((before[2] - model.e)[rows[4], 1] * np.sqrt(one[0][rows[4]]), want[2], atol=1e-4)


BIG = [2**60 + 1, 2**60 + 3, None]


@pytest.fixture(scope="module")
def big(spark):
    """Large ids beside a null one in one batch, repeated rows, ties and a long text."""
    rows = [(i, f"some plain text number {k} with words of its own {'abcdefgh'[k]}", 3, "en") for k, i in enumerate(BIG)]
    rows += [(7, "twice the same", 1, "en")] * 2 + [(8, "word " * 50_000, 1, "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, score int, lang string").coalesce(1)


def test_ids_stay_as_they_are(spark, big, docs):
    want = sorted(map(str, [*BIG, 7, 7, 8]))
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic", "cast(doc_id % 2 as int) as quality")
    outs = [
        op2_toxicity.toxicity(big, op2_toxicity.train(docs, labels)), op10_quality.quality(big, op10_quality.train(docs, labels)), op6_neardup.near_duplicates(big),
        op4_language.identify(big, op4_language.learn(docs)), op1_license.license_scan(big), op7_fingerprint.fingerprints(big), op8_mixing.choose(big.selectExpr("*", "lang as source")), op9_pii.pii(big),
    ]
    for out in outs:
        rows = out.collect()
        assert sorted(str(r.doc_id) for r in rows) == want
        assert "near_next" in out.columns or len({str(r) for r in rows if r.doc_id == 7}) == 1  # op7's rows differ in the next one
    near = {r.doc_id: r for r in outs[2].collect()}
    assert near[BIG[0]].component_id == BIG[0] and near[BIG[1]].component_id == BIG[1] and near[BIG[1]].kept
    packed = op3_packing.pack(big, op3_packing.tokenizer_path()).collect()
    assert {r.doc_id for r in packed} == {*BIG, 7, 8}
    assert all(sum(p.length for p in packed if p.doc_id == i) == next(p.doc_tokens for p in packed if p.doc_id == i) for i in BIG)


def test_packing_round_trip(docs, none):
    from tokenizers import Tokenizer

    path = op3_packing.tokenizer_path()
    encoder = Tokenizer.from_file(path)
    out = op3_packing.pack(docs, path, size=64, open_windows=2, merge=2).toPandas()
    for i, t in enumerate(TEXTS):
        ids = np.array([*encoder.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        mine, at = out[out.doc_id == i * 7].drop_duplicates("start").sort_values("start"), 0
        for r in mine.itertuples():
            assert r.doc_tokens == len(ids)
        mine = out[out.doc_id == i * 7].sort_values("start")
        if i != 8:
            for r in mine.itertuples():
                assert r.start == at and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
                at += r.length
            assert at == len(ids)
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.to_numpy() == np.concatenate([[0], np.cumsum(s.length)[:-1]])).all()
        n = int(s.length.sum())
        assert n <= 64 and n & (n - 1) == 0
    assert op3_packing.pack(none, path).count() == 0


def test_language(spark, docs, none):
    model = op4_language.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    out = op4_language.identify(docs, model)
    assert out.count() == docs.count() and set(docs.columns) - {"score"} <= set(out.columns)
    rows = {r.doc_id: r for r in out.collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].rejected for i in (0, 7, 14))
    far = spark.createDataFrame([(1, "Съешь же ещё этих мягких французских булок")], "doc_id long, text string")
    assert op4_language.identify(far, model).first().rejected
    assert op4_language.identify(none, model).count() == 0 and op4_language.identify(docs, op4_language.learn(none)).where("lang_pred = 'und'").count() == docs.count()


def test_language_keeps_all_grams(spark):
    # Over 300,000 different 4-grams of one language: all count, the single ones too, and each language is calibrated.
    rng = np.random.default_rng(0)
    words = ["".join(chr(0x4E00 + c) for c in w) for w in rng.integers(0, 5000, (12_000, 38))]
    rows = [(i, " ".join(words[k : k + 100]), "zh") for i, k in enumerate(range(0, len(words), 100))]
    rows += [(10_000 + i, "a few plain words of another tongue", "en") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = op4_language.learn(df)
    n = op4_language.gram_counts(df.where(~op4_language.held_out(4, 2))).where("lang = 'zh'").count()
    assert n > 300_000 and len(got.models["zh"].hashes[3]) == n and np.isfinite(got.deviation).all()


def test_language_calibrates_on_all_rows(spark):
    # More training rows a language than any sample of 2000 has room for; repeated ids and rows without one count each, held-out ones don't.
    rng = np.random.default_rng(5)
    rows = []
    for lang, letters in (("aa", "abcdeé"), ("bb", "bcdfgß")):
        for i in range(1700):
            alphabet = list(letters[: 2 + i % 5])
            rows.append((2 * i + (lang == "bb"), " ".join("".join(rng.choice(alphabet, rng.integers(1, 9))) for _ in range(rng.integers(1, 30))), lang))
        rows += [(None, f"{letters} {letters[:3]}", lang)] * 70 + [(9, letters * 3, lang)] * 60 + [(11, "½ 7", lang), (12, None, lang)]
    rows += [(20_000 + i, "zzz", None) for i in range(9)] + [(30_000, "qqq qqq", "cc")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = op4_language.learn(df)
    trained = [r for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 4 != 2]
    for lang in ("aa", "bb"):
        k, texts = got.langs.index(lang), [t for _, t, x in trained if x == lang]
        e, n = got.entropies(texts)
        e, n = e[n > 0, k], n[n > 0]
        assert len(e) > 1300 and abs(got.mean[k] - np.median(e)) < 1e-9
        assert abs(got.deviation[k] - np.sqrt(np.mean((e - np.median(e)) ** 2 * np.minimum(n, 256)))) < 1e-7
    if "cc" in got.langs:  # one text tells no deviation, so nothing is rejected
        assert got.deviation[got.langs.index("cc")] == np.inf
    sort = lambda d: sorted(map(tuple, d.select("doc_id", "text", "lang", "lang_pred", "score", "rejected").collect()), key=repr)
    assert sort(op4_language.identify(df, got, 2.0)) == sort(op4_language.identify_own(df, 2.0))


def test_language_medians(spark):
    rng = np.random.default_rng(6)
    groups = {"one": [0.75], "two": [1.0, 3.5], "even": [1.0] * 4 + [2.0] * 4, "odd": [2.0, 1.0, 1.0], "near": 1 + rng.random(1000) * 2.0**-12, "wide": rng.random(1001) * 40}
    df = spark.createDataFrame([(k, float(e)) for k, v in groups.items() for e in v], "lang string, e double")
    got = {r["lang"]: r["mean"] for r in op4_language.medians(df).collect()}
    assert set(got) == set(groups) and all(0 <= np.median(v) - got[k] < 2.0**-32 for k, v in groups.items())


def dictionary_model(words):
    """Interpolated Kneser-Ney over padded words, by dictionaries of tuples: log-probability of each 4-gram's last character."""
    full = Counter(tuple((["\0"] * 3 + ["<", *w, ">"])[i : i + 4]) for w in words for i in range(1, len(w) + 2))
    counts = {4: full}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    d, total, width = {}, {}, {}
    for n, c in counts.items():
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d[n] = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
        for g, v in c.items():
            total[n, g[:-1]] = total.get((n, g[:-1]), 0) + v
            width[n, g[:-1]] = width.get((n, g[:-1]), 0) + 1

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / 2000
        below = p(g[1:])
        if (n, g[:-1]) not in total:
            return below
        t = total[n, g[:-1]]
        return max(counts[n][g] - d[n], 0) / t + d[n] * width[n, g[:-1]] / t * below if n > 1 else max(counts[1][g] - d[1], 0) / t + d[1] * width[1, ()] / t / 2000

    return p


def test_language_models_equal_dictionaries(spark):
    rng = np.random.default_rng(3)
    rows, words = [], {}
    for lang, letters in (("aa", "abcdeé"), ("bb", "bcdfgß😀𐐀𐐁")):
        for i in range(60):
            text = " ".join("".join(rng.choice(list(letters), rng.integers(1, 9))) for _ in range(30))
            rows.append((len(rows), text, lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            words.setdefault(lang, []).extend(op4_language.runs(text))
    got = op4_language.learn(df)
    texts = [t for _, t, _ in rows[::7]] + ["unseen zzz", "ab", "a" * 100 + " gß"]
    entropies, n = got.entropies(texts)
    models = {lang: dictionary_model(w) for lang, w in words.items()}
    for row, text in enumerate(texts):
        for k, lang in enumerate(got.langs):
            logs = [np.log(models[lang](tuple((["\0"] * 3 + ["<", *w, ">"])[i : i + 4]))) for w in op4_language.runs(text) for i in range(1, len(w) + 2)]
            assert len(logs) == n[row] and abs(-np.mean(logs) - entropies[row, k]) < 1e-4


def test_language_of_numerals_and_repeats(spark):
    rows = [(i, "the quiet river runs past the old mill", "en") for i in range(40)] + [(100 + i, "der stille fluss fliesst an der alten muehle", "de") for i in range(40)]
    rows += [(900, "½ ²", None), (901, "the old river", None), (901, "the old river", None), (2**60 + 1, "der alte fluss", None), (None, "the mill", None), (2**60 + 3, "the mill " * 20_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = [(r.doc_id, r.lang_pred, r.score) for r in op4_language.identify(df, op4_language.learn(df)).collect()]
    assert (900, "und", 0.0) in out and len({r for r in out if r[0] == 901}) == 1
    assert {r[:2] for r in out} >= {(901, "en"), (2**60 + 1, "de"), (None, "en"), (2**60 + 3, "en")}


def test_top_k(spark, db):
    same(op5_topk.op5_top_k(spark, SF).toPandas(), db.execute(op5_topk.ORACLE).df(), ["query_id", "rank"])
    rows = [(i, [float(i % 3), 1.0]) for i in range(300)] + [(300, None), (301, [float("nan"), 1.0]), (302, [None, 1.0]), (None, [1.0, 1.0]), (5, [2.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = op5_topk.search(v, v.where("vec_id % 50 = 0"), page_rows=4)
    for q in (0, 50, 100):
        x = {i: np.array([256 * (i % 3), 256]) for i in range(300)}
        want = sorted((-int(x[q] @ y), i) for i, y in x.items() if i != q)[:5]
        assert [(r.score, r.vec_id) for r in got.where(f"query_id = {q}").orderBy("rank").collect()] == [(-s, i) for s, i in want]
    few = op5_topk.search(v.where("vec_id < 3"), v.where("vec_id = 0"))
    assert few.count() == 2 and op5_topk.search(v.where("false"), v).count() == 0


def test_top_k_deals_large_rings(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(0)
    x = np.concatenate([1 + rng.integers(0, 3, (3000, 8)) / 256, rng.normal(size=(300, 8))])  # nearly one vector, and others
    v = spark.createDataFrame([(i, [float(e) for e in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    near = op5_topk.integer_vectors(v).select("v", F.lit(0).alias("route"), F.lit(0).cast("long").alias("ring"))
    sizes = [r["count"] for r in op5_topk.dealt(near, 256).groupBy("route", "ring", "salt").count().collect()]
    assert sum(sizes) == 3300 and len(sizes) == 13 and max(sizes) < 512
    got = op5_topk.search(v, v.where("vec_id % 300 = 0"), page_rows=4).toPandas()
    y = np.floor(x * 256).astype(np.int64)
    for q in range(0, 3300, 300):
        want = sorted((-int(y[q] @ y[i]), i) for i in range(3300) if i != q)[:5]
        assert [(-s, i) for s, i in zip(*got[got.query_id == q].sort_values("rank")[["score", "vec_id"]].to_numpy().T, strict=True)] == want


def test_tree_search_spares_pages_and_products():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 300, (40, 16))
    x = np.floor(np.repeat(centres, 200, axis=0) + rng.normal(0, 6, (8000, 16)))
    top = float((x**2).sum(1).max())
    tree = op5_topk.Tree(x, top)
    assert sorted(tree.order) == list(range(8000)) and (tree.hi - tree.lo)[tree.leaf].max() <= 64
    pages = products = 0
    ids = [[i] for i in range(8000)]
    for i in range(0, 8000, 400):
        got = tree.search(x[i], 5, ids, i)
        scores = (x @ x[i]).astype(int)
        assert got == sorted(((int(s), j) for j, s in enumerate(scores) if j != i), key=lambda p: (-p[0], p[1]))[:5]
        pages, products = pages + tree.visited, products + tree.products
    assert pages < 0.25 * 20 * len(tree.leaf) and products < 0.25 * 20 * 8000


@pytest.mark.parametrize("scale", [1.0, 9e6 / 256, 3e8 / 256])
def test_top_k_of_ragged_empty_and_large_vectors(spark, scale):
    rng = np.random.default_rng(6)
    rows = [(i, [float(e) for e in np.floor(rng.normal(0, scale, rng.integers(0, 9)) * 256) / 256]) for i in range(200)]
    rows += [(201, [float("inf")]), (202, None), (203, []), (2**60 + 1, rows[3][1]), (2**60 + 3, rows[3][1])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = op5_topk.search(v, v.where("vec_id % 20 = 3 or vec_id > 1000")).collect()
    x = {i: [int(np.floor(e * 256)) for e in r] for i, r in rows if r is not None and i != 201}
    for q in [i for i in x if i % 20 == 3 or i > 1000]:
        want = sorted(((-sum(a * b for a, b in zip(x[q], y)), i) for i, y in x.items() if i != q))[:5]
        assert sorted((r["rank"], -r.score, r.vec_id) for r in got if r.query_id == q) == [(k + 1, s, i) for k, (s, i) in enumerate(want)]
    assert not any(r.query_id in (201, 202) or r.vec_id in (201, 202) for r in got)


@pytest.mark.parametrize("large", [9e6, 3e8, 3e12])
def test_top_k_of_vectors_with_large_norms(spark, large):
    rng = np.random.default_rng(8)
    rows = [(1, [large, 0.0]), (50, [1.0, 1.0]), (100, [3.0, 1.0])] + [(2 + i, (rng.normal(size=2) * 10.0 ** rng.integers(0, 7)).tolist()) for i in range(30)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = op5_topk.search(v, v.where("vec_id % 50 = 0")).collect()
    x = {i: [int(np.floor(e * 256)) for e in r] for i, r in rows}
    for q in (50, 100):
        want = sorted((-sum(a * b for a, b in zip(x[q], y)), i) for i, y in x.items() if i != q)[:5]
        assert sorted((r["rank"], -r.score, r.vec_id) for r in got if r.query_id == q) == [(k + 1, s, i) for k, (s, i) in enumerate(want)]
        assert want[0][1] == 1


def test_top_k_of_scores_that_are_no_longs(spark):
    for rows in ([(0, [3e8]), (1, [2e8]), (2, [1.0])], [(0, [1.0]), (1, [1e30])]):
        v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="no 64-bit number"):
            op5_topk.search(v, v.where("vec_id % 50 = 0")).collect()


def test_fingerprint_folds_case(spark):
    pairs = [("Straße", "STRASSE"), ("οδοσ", "ΟΔΟΣ"), ("ΟΔΟΣ", "οδος"), ("ﬁn", "FIN"), ("ǰ", "J̌")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(t for p in pairs for t in p)], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in op7_fingerprint.fingerprints(df).collect()}
    assert all(got[2 * i] == got[2 * i + 1] for i in range(len(pairs))) and len(set(got.values())) == len(pairs) - 1


def test_mixing_deals_rows_without_ids_by_their_texts(spark):
    rows = [(None, f"text number {i} " * (1 + i % 7), "s") for i in range(600)] + [(None, "the same text", "s")] * 300 + [(i, "other words", "t") for i in range(50)] + [(7, "again", "t")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = op8_mixing.deal(df).collect()
    assert len(got) == len(rows) and len({r.block for r in got if r.source == "s"}) > 8
    assert len({r.times for r in got if r.key == "7"}) == 1 and len({(r.block, r.times) for r in got if r.source == "s" and r.tokens == 3 and r.key.startswith("#")}) >= 1
    same_text = [k for k in {r.key for r in got} if sum(r.key == k for r in got) == 300]
    assert len(same_text) == 1 and len({r.times for r in got if r.key == same_text[0]}) == 1
    for s in ("s", "t"):
        own = [r for r in got if r.source == s]
        budget = int(own[0].weight * sum(r.tokens for r in got))
        assert budget - 900 <= sum(r.tokens * r.times for r in own) <= budget + 1


def test_near_duplicates(spark, db, docs, none):
    same(op6_neardup.op6_near_duplicates(spark, SF).toPandas(), db.execute(op6_neardup.ORACLE).df(), ["doc_id"])
    out = op6_neardup.near_duplicates(docs).collect()
    assert len(out) == docs.count() and op6_neardup.near_duplicates(none).count() == 0
    by = {r.doc_id: r for r in out}
    assert by[56].component_id == by[63].component_id == by[70].component_id == 56 and by[0].n_shingles == 0 and by[0].kept
    assert by[None].component_id is None and by[None].kept


def test_near_duplicates_in_large_families(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 5000, 200)]
    texts = []
    for i in range(120):
        t = list(base)
        for k in rng.choice(200, rng.integers(0, 7), replace=False):
            t[k] = f"e{rng.integers(0, 40)}"
        texts.append(" ".join(t))
    sets = [set(zip(*[t.split()[k:] for k in range(5)])) for t in texts]
    top = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            top[i] = min(top[j] for j in range(len(texts)) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in op6_neardup.near_duplicates(df).collect()} == dict(enumerate(top))


def components_by_all_pairs(texts):
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    top = list(range(len(texts)))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    for _ in texts:
        before = list(top)
        for i, j in links:
            top[i] = top[j] = min(top[i], top[j])
        if before == top:
            return top, len(links)


def test_near_duplicates_at_the_threshold(spark):
    """Pairs of texts of many lengths whose likeness lies around 0.85: none that reaches it is lost."""
    rng, texts = np.random.default_rng(8), []
    for pair in range(260):
        n = int(rng.integers(60, 900))
        words = [f"p{pair}w{k}" for k in range(n)]
        other = list(words)
        gone = round((n - 4) * rng.uniform(0.05, 0.10))  # a changed run of r words takes r + 4 shingles of either text
        at = int(rng.integers(0, n - gone))
        other[at : at + max(1, gone - 4)] = [f"q{pair}w{k}" for k in range(max(1, gone - 4))]
        texts += [" ".join(words), " ".join(other)]
    top, links = components_by_all_pairs(texts)
    assert 80 < links < 240
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in op6_neardup.near_duplicates(df).collect()} == dict(enumerate(top))


def test_near_duplicates_of_form_letters(spark):
    """A large family that shares most of its words but stays below the threshold, beside copies in it."""
    rng, base = np.random.default_rng(9), [f"b{k}" for k in range(120)]
    texts = []
    for i in range(150):
        t = list(base)
        at = int(rng.integers(0, 90))
        t[at : at + 30] = [f"i{i % 140}k{k}" for k in range(30)]
        texts.append(" ".join(t))
    top, _ = components_by_all_pairs(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in op6_neardup.near_duplicates(df).collect()} == dict(enumerate(top))


def test_classes_that_only_the_signature_shares_are_told_apart(spark, monkeypatch):
    rows = [(1, 1, 1, 5, [1]), (2, 1, 1, 5, [2]), (3, 9, 9, 6, [3]), (4, 9, 9, 6, [3])]
    sets = spark.createDataFrame(rows, "doc_id long, s1 long, s2 long, n long, s array<long>")
    assert [tuple(r) for r in op6_neardup.unlike(sets).collect()] == [(1, 1, 5)]
    # With a signature that all sets of a size share, the result is the same.
    texts = ["a b c d e f g", "h i j k l m n", "a b c d e f g", "o p q r s t u v", "h i j k l m n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    real = op6_neardup.unlike
    monkeypatch.setattr(op6_neardup, "unlike", lambda s: real(s).unionByName(s.select("s1", "s2", "n")).distinct())
    assert {r.doc_id: r.component_id for r in op6_neardup.near_duplicates(df).collect()} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 1}


def test_rows_that_repeat_an_id_are_one_document(spark):
    rows = [(1, "a b c d e f g"), (1, "a b"), (2, "a b"), (3, "a b c d e f g")]
    out = op6_neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out) == [(1, 3, 1, True), (1, 3, 1, True), (2, 1, 2, True), (3, 3, 1, False)]


def test_fingerprints(docs, none, spark):
    import xxhash

    rows = sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in docs.collect()))
    out = op7_fingerprint.fingerprints(docs).collect()
    assert len(out) == len(rows) and op7_fingerprint.fingerprints(none).count() == 0
    nfkc = lambda t: unicodedata.normalize("NFKC", t)
    form = lambda t: re.sub(r"\s+", " ", nfkc(nfkc(t).casefold())).strip()
    by = {}
    for r in out:
        by.setdefault(-1 if r.doc_id is None else r.doc_id, r)
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 4
        edited = t[: len(t) - k] + n[:k]
        if i not in (56,):
            assert by[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert by[i].near_next == float(form(t) == form(n))
        if i != 42:
            seeds = 42, xxhash.xxh64_intdigest(b"wide", seed=42)
            assert by[i].fingerprint == "".join(f"{xxhash.xxh64_intdigest(form(t).encode(), seed=s):016x}" for s in seeds)
    assert by[77].fingerprint == by[84].fingerprint and by[56].fingerprint == by[63].fingerprint == by[70].fingerprint
    forms = spark.createDataFrame([(1, 2, "a"), (1, 2, "b"), (1, 3, "c"), (1, 3, "c")], "d1 long, d2 long, form string")
    assert [tuple(r) for r in op7_fingerprint.clashes(forms).collect()] == [(1, 2)]


def test_fingerprints_follow_ids_over_buckets(spark):
    """Ids far apart, negative ones, and many rows without an id: each is followed by the next one's text."""
    ids = [-5, 3, 255, 256, 2**20, 2**41 + 7, 2**60 + 1, 2**60 + 3]
    df = spark.createDataFrame([(i, f"text of {i} " * 5) for i in ids] + [(None, f"no id {k} " * 3) for k in range(30)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in op7_fingerprint.fingerprints(df).collect() if r.doc_id is not None}
    text = {i: f"text of {i} " * 5 for i in ids}
    for i, j in zip(ids, ids[1:]):
        k = len(text[i]) // 4
        assert got[i].edited_sha256 == hashlib.sha256((text[i][: len(text[i]) - k] + text[j][:k]).encode()).hexdigest()
    loose = op7_fingerprint.fingerprints(df.where("doc_id is null")).collect()
    assert len(loose) == 30 and len({r.edited_sha256 for r in loose}) == 30


def test_mixing(spark, db, docs, none):
    same(op8_mixing.op8_mixing(spark, SF).toPandas(), db.execute(op8_mixing.ORACLE).df(), ["doc_id"])
    assert op8_mixing.choose(docs).count() == docs.count() and op8_mixing.choose(none).count() == 0
    rows = [(i, "w " * 10, "big" if i % 10 else "small") for i in range(1000)]
    out = op8_mixing.choose(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_repeats=2.0).toPandas()
    got = (out.tokens * out.times).groupby(out.source).sum()
    assert abs(got["small"] - 2000) <= 20 and abs(got.sum() - 10_000) <= 40
    even = op8_mixing.choose(spark.createDataFrame(rows, "doc_id long, text string, source string"), entropy=0.6).toPandas()
    w = even.groupby("source").weight.first().to_numpy()
    assert 0.6 <= -(w * np.log(w)).sum() < 0.601


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def brute(text):
    def good(kind, v):
        digits = re.sub("[^0-9]", "", v)
        d = [int(c) for c in digits[::-1]]
        luhn = sum(sum(divmod(2 * c, 10)) if i % 2 else c for i, c in enumerate(d)) % 10 == 0
        return {
            "email": True, "ip": kind == "ip" and all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in v.split(".")),
            "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15,
        }[kind]

    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in BASE for m in re.finditer(p, text or "") if good(k, m.group()))


def test_pii_base_spans(docs, none, spark):
    more = ["😀 a@b.c_x@d.e @x.y a..b%@c-d.e.f.", "+1+1 555 (23) 44-5 6. +9 1234567890123456", "1.2.3.4.5.6.7.8 0001.002.3.4 1.2.3", "4111-1111 1111-1111 4111111111111112 0", "0 0 " * 500, "a@b.c " * 300]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    out = op9_pii.pii(df)
    got = out.select("doc_id", op9_pii.spelled(out.base).alias("b"), op9_pii.spelled(out.all).alias("a")).collect()
    want = {r.doc_id: brute(r.text) for r in df.collect()}
    assert len(got) == df.count() and all(r.b == want[r.doc_id] for r in got)
    assert all(set(filter(None, r.b.split(","))) <= set(r.a.split(",")) for r in got) and op9_pii.pii(none).count() == 0


def test_pii_finds_by_context_and_redacts(spark):
    rows = [(i, f"please write to user{i}@host.example today") for i in range(60)] + [(99, "please write to bob99@localhost today"), (100, "the year 1999 was fine")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in op9_pii.pii(df).collect()}
    assert len(out[5]["all"]) == 1 and not out[100]["all"]
    clean = {r.doc_id: r.text for r in op9_pii.redact(df).collect()}
    assert clean[5] == "please write to [EMAIL] today" and clean[100] == rows[-1][1]


def test_pii_finds_items_of_other_shapes(spark):
    rows = [(i, f"please write to user{i}@host.example today or call me at +1 (988) 555-2{i:03} any time") for i in range(60)]
    rows += [(99, "please write to bob99@localhost today"), (101, "we write to (amy7@intranet), today"), (102, "then call me at 988 555 1234 any time")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in op9_pii.redact(df).collect()}
    assert clean[99] == "please write to [EMAIL] today" and clean[101] == "we write to ([EMAIL]), today"
    assert clean[102] == "then call me at [PHONE] any time"


def test_pii_second_round_reaches_further(spark):
    rows = [(i, f"please write to user{i}@host.example today") for i in range(200)]
    # Found in the first round; they alone make "login" a pattern, which ann7@intranet needs.
    rows += [(1000 + i, f"please write to bob{i}@localhost today and login bob{i}@localhost now") for i in range(12)]
    rows += [(2000, "then login ann7@intranet again"), (2001, "in 1999, today was \"fine\"")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = op9_pii.materialise(op9_pii.base_spans(df), "pii")
    ids = [{r.doc_id for r in op9_pii.discover(found, rounds=n).collect()} for n in (1, 2)]
    assert ids == [set(range(1000, 1012)), {2000, *range(1000, 1012)}]
    clean = {r.doc_id: r.text for r in op9_pii.redact(df).where("doc_id >= 1000").collect()}
    assert clean[1003] == "please write to [EMAIL] today and login [EMAIL] now" and clean[2000] == "then login [EMAIL] again"
    assert clean[2001] == rows[-1][1]


def test_quality(docs, none):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # no feature alone tells
    m = op10_quality.AdditiveModel().fit(x[:1500], y[:1500])
    assert ((m.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.9
    model = op10_quality.train(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"))
    assert op10_quality.quality(docs, model).where("score between 0 and 1").count() == docs.count() and op10_quality.quality(none, model).count() == 0
    assert op10_quality.train(none, none.selectExpr("doc_id", "1 as quality")).prior == 0.5


def test_quality_scores_equal_single_lookups():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    m = op10_quality.AdditiveModel().fit(x, (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float), rounds=20, pair_rounds=10)
    for row, score in zip(x, m.score(x), strict=True):
        bins = [sum(e <= v for e in edges) for v, edges in zip(row, m.edges, strict=True)]
        z = m.bias + sum(t[b] for t, b in zip(m.tables, bins, strict=True))
        z += sum(t[bins[i] * 8 // len(m.tables[i]), bins[j] * 8 // len(m.tables[j])] for (i, j), t in m.pairs.items())
        assert abs(1 / (1 + np.exp(-z)) - score) < 1e-9


def test_quality_reads_whole_texts_and_wide_letters():
    assert (op10_quality.features("𐐀𐐨 a!") == op10_quality.features("Éé a!")).all()
    assert op10_quality.features("word " * 100_000 + "!")[11] > 0 and op10_quality.features(None)[0] == 0


def test_mixing_deals_large_sources_alike_in_ranges(spark):
    """Over 64 blocks a source, the budget ends in one range, one block: the same as one running sum over all blocks."""
    rows = [(i, "w " * (1 + i % 5), "a" if i % 3 else "b") for i in range(30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = op8_mixing.choose(df, max_repeats=1.5, block_docs=16).toPandas()
    got = (out.tokens * out.times).groupby(out.source).sum()
    own = out.tokens.groupby(out.source).sum()
    budget = out.groupby("source").weight.first() * own.sum()
    assert ((budget - got >= 0) & (budget - got < 5 + 1)).all() and set(out.times) <= {0, 1, 2}


def test_pii_precision_on_planted_identifiers(spark):
    """Identifiers of forms that no base pattern takes, planted in the contexts of base ones: found, and little else."""
    rng = np.random.default_rng(7)
    plain = ["river", "stone", "market", "winter", "paper", "garden", "bridge", "evening"]
    rows, planted = [], set()
    for i in range(400):
        noise = " ".join(rng.choice(plain, 6)) + f" in {1900 + i % 120} or room {i % 40} of b{i % 9}"
        kind = i % 4
        if kind == 0:
            rows.append((i, f"{noise} please contact ann{i}@mail.example tomorrow"))
        elif kind == 1:
            rows.append((i, f"{noise} you may ring +44 20 7946 {i:04} anytime"))
        elif kind == 2 and i % 40 == 2:
            rows.append((i, f"{noise} please contact user_{i} tomorrow"))
            planted.add(i)
        elif kind == 3 and i % 40 == 3:
            rows.append((i, f"{noise} you may ring 020 7946 {i:04} anytime"))
            planted.add(i)
        else:
            rows.append((i, f"{noise} please come tomorrow"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    added = {r.doc_id for r in op9_pii.pii(df).where("size(all) > size(base)").collect()}
    assert added >= planted and len(added & planted) / len(added) > 0.95


def test_pii_contexts_of_any_length(spark):
    word = "x" * 50
    gaps = [f"go to {word}ab ", f" {word}cd: ", " " * 60, "a " + "-" * 40, "7 - ", "é1 " + "!" * 50 + "tail ", word, ""]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(gaps)], "i int, g string")
    got = {r.i: (r.a, r.b) for r in df.select("i", op9_pii._context(df.g, "left").alias("a"), op9_pii._context(df.g, "right").alias("b")).collect()}
    left = re.compile(r"([^\W\d_]+)[\W_]*$")
    right = re.compile(r"^[\W_]*([^\W\d_]+)")
    for i, g in enumerate(gaps):
        assert got[i] == tuple((m.group(1).lower() if m else "") for m in (left.search(g), right.search(g)))


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in c.STAGES[:-1]:
        out = c.materialise(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        if name == "near_duplicates":
            keep = {r.doc_id for r in op6_neardup.near_duplicates(docs).where("kept").collect()}
            assert {r.doc_id for r in out.collect()} == keep
        if name == "personal_data":
            assert not any(brute(r.text) for r in out.collect())
        docs = out
    times = docs.groupBy("doc_id").count()
    packed = c.packing(spark, docs, SF).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).join(times, "doc_id").toPandas()
    assert (packed["sum(length)"] == packed["max(doc_tokens)"] * packed["count"]).all() and len(packed) == times.count()


def test_pipeline_mixing_takes_null_and_repeated_ids(spark):
    import corpus_pipeline as c

    rows = [(None if i % 5 == 0 else i % 70, f"{i} " + "w " * (i % 9), ["big", "big", "big", None, "small"][i * 7 % 11 % 5]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    times = {}
    for r in op8_mixing.deal(df, max_repeats=2.0).collect():
        assert times.setdefault((r.source, r.key), r.times) == r.times
    got = c.mixing(spark, df, SF)
    key = {tuple(r)[:3]: r.k for r in df.withColumn("k", op8_mixing.dealt_by(df.doc_id, df.text)).collect()}
    want = sorted(repr(r) for r in rows for _ in range(times[r[2] or "", key[r]]))
    assert got.columns == df.columns and any("(None" in r for r in want) and sorted(repr(tuple(r)) for r in got.collect()) == want


def test_pipeline_run_hands_over_and_deletes(spark, tmp_path):
    """run() on a whole small table is its stages one after the other, each on what the one before gave."""
    import os
    import shutil

    import corpus_pipeline as c

    shutil.copytree(SF, tmp_path / "sf")
    sf = str(tmp_path / "sf")
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = set(os.listdir(root))
    got = c.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(set(os.listdir(root)) - before) == 1  # the last stage's table alone is left
    sizes = []
    for _, stage in c.STAGES:
        docs = op1_license.materialise(stage(spark, docs, sf), "held")
        sizes.append(docs.count())
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]  # which window a piece is in depends on the tasks
    per_doc = lambda df: sorted(map(tuple, df.groupBy("doc_id").agg({"length": "sum"}).collect()))
    assert set(kept) <= set(got.columns) and per_doc(got) == per_doc(docs) and sizes[0] > sizes[1]


def test_pipeline_stages_on_odd_tables(spark, docs, none):
    import corpus_pipeline as c

    for name, stage in c.STAGES:
        assert stage(spark, none, SF).count() == 0
        out = stage(spark, docs, SF)
        assert name == "packing" or out.columns == docs.columns
        if name == "language":
            assert not {0, 7, 14} & {r.doc_id for r in out.collect()}
        if name == "near_duplicates":
            ids = [r.doc_id for r in out.collect()]
            assert ids.count(56) == 1 and not {63, 70} & set(ids) and None in ids and {0, 7, 14} <= set(ids)
        if name == "personal_data":
            assert out.count() == docs.count() and {r.doc_id: r.text for r in out.collect()}[0] is None


def test_pipeline_leaves_only_its_result(spark):
    import corpus_pipeline as c
    from lumencube.llm import common

    before = list(common._WRITTEN)
    with common.Intermediates(spark) as tables:
        a = common.materialise(spark.range(3), "a")
        b = tables.keep(a.selectExpr("id + 1 as id"), "b")
    assert common._WRITTEN == before and len(tables.kept) == 1 and sorted(r.id for r in b.collect()) == [1, 2, 3]
    with pytest.raises(Exception, match="(?i)exist|not.found"):
        a.count()
    assert callable(c.run)
