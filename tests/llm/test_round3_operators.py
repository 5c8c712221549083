"""Filter audit, decontamination and whitening against brute force and odd tables."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontamination, filter_audit, whitening

BLANKS = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, source string, part string, mask int, words array<string>, n_words long"
LABELS = "doc_id long, quality int, toxic int, n int"
LONG = "Lorem ipsum dolor sit amet " * 30_000


def plain(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# 11 Filter audit


def audit_by_hand(docs, labels):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    out = Counter()
    parts = {s or "" for _, _, s in docs}
    lost = Counter()
    for i, t, s in docs:
        t, part = t or "", s or ""
        w = BLANKS.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": re.search("[#$%&*|]", t) is not None}
        fails["E"] = i is not None and i > least.get(t, i)
        for order in itertools.permutations("ABCDE"):
            alive, name = True, "".join(order)
            for step, f in enumerate(order, 1):
                key = (part, name, step)
                if fails[f] and alive:
                    out[key, "removed"] += 1
                    out[key, "good_lost"] += i in good
                    out[key, "toxic_lost"] += i in toxic
                    lost[part, f] += 1
                elif fails[f]:
                    out[key, "redundant"] += 1
                alive = alive and not fails[f]
                out[key, "kept"] += alive
                out[key, "unique_fails"] += fails[f] and not any(v for g, v in fails.items() if g != f)
    rows = {}
    for part in parts:
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                key = (part, "".join(order), step)
                rows[key] = tuple(lost[part, f] if m == "shapley" else out[key, m] for m in filter_audit.MEASURES)
    return rows


def audited(spark, docs, labels):
    frame = spark.createDataFrame([(*d, "x", 3, ["y"], 1) for d in docs], DOCS)
    got = filter_audit.audit(frame, spark.createDataFrame([(*l, 5) for l in labels], LABELS))
    assert got.columns == ["part", "filter_order", "step", *filter_audit.MEASURES]
    assert all(kind == "bigint" for c, kind in got.dtypes if c in filter_audit.MEASURES)
    rows = got.collect()
    found = {(r.part, r.filter_order, r.step): tuple(r[m] for m in filter_audit.MEASURES) for r in rows}
    assert len(found) == len(rows)
    return found


def test_first_failures_are_those_of_the_orders():
    for mask in range(32):
        for o, order in enumerate(filter_audit.ORDERS):
            want = next((s for s, f in enumerate(order) if mask >> "ABCDE".index(f) & 1), 5)
            assert filter_audit.FIRST[mask, o] == want
    assert len(set(filter_audit.ORDERS)) == 120


def test_audit_against_brute_force(spark):
    rng = random.Random(4)
    pool = ["#", "Xx", "word", *[f"w{i}" for i in range(300)]]
    docs = []
    for i in range(150):
        kind = rng.randint(0, 5)
        n = rng.choice([5, 199, 200, 260])
        text = " ".join(rng.choice(pool if kind else pool[2:4]) for _ in range(n)) if kind < 5 else docs[rng.randrange(len(docs))][1] if docs else "a"
        docs.append((rng.randint(0, 140), text if kind != 3 else "A B" + text.upper()[: rng.randint(0, 40)] + text, rng.choice(["s", "t", None, "", "é"])))
    docs += [(None, docs[0][1], "s"), (500, None, "s"), (501, "", "t"), (None, None, None), (7, LONG, "s"), (3, LONG, "t"), (3, LONG, "t"), (502, " \n\t", "only")]
    docs += [(900 + i, "the same text", "hot") for i in range(700)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 140, 3)] + [(3, 0, 1), (3, 1, 0), (None, 1, 1), (905, 1, 1)]
    assert audited(spark, docs, labels) == audit_by_hand(docs, labels)


def test_audit_of_odd_tables(spark):
    assert audited(spark, [], [(1, 1, 1)]) == {}
    docs = [(None, None, None)] * 3 + [(4, "", "a"), (4, "", "a"), (5, "", "b")]
    assert audited(spark, docs, []) == audit_by_hand(docs, [])
    assert audited(spark, [(i, "t", f"s{i}") for i in range(1100)], []) == audit_by_hand([(i, "t", f"s{i}") for i in range(1100)], [])


# 12 Decontamination


def contamination_by_hand(docs, items, window):
    windows = defaultdict(set)
    for i, t in items:
        w = WORDS.findall(plain(t))
        for s in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[s : s + window])].add(i)
    out = []
    for i, t in docs:
        w = WORDS.findall(plain(t))
        covered, found = set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                got = windows.get(tuple(w[s : s + k]))
                if got is not None:
                    covered.update(range(s, s + k))
                    found |= {str(x) for x in got if x is not None}
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(covered), len(found), digest, bool(covered)))
    return Counter(out)


def contaminated(spark, docs, items, **how):
    frame = spark.createDataFrame([(i, t, "s", "p", 1, ["y"], 9) for i, t in docs], DOCS)
    got = decontamination.contamination(frame, spark.createDataFrame([(*x, "window") for x in items], "item_id long, text string, words string"), **how)
    return Counter(tuple(r)[:6] for r in got.collect())


def test_decontamination_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["a", "b", "A", "the", "é", "É", "9", "don't"]
    say = lambda n: rng.choice([" ", "-", ". "]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(rng.randint(0, 30), say(rng.choice([1, 2, 3, 4, 5, 7, 12]))) for _ in range(25)] + [(None, say(6)), (31, None), (32, ""), (33, "!?")]
    docs = [(rng.randint(0, 50), say(rng.randint(0, 60))) for _ in range(120)]
    docs += [(60 + i, say(9) + " " + t + " " + say(9)) for i, (_, t) in enumerate(items) if t] + [(None, None), (None, items[0][1]), (1, ""), (1, "")] + [docs[0]] * 3
    for window, shingle in ((5, 3), (4, 4), (3, 1), (10, 4)):
        assert contaminated(spark, docs, items, window=window, shingle=shingle) == contamination_by_hand(docs, items, window)
    assert contaminated(spark, docs, items, window=5, shingle=3, most=11) == contamination_by_hand(docs, items, 5)


def test_decontamination_of_odd_tables(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven"), (12, "Short Item"), (2, "short item")]
    docs = [(1, "x one two three four five six seven eight nine ten ELEVEN"), (2, "short"), (3, "a SHORT item, short item"), (4, None), (5, "ten nine eight")]
    got = contaminated(spark, docs, items)
    assert got == contamination_by_hand(docs, items, 10)
    assert {r[0]: r[2:4] for r in got} == {1: (11, 1), 2: (0, 0), 3: (4, 2), 4: (0, 0), 5: (0, 0)}
    assert contaminated(spark, [], items) == Counter()
    assert contaminated(spark, docs, []) == contamination_by_hand(docs, [], 10)
    assert contaminated(spark, docs, [(7, "... !!!"), (8, None)]) == contamination_by_hand(docs, [], 10)
    hot = [(i, "x short item y") for i in range(900)] + [(5, LONG), (5, LONG), (6, LONG + "short item")]
    assert contaminated(spark, hot, [*items, (9, "lorem"), (10, LONG[:90])]) == contamination_by_hand(hot, [*items, (9, "lorem"), (10, LONG[:90])], 10)


def test_texts_stay_in_compiled_stages(spark):
    """A row of a position holds all words of its document, so no position may be copied on its way to the join."""
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string").select("doc_id", F.lit(1).alias("h1"), F.lit(2).alias("h2"), decontamination.words_of(F.col("text")).alias("words")).withColumn("n_words", F.size("words").cast("long"))
    windows, _ = decontamination.windows_of(spark.createDataFrame([(1, "b c d e")], "item_id long, text string"), 10, 4)
    found = decontamination._occurrences(docs, decontamination.prefixes(docs, windows, [4]), [4])
    found.collect()
    final = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(re.findall(r"\*\(\d+\) Generate posexplode", final)) == 2 and re.search(r"\*\(\d+\) BroadcastHashJoin", final)


# 13 Whitening

VECTORS = "vec_id long, embedding array<float>, label int, vector binary, component string"


def whitened_by_hand(vectors):
    """{row: (deviation, whitened up to sign)}, explained."""
    x = {k: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for k, v in vectors.items()}
    different = sorted({tuple(v) for v in x.values()})
    n, m = len(different), np.array(different, float)
    s = [sum(v[d] for v in different) for d in range(m.shape[1])]
    centred = m - m.mean(axis=0)
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:16], u[:, ::-1][:, :16]
    solid = e > e[0] * m.shape[1] * 2.3e-16
    mean = np.array([t / n for t in s])
    rows = {k: (sum((n * a - b) ** 2 for a, b in zip(w, s)), (np.array(w) - mean) @ u[:, solid] / np.sqrt(e[solid])) for k, w in x.items()}
    return n, rows, e[solid] / np.trace(v)


def whitened(spark, rows):
    frame = spark.createDataFrame([(k, v, 1, b"x", "c") for k, v in rows], VECTORS)
    return whitening.whiten(frame).toPandas()


def held_against_hand(got, vectors):
    n, rows, explained = whitened_by_hand(vectors)
    k = len(explained)
    assert len(got) == len(vectors) * k and (got.n == n).all() and (got.identity_error < 1e-8).all()
    table = got.pivot(index="vec_id", columns="component", values="whitened")
    assert list(table.columns) == list(range(1, k + 1))
    want = np.array([rows[i][1] for i in table.index])
    signs = np.sign((table.to_numpy() * want).sum(axis=0))
    np.testing.assert_allclose(table.to_numpy() * signs, want, atol=1e-7)
    assert all(rows[r.vec_id][0] == r.deviation for r in got.itertuples())
    np.testing.assert_allclose(got[got.vec_id == got.vec_id.iloc[0]].sort_values("component").explained, explained, rtol=1e-9)


@pytest.mark.parametrize(("width", "rows", "scale"), [(20, 300, 1.0), (64, 200, 0.2), (3, 50, 40.0), (40, 90, 3000.0), (300, 60, 1.0)])
def test_whitening_against_brute_force(spark, width, rows, scale):
    rng = np.random.default_rng(width)
    x = (rng.standard_normal((rows, width)) * np.linspace(2, 0.5, width) * scale + 0.3).astype(np.float32)
    x[5:9] = x[4]
    held_against_hand(whitened(spark, [(i, v.tolist()) for i, v in enumerate(x)]), {i: v.tolist() for i, v in enumerate(x)})


def test_whitening_of_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    fine = {i: [float(i % 5), i * 0.37, -float(i * i % 7)] for i in range(30)}
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [nan, 1.0, 1.0]), (104, [inf, 1.0, 1.0]), (105, [1.0, 2.0]), (106, [-inf, 0.0, 0.0]), (107, [3e38, 0.0, 0.0])]
    held_against_hand(whitened(spark, [*fine.items(), *odd]), fine)
    assert len(whitened(spark, [])) == 0 and len(whitened(spark, odd[:2])) == 0
    assert len(whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])) == 0  # all equal: no direction
    got = whitened(spark, [(None, [1.0, 2.0]), (2, [1.0, 3.0]), (2, [1.0, 3.0]), (3, [1.0, 5.0])])
    assert len(got) == 4 and set(got.component) == {1} and (got.n == 3).all() and got.vec_id.isna().sum() == 1
    assert [c for c in got] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_are_exact_or_null():
    m = whitening.Whitener(2, 3, [9, 3 << 55], np.array([3.0, float(1 << 55)]), np.eye(2), np.ones(2))
    assert m.deviations(np.array([[4, 1 << 55]])) == [9]
    assert m.deviations(np.array([[4, 1 << 54]])) == [None]


def test_packed_numbers_come_back():
    import pyarrow as pa

    x = np.array([[1, -2], [300, 4], [1 << 20, 5], [-(1 << 61), 6], [127, -128], [128, 0]])
    assert (whitening.unpacked(whitening.packed(x), 2) == x).all()
    assert [len(b) for b in whitening.packed(x).to_pylist()] == [2, 4, 8, 16, 2, 4]
    assert (whitening.unpacked(whitening.packed(x[:1]), 2) == x[:1]).all() and len(whitening.packed(x[:0])) == 0 and pa is not None


# Shared ids, ties and wide counts in the earlier operators

SMALL = "doc_id long, text string, lang string, source string, n_chars long"


def two_languages(spark, ids):
    rng = random.Random(3)
    en, de = "the and of that with this from have they which".split(), "der und das mit nicht eine sich auch wird sind".split()
    rows = [(ids(i), " ".join(rng.choice(w) for _ in range(12)) + f" {i}", lang, "s", 1) for i in range(700) for w, lang in ((en, "en"), (de, "de"))]
    return spark.createDataFrame(rows, SMALL)


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 7, lambda i: 8, lambda i: i % 3])
def test_languages_are_learned_under_shared_ids(spark, ids):
    from graphloom.llm import language_id

    docs = two_languages(spark, ids)
    model = language_id.fit(docs, sample=100)
    told = language_id.predict(docs, model, keep=("lang",)).groupBy("lang", "lang_pred").count().collect()
    assert {(r.lang, r.lang_pred): r["count"] for r in told} == {("en", "en"): 700, ("de", "de"): 700}


def test_a_language_of_empty_texts_is_not_learned(spark):
    from graphloom.llm import language_id

    docs = two_languages(spark, lambda i: i).union(spark.createDataFrame([(5, "", "fr", "s", 0), (6, None, "it", "s", 0)], SMALL))
    model = language_id.fit(docs, sample=100)
    assert model.langs == ["de", "en"]


def test_the_pipeline_keeps_a_given_language_unless_it_is_sure(spark):
    import corpus_pipeline as pipe

    rows = [(None, f"{t} {i}", lang, "s", 1) for i in range(60) for t, lang in (("the and of that with this from have", "en"), ("der und das mit nicht eine sich auch", "de"))]
    odd = [(1, "the and of that with this from have they", None, "s", 1), (2, "the and of that with this from have", "de", "s", 1), (3, "xq", "de", "s", 1), (3, "xq", "en", "s", 1), (4, None, "en", "s", 1), (5, "12 34", "en", "s", 1)]
    got = pipe.identify_language(spark, spark.createDataFrame(rows + odd, SMALL), "")
    assert got.columns == list(pipe.COLUMNS) and got.where("doc_id is null").count() == 120
    assert Counter((r.doc_id, r.lang) for r in got.where("doc_id is not null").collect()) == Counter([(1, "en"), (2, "en"), (3, "de"), (3, "en")])
    assert {r.lang for r in got.where("doc_id is null").collect()} == {"en", "de"}
    assert pipe.identify_language(spark, spark.createDataFrame(odd[:1], SMALL), "").count() == 0


def test_mixing_ties_do_not_depend_on_partitions(spark):
    from graphloom.llm import mixing

    rows = [(7, f"one two three {i:02d}", "a" if i % 3 else "b", i) for i in range(40)] + [(None, f"x y z {i:02d}", "a", i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    for boundary in ("cut", "nearest"):
        found = []
        for n in (1, 3, 7):
            got = mixing.mix(docs.repartition(n, "text"), None, boundary=boundary, keep=("text", "n")).collect()
            found.append(sorted((r.text, r.n, r.taken) for r in got))
        assert found[0] == found[1] == found[2] and len(found[0]) == 80 and len({x[2] for x in found[0]}) > 1


def test_counts_beyond_the_narrow_type(spark):
    from graphloom.llm import lm_score

    docs = spark.createDataFrame([(i % 4, f"a b c d{i % 5}") for i in range(2300)], "doc_id long, text string")
    want = Counter(tuple(r) for r in lm_score.score(docs).collect())
    assert sum(want.values()) == 2300
    assert Counter(tuple(r) for r in lm_score.score(docs, wide=20).collect()) == want
    assert (lm_score._unpacked(lm_score._packed(lm_score._narrow(np.array([3, 1 << 33], np.uint64))), 2) == [3, 1 << 33]).all()
    assert lm_score._narrow(np.array([3], np.uint64)).dtype == np.uint32


def test_long_texts_are_cut_part_by_part(monkeypatch):
    from graphloom.llm import toxicity

    rng = random.Random(5)
    model = toxicity.Model(b"one two three four five six seven ", b"bad worse worst evil vile foul nasty ")
    texts = ["", " ", "x" * 300, "x" * 150 + " ", " " * 200 + "a", "a " + "y" * 500 + " b c", *["".join(rng.choice("ab cd\n\u00a0\u00e9") for _ in range(rng.randint(0, 900))) for _ in range(40)]]
    whole = [model.distances(t) for t in texts]
    plain_ = [model._saved(toxicity.windows(t, head=toxicity.HEAD.decode() + " ", tail=" " + toxicity.TAIL.decode()), True) for t in texts]
    monkeypatch.setattr(toxicity, "PART", 64)
    monkeypatch.setattr(toxicity, "HELD", 50)  # forgets what it knew again and again
    again = toxicity.Model(model.ordinary, model.toxic)
    for t, a, b in zip(texts, whole, plain_):
        assert (a == b).all() and len(a) == len(b)
        assert (again.distances(t) == a).all() and len(again.distances(t)) == len(a)
        assert np.allclose(again.features(t), model._features([a]))


def test_windows_that_cost_both_sides_the_same_are_not_compressed(monkeypatch):
    from graphloom.llm import toxicity

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    common = " ".join(word() for _ in range(1200))
    sides = [" ".join(word() for _ in range(300)).encode()[:1200] for _ in range(2)]
    model = toxicity.Model(*(x + b" " + common.encode() for x in sides))

    def piece():
        x = rng.choice([model.ordinary, model.toxic, model.ordinary[1190:1230], model.toxic[1190:1230], toxicity.HEAD + toxicity.TAIL]).decode()
        at = rng.randrange(len(x))
        return x[at : at + rng.randint(2, 20)]

    texts = ["", "a", " ".join(word() for _ in range(4000)), "".join(rng.choice([piece(), piece(), word(), " "]) for _ in range(20_000)), "x" * 3000 + " " + common[:2000].replace(" ", "") + " b"]
    direct = [model._saved(toxicity.windows(t)) for t in texts]
    sent, saved = [], toxicity.Model._saved
    monkeypatch.setattr(toxicity.Model, "_saved", lambda self, cut, carried=False: (sent.extend(cut), saved(self, cut, carried))[1])
    assert [model.distances(t).tolist() for t in texts] == [d.tolist() for d in direct]
    untried = len(sent)
    sent.clear()
    again = toxicity.Model(model.ordinary, model.toxic)
    again.skips = again._holds([w for t in texts for w in toxicity.windows(t)], np.concatenate(direct))
    assert again.skips and [again.distances(t).tolist() for t in texts] == [d.tolist() for d in direct]
    assert len(sent) < 0.8 * untried and any(d.any() for d in direct)
    # Together or one by one, texts score the same.
    again.weights, alone = np.linspace(-2, 3, 10), []
    monkeypatch.setattr(toxicity, "TOGETHER", 3000)
    several = [None, *texts, "a b", "", *[" ".join(word() for _ in range(rng.randint(0, 300))) for _ in range(50)]]
    for t in several:
        alone.append(again.score(t))
    assert again.scores(several) == alone and len(set(alone)) > 20 and again.scores([]) == []
    # Not ruled out: places that do not agree, carrier bytes in a side, no common end; nor is anything after a failed trial.
    for a, b in ((b"x" + model.ordinary, model.toxic), (b"I " + model.ordinary, b"yy" + model.toxic), (b"abc", b"def")):
        assert toxicity.Contrast(a, b).between(b" a b ", np.array([0]), np.array([5])).all()
    assert not again._holds([b" zz yy "], np.array([1]))


def test_toxicity_fitted_in_tasks_is_fitted_in_one_process(spark, sf):
    from graphloom.llm import toxicity

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs.repartition(5), labels)
    known = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.where("text is not null").select("doc_id", "text").distinct().join(known, "doc_id").orderBy("doc_id", "text").collect()
    one = toxicity.Model.trained([r.text for r in rows if r.toxic], [r.text for r in rows if not r.toxic])
    assert (model.ordinary, model.toxic) == (one.ordinary, one.toxic) and np.allclose(model.weights, one.weights, atol=1e-9)


def test_top_k_carries_what_it_has_reached(spark, monkeypatch):
    import pickle

    from graphloom.llm import top_k

    rng = np.random.default_rng(9)
    v = rng.integers(-200, 200, size=(3000, 16))
    v[1500:1520] = v[7]
    ids = np.arange(3000)
    search = top_k.Search(ids[:40], v[:40], top_k.rotation(v[:500].astype(float)), 5)

    class Sent:
        value = pickle.dumps([search])

    import pyarrow as pa

    def task(held):
        flat = pa.array(v.tolist(), pa.list_(pa.int64()))
        batches = [pa.RecordBatch.from_arrays([pa.array(ids[a : a + 100]), flat.slice(a, 100)], ["vec_id", "v"]) for a in range(0, 3000, 100)]
        return [r for b in top_k._task(Sent, 16, held)(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]

    score = v[:40] @ v.T
    want = {(q, int(c), int(score[q, c])) for q in range(40) for c in sorted((c for c in range(3000) if c != q), key=lambda c: (-score[q, c], c))[:5]}
    assert set(task(1 << 20)) == want
    # Thirty flushes give out no more rows than one.
    assert set(task(100)) == want and len(task(100)) == len(want) == 200
    rows = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "vec_id long, v array<long>")
    for most in (16 * 8 * 14, 16 * 8 * 20, 1 << 20):  # three passes, two and one
        got = top_k.top_k(rows, rows.where("vec_id < 40"), 5, most=most)
        assert {(r.query_id, r.vec_id, r.score) for r in got.collect()} == want
    with pytest.raises(ValueError, match="64 bits"):
        top_k.top_k(spark.createDataFrame([(1, [1 << 32, 0])], "vec_id long, v array<long>"), rows.limit(1).selectExpr("vec_id", "slice(v, 1, 2) v"), 5)


def test_a_cut_off_archive_is_a_value_error(spark, tmp_path):
    import gzip

    from graphloom.llm import archives

    whole = archives.arc_header(1, "x") + b"".join(archives.arc_record(1, f"http://a/{i}", "20200101000000", b"HTTP/1.0 200 OK\r\n\r\n" + bytes(range(256)) * 9) for i in range(20))
    (tmp_path / "cut.arc.gz").write_bytes(gzip.compress(whole)[:-40])
    files = spark.createDataFrame([(str(tmp_path / "cut.arc.gz"),)], "path string")
    with pytest.raises(Exception, match="ValueError.*is broken after record"):
        archives.convert_files(files, str(tmp_path / "out"))
