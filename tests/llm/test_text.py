"""Classifiers, language identification, mixing and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import common, langid, mixing, quality, toxicity
from tidemark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
ODD = [(1, "ein Text über Hunde und Katzen", "de", "a", 9), (1, "ein Text über Hunde und Katzen", "de", "a", 9), (None, None, None, None, None), (2, "", "en", "b", 0), (3, "the dog and the cat " * 5000, "en", "b", 1), (4, "123 !!", "en", None, 1), (5, "the cat and the dog", None, "c", 1)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def held(ids, modulus, rest):
    return {i: zlib.crc32(str(i).encode()) % modulus == rest for i in ids}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize(("name", "label", "modulus", "rest", "least"), [("op1_toxicity", "toxic", 4, 2, 0.9), ("op5_quality", "quality", 3, 1, 0.95)])
def test_classifier(spark, labels, name, label, modulus, rest, least):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    want = held(got.doc_id, modulus, rest)
    assert all(want[i] == h for i, h in zip(got.doc_id, got.held_out))
    assert got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= {"toxic": 0.3, "quality": 0.5}[label])).all()
    out = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert (out.predicted == out[label]).mean() > least


def test_classifiers_take_odd_rows(spark, odd, labels):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for model, score, name in ((toxicity.fit(docs, labels, F.lit(True), sample=300), toxicity.score, "toxicity"), (quality.fit(docs, labels, F.lit(True), sample=300), quality.score, "quality")):
        got = score(odd.withColumn(name, F.lit("mine")).withColumn("_bytes", F.lit(1)), model).toPandas()
        assert len(got) == len(ODD) and got[name].between(0, 1).all()
        assert got[got.doc_id == 1][name].nunique() == 1
        assert got[got.text.isna()][name].iloc[0] == got[got.text == ""][name].iloc[0]


def test_classifiers_without_labels(spark, odd):
    none = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    empty = odd.limit(0)
    for docs in (odd, empty):
        assert toxicity.score(docs, toxicity.fit(docs, none, F.lit(True))).count() == docs.count()
        assert quality.score(docs, quality.fit(docs, none, F.lit(True))).count() == docs.count()
    one = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.good for r in quality.score(odd, quality.fit(odd, one, F.lit(True))).collect()} == {1}
    # a single label 0: the smoothed share of ones is 1 / 3 of 1 document
    assert {(round(r.toxicity, 6), r.toxic) for r in toxicity.score(odd, toxicity.fit(odd, one, F.lit(True))).collect()} == {(round(1 / 3, 6), 1)}


def hashed_gram(gram):
    h = 0
    for c in gram:
        h = ((h ^ ord(c)) * 0x9E3779B1) & 0xFFFFFFFF
        h ^= h >> 15
    return (((h ^ (len(gram) * 0x85EBCA6B & 0xFFFFFFFF)) * 0xC2B2AE35) & 0xFFFFFFFF) >> (32 - toxicity.BITS)


def brute_grams(text, slots):
    padded = " ".join(["", *(text or "").lower().split(), ""])
    found = {slots[hashed_gram(padded[i : i + n])] for n in toxicity.ORDERS for i in range(len(padded) - n + 1)}
    return sorted(found - {-1})


@pytest.fixture(scope="module")
def few(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1500").limit(60).select("doc_id", "text")
    extra = [(10_001, "ÉTÉ où ΣΑΣ日本語  ½"), (10_002, ""), (10_003, None), (10_004, "a"), (10_005, "x " * 3_000)]
    return rows.union(spark.createDataFrame(extra, rows.schema))


def test_toxicity_equals_a_plain_scorer(spark, few, labels):
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels, F.lit(True), sample=300)
    for r in toxicity.score(few, model).collect():
        z = model.intercept + sum(model.weights[g] for g in brute_grams(r.text, model.slots))
        assert r.toxicity == pytest.approx(1 / (1 + np.exp(-np.clip(z, -35, 35))), rel=1e-9)


def test_toxicity_counts_texts_by_class():
    import collections

    texts = ["Abc abc", "abd ÀB", "zzz"]
    want = collections.Counter()
    for t in texts[:2]:
        want.update(set(brute_grams(t, np.arange(1 << toxicity.BITS))))
    rows = [feature.tolist() for _, feature in toxicity.presence([t.encode() for t in texts[:2]])]
    assert collections.Counter(x for r in rows for x in r) == want


def test_quality_equals_a_plain_scorer(spark, few, labels):
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels, F.lit(True), sample=300, steps=60)
    for r in quality.score(few, model).collect():
        x = quality.features([(r.text or "").encode()])[0]
        z = np.clip((x - model.mean) / model.spread, -8, 8)
        held = brute_grams(r.text, model.slots)
        s = np.r_[z, np.minimum(z * z, 16)] @ model.weights + sum(model.grams[g] for g in held) / np.sqrt(max(len(held), 1)) - model.cut
        assert r.quality == pytest.approx(1 / (1 + np.exp(-np.clip(s, -35, 35))), rel=1e-6)


def test_quality_tells_the_order_of_bytes():
    one, two = quality.features([b"stop pots tops opts", b"stop stop stop stop"])
    assert one[quality.NAMES.index("distinct")] == 1 and two[quality.NAMES.index("distinct")] == 0.25


def test_repeated_ids_do_not_swell_the_sample(spark, labels):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "two")], "doc_id long, text string")
    known = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    from tidemark.llm import linear

    assert linear.labelled_texts(docs, known, "toxic", F.lit(True), 10).count() == 2


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    got = QUERIES["op3_language_id"](spark, SF).toPandas().merge(docs, on="doc_id")
    assert len(got) == len(docs)
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.98
    want = held(got.doc_id, 4, 2)
    assert all(want[i] == h for i, h in zip(got.doc_id, got.held_out))


def test_words_are_letters_and_marks():
    assert langid.words_of("½ ² ① Ⅷ 12 _ !") == []
    assert langid.words_of("हिन्दी naïve x1y²z Ærø’s") == ["हिन्दी", "naïve", "x", "y", "z", "ærø", "s"]
    assert langid.words_of("cafe\u0301 ok") == ["cafe\u0301", "ok"]


def plain_language(text, model):
    import unicodedata

    words, word = [], ""
    for c in (text or "").lower() + " ":
        kind = unicodedata.category(c)[0]
        if kind == "L" or (kind == "M" and word):
            word += c
        elif word:
            words.append(word)
            word = ""
    if not words:
        return "und", 0.0
    total = np.zeros(len(model.langs))
    for w in words:
        if w in model.tables[0]:
            total += model.logs[0][[model.tables[0][w]]][0]
            continue
        padded = f" {w} "
        for n in model.orders:
            hits = [model.tables[n][padded[i : i + n]] for i in range(len(padded) - n + 1) if padded[i : i + n] in model.tables[n]]
            if hits:
                total += model.logs[n][hits].mean(axis=0)
                break
    return model.langs[int(total.argmax())], float(1 / np.exp(total - total.max()).sum())


def test_language_equals_a_plain_scorer(spark, few):
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 7 = 0"), F.lit(True), entries=300)
    for r in langid.predict(few, model).collect():
        lang, score = plain_language(r.text, model)
        assert (r.lang_pred, r.lang_score) == (lang, pytest.approx(score, rel=1e-3))


def test_language_backs_off():
    import numpy as np

    model = langid.Model(["aa", "bb"], np.zeros(2), {0: {"word": 0}, 2: {"xy": 0}, 1: {"q": 0}}, {0: np.array([[-1.0, -9.0]]), 2: np.array([[-9.0, -1.0]]), 1: np.array([[-1.0, -2.0]])}, (2, 1))
    assert langid.identify("word", model)[0] == "aa"
    assert langid.identify("axya", model)[0] == "bb"
    assert langid.identify("qqq", model)[0] == "aa"
    assert langid.identify("zzz", model) == ("aa", 0.5)
    assert langid.identify("12 !", model) == ("und", 0.0)


def test_language_takes_odd_rows(spark, odd):
    model = langid.fit(odd, F.lit(True))
    got = langid.predict(odd.withColumn("lang_pred", F.lit(7)), model).toPandas()
    assert len(got) == len(ODD)
    assert set(got[got.text.isna() | got.text.isin(["", "123 !!"])].lang_pred) == {"und"}
    assert set(got[got.doc_id == 5].lang_pred) == {"en"} and set(got[got.doc_id == 1].lang_pred) == {"de"}
    none = langid.fit(odd.limit(0), F.lit(True))
    assert {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}


def test_language_rare_words_are_kept(spark):
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghij", k=6)) for _ in range(130)]
    rows = [(i, " ".join(words[60 * (i % 2) : 60 * (i % 2) + 60]), "xy"[i % 2]) for i in range(40)]
    rows += [(100 + i, " ".join(words[120:]), "rare") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True), entries=20)
    assert set(words[120:]) <= set(model.tables[0]) and len(model.tables[0]) == 50
    assert {(r.lang, r.lang_pred) for r in langid.predict(docs.where("lang = 'rare'"), model).collect()} == {("rare", "rare")}


def test_language_of_many(spark):
    # 203 languages of one word each; the last three are the rarest, and a full memo starts anew
    name = lambda i: f"{'abcdefghijklmno'[i % 15]}{'abcdefghijklmno'[i // 15]}"
    rows = [(1000 * k + i, f"{name(i)}qz{name(i)} " * 4, f"l{i:03}") for i in range(203) for k in range(1 if i >= 200 else 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)
    model = langid.fit(docs, F.lit(True))
    assert len(model.langs) == 203
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows) and all(r.lang_pred == r.lang for r in got)


def test_language_rows_equal_dense_ones():
    counts = np.array([[3, 0, 1], [0, 0, 7], [2, 2, 0]])
    total = np.array([10.0, 4.0, 20.0]) + 0.1 * 3
    entry, lang = np.nonzero(counts)
    rows = langid.Rows(np.log(0.1 / total), np.searchsorted(entry, np.arange(4)), lang, np.log(10.0 * counts[entry, lang] + 1))
    assert np.allclose(rows[[2, 0, 1, 2]], np.log((counts + 0.1) / total)[[2, 0, 1, 2]])


def test_mixing_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(ORACLES["op4_mixing"]).fetchdf().sort_values("doc_id")
    got = QUERIES["op4_mixing"](spark, SF).toPandas().sort_values("doc_id")
    for c in ("doc_id", "size", "source_size", "taken"):
        assert (got[c].to_numpy() == want[c].to_numpy()).all()
    assert (abs(got.target.to_numpy() - want.target.to_numpy()) < 1e-6).all()
    assert (got.taken <= 2 * got["size"]).all()


def test_mixing_targets(spark, odd):
    sizes = spark.createDataFrame([("a", 100), ("b", 100), ("c", 1000), (None, 1000), ("e", 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # a: 5, b: 2, c: 1, e: 5, none: 2; 3300 words to share; a and b are capped at 200, e at 0
    assert got["a"] == 200 and got["b"] == 200 and got["e"] == 0
    assert got["c"] == pytest.approx(2900 / 3) and got[None] == pytest.approx(2 * 2900 / 3)
    mixed = mixing.copies(odd)
    assert mixed.count() == len(ODD) and mixing.copies(odd.limit(0)).count() == 0
    twice = [Counter((r.doc_id, r.copies) for r in mixing.copies(odd.repartition(n)).collect()) for n in (1, 5)]
    assert twice[0] == twice[1]
    clashing = odd.withColumns({c: F.lit("mine") for c in ("size", "target", "copies", "_source", "_w", "_cap", "_copy")})
    assert Counter(mixing.copies(clashing).select(*mixed.columns).collect()) == Counter(mixed.collect())
    assert {(r._source, r._w, r._cap) for r in mixing.copies(clashing).collect()} == {("mine",) * 3}
    shuffled = mixing.copies(odd, broadcast_bytes=0)
    assert Counter(shuffled.collect()) == Counter(mixed.collect())


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (None, 1), (10, 11), (11, 12), (12, 13), (13, 3), *[(100, i) for i in range(101, 160)]]
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in (2, 3, 10, 11, 12, 13)} == {1} and got[5] == 4 and 7 not in got
    assert {got[i] for i in range(101, 160)} == {100}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
    path = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert set(dict(common.components(path).collect()).values()) == {0}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("simhash", F.lit("x")).withColumn("_h", F.lit(1)).withColumn("kept", F.lit(2)).withColumn("size", F.lit(3)).withColumn("lang_pred", F.lit(4))
    names, before = docs.columns, docs.count()
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.cut(stage(spark, docs, SF))
        counts[name] = docs.count()
        if name != "packing":
            assert docs.columns == names
            first = docs.first()
            assert (first.simhash, first._h, first.kept, first["size"], first.lang_pred) == ("x", 1, 2, 3, 4)
        if name == "mixing":
            mixed = docs.toPandas()
    assert counts["language ID"] >= 0.99 * before
    assert counts["suffix-array dedup"] <= counts["SimHash near-dedup"] < before
    pieces = docs.toPandas()
    per = pieces.groupby("sequence_id").length.sum()
    assert per.max() <= 2048 and all(n == 2048 or n & (n - 1) == 0 for n in per)
    assert set(pieces.doc_id) == set(mixed.doc_id)
    one = pieces.drop_duplicates(["doc_id", "start"]).groupby("doc_id").doc_tokens.first()
    assert pieces.length.sum() == sum(one[i] * n for i, n in mixed.doc_id.value_counts().items())


def test_pipeline_takes_odd_rows(spark, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = common.cut(stage(spark, docs, SF))
    assert {r.doc_id for r in docs.collect()} <= {1, 3, 5}
    docs = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.cut(stage(spark, docs, SF))
    assert docs.count() == 0


def test_pipeline_removes_what_repeats(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randint(3, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = {n: prose(n) for n in (30, 51, 55, 60, 70)}
    rows, clean = [], {}
    for i in range(40):
        n = (51, 55, 60, 70, 30)[i % 5]
        a, b = prose(80), prose(90)
        rows.append((i, f"{a} {shared[n]} {b}", "en", "s", 0))
        if n == 30:
            clean[i] = rows[-1][1]
    for i in range(40, 60):
        clean[i] = prose(120)
        rows.append((i, clean[i], "en", "s", 0))
    rows += [(60, shared[51], "en", "s", 0), (61, "", "en", "s", 0), (62, clean[41] + " tail", "en", "s", 0), (63, clean[41], "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    near = {x.doc_id: x.text for x in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert 41 in near and not {62, 63} & set(near) and set(clean) <= set(near)
    left = {x.doc_id: x for x in corpus_pipeline.substring_dedup(spark, docs.where("doc_id < 62"), SF).collect()}
    assert set(left) == set(range(60)) | {61}  # 60 was a passage and nothing else; 61 never had a word
    for i, x in left.items():
        assert x.n_chars == len(x.text)
        assert clean[i] == x.text if i in clean else not any(shared[n] in x.text for n in (51, 55, 60, 70))
