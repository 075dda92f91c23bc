"""Near-duplicates, repeated substrings, token files, packing and search, against brute force."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import ann, binary, common, packing, simhash, substrings, tokens, vector_dups
from tidemark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def labelled(n, pairs, names):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b, key=lambda k: names[k])] = min(a, b, key=lambda k: names[k])
    return [names[find(i)] for i in range(n)]


def brute_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(len(w) - 2, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


# --- SimHash


def test_simhash_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id")
    got = QUERIES["op9_simhash"](spark, SF).toPandas().sort_values("doc_id")
    prints = [brute_print(t) for t in docs.text]
    assert got.fingerprint.tolist() == [f"{p:016x}" for p in prints]
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    assert got.component_id.tolist() == labelled(len(prints), pairs, docs.doc_id.tolist())


@pytest.mark.parametrize("node_size", [4, 64, 100_000])
def test_trie_links(spark, node_size):
    r = np.random.default_rng(3)
    v = r.integers(0, 1 << 62, 60, dtype=np.uint64)
    v[:30] &= np.uint64(0xFF)  # crowd one node
    flips = v ^ (np.uint64(1) << r.integers(0, 64, 60, dtype=np.uint64))
    twice = flips ^ (np.uint64(1) << r.integers(0, 64, 60, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 60, dtype=np.uint64))
    v = np.unique(np.concatenate([v, flips, twice]))
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "simhash long"), node_size=node_size).collect()
    at = {int(x): i for i, x in enumerate(v.view(np.int64))}
    near = [(i, j) for i in range(len(v)) for j in range(i) if int(v[i] ^ v[j]).bit_count() <= 3]
    assert len(edges) <= 40 * len(v)  # forests, not all pairs; an edge leads to a root, not to a neighbour
    names = list(range(len(v)))
    assert labelled(len(v), [(at[a], at[b]) for a, b in edges], names) == labelled(len(v), near, names)


def test_simhash_odd_rows(spark):
    long = "w " * 60_000
    rows = [(5, None), (4, ""), (3, " \n "), (7, "A b c d"), (6, "a B c d"), (6, "a B c d"), (None, "a b c d"), (None, "other words here"), (9, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in simhash.near_duplicates(docs.withColumn("simhash", F.lit(1)).withColumn("component_id", F.lit(1))).select(F.coalesce("doc_id", F.lit(-1)), F.coalesce("component_id", F.lit(-1))).collect())
    assert got == sorted([(5, 3), (4, 3), (3, 3), (7, 6), (6, 6), (6, 6), (-1, 6), (-1, -1), (9, 9)])
    kept = sorted((r.doc_id or -1, r.text) for r in simhash.dedup(docs).collect())
    assert kept == sorted([(3, " \n "), (6, "a B c d"), (-1, "other words here"), (9, long)])
    assert simhash.dedup(docs.limit(0)).count() == 0


# --- repeated substrings


def brute_cut(texts, length):
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def cut(docs, length):
    found = substrings.dedup(docs, length)
    rows = found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("r"), F.size("spans").alias("s"), F.sha2("kept", 256).alias("h")).collect()
    return [tuple(r[1:]) for r in sorted(rows, key=lambda r: r.doc_id)]


def test_substring_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id")
    got = QUERIES["op10_substrings"](spark, SF).toPandas().sort_values("doc_id")
    raw = [t.encode() for t in docs.text]
    assert list(got[["n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False, name=None)) == brute_cut(raw, 400)
    assert got.n_passages.tolist() == [len(p) for p in passages_of(raw, 200, 51, 400)]


def test_substrings_at_every_offset(spark):
    r = np.random.default_rng(9)
    word = lambda n, k=26: bytes(r.integers(97, 97 + k, n, dtype=np.uint8)).decode()
    common_ = word(90)
    texts = []
    for i in range(60):
        a, b = sorted(r.integers(0, 91, 2))
        texts.append(word(int(r.integers(0, 60))) + common_[a:b] + word(int(r.integers(0, 60))))
    texts += ["ab" * 100, "ab" * 7 + word(30), "a" * 300, word(50), word(80, 2), word(200, 2), "é" * 60, texts[3] + texts[3], texts[5], "", common_ * 3, word(19), word(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert cut(docs, 20) == brute_cut([t.encode() for t in texts], 20)


def brute_runs(texts, length):
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, dtype=int)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p + 1 : p + length + 1] = 1
        turn = np.diff(gone)
        out.append(list(zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist())))
    return out


def passages_of(texts, least, words, enough):
    return [[(a, b) for a, b in runs if b - a >= enough or len(t[a:b].split()) >= words] for t, runs in zip(texts, brute_runs(texts, least))]


def mixed_texts():
    r = np.random.default_rng(8)
    word = lambda: bytes(r.integers(97, 123, int(r.integers(1, 5)), dtype=np.uint8)).decode()
    phrase = lambda n: " ".join(word() for _ in range(n))
    shared = [phrase(int(n)) for n in r.integers(4, 30, 12)]
    texts = [" ".join([phrase(int(r.integers(0, 9))), shared[int(r.integers(0, 12))], phrase(int(r.integers(0, 9)))]) for _ in range(60)]
    return [*texts, texts[3], texts[4] + texts[5], "a" * 90, "a" * 61, "é" * 40, "", shared[0], "xyz" * 30]


def test_passages_and_strings_in_one_search(spark):
    texts = mixed_texts()
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    raw = [t.encode() for t in texts] + [texts[0].encode()]
    want, short, long = brute_cut(raw, 40), passages_of(raw, 20, 8, 40), brute_runs(raw, 40)
    spans = lambda col: [(s.lo, s.hi) for s in col]
    got = Counter((r.doc_id, r.n_bytes, tuple(spans(r.passages)), tuple(spans(r.spans)), hashlib.sha256(r.kept).hexdigest()) for r in substrings.dedup_both(docs, 40, 20, 8).collect())
    assert got == Counter((d, w[0], tuple(p), tuple(s), w[3]) for d, w, p, s in zip([*range(len(texts)), 0], want, short, long))
    cut_ = Counter((r.doc_id, bytes(r.kept)) for r in substrings.dedup_passages(docs, 20, 8, 40).collect())
    gone = lambda t, p: b"".join(t[a:b] for a, b in zip([0, *(x for _, x in p)], [*(x for x, _ in p), len(t)]))
    assert cut_ == Counter((d, gone(t, p)) for d, t, p in zip([*range(len(texts)), 0], raw, short))


def test_substrings_of_a_very_long_text(spark):
    r = np.random.default_rng(6)
    long = bytes(r.integers(97, 123, 2_500_000, dtype=np.uint8)).decode()
    docs = spark.createDataFrame([(1, long), (2, long[1_000_000:1_000_700]), (3, "ab" * 600_000), (4, long[:399])], "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, [(s.lo, s.hi) for s in x.spans]) for x in substrings.dedup(docs).drop("kept").collect()}
    assert got == {1: (2_500_000, [(1_000_000, 1_000_700)]), 2: (700, [(0, 700)]), 3: (1_200_000, [(0, 1_200_000)]), 4: (399, [])}


def test_substring_odd_rows(spark):
    text = "x" + "abcdefghij" * 3
    docs = spark.createDataFrame([(1, None), (2, ""), (3, text), (3, text), (None, "lone words of one"), (4, "short")], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_bytes, len(r.kept)) for r in substrings.dedup(docs.withColumn("_h", F.lit(0)), 10).collect())
    assert got == Counter({(1, 0, 0): 1, (2, 0, 0): 1, (3, 31, 0): 2, (None, 17, 17): 1, (4, 5, 5): 1})
    assert substrings.dedup(docs.limit(0)).count() == 0


def test_cut_characters_go(spark):
    docs = spark.createDataFrame([(1, "é" + "a" * 12 + "z"), (2, "è" + "a" * 12 + "y")], "doc_id long, text string")
    for r in substrings.dedup(docs, 10, as_text=True).collect():
        assert r.kept in ("éz", "èy", "z", "y")


# --- token files and packing

TEXTS = ["Hello, World!", "", None, "it's 2024 and we'll see… ÉCOLE é İstanbul ΣΑΣ", "a b c \x1c d\x85e", "<|endoftext|> x<|endoftext|>y", "naïve  \n\t tabs", "日本語 テスト", "'s 't don't 'LL"]


def exact(texts, end):
    tk = Tokenizer.from_file(tokens.path_of(tokens.WORD_BPE))
    return [np.array([*tk.encode(t or "", add_special_tokens=False).ids, end], dtype="<u4") for t in texts]


def test_encoder_equals_the_library():
    got = tokens.encoder().encode([(t or "").encode() for t in TEXTS])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [x[:-1].tolist() for x in exact(TEXTS, 0)]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_encoder_equals_the_library_on_any_text(text):
    got = tokens.encoder().encode([text.encode("utf-8", "replace")])[0]
    assert np.frombuffer(got, "<u4").tolist() == exact([text.encode("utf-8", "replace").decode()], 0)[0][:-1].tolist()


@given(st.lists(st.integers(0, 5000), max_size=700))
def test_elias_fano(steps):
    values = np.cumsum(np.array(steps, dtype=np.int64))
    code = binary.EliasFano.of(values)
    assert (code.slice(0, len(values)) == values).all()
    for i in range(0, len(values), 37):
        assert code.select(i) == values[i]
        assert (code.slice(i, min(i + 300, len(values))) == values[i : i + 300]).all()
    if len(values) > 300 and values[-1]:
        assert len(code.low) + len(code.high) <= len(values) * (2.2 + max(0, np.log2(values[-1] / len(values)))) / 8 + 16


def test_token_file_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id")
    want = exact(docs.text, 2)
    n = np.array([len(x) for x in want])
    got = QUERIES["op6_token_ids"](spark, SF).toPandas().sort_values("doc_id")
    assert (got.n_tokens.to_numpy() == n).all() and (got.start.to_numpy() == np.cumsum(n) - n).all()
    assert got.ids_crc32.tolist() == [zlib.crc32(x.tobytes()) for x in want]


def test_token_file_odd_rows(spark):
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (None, "no id"), (50, "long text " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit("mine")).withColumn("ids", F.lit(1))
    got = binary.read(binary.write(docs).df).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 0, 1, 2, 3, 3, *range(4, len(TEXTS)), 50]
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids) // 4
    assert bytes(got[1].ids) == exact([TEXTS[0]], 2)[0].tobytes()
    empty = binary.write(spark.createDataFrame([], "doc_id long, text string"))
    assert binary.read(empty.df).count() == 0


def test_token_file_offsets(spark, monkeypatch):
    monkeypatch.setattr(binary, "SLICE", 7)
    rows = [(i // 2, f"text {i} " * (i % 9)) for i in range(700)] + [(None, "x")]
    files = binary.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).df
    whole = Counter((r.doc_id, r.start, len(r.ids) // 4) for r in binary.read(files).collect())
    assert len(whole) == 701
    wanted = spark.createDataFrame([(5,), (5,), (340,), (349,), (0,), (9_999,), (None,)], "doc_id long")
    got = Counter(tuple(r) for r in binary.offsets(files, wanted).collect())
    assert got == Counter({k: n for k, n in whole.items() if k[0] in (5, 340, 349, 0)}) and len(got) == 8


def check_packing(pieces, want):
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append(p)
    for window in by.values():
        window.sort(key=lambda p: p.offset)
        at = 0
        for p in window:
            assert p.offset == at and p.length == len(p.ids) // 4 > 0
            at += p.length
        assert at <= 2048 and at & (at - 1) == 0
    whole = Counter()
    cover = {}
    for p in pieces:
        cover.setdefault((p.doc_id, p.start), []).append(bytes(p.ids))
        whole[p.doc_id] += p.length
    for doc, ids in want.items():
        assert whole[doc] == sum(map(len, ids))
    return by


def test_packing_query(spark):
    docs = common.documents(spark, SF)
    pdf = docs.toPandas()
    want = dict(zip(pdf.doc_id, exact(pdf.text, 1)))
    pieces = packing.pack(docs).collect()
    check_packing(pieces, {d: [x] for d, x in want.items()})
    for p in pieces:
        assert bytes(p.ids) == want[p.doc_id][p.start : p.start + p.length].tobytes() and p.doc_tokens == len(want[p.doc_id])
    crc = QUERIES["op7_packing"](spark, SF).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in crc) == Counter((p.doc_id, p.start, p.length, zlib.crc32(p.ids)) for p in pieces)


def test_packing_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c"), (4, "long text " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("mine")).withColumn("part", F.lit(1))
    pieces = packing.pack(docs.coalesce(1)).collect()
    check_packing(pieces, {d: exact([t for e, t in rows if e == d], 1) for d in (1, 2, 3, None, 4)})
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("fan", [1024, 4])
def test_packing_merges_over_partitions(spark, fan):
    rows = [(i, f"some words of {i} " * 60) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    want = {d: exact([t], 1) for d, t in rows}
    by = check_packing(packing.pack(docs, fan=fan).collect(), want)
    total, sizes = sum(len(x[0]) for x in want.values()), sorted((sum(p.length for p in w) for w in by.values()), reverse=True)
    assert total // 20 < 2048 < total
    assert sizes[: total // 2048] == [2048] * (total // 2048)
    assert len(sizes) - total // 2048 == (total % 2048).bit_count()


@settings(deadline=None)
@given(st.lists(st.integers(1, 90), max_size=60), st.integers(1, 5))
def test_packer_keeps_everything(sizes, windows):
    packer, out = packing.Packer(32, windows), []
    for d, n in enumerate(sizes):
        out += packer.add(d, np.arange(n, dtype="<u4").tobytes())
        assert len(packer.open) <= windows
    out += packer.finish()
    got = {}
    for window in out:
        total = sum(len(p[2]) // 4 for p in window)
        assert total <= 32 and total & (total - 1) == 0
        for doc, start, ids, n in window:
            got.setdefault(doc, {})[start] = np.frombuffer(ids, "<u4")
            assert n == sizes[doc]
    for d, n in enumerate(sizes):
        assert np.concatenate([got[d][s] for s in sorted(got[d])]).tolist() == list(range(n))


# --- vectors


def vectors_(seed=4, n=400, dim=16):
    r = np.random.default_rng(seed)
    base = r.standard_normal((n, dim))
    base[n // 2 :] = base[: n - n // 2] + 0.09 * r.standard_normal((n - n // 2, dim))
    base[-20:] = base[0] + 0.02 * r.standard_normal((20, dim))
    return base


@pytest.mark.parametrize("cell", [20, 10_000])
def test_vector_links(spark, cell):
    x = vectors_()
    x[10:14] = x[9]
    x[14] = 3 * x[9]
    ids = np.arange(len(x)) * 3 + 1
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dups.near_duplicates(df, cell_size=cell, block=64).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    comp = labelled(len(x), list(zip(*np.nonzero(near))), ids.tolist())
    assert got == {int(i): (int(near[k].sum()), c, i == c) for k, (i, c) in enumerate(zip(ids, comp))}


ODD_VECTORS = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (20, [0.0, 1.0]), (40, [0.0, 1.0])]


def test_vector_odd_rows(spark):
    df = spark.createDataFrame(ODD_VECTORS, "vec_id long, embedding array<float>").withColumn("n_links", F.lit("x"))
    got = sorted(((r.vec_id or -1), r.n_links, r.component_id or -1, r.kept) for r in vector_dups.near_duplicates(df).collect())
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)]
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), *alone, (-1, 0, -1, False), (20, 1, 20, True), (40, 1, 20, False)])
    assert vector_dups.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("made", [False, True])
def test_vector_query_equals_sql(spark, tmp_path, made):
    import duckdb

    folder = str(tmp_path) if made else "/root/testdata/sf0.01"
    if made:
        rows = [(i, v.tolist()) for i, v in enumerate(vectors_(2, 200, 8))] + [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, [None, 1.0])]
        spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet{'/*.parquet' if made else ''}'")
    want = con.execute(ORACLES["op2_embedding_dups"]).fetchdf().sort_values("vec_id")
    got = QUERIES["op2_embedding_dups"](spark, folder).toPandas().sort_values("vec_id")
    for c in ("vec_id", "n_links", "component_id", "kept"):
        assert got[c].tolist() == want[c].tolist()
    assert not made or (got.n_links > 1).any()


def test_vectors_of_many_lengths(spark):
    r = np.random.default_rng(7)
    rows = [(100 * d + i, (r.standard_normal(d) + 10 * (i % 3 == 0)).tolist()) for d in range(2, 72) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {x.vec_id: (x.n_links, x.component_id) for x in vector_dups.near_duplicates(df, block=4).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    links = {i: {j for j in unit if i != j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95} for i in unit}
    names = sorted(unit)
    comp = labelled(len(names), [(a, b) for a, i in enumerate(names) for b, j in enumerate(names) if j in links[i]], names)
    assert got == {i: (len(links[i]), c) for i, c in zip(names, comp)}
    queries = sorted(i for i in unit if i % 20 == 0)
    found = Counter(x.query_id for x in ann.search(df, F.col("vec_id") % 20 == 0).collect())
    assert found == Counter({i: 5 for i in queries})


def test_search_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding.to_numpy()).astype(float)
    got = QUERIES["op8_nearest"](spark, sf).toPandas()
    hit = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(axis=1)
        mine = got[got.query_id == ids[i]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21))
        assert np.allclose(mine.score, s[np.searchsorted(ids, mine.vec_id)], rtol=1e-12) if (np.diff(ids) > 0).all() else True
        s[i] = -np.inf
        hit += len(set(mine.vec_id) & set(ids[np.lexsort((ids, -s))[:20]]))
        total += 20
    assert total == 20 * int((ids % 20 == 0).sum()) and hit / total >= 0.9
    assert ann.parts_for(len(ids), 20, 4_096, 8, 256) == 8  # the parts are learnt on a table of this size too


def test_parts_follow_the_table():
    assert [ann.parts_for(n, 20, 4_096, 8, 256) for n in (5, 319, 320, 40_000, 300_000, 10**9)] == [1, 1, 8, 16, 128, 256]


def test_search_recall_and_scores(spark):
    x = vectors_(5, 3_000, 16)
    x[50:90] = x[7]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, part_size=400).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    assert sorted(got) == list(range(0, 3_000, 20))
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21)) and q not in [r[1] for r in rows]
        s = (x * x[q]).sum(axis=1)
        assert np.allclose([r[2] for r in rows], s[[r[1] for r in rows]], rtol=1e-12)
        assert [(-r[2], r[1]) for r in rows] == sorted((-r[2], r[1]) for r in rows)
        s[q] = -np.inf
        hit += len({r[1] for r in rows} & set(np.lexsort((np.arange(len(x)), -s))[:20].tolist()))
        total += 20
    assert hit / total >= 0.9


def test_parts_are_balanced_and_learnt():
    r = np.random.default_rng(2)
    centres = r.standard_normal((8, 12)) * 4
    x = (centres[np.arange(1_600) % 8] + r.standard_normal((1_600, 12)))
    label = ann.balanced_cut(ann.neighbour_graph(x, 10), 8)
    assert np.bincount(label).tolist() == [200] * 8
    router = ann.learn(x, 8, 10, 0.95)
    assert router.probes < 8


def test_search_odd_rows(spark):
    df = spark.createDataFrame(ODD_VECTORS, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    got = sorted(tuple(r) for r in ann.search(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(20, 1, 40, 1.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0), (20, 4, 2, 0.0), (40, 1, 20, 1.0), (40, 2, 1, 0.0), (40, 3, 2, 0.0), (40, 4, 2, 0.0)]
    assert ann.search(df.limit(0), F.lit(True)).count() == 0
