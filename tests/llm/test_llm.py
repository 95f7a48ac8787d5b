"""Small tests of the operators: contracts against brute force, and the odd cases that each docstring defines."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bytesift.llm import ann, encoders, html, langid, linededup, mixing, packing, sharding, tokencount, topk, vectors

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = "long words and more " * 20_000
ODD = [None, "", " ", "\n\n", "a", "a  b   c ", "▁x", "x▁ y", "it's 12\t<|endoftext|> end", "<s> </s>", "é ß 中文 😀", "\x00\x1c \x85", LONG]


# --- encoders and token counts ---


def test_encoders_equal_their_libraries():
    import sentencepiece

    tk, sp = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = np.random.default_rng(1)
    alphabet = [*" \n\t▁ab'é中😀1.", "  ", "<|endoftext|>", "<s>", "the", "'s", "\xa0", "　", "\x1c"]
    texts = [t for t in ODD if t is not None] + ["".join(rng.choice(alphabet, rng.integers(0, 16))) for _ in range(4000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoders.ByteLevelEncoder(BPE).many(texts)] == [e.ids for e in tk.encode_batch(texts, add_special_tokens=False)]
    assert encoders.PieceCounter(PIECES).many(texts) == [len(x) for x in sp.encode(texts)]


@pytest.mark.parametrize("path", [BPE, PIECES, public_tokenizers.path("word_bpe_49k.json")])
def test_token_counts_and_cache(spark, tmp_path, path):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(ODD)] + [(None, "a", 7), (4, "a", 7), (4, "a", 7)], "doc_id long, text string, n_tokens int")
    cache = str(tmp_path / "cache")
    first = tokencount.count_tokens(docs, path, cache, limit=100).collect()
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for t in ODD})
    again = tokencount.count_tokens(docs, path, cache, limit=100).collect()
    assert spark.read.parquet(cache).count() == stored  # nothing was encoded again
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, first), key=key) == sorted(map(tuple, again), key=key)
    want = dict(zip(range(len(ODD)), encoders.count_many(path, [t or "" for t in ODD])))
    assert len(first) == len(ODD) + 3
    for r in first:
        i = 4 if r.doc_id is None else r.doc_id
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((ODD[i] or "").encode()), want[i], want[i] > 100)
    assert tokencount.count_tokens(docs.limit(0), path, cache).count() == 0


# --- packing ---


def brute_best_fit(sizes, capacity):
    left = []
    for s in sorted(sizes, reverse=True):
        fits = [x for x in left if x >= s]
        if fits:
            left[left.index(min(fits))] -= s
        else:
            left.append(capacity - s)
    return sorted(left)


def test_best_fit_decreasing_and_bounds():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 40, 300):
        for top in (20, 60, 100):
            sizes = rng.integers(1, top + 1, n)
            bins, offsets, k = packing.best_fit_decreasing(sizes, 100)
            fill = np.bincount(bins, sizes, k) if n else np.zeros(0)
            assert sorted((100 - fill).astype(int).tolist()) == brute_best_fit(sizes.tolist(), 100)
            for b in range(k):
                own = np.argsort(offsets[bins == b])
                assert np.concatenate([[0], np.cumsum(sizes[bins == b][own])])[:-1].tolist() == offsets[bins == b][own].tolist()
            assert packing.lower_bound(sizes, 100) <= k
    assert packing.lower_bound(np.array([51] * 7), 100) == 7 and packing.lower_bound(np.array([34] * 7), 100) == 4


def test_cut_points():
    assert packing.cut_points(1024, 1024) == [(0, 1024)]
    assert packing.cut_points(2050, 1024) == [(0, 2), (2, 1026), (1026, 2050)]
    assert packing.cut_points(2048, 1024) == [(0, 1024), (1024, 2048)]


def check_packing(rows, ids, capacity):
    """rows: (doc, piece, start, length, crc, sequence, offset); ids: {doc: ids}. Each piece is right, and each sequence gapless."""
    pieces = Counter()
    by_seq = {}
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32 and len(own) == r.length
        pieces[r.doc_id] += r.length
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return pieces, len(by_seq)


@pytest.mark.parametrize("partition", [50_000, 40])
def test_packing(spark, partition):
    texts = [t for t in ODD if t != LONG] + ["word " * n for n in (3, 30, 100, 200, 300, 1023, 1024, 1025, 5000)] + [f"some text {i} " * (i % 60) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(9000, texts[-1], "x")] * 2, "doc_id long, text string, bin string")
    rows = packing.pack_documents(docs, BPE, 2, 1024, partition).collect()
    tk = Tokenizer.from_file(BPE)
    ids = {i: tk.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    ids[9000] = ids[len(texts) - 1]
    pieces, n = check_packing(rows, ids, 1024)
    assert pieces == Counter({i: len(v) * (2 if i == 9000 else 1) for i, v in ids.items()})
    assert n <= -(-sum(pieces.values()) // 1024) + 1
    assert packing.pack_documents(docs.limit(0), BPE, 2).collect() == []


def test_null_ids_are_packed(spark):
    docs = spark.createDataFrame([(None, "a b c"), (1, None)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.length) for r in packing.pack_documents(docs, BPE, 2).collect()) == [(False, 1), (True, 4)]


def test_pieces_can_carry_their_ids(spark):
    docs = spark.createDataFrame([(1, "hello world " * 600)], "doc_id long, text string")
    rows = sorted(packing.encode_pieces(docs, BPE, 2, 1024, with_ids=True).collect(), key=lambda r: r.piece)
    assert sum((r.ids for r in rows), []) == Tokenizer.from_file(BPE).encode("hello world " * 600, add_special_tokens=False).ids + [2]


# --- mixing ---


def water(sizes, weights=(1, 2, 3), cap=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    free, left, out = set(names), float(sum(sizes.values())), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > cap * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def test_mixing(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(0, 90)), s) for i, s in enumerate(rng.choice(["a", "B", "é", "hot", "hot", "hot", "hot", "z"], 900).tolist())]
    rows += [(5000, "one two", "tiny"), (5001, None, "silent"), (5002, "", "silent"), (None, "x y z", None), (5003, "x y z", None), (5003, "x y z", None), (5004, LONG, "hot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit("extra"))
    out = mixing.mix_documents(docs, block_rows=100)
    got = out.collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = water(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        ratio = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert r.copies in (int(ratio + 1e-9), int(ratio + 1e-9) + 1)
        taken[r.source] += r.taken
    for s in ("a", "B", "é", "z"):
        assert abs(taken[s] - want[s]) <= 3
    key = lambda r: tuple(str(x) for x in r)
    again = mixing.mix_documents(docs.repartition(5), block_rows=100).collect()
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, again), key=key)
    assert mixing.mix_documents(docs.limit(0)).collect() == []


def test_mixed_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "x", 1), (2, "c d e", "y", 2), (2, "c d e", "y", 2), (None, "f", None, 3)], "doc_id long, text string, source string, row_id int").withColumn("row_copies", F.lit(1))
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    plan = {(r.doc_id, r.source): r.copies for r in mixing.mix_documents(docs).filter("doc_id <> 2").collect()}
    counts = Counter((r.doc_id, r.source) for r in out.filter("doc_id <> 2").collect())
    assert counts == Counter({k: n for k, n in plan.items() if n})


def test_flight_keeps_both_sums():
    rng = np.random.default_rng(4)
    for n, size in ((500, rng.integers(0, 1000, 500)), (50, np.full(50, 7)), (3, np.array([0, 0, 5])), (0, np.zeros(0))):
        p = np.full(n, 0.37)
        q = mixing.flight(p, size, np.random.default_rng(1))
        assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2
        assert abs(q.sum() - p.sum()) < 1e-6 and abs((q - p) @ size) < 1e-4
    mean = np.mean([mixing.flight(np.full(6, 0.3), np.array([1, 2, 3, 4, 5, 6]), np.random.default_rng(s)) for s in range(3000)], 0)
    assert np.abs(mean - 0.3).max() < 0.04


# --- sharding ---


def test_lookup_table_and_shards(spark):
    names = tuple(f"s{i}" for i in range(7))
    table = sharding.lookup_table(names, 1009)
    prefer = {n: [(sharding._hash(n, "offset") + j * (sharding._hash(n, "skip") % 1008 + 1)) % 1009 for j in range(1009)] for n in names}
    free, own = set(range(1009)), {}
    while free:  # the same by hand: turns, each taking the first free slot of its list
        for i, n in enumerate(names):
            if free:
                slot = next(s for s in prefer[n] if s in free)
                free.discard(slot)
                own[slot] = i
    assert table.tolist() == [own[s] for s in range(1009)]
    assert max(Counter(table.tolist()).values()) - min(Counter(table.tolist()).values()) <= 1
    less = sharding.lookup_table(names[:-1], 1009)
    moved = (less != table)[table != 6].mean()
    assert moved < 0.25  # most slots of the shards that stay are where they were
    docs = spark.createDataFrame([(i, "x") for i in range(500)] + [(None, "n"), (3, "again")], "doc_id long, slot string")
    got = sharding.shard(docs, ["doc_id"], names, 1009)
    rows = got.collect()
    assert got.columns == ["doc_id", "slot", "_slot", "shard", "shard_name"] and len(rows) == 502
    assert all(names[r.shard] == r.shard_name and table[r._slot] == r.shard for r in rows)
    assert len({r.shard for r in rows if r.doc_id == 3}) == 1
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    for bad in ((), ("a", "a")):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 1009)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)
    assert sharding.shard(docs.limit(0), ["doc_id"]).count() == 0


def test_written_shards(spark, tmp_path):
    rows = [(i % 3 or None, "text " * (i % 50), i) for i in range(600)] + [(7, "long " * 50_000, 600), (7, None, 601)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    at = str(tmp_path / "s")
    sharding.write_shards(docs, ["doc_id"], at, file_bytes=20_000)
    back = spark.read.parquet(at)
    assert sorted((r.doc_id or -1, r.text or "", r["shard"]) for r in back.collect()) == sorted((d or -1, t or "", n) for d, t, n in rows)
    folders = {p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("_shard=")}
    assert len(folders) <= 4 and max(len(list((tmp_path / "s" / f).glob("*.parquet"))) for f in folders) > 1  # one key, several files
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        sharding.write_shards(docs, ["doc_id"], at)
    assert spark.read.parquet(at).count() == len(rows)
    sharding.write_shards(docs.limit(0), ["doc_id"], str(tmp_path / "none"))
    assert not list((tmp_path / "none").rglob("*.parquet"))


# --- vectors ---


def vector_frame(spark, x, odd=True):
    rows = [(i, [float(v) for v in row], "e") for i, row in enumerate(x)]
    if odd:
        n = len(x)
        rows += [(n, None, "e"), (n + 1, [0.0] * 8, "e"), (n + 2, [1.0, None, 2.0], "e"), (n + 3, [float("nan")] * 8, "e"), (n + 4, [float("inf")] * 8, "e"), (n + 5, [], "e"), (0, rows[0][1], "e"), (None, rows[1][1], "e")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, norm string")


def test_additive_quantisation_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(3000, 32)) * rng.gamma(2, 1, (3000, 1))).astype(np.float32).astype(float)
    out = ann.search(vector_frame(spark, x, odd=False), lambda i: i % 20 == 0, k=20, rerank=100, shard_rows=1000, block_queries=64).collect()
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    hit = 0
    for q in range(0, 3000, 20):
        own = sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21))
        assert np.allclose([r.score for r in own], s[q][[r.vec_id for r in own]])
        hit += len({r.vec_id for r in own} & set(np.argsort(-s[q])[:20].tolist()))
    assert hit / (150 * 20) >= 0.9


def test_neighbours_in_tight_clusters_are_found(spark, monkeypatch):
    monkeypatch.setattr(ann, "sample", lambda heads: vectors.sample(heads, 1500))  # half the rows lie outside the sample
    rng = np.random.default_rng(12)
    centre = ann.directions(rng.normal(size=(4, 64)))[0]
    x = ann.directions(centre[rng.integers(0, 4, 3000)] + 0.003 * rng.normal(size=(3000, 64)))[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 50 == 0, k=20).collect()
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    hit = sum(r.vec_id in set(np.argsort(-s[r.query_id])[:20].tolist()) for r in out)
    assert hit / (60 * 20) >= 0.9


def test_codebooks_serve_rows_outside_the_sample():
    x = ann.directions(np.random.default_rng(13).normal(size=(3000, 96)))[0]
    books = ann.fit_codebooks(x[:2500], 48, held=ann.HELD)
    codes = ann.encode(x[2500:], books)
    left = x[2500:] - sum(books[b][codes[:, b]] for b in range(48))
    assert (left * left).sum(1).mean() < 0.2


def test_copies_of_a_vector_keep_the_smallest_ids(spark):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(500, 8)).round(3)
    v[rng.choice(np.arange(1, 500), 200, replace=False)] = v[0]
    rows = [(int(i), v[i].tolist()) for i in rng.permutation(500)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i == 0, k=20, rerank=40).orderBy("rank").collect()
    exact = v @ v[0]
    want = sorted((i for i in range(1, 500)), key=lambda i: (-round(exact[i], 9), i))[:20]
    assert [r.vec_id for r in got] == want


def test_beam_search_is_no_worse_than_greedy():
    rng = np.random.default_rng(6)
    x = ann.directions(rng.normal(size=(600, 16)))[0]
    books = ann.fit_codebooks(x, 4, 32)

    def error(beam):
        codes = ann.encode(x, books, beam)
        return ((x - sum(books[b][codes[:, b]] for b in range(4))) ** 2).sum(1).mean()

    assert error(8) < error(1)


def test_odd_vectors(spark):
    x = np.random.default_rng(7).normal(size=(40, 8)).astype(np.float32)
    df = vector_frame(spark, x)
    near = ann.search(df, lambda i: i % 20 == 0, k=5).collect()
    assert {r.query_id for r in near} == {0, 20} and len(near) == 15  # two rows have id 0, each is a query
    assert all(r.vec_id is None or r.vec_id < 40 for r in near)
    assert sum(r.vec_id == 0 for r in near if r.query_id == 0) == 2  # each finds the other
    top = topk.search(df, lambda i: i % 20 == 0, k=50).collect()
    assert {r.query_id for r in top} == {0, 20} and all(r.vec_id != 40 for r in top)  # 40 is null, 41 and 45 are zero and take part
    assert max(r.rank for r in top if r.query_id == 20) == 43
    for f in (ann.search, topk.search):
        assert f(df.limit(0), lambda i: i % 20 == 0).collect() == []


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_exact_top_k(spark, scale):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(900, 12)) * rng.gamma(1, 1, (900, 1)), 2) * scale
    x[100:160] = x[100]  # ties
    x[5], x[6] = 0, -x[7]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = topk.search(df, lambda i: i % 50 == 0, k=10, shard_rows=200, block_queries=8).collect()
    ints = [[int(np.floor(1024 * v)) for v in row] for row in x]
    limit = np.iinfo(np.int64)
    for q in range(0, 900, 50):
        s = [min(max(sum(a * b for a, b in zip(ints[q], v)), limit.min), limit.max) for v in ints]
        want = sorted((i for i in range(900) if i != q), key=lambda i: (-s[i], i))[:10]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [(r.vec_id, r.score) for r in own] == [(i, s[i]) for i in want]


def test_bounds_spare_most_products_of_unit_vectors():
    rng = np.random.default_rng(12)
    x = np.concatenate([ann.directions(rng.normal(size=(6000, 64)))[0], ann.directions(rng.normal(size=(2000, 64)) * np.linspace(3, 0.1, 64))[0]])
    x = np.floor(1024 * x)
    q, tie = x[::80], np.arange(len(x))
    turn, stops = topk.rotation(x[::16])
    for floor in (None, topk.floors(q, x[::16], 10, 1.0)):
        u, v, score, work = topk.top_k(q, x, tie, 10, turn, stops, 1.0, floor)
        s = (q @ x.T).astype(np.int64)
        for i in range(len(q)):
            want = np.lexsort((tie, -s[i]))[:10]
            assert v[u == i].tolist() == want.tolist() and score[u == i].tolist() == s[i][want].tolist()
        assert work["products"] < work["pairs"] / 3 and work["terms"] < work["pairs"] * 64
    assert len(stops) >= 3 and work["products"] < work["pairs"] / 20


def test_huge_components_are_whole_numbers_too(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(60, 4)).round(3)
    x[7] *= 1e306
    x[8], x[9], x[10] = [1e200, 0, 0, 1], [-1e200, 0, 0, 2], [0, 0, 1e-300, -3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = topk.search(df, lambda i: i < 12, k=5).collect()
    ints = [[int(v) * 1024 if abs(v) > 2**53 else int(np.floor(1024 * v)) for v in row] for row in x]
    limit = np.iinfo(np.int64)
    for q in range(12):
        s = [min(max(sum(a * b for a, b in zip(ints[q], v)), limit.min), limit.max) for v in ints]
        want = sorted((i for i in range(60) if i != q), key=lambda i: (-s[i], i))[:5]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [(r.vec_id, r.score) for r in own] == [(i, s[i]) for i in want]
    near = ann.search(df, lambda i: i < 12, k=5).collect()
    assert {r.query_id for r in near} == set(range(12))


# --- language ---

WORDS = {"en": "the of and to in that with this from have", "de": "der die und nicht für über eine schön werden auf", "fr": "le les des une être très déjà pour avec dans"}


def language_rows(n):
    rng = np.random.default_rng(9)
    return [(i, " ".join(rng.choice(WORDS[lang].split(), rng.integers(5, 120))), lang) for i, lang in enumerate(rng.choice(list(WORDS), n).tolist())]


def test_language_id(spark):
    rows = language_rows(900)
    rows += [(9001, None, "en"), (9002, "", "en"), (9003, "123 --- !!", "en"), (9004, "the and of", None), (None, "der die das", "de"), (9005, "the of and " * 30_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == ["de", "en", "fr"]
    frame = docs.withColumn("held_out", langid.held_out(F.col("doc_id")))
    got = {r.doc_id: r for r in langid.identify(frame, model, ["doc_id", "held_out", "lang"]).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == (d is not None and zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    out = [r for d, r in got.items() if d is not None and d < 9000 and r.held_out]
    assert len(out) > 200 and np.mean([r.lang_pred == r.lang for r in out]) > 0.97
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (9001, 9002, 9003))
    assert got[9005].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.identify(docs, None, ["doc_id"]).collect()} == {"und"}
    assert langid.fit(docs.withColumn("lang", F.lit(None).cast("string"))) is None and langid.fit(docs.limit(0)) is None
    assert langid.identify(docs.limit(0), model, ["doc_id"]).count() == 0


def test_nothing_held_out_is_learned_from(spark):
    docs = spark.createDataFrame(language_rows(300), "doc_id long, text string, lang string")
    spoiled = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    a, b = langid.training_sample(docs), langid.training_sample(spoiled)
    assert a.equals(b) and set(a["label"]) == set(WORDS)


def test_the_network_equals_a_slow_forward_pass():
    rng = np.random.default_rng(14)
    rows = language_rows(120)
    texts, labels = [t for _, t, _ in rows], [a for _, _, a in rows]
    own = [langid.drawn_windows(t, i) for i, t in enumerate(texts)]
    model = langid.train(np.concatenate(own), [a for a, w in zip(labels, own) for _ in w], epochs=1)
    filters = model.conv.T.reshape(-1, max(langid.WIDTHS), langid.DIMS).astype(float)

    def slow(window):
        e = model.embed[window].astype(float)
        pooled = []
        for f, kernel in enumerate(filters):
            width = langid.WIDTHS[f // langid.FILTERS]
            assert not kernel[width:].any()
            padded = np.concatenate([e, np.repeat(model.embed[:1].astype(float), max(langid.WIDTHS) - 1, 0)])
            pooled.append(max(sum(float(padded[i + k] @ kernel[k]) for k in range(width)) for i in range(len(window))))
        z = np.maximum(np.array(pooled) + model.bias, 0) @ model.out.astype(float) + model.out_bias
        z = np.exp(z - z.max())
        return z / z.sum()

    odd = ["", "x", "é", texts[0], texts[0] * 30, None, texts[1].upper()]
    got = langid.predict(model, odd)
    for text, (lang, score) in zip(odd, got):
        if text is None:
            assert (lang, score) == ("und", 0.0)
            continue
        mean = np.mean([slow(w) for w in langid.windows_of(langid.data_of(text))], 0)
        assert lang == model.languages[int(mean.argmax())] and abs(score - mean.max()) < 1e-4
    # However texts are gathered, each has its own result.
    many = langid.predict(model, odd * 40)
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-6 for a, b in zip(many, got * 40))
    langid_gathered, langid.GATHERED = langid.GATHERED, 3
    try:
        assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-6 for a, b in zip(langid.predict(model, odd), got))
    finally:
        langid.GATHERED = langid_gathered


def test_windows_cover_all_bytes():
    for n in (0, 1, 255, 256, 257, 512, 700):
        data = bytes(i % 251 + 1 for i in range(n))
        w = langid.windows_of(data)
        seen = b"".join(x.tobytes() for x in w)
        assert set(data) <= set(seen) and len(w) == max(1, -(-n // 256)) and w.shape[1] == 256


# --- main text ---

PARAGRAPH = "A sentence of the article that goes on for a while, as such sentences do. " * 3


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<nav><a href=x>Menu</a></nav><footer>foot</footer>", ""),
        ("<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav>m</nav><article><h1>Head &amp; more</h1><p>One\n  two<br>three<p>Short.</article><footer>f</footer>", "Head & more\nOne two three\nShort."),
        (f"<body><div class='site-header'>H</div><div class=sidebar>S</div><div class='content'><h2>T</h2><p>{PARAGRAPH}</p><p>Yes.</p><p>{PARAGRAPH}</p></div><div id='comments'><p>{PARAGRAPH}</p></div><div class='cookie-notice'>ok</div></body>", f"T\n{PARAGRAPH.strip()}\nYes.\n{PARAGRAPH.strip()}"),
        (f"<main><p>{PARAGRAPH}</p><form><p>{PARAGRAPH}</p><input></form><aside>x</aside><ul><li>one<li>two</ul></main>", f"{PARAGRAPH.strip()}\none\ntwo"),
        ("<article><p>&eacute;&nbsp;&#x4e2d; &lt;b&gt;</p></article>", "é 中 <b>"),
        ("<article><div><p>open <b>bold<div class=ad>buy</div> rest", "open bold\nrest"),
        ("plain text only", "plain text only"),
        (f"<div class='page has-sidebar'><div><a href=1>One</a> <a href=2>Two</a></div><div><p>{PARAGRAPH}</p></div><div><p>Short.</p></div><div><p>{PARAGRAPH}</p></div><div class='sideBar widget'>x</div></div>", f"{PARAGRAPH.strip()}\nShort.\n{PARAGRAPH.strip()}"),
        (f"<main><h1>T</h1><p>{PARAGRAPH}</p><article class='comment'><p>{PARAGRAPH}</p></article></main>", f"T\n{PARAGRAPH.strip()}"),
        (f"<article><header><h1>T</h1></header><p>{PARAGRAPH}<a href=x>link</a></p><div class='share-buttons'>Share</div><section id='comments'>{PARAGRAPH}</section></article>", f"T\n{PARAGRAPH}link"),
    ],
)
def test_main_text(page, want):
    assert html.main_text(page) == want


def test_extract_frame(spark):
    rows = [(1, "u", "<article><p>x</p></article>", "t"), (1, "u", "<article><p>x</p></article>", "t"), (None, None, None, None), (2, "v", "<article>" + "<p>word &amp; word</p>" * 20_000, "t")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.text[:13], r.n_chars) for r in got) == [(0, "", 0), (1, "x", 1), (1, "x", 1), (2, "word & word\nw", 12 * 20_000 - 1)]
    assert html.extract(spark.createDataFrame([], "page_id int, url string, html string")).count() == 0


def test_smoothing_and_threshold():
    assert np.allclose(html.smoothed(np.full(5, 3.0)), 3)
    assert html.threshold(np.array([1.0, 1.2, 9.0, 9.5])) > 1.2 and html.threshold(np.array([2.0, 2.0])) == 2


# --- lines ---


def brute_lines(rows, least):
    """(doc_id, text) -> rows; ids are distinct and not null here."""
    sites, first = {}, {}
    for d, s, t in sorted(rows, key=lambda r: r[0]):
        for pos, line in enumerate((t or "").split("\n")) if t is not None else []:
            k = line.strip(linededup.BLANKS)
            if k:
                sites.setdefault(k, set()).add(s)
                first.setdefault(k, (d, pos))
    out = {}
    for d, _, t in rows:
        if t is None:
            out[d] = None
            continue
        keep = []
        for pos, line in enumerate(t.split("\n")):
            k = line.strip(linededup.BLANKS)
            if not k or len(sites[k] - {None}) < least or first[k] == (d, pos):
                keep.append(line)
        out[d] = "\n".join(keep)
    return out


@pytest.mark.parametrize("limit", [100_000, -1])
def test_line_dedup(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(linededup, "BROADCAST_LINES", limit)
    rng = np.random.default_rng(10)
    lines = [f"line {i}" for i in range(40)] + ["", "  "]
    rows = [(i, f"s{rng.integers(0, 8)}" if i % 11 else None, "\n".join(rng.choice(lines, rng.integers(0, 12)))) for i in range(80)]
    rows += [(1000, "s1", None), (1001, "s2", "\n"), (1002, "s3", "  line 3\t\nonly here"), (1003, "s3", "\n".join(["line 3"] * 30_000))]
    spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("n_lines", F.lit(1)).withColumn("gone_lines", F.lit(2)).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = linededup.dedup_lines(docs, min_sites=5)
    assert got.columns == ["doc_id", "source", "text", "n_lines", "gone_lines", "_n_lines", "n_removed"]
    want = brute_lines(rows, 5)
    found = got.collect()
    assert {r.doc_id: r.text for r in found} == want and len(found) == len(rows)
    size = {d: 0 if t is None else len(t.split("\n")) for d, _, t in rows}
    assert all(r._n_lines == size[r.doc_id] for r in found) and sum(r.n_removed for r in found) > 30_000
    assert linededup.dedup_lines(docs.limit(0), 5).count() == 0


def test_line_dedup_of_repeated_rows(spark, tmp_path):
    rows = [(i, f"s{i % 6}", "same line\nown %d" % i) for i in range(6)] + [(0, "s0", "same line\nown 0"), (None, "s1", "same line")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "d"))
    got = linededup.dedup_lines(spark.read.parquet(str(tmp_path / "d")), 5).collect()
    assert sum("same line" in r.text for r in got) == 1 and len(got) == 8
    assert [r.text for r in got if r.doc_id is None] == [""]


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(k, k, f"site{s}") for k in range(200) for s in range(9 + k % 3)]
    lines = spark.createDataFrame(rows, "k1 long, k2 long, site string")
    got = {r.k1 for r in linededup.boilerplate_keys(lines, 10, lg_k=4).collect()}  # a coarse sketch leaves much to exact counts
    assert got == {k for k in range(200) if 9 + k % 3 >= 10}
