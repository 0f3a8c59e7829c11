"""Training-data operators against brute force, round trips and held-out labels, with the odd inputs that each must take."""

import glob
import hashlib
import math
import os
import time
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import best_fit_packing, chat_formatting, common, compact_windows, decontamination, hilbert_sharding, importance_resampling, ngram_jaccard, queries, segment_topk, suffix_dedup, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def words(text):
    return (text or "").encode().lower().split()


def random_text(rng, n, vocabulary=5000):
    return " ".join(f"w{i}" for i in rng.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, clashing extra columns, near copies and a shared passage."""
    rng = np.random.default_rng(3)
    base, passage = random_text(rng, 300), random_text(rng, 60)
    near = base.split()
    near[7] = "changed"
    texts = [base, " ".join(near), base.upper(), None, "", "one", "one two", "one two", random_text(rng, 30_000), random_text(rng, 200) + " " + passage, random_text(rng, 90) + "\n" + passage + " end", "\t\n ", "same " * 400, "to and " * 200 + "fro " + "and to " * 60]
    rows = [(i, t, None if i == 2 else "en", "src", None) for i, t in enumerate(texts)]
    rows.append(rows[6])
    extra = {"row": F.lit(1), "spans": F.lit("x"), "size": F.lit(2), "rank": F.lit(3), "id": F.lit(4), "a": F.lit(5), "u": F.lit(6)}
    return spark.createDataFrame(rows, DOC).repartition(3).withColumns(extra)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def brute_components(rows, n, percent):
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            a, b = sorted((root(a), root(b)))
            label[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join(spark, odd, empty, sf_dir, n, percent):
    for docs in (odd, common.documents(spark, sf_dir)):
        got = {r.doc_id: (r.n_grams, r.component_id) for r in ngram_jaccard.join(docs, n, percent, bits=16).collect()}
        assert got == brute_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], n, percent)
    assert ngram_jaccard.join(empty, n, percent, bits=16).count() == 0


def test_progressions():
    keys = np.array([5, 6, 5, 6, 5, 9, 5, 5, 7], np.uint64)
    at, owner = np.array([0, 1, 2, 3, 4, 5, 90, 91, 92]), np.array([0, 0, 0, 0, 0, 0, 0, 0, 1])
    first, run, step = common.progressions(keys, at, owner)
    assert sorted(zip(keys[first].tolist(), at[first].tolist(), run.tolist(), step.tolist(), strict=True)) == [(5, 0, 3, 2), (5, 90, 2, 1), (6, 1, 2, 2), (7, 92, 1, 1), (9, 5, 1, 1)]
    rng = np.random.default_rng(0)
    keys, at, owner = rng.integers(0, 4, 300).astype(np.uint64), np.sort(rng.choice(2000, 300, replace=False)), np.zeros(300, int)
    first, run, step = common.progressions(keys, at, owner)
    assert sorted((k, p + i * s) for k, p, n, s in zip(keys[first].tolist(), at[first].tolist(), run.tolist(), step.tolist(), strict=True) for i in range(n)) == sorted(zip(keys.tolist(), at.tolist(), strict=True))
    assert all(len(x) == 0 for x in common.progressions(keys[:0], at[:0], owner[:0]))


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (20, 3), (5, 5)], "a long, b long")
    assert dict(map(tuple, common.components(edges).collect())) == {1: 1, 2: 1, 3: 1, 20: 1, 7: 7, 8: 7, 9: 7}


def brute_repeats(rows, length):
    first, seen, text = {}, defaultdict(set), {}
    for d, t in sorted(set(rows), key=lambda r: r[0]):
        text[d] = words(t)
        for p in range(len(text[d]) - length + 1):
            g = tuple(text[d][p : p + length])
            first.setdefault(g, (d, p))
            seen[g].add((d, p))
    marked = {d: ([0] * len(w), [0] * len(w)) for d, w in text.items()}
    for g, places in seen.items():
        if len(places) > 1:
            for d, p in places:
                for i in range(p, p + length):
                    marked[d][0][i] = 1
                    if first[g] != (d, p):
                        marked[d][1][i] = 1
    return {d: m for d, m in marked.items() if any(m[0])}, text


def test_suffix_dedup(spark, odd, empty, sf_dir):
    for docs in (odd, common.documents(spark, sf_dir)):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        want, text = brute_repeats(rows, 50)
        got = {}
        for r in suffix_dedup.passages(docs, 50).collect():
            m = got.setdefault(r.doc_id, ([0] * len(text[r.doc_id]), [0] * len(text[r.doc_id])))
            assert r.n_words == r.end - r.start >= 50
            for i in range(r.start, r.end):
                m[0][i] = 1
                m[1][i] |= not r.first
        assert got == want
        left = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(docs, 50).collect()}
        for d, t in rows:
            gone = want.get(d, (0, [0] * len(words(t))))[1]
            kept = [w for w, g in zip((t or "").encode().split(), gone, strict=True) if not g]
            assert (left.get(d) or "").encode().split() == kept
    assert suffix_dedup.remove_repeats(empty, 50).count() == 0
    assert suffix_dedup.remove_repeats(odd, 50).columns == odd.columns


def test_compact_windows(spark, odd, empty, sf_dir):
    docs = common.documents(spark, sf_dir)
    want, _ = brute_repeats([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 50)
    across = defaultdict(set)
    for r in docs.select("doc_id", "text").collect():
        w = words(r.text)
        for p in range(len(w) - 49):
            across[tuple(w[p : p + 50])].add(r.doc_id)
    exact = {d for s in across.values() if len(s) > 1 for d in s}
    got = {r.doc_id for r in compact_windows.passages(docs).collect()}
    assert exact <= got
    assert {r.doc_id for r in compact_windows.passages(odd).collect()} == {0, 1, 2, 9, 10}
    assert compact_windows.passages(empty).count() == 0


def test_decontamination(spark, odd, empty, sf_dir):
    docs, bench = common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    number = defaultdict(lambda: len(number))
    ids = lambda text: np.array([number[w] for w in words(text)])
    items, want = {r.item_id: ids(r.text) for r in bench.collect()}, set()
    for r in docs.select("doc_id", "text").collect():
        w = ids(r.text)
        for i, b in items.items():
            n = min(13, len(b))
            if len(b) < 5 or len(w) < n or len(np.intersect1d(w, b)) < (n - 2 if len(b) >= 13 else n):
                continue
            same = w[:, None] == b[None, :]
            total = sum(same[k : len(w) - n + 1 + k, k : len(b) - n + 1 + k].astype(np.int8) for k in range(n))
            if total.max() >= (n - 2 if len(b) >= 13 else n):
                want.add((r.doc_id, i))
    got = decontamination.overlaps(docs, bench).collect()
    assert want and {(r.doc_id, r.item_id) for r in got} == want
    twice = decontamination.overlaps(docs.unionByName(docs), bench.unionByName(bench)).collect()
    assert sorted(map(tuple, twice)) == sorted(map(tuple, got))
    own = [(1, "a b c d e f g h i j k l m n o p"), (2, None), (3, "x y z"), (4, "p q r s t")]
    b2 = spark.createDataFrame(own, "item_id long, text string")
    d2 = spark.createDataFrame([(1, "z a b X d e f g Y i j k l m n o p q"), (2, "a X c Y e Z g h i Q k l m n"), (3, "o p q r s t u"), (4, None), (5, "p q r X t")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.overlaps(d2, b2).collect()} == {(1, 1), (3, 4)}
    assert decontamination.clean(odd, bench).count() == odd.count()
    assert decontamination.overlaps(empty, bench).count() == 0 and decontamination.overlaps(odd, b2.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want, got = con.execute(queries.ORACLES[name]).df(), queries.QUERIES[name](spark, sf_dir).toPandas()
    assert sorted(map(tuple, got[want.columns].values.tolist())) == sorted(map(tuple, want.values.tolist())) and set(got.columns) == set(want.columns)


def test_added_conversation(spark, sf_dir):
    own = "</s>[INST] ok [/INST]"
    (row,) = queries.op5_chat_formatting(spark, sf_dir).where("conv_id = -7").collect()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{own}\nassistant\n{own}\n".encode()).hexdigest()
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(own), hashlib.sha256(own.encode()).hexdigest())


def test_chat_formatting(spark):
    texts = ["</s>[INST] ok [/INST]", "\\[INST] [\\INST]\\", "<|end|>\n<|turn|>", None, "", "a\\\\b<<SYS>>"]
    rows = [(c, t, ["user", "assistant", None][(c + t) % 3], texts[(c * 2 + t) % 6], "extra") for c in range(4) for t in range(5)]
    rows += [rows[0], (None, 0, "user", "no id", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string")
    got = {r.conv_id: r for r in chat_formatting.read_back(chat_formatting.render(chat_formatting.fold(chat_formatting.format_rows(df)))).collect()}
    for c in (0, 1, 2, 3, None):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_formatting.render(chat_formatting.fold(chat_formatting.format_rows(df.limit(0)))).count() == 0


def test_events_fold(spark):
    log = [
        (1, 1, 0, "open", "user", "hi"), (1, 2, 1, "open", "assistant", None), (1, 2, 2, "delta", None, "wro"), (1, 2, 3, "delta", None, "ng"), (1, 2, 4, "regenerate", None, None),
        (1, 2, 6, "delta", None, "t"), (1, 2, 5, "delta", None, "righ"), (1, 2, 5, "delta", None, "righ"), (1, 1, 7, "edit", None, "hello"), (1, 3, 8, "open", "user", "x"), (1, 3, 9, "delete", None, None),
    ]
    got = chat_formatting.fold(spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, "user", "hello"), (1, 2, "assistant", "right")]


def test_hilbert_curve_is_a_path(spark):
    cells = spark.range(4**3 * 8).selectExpr("id % 8 a", "id div 8 % 8 b", "id div 64 c")
    rows = sorted((r.h, r.a, r.b, r.c) for r in cells.withColumn("h", hilbert_sharding.hilbert_index([F.col("a"), F.col("b"), F.col("c")], 3)).collect())
    assert [r[0] for r in rows] == list(range(512))
    assert all(sum(abs(x - y) for x, y in zip(p[1:], q[1:], strict=True)) == 1 for p, q in zip(rows, rows[1:], strict=False))


def test_hilbert_shards(spark, odd, empty, sf_dir):
    for docs in (odd, common.documents(spark, sf_dir)):
        got = hilbert_sharding.shard(docs, 16).toPandas()
        sizes = got.groupby("shard").slot.agg(list)
        assert len(got) == docs.count() and max(map(len, sizes)) - (min(map(len, sizes)) if len(sizes) == 16 else 0) <= 1
        assert all(sorted(s) == list(range(len(s))) for s in sizes)
        raw = {r.doc_id: (r.text or "").encode() for r in docs.select("doc_id", "text").collect()}
        assert all(s == len(raw[i]) + 1 and c == zlib.crc32(raw[i]) for i, s, c in zip(got.doc_id, got["size"], got.text_crc32, strict=True))
    placed = got.sort_values(["shard", "slot"])  # the order is the curve's, whose path another test holds
    assert placed.curve.is_monotonic_increasing and placed["rank"].tolist() == list(range(len(placed)))
    cells = common.documents(spark, sf_dir).select("doc_id", hilbert_sharding._log_bucket(F.octet_length(F.coalesce("text", F.lit(""))) + 1, 5).alias("a"), *[hilbert_sharding._hash_bucket(F.col(c), 5).alias(c) for c in ("source", "lang")])
    cells = cells.withColumn("curve", hilbert_sharding.hilbert_index([F.col(c) for c in ("a", "source", "lang")], 5)).toPandas().set_index("doc_id").curve
    assert (cells[got.doc_id].to_numpy() == got.curve.to_numpy()).all()
    sizes = placed.groupby("shard")["size"].agg(["min", "max"])
    assert ((sizes["min"] <= 300) & (sizes["max"] >= 300)).sum() < 16  # a reader that wants one size skips shards
    assert hilbert_sharding.shard(empty).count() == 0


def test_segment_topk(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16))
    x[50:90] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, [1.0] * 15 + [None]), (302, [float("nan")] * 16), (303, [float("inf")] * 16), (304, []), (5, x[5].tolist()), (306, [1.0, 2.0])]
    vecs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = segment_topk.topk(vecs, vecs.where("vec_id % 20 = 0"), 20, 64, block=64).collect()
    q = np.floor(x * 64).astype(int)
    want = set()
    for i in range(0, 300, 20):
        s = q @ q[i]
        order = sorted((j for j in range(300) if j != i), key=lambda j: (-s[j], j))[:20]
        want |= {(i, r + 1, j, int(s[j])) for r, j in enumerate(order)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want
    assert segment_topk.topk(vecs.limit(0), vecs, 20).count() == 0


def test_best_fit_packing(spark, odd, empty, sf_dir):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(TOKENIZER)
    for docs in (odd, common.documents(spark, sf_dir)):
        rows = docs.select("doc_id", "text").collect()
        ids = {r.doc_id: np.array([*slow.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for r in rows}
        got = best_fit_packing.pack_documents(docs, TOKENIZER, 2048, part_items=40).toPandas()
        assert got.length.sum() == sum(len(ids[r.doc_id]) for r in rows)
        for r in got.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
            assert r.piece == 0 or r.length == 2048
        for _, s in got.groupby("sequence_id"):
            s = s.sort_values("offset")
            assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048
        assert got.sequence_id.nunique() <= 1.02 * got.length.sum() / 2048 + 2
    assert best_fit_packing.pack_documents(empty, TOKENIZER).count() == 0


def test_batches_are_bounded_by_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, reader = spark.conf.get(name), "spark.sql.parquet.columnarReaderBatchSize"
    docs = spark.range(40, numPartitions=1).select("id", F.repeat(F.lit("some words "), 60_000).alias("text"))
    sizes = lambda batches: (pa.record_batch([pa.array([b.nbytes], pa.int64())], names=["bytes"]) for b in batches)
    try:
        spark.conf.set(name, str(64 << 20))
        common.bound_batches(spark)
        got = [r.bytes for r in docs.mapInArrow(sizes, "bytes long").collect()]
        assert len(got) > 4 and max(got) < 2 * common.BATCH_BYTES
        spark.conf.set(name, "1000")
        common.bound_batches(spark)
        assert int(spark.conf.get(name).rstrip("b")) == 1000
        for own, after in ((4096, common.READ_ROWS), (64, 64)):
            spark.conf.set(reader, str(own))
            common.bound_batches(spark)
            assert int(spark.conf.get(reader)) == after
    finally:
        spark.conf.unset(reader)
        spark.conf.set(name, before.rstrip("b"))


def test_encoder_matches_the_tokenizers_library():
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(TOKENIZER), best_fit_packing.encoder(TOKENIZER)
    assert slow.encode("hello <|endoftext|> x", add_special_tokens=False).ids == [31373, 220, 50256, 2124]
    for text in ["hello <|endoftext|> x", "<|endoftext|><|endoftext|>", "", " ", "\n\n  a", "don't  stop\t", "ÉÑß 中文 🙂", "a" * 5000, " " * 5000, "<|endoftext|>", "1234,56"]:
        assert fast(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_toxicity(spark, odd, empty, sf_dir):
    rng = np.random.default_rng(2)
    calm = lambda: " ".join(random_text(rng, 8, 300).replace("w", "so") + "." for _ in range(4))
    rows = [(i, calm() + (" you idiot stay." if i % 3 == 0 else " so calm.") + calm()) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).toPandas()
    assert set(got[got.held_out].doc_id) == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    held = got[got.held_out]
    assert ((held.predicted == 1) == (held.doc_id % 3 == 0)).mean() > 0.95
    word = lambda w: float(toxicity._Scores(model)(pa.array([w]))[0])
    assert word("i.d.i.o.t") > 0.3 and word("idxiot") > word("so12")
    out = toxicity.score(odd, model).toPandas()
    assert len(out) == odd.count() and out.score.between(0, 1).all()
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.train(docs, labels.limit(0)).prior == 0
    assert toxicity.reject(odd, model).columns == odd.columns


def test_kernel_against_all_subsequences():
    def brute(a, b):
        spans = lambda w, n: [(tuple(w[k] for k in i), i[-1] - i[0] + 1) for i in combinations(range(len(w)), n)]
        return sum(toxicity.DECAY ** (p + q) for n in toxicity.ORDERS for u, p in spans(a, n) for v, q in spans(b, n) if u == v)

    pairs = [("idiot", "idiot"), ("idxiot", "idiot"), ("aaaa", "aaa"), ("ab", "ab"), ("moronic", "moron"), ("éñé中x", "ñé中"), ("", "abc"), ("abcdefghabcd", "badcfehg")]
    got = toxicity.kernel(toxicity._letters([a for a, _ in pairs]), toxicity._letters([b for _, b in pairs]))
    assert np.allclose(got, [brute(a, b) for a, b in pairs], rtol=1e-5)
    model = toxicity.Model(["idiot", "clown"])
    want = [brute("idiots", "idiot") / brute("idiot", "idiot") ** 0.5 / model._unit, 0]
    assert np.allclose(model.features(["idiots"])[0, :2], want, rtol=1e-5)


def test_units_of_texts():
    found, index, owner = toxicity.units(pa.array(["x", "You  i d-i o.t, stay", None, "", "a\tb\n", "cde abcd"]).slice(1))
    words_of = [sorted(found.to_pylist()[i] for i, o in zip(index, owner, strict=True) if o == k and found.to_pylist()[i]) for k in range(5)]
    assert words_of == [["di", "i", "ot", "stay", "you", "youidi"], [], [], ["a", "ab", "b"], ["abcd", "cde"]]


def test_importance_resampling(spark, odd, empty, sf_dir):
    docs, labels = common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    w = common.cut(importance_resampling.weights(docs, labels.where("quality = 1")), "w").toPandas()
    good = set(r.doc_id for r in labels.where("quality = 1").collect())
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    held = {d: Counter(importance_resampling._buckets(common.Words(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())])))[0].tolist()) for d, t in texts.items()}
    raw_n, target_n = (sum((held[d] for d in some), Counter()) for some in (held, [d for d in held if d in good]))
    size, sizes = importance_resampling.BUCKETS, (raw_n.total(), target_n.total())
    log_weight = {d: sum(k * (math.log((target_n[b] + 1) / (sizes[1] + size)) - math.log((raw_n[b] + 1) / (sizes[0] + size))) for b, k in own.items()) for d, own in held.items()}
    assert np.allclose(w.log_weight, [log_weight[d] for d in w.doc_id]) and w.n_grams.tolist() == [held[d].total() for d in w.doc_id]
    target, raw = importance_resampling.bucket_counts(docs.where(F.col("doc_id").isin(list(good)))), importance_resampling.bucket_counts(docs)
    assert raw.sum() == w.n_grams.sum() and target.sum() == w[w.doc_id.isin(good)].n_grams.sum()
    junk = labels.where("quality = 0").toPandas().doc_id
    assert w[w.doc_id.isin(good)].log_weight.mean() > 0 > w[w.doc_id.isin(junk)].log_weight.mean()
    got = importance_resampling.resample(docs, labels.where("quality = 1"), 150).toPandas()
    assert set(got.doc_id) == set(w.sort_values("key", ascending=False).doc_id[:150])
    many = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("double").alias("key"))
    top = importance_resampling.top_keys(many, 1000).toPandas()
    assert len(top) == 1000 and top.key.min() == 5.0 and (top.key == 6.0).sum() == 714
    assert importance_resampling.resample(odd, labels, 4).count() == 4
    assert importance_resampling.resample(empty, labels, 4).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs, kept = common.documents(spark, sf_dir), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.cut(stage(spark, docs, sf_dir), f"test-stage-{i}")
        if i < 4:
            assert out.columns == docs.columns
        kept.append({r.doc_id for r in out.select("doc_id").collect()})
        docs = out
    assert all(b <= a for a, b in zip(kept, kept[1:], strict=False)) and kept[3] == kept[4]
    left = brute_components([(r.doc_id, r.text) for r in common.documents(spark, sf_dir).where(F.col("doc_id").isin(list(kept[0]))).collect()], 5, 80)
    assert kept[1] == {d for d, (_, c) in left.items() if d == c}


def test_pipeline_stages_take_odd_rows(spark, odd, empty, sf_dir):
    """Rows that repeat, rows without an id, extra columns whose names clash, and an empty table."""
    import corpus_pipeline

    docs = odd.unionByName(odd.where("doc_id = 0")).unionByName(odd.where("doc_id in (8, 9)").withColumn("doc_id", F.lit(None).cast("long")))
    docs = docs.withColumns({"gone": F.lit(1), "lacks_id": F.lit(2), "repeat_row": F.lit(3), "repeat_doc": F.lit(4), "__leaked": F.lit(5)})
    own = docs.where("doc_id is null").withColumn("text", F.concat(F.lit("all "), F.repeat(F.lit("its own "), 20), F.reverse("text"))).limit(1)
    docs = common.cut(docs.unionByName(own).unionByName(own), "odd-rows")
    kept = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        kept = common.cut(stage(spark, kept, sf_dir), f"odd-stage-{i}")
        if i < 4:
            assert kept.columns == docs.columns
        if name == "near duplicates":
            ids = [r.doc_id for r in kept.select("doc_id").collect()]
            left = brute_components([(r.doc_id, r.text) for r in docs.where("doc_id is not null").collect()], 5, 80)
            assert sorted(i for i in ids if i is not None) == sorted(d for d, (_, c) in left.items() if c == d)
            assert ids.count(None) == 1
    assert kept.where("doc_id is null").count() >= 1
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, empty, sf_dir).columns == empty.columns and stage(spark, empty, sf_dir).count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, empty, sf_dir).count() == 0


def window_keys(text):
    column = pa.array([text])
    ((_, _, data, offsets),) = common.blocks(pa.record_batch([column], names=["text"]))
    return set(compact_windows.nodes(common.Words(data, offsets), 50)[0].tolist())


def changed(text, **at):
    out = text.split()
    for k, v in at.items():
        out[int(k[1:])] = v
    return " ".join(out)


@pytest.mark.parametrize("case", ["two groups", "chain", "second place"])
def test_compact_windows_compares_all_that_meet(spark, case):
    """Nodes that meet only where a smaller document, near to neither, near to one, or elsewhere in the first one, holds the key too."""
    for seed in range(1000):
        base = random_text(np.random.default_rng(seed), 50)
        if case == "two groups":
            two, three = changed(base, w4="c", w46="d"), changed(base, w4="e", w46="f")
            texts, near = {1: changed(base, w4="a", w46="b"), 2: two, 3: three, 4: two + " end", 5: three + " end"}, [(2, 4), (3, 5)]
        elif case == "chain":
            texts, near = {1: base, 2: changed(base, w4="x"), 3: changed(base, w4="x", w46="y")}, [(1, 2), (2, 3)]
        else:
            texts, near = {1: changed(base, w4="x", w46="y") + " " + random_text(np.random.default_rng(seed + 5000), 100) + " " + base, 2: base + " end"}, [(1, 2)]
        keys = {d: window_keys(t) for d, t in texts.items()}
        held = window_keys(texts[1][: len(changed(base, w4="x", w46="y"))]) if case == "second place" else keys[1] & keys[2] if case == "two groups" else keys[1]
        if all(keys[a] & keys[b] and keys[a] & keys[b] <= held for a, b in near):
            break
    else:
        raise AssertionError("no such texts")
    got = compact_windows.passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).toPandas()
    assert set(got.doc_id) == {d for pair in near for d in pair}


def test_compact_windows_recall(spark):
    """Passages amid texts of their own: equal ones with a common line in the middle, and near ones with changes."""
    rng = np.random.default_rng(11)
    line = random_text(rng, 30)
    rows, pairs = [], defaultdict(list)

    def add(kind, left, right):
        for text in (left, right):
            rows.append((len(rows), " ".join([random_text(rng, 80, 10**6), text, random_text(rng, 80, 10**6)])))
        pairs[kind].append((len(rows) - 2, len(rows) - 1))

    for _ in range(60):
        own = f"{random_text(rng, 10, 10**6)} {line} {random_text(rng, 10, 10**6)}"
        add("equal, with a common line", own, own)
        for n, k in ((50, 1), (60, 1), (100, 2)):
            text = random_text(rng, n, 10**6)
            spots = sorted(rng.choice(np.arange(n // (2 * k), n), 1).tolist() + ([n // 4] if k == 2 else []))
            add(f"{k} of {n} changed", text, changed(text, **{f"w{s}": "other" for s in spots}))
    got = {r.doc_id for r in compact_windows.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    found = {kind: sum(a in got and b in got for a, b in some) for kind, some in pairs.items()}
    assert found.pop("equal, with a common line") == 60
    assert min(found.values()) >= 54, found


def test_toxicity_reads_over_white_space():
    rng = np.random.default_rng(2)
    calm = lambda: " ".join(random_text(rng, 8, 300).replace("w", "so") + "." for _ in range(4))
    rows = [(calm() + (" you idiot stay. " if i % 3 == 0 else " so calm. ") + calm(), int(i % 3 == 0)) for i in range(300)]
    scores = toxicity._Scores(toxicity.fit([(set(toxicity.units(pa.array([t]))[0].to_pylist()), y) for t, y in rows], 1 / 3))
    spaced = ["you i d i o t stay.", "so id iot stay", "you i\td  i o t", "it is i d i o t so be it"]
    assert (scores(pa.array([f"{calm()} {t} {calm()}" for t in spaced])) > 0.3).all()
    assert (scores(pa.array([f"{calm()} so it is a do to {calm()}" for _ in range(20)])) < 0.3).all()


def test_slices_reach_the_driver_in_one_job(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(40)], "doc_id long, text string")
    spark.sparkContext.setJobGroup("slices", "slices")
    counts = ngram_jaccard.gram_counts(docs, 3, 18)
    spark.sparkContext.setJobGroup("others", "others")
    assert counts.sum() == 40 * 3 and len(spark.sparkContext.statusTracker().getJobIdsForGroup("slices")) <= 3


def test_what_a_cut_shuffled_goes_with_it(spark):
    made = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before = made()
    common.cut(spark.range(1000).groupBy(F.col("id") % 7).count(), "shuffled")
    until = time.time() + 20
    while made() - before and time.time() < until:
        time.sleep(0.2)
    assert not made() - before


def test_steps_leave_only_the_cuts_they_read(spark, odd, sf_dir):
    import corpus_pipeline

    shared = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(shared))
    kept = corpus_pipeline.drop_near_duplicates(spark, odd, sf_dir)
    trimmed = corpus_pipeline.cut_repeated_passages(spark, odd, sf_dir)
    left = {f.rsplit("-", 1)[0] for f in set(os.listdir(shared)) - before}
    assert left <= {"near-duplicates", "repeated-ids", "repeats", "trimming"}, left
    assert 0 < kept.count() < odd.count() and trimmed.count() > 0


def test_python_steps_write_their_cuts_themselves(spark, odd, empty):
    """No file of these is made by Hadoop's writer, which puts a .crc beside it and starts processes as large as the executor."""
    shared = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(shared))
    want = sorted(map(tuple, odd.select("doc_id", "text").collect()), key=str)
    same = common.cut_mapped(odd.select("doc_id", "text").repartition(3), lambda batches: batches, "doc_id long, text string", "whole")
    assert sorted(map(tuple, same.collect()), key=str) == want
    assert common.cut_mapped(empty.select("doc_id"), lambda batches: batches, "doc_id long", "none").count() == 0
    suffix_dedup.passages(odd, 50)
    made = {name: os.listdir(f"{shared}/{name}") for name in set(os.listdir(shared)) - before}
    for step in ("whole", "none", "suffixes", "suffixes-kept", "suffix-ahead", "suffix-windows"):
        (files,) = [files for name, files in made.items() if name.rsplit("-", 1)[0] == step]
        assert all(f.startswith("part-") and f.endswith(".parquet") for f in files) and bool(files) == (step != "none")

    def breaks(batches):
        yield from batches
        raise ValueError("on purpose")

    with pytest.raises(Exception, match="on purpose"):
        common.cut_mapped(odd.select("doc_id"), breaks, "doc_id long", "broken")
    assert [os.listdir(f) for f in glob.glob(f"{shared}/broken-*")] == [[]]


def test_cuts_in_other_file_systems_are_written_by_spark(spark, tmp_path, monkeypatch):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.cuts.link./to", f"file://{tmp_path}")
    monkeypatch.setattr(common, "shared_dir", lambda spark: "viewfs://cuts/to")
    made = common.cut_mapped(spark.range(50), lambda batches: batches, "id long", "far")
    assert sorted(r.id for r in made.collect()) == list(range(50))
    assert glob.glob(f"{tmp_path}/far-*/_SUCCESS")
