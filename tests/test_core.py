"""Operators of the search engine on small fixtures with known answers, and every catalogued query against DuckDB."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import vectors as V
from tidemark.operators import cache, graph, metrics, quantize, results, search, workload
from tidemark.plans import catalog, engine
from tidemark.sources import tables, vector_files


@pytest.fixture(scope="module")
def vecs(spark):
    rows = [(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [3.0, 4.0]), (4, [1.0, 0.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return [plain(x) for x in v]
    if v is None or v is pd.NA or isinstance(v, float) and v != v:
        return None
    return v


def rows_of(frame, columns):
    return sorted(repr([plain(v) for v in row]) for row in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_catalog(spark, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name not in catalog.ORACLES:
        assert len(got)
        return
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got, sorted(want.columns)) == rows_of(want, sorted(want.columns))


def test_knn_orders_ties_by_id(spark, vecs):
    got = search.knn(vecs, vecs.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), "embedding"), 3).orderBy("rnk").collect()
    assert [(r.neighbor_id, r.dist) for r in got] == [(1, 0.0), (4, 0.0), (0, 1.0)]


def test_metrics_reject_integers_for_inner_product():
    with pytest.raises(ValueError):
        V.distance("ip", None, None, "int8")
    with pytest.raises(ValueError):
        V.distance("hamming", None, None)


def test_cosine_of_zero_is_the_largest_float(spark):
    row = spark.sql("SELECT array(0.0D, 0.0D) a, array(1.0D, 0.0D) b").select(V.cosine(F.col("a"), F.col("b")).alias("d")).first()
    assert row.d == pytest.approx(3.4028234663852886e38)


def against_sql(spark, folder, name, vectors, dtype="float"):
    """A query over a folder of the vectors (vec_id, embedding, label) beside its SQL."""
    spark.createDataFrame([(i, v, 0) for i, v in vectors], f"vec_id long, embedding array<{dtype}>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = [tuple(r) for r in catalog.QUERIES[name](spark, str(folder)).select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want.fetchall()))
    return got


def test_vec_text_rounds_as_its_sql(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    odd = [(0, [0.0078125, 0.0234375, -0.0078125]), (1, [nan, inf, -inf]), (2, [-0.0, 1e-9, 16777216.0]), (3, None), (4, []), (5, [1.0, None, 2.0])]
    got = {r[0]: r[1] for r in against_sql(spark, tmp_path, "vec_text", odd)}
    assert got[0] == "[0.007812,0.023438,-0.007812]" and got[1] == "[nan,inf,-inf]"


ODD_VECTORS = [(0, [3.0, 4.0, 0.5]), (1, [3.0, 4.0, 0.5]), (2, None), (3, [-3.0, -4.0, -0.5]), (50, [0.25, 1e-4, -1.0]), (100, None), (51, [0.25, 1.0001e-4, -1.0]), (150, [1000.0, 999.0, 0.001]), (151, [1000.0, 999.0, 0.0])]


@pytest.mark.parametrize("name", ["dist_cosine", "dist_l2_int8", "dist_l2_expanded"])
def test_distances_of_all_pairs_come_from_blocks(spark, tmp_path, name):
    assert any(r[2] is None for r in against_sql(spark, tmp_path, name, ODD_VECTORS))
    plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_blocks_hold_each_pair_once(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=3 if i % 7 else 2).tolist() if i % 11 else None) for i in range(90)] + [(90, [1.0, None, 2.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = e.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
    for metric, f in V.BLOCKWISE.items():
        got = {(r.query_id, r.neighbor_id): r.dist for r in search.all_pairs(e, q, f, block=16).collect()}
        plain = {"cosine": V.cosine, "l2_integer": V.l2, "l2_expanded": lambda a, b: F.sqrt(V.l2(a, b))}[metric]
        sides = q.withColumnRenamed("embedding", "a").crossJoin(e.withColumnRenamed("embedding", "b"))
        want = {(r.query_id, r.vec_id): r.d for r in sides.select("query_id", "vec_id", plain(F.col("a"), F.col("b")).alias("d")).collect()}
        assert got.keys() == want.keys() and len(got) == q.count() * e.count()
        assert all(got[k] is None if d is None else got[k] == pytest.approx(d, abs=1e-12) for k, d in want.items())


def test_nearest_codes_are_those_of_all_look_up_distances(spark, sf_dir):
    e = tables.table(spark, sf_dir, "embeddings").where("vec_id < 120").select("vec_id", "embedding")
    e = e.union(e.select(F.col("vec_id") + 1000, "embedding")).union(spark.sql("SELECT 990L, CAST(null AS array<float>)"))  # copies are ties
    q = e.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    book, ranges = catalog.book(e), quantize.chunks(64, 8)
    codes = tables.written(quantize.encode(e, book, ranges), "codes")
    want = search.rank(quantize.adc(q, codes, book, ranges).withColumn("dist", F.round("dist", 9)), 7)
    got = quantize.adc_nearest(q, codes, e.count(), book, ranges, 7, block=64)
    key = lambda df: sorted((r.query_id, r.rnk, r.neighbor_id) for r in df.collect())
    assert key(got) == key(want) and got.count() == 7 * q.count()


def test_pq_search_makes_no_rows_of_all_pairs(spark, sf_dir):
    plan = catalog.QUERIES["pq_rerank_knn"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "sum(d" not in plan


def test_padding_and_missing_vectors(spark, vecs):
    asked = vecs.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    assert search.pad(search.knn(vecs.limit(2), asked, 4), asked, 4).where("neighbor_id is null").count() == 2
    ids = spark.createDataFrame([(0, 3), (1, 99)], "seq long, vec_id long")
    assert [r.embedding for r in search.fetch_by_ids(vecs, ids, "zero", 2).orderBy("seq").collect()] == [[3.0, 4.0], [0.0, 0.0]]


def test_pq_error_falls_with_iterations(spark):
    x = np.random.default_rng(1).normal(size=(200, 8)).tolist()
    points = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    errors = []
    for n in (0, 4):
        book = quantize.train_pq(points, quantize.chunks(8, 2), 8, n)
        errors.append(quantize.encode(points, book, quantize.chunks(8, 2)).agg(F.sum("d")).first()[0])
    assert errors[1] <= errors[0]
    assert quantize.chunk_count(1000, 10, 8) == 8 and quantize.chunk_count(5, 10, 8) == 1


def test_graph_search_finds_most_true_neighbours(spark, sf_dir):
    e = tables.table(spark, sf_dir, "embeddings")
    asked = catalog.asked(e)
    found = graph.walk(e, graph.build(e, 16, 48), asked, 10, 64)
    assert metrics.recall(found, search.knn(e, asked, 10), 10).agg(F.avg("recall")).first()[0] >= 0.9
    backend = engine.Inverted(e, centers=8, chunks=16, probes=7, widen=30)
    assert metrics.recall(backend.search(asked, 10), search.knn(e, asked, 10), 10).agg(F.avg("recall")).first()[0] >= 0.9
    with pytest.raises(NotImplementedError):
        backend.insert(e)


def test_graph_search_over_many_shards(spark, sf_dir):
    e = tables.table(spark, sf_dir, "embeddings")
    asked, rows = catalog.asked(e), 50
    found = graph.walk(e, tables.written(graph.build(e, 16, 48, shard_rows=rows), "graph"), asked, 10, 16, rows)
    assert metrics.recall(found, search.knn(e, asked, 10), 10).agg(F.avg("recall")).first()[0] >= 0.9


def test_robust_prune_hides_what_is_behind_a_kept_node():
    x = np.array([[1.0, 0.0], [1.1, 0.0], [0.0, 1.0]])
    kept = graph.robust_prune(np.zeros(3), np.arange(3), x, (x * x).sum(1), 2, 1.0)
    assert kept == [0, 2]


def test_consolidate_replaces_a_deleted_neighbour(spark, vecs):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 3, 20.0), (3, 2, 18.0)], "src long, dst long, dist double")
    gone = spark.createDataFrame([(1,)], "vec_id long")
    assert sorted(map(tuple, graph.consolidate(edges, gone, vecs).collect())) == [(0, 3), (3, 2)]


def test_theta_moves_as_an_average(spark):
    seen = spark.createDataFrame([(1, 2, 2.0), (1, 1, 1.0), (1, 3, 3.0)], "region long, seq long, d double")
    assert cache.theta_table(seen, 0.9).first().theta == pytest.approx(2.89)


def stream_of(spark, e, n=60):
    ids = spark.range(n).select((F.col("id") % 2).alias("cache_id"), F.col("id").alias("query_seq"), (F.col("id") * 7 % 10 * 50).alias("query_id"))
    return ids.join(catalog.asked(e), "query_id").select("cache_id", "query_seq", "query_id", "embedding")


def test_replay_hits_stay_within_their_threshold(spark, sf_dir):
    e = tables.table(spark, sf_dir, "embeddings")
    config = cache.CacheConfig(k=5, deviation=0.1)
    got = engine.Cached(engine.Exact(e), e, config).replay(stream_of(spark, e)).toPandas()
    hits = got[got.hit]
    assert len(got) == 60 and len(hits) and (hits.kth <= 1.1 * hits.theta + 1e-12).all()


def test_cache_evicts_the_least_recently_used_shard_and_honours_deletes():
    c = cache.Cache(cache.CacheConfig(k=1, shards=2, capacity=2, by_region=False, deviation=0.0))
    for i in range(3):
        v = np.array([float(i), 0.0])
        c.step(v, 1, [(i, 0.0, v)])
    assert sum(map(len, c.shards.values())) == 2 and not any(0 in s for s in c.shards.values())
    assert c.step(np.array([2.0, 0.0]), 1, [])[0]
    c.write(np.array([2.0, 0.0]), 2, delete=True)
    hit, found, _ = c.step(np.array([2.0, 0.0]), 1, [(2, 0.0, np.array([2.0, 0.0]))])
    assert not hit and found == []


def test_streaming_equals_batch(spark, sf_dir, tmp_path):
    from tidemark.operators.cache import with_answers
    from tidemark.streaming import caches

    e = tables.table(spark, sf_dir, "embeddings")
    config = cache.CacheConfig(k=5, deviation=0.1)
    rows = stream_of(spark, e).withColumn("k", F.lit(5)).withColumn("embedding", V.doubles(F.col("embedding")))
    ready = with_answers(rows, search.knn(e, catalog.asked(e), 5), e)
    for i in range(3):  # three files, one a micro-batch, in order
        ready.where(F.floor(F.col("query_seq") / 20) == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(ready.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = caches.cached_search(source, config).writeStream.format("memory").queryName("cached").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("cached").orderBy("cache_id", "query_seq").collect()
    assert [(r.cache_id, r.query_seq, r.hit, r.ids) for r in got] == [(r.cache_id, r.query_seq, r.hit, r.ids) for r in cache.replay(ready, config).orderBy("cache_id", "query_seq").collect()]


def test_alias_chain(spark):
    links = spark.createDataFrame([(3, 2), (2, 1), (1, None), (5, None)], "query_id long, parent_id long")
    assert dict(map(tuple, results.alias_roots(links).collect())) == {1: 1, 2: 1, 3: 1, 5: 5}


def test_write_log_window(spark):
    entry = spark.createDataFrame([(0, 2, 9.0, [0.0])], "query_id long, checkpoint long, max_d double, embedding array<double>")
    log = spark.createDataFrame([(i, i, [float(i)]) for i in range(1, 6)], "vec_id long, epoch long, embedding array<double>")
    assert [r.vec_id for r in results.scan_log(entry, log, 2).collect()] == []
    assert [r.vec_id for r in results.scan_log(entry.withColumn("max_d", F.lit(10.0)), log, 2).collect()] == [3]


def test_percentiles_are_nearest_rank(spark):
    ms = spark.createDataFrame([("a", float(i)) for i in range(1, 11)], "g string, ms double")
    assert metrics.percentiles(ms, ["g"], "ms").first()[1:] == (5.0, 9.0, 10.0, 10.0)
    assert metrics.percentile_floor_rank(ms, ["g"], "ms", 0.9).first().pct == 10.0


def test_zipf_bounds():
    with pytest.raises(ValueError):
        workload.zipf_rank(None, 10, 1.5)


def test_vector_files_round_trip(spark, vecs, tmp_path):
    path = str(tmp_path / "v.bin")
    vector_files.save_vectors(vecs, path)
    assert vector_files.metadata(path) == (5, 2)
    assert [tuple(r) for r in vector_files.vectors(spark, path).orderBy("vec_id").collect()] == [tuple(r) for r in vecs.collect()]
    x = np.arange(6, dtype="<f4").reshape(2, 3)
    with open(tmp_path / "x.fvecs", "wb") as f:
        for row in x:
            np.array([3], "<u4").tofile(f)
            row.tofile(f)
    assert vector_files.convert_vecs(str(tmp_path / "x.fvecs"), path, "fvecs") == (2, 3)
    assert (vector_files.read_bin(path) == x).all()
    np.save(tmp_path / "b.npy", x)
    assert vector_files.convert_npy(str(tmp_path / "*.npy"), path) == (2, 3)
    truth = spark.createDataFrame([(0, 1, 7, 0.5), (0, 2, 8, 1.0)], "query_id long, rnk long, neighbor_id long, dist double")
    vector_files.save_truth(truth, path)
    assert [tuple(r) for r in vector_files.truth(spark, path).collect()] == [(0, 1, 7, 0.5), (0, 2, 8, 1.0)]
    with open(path, "r+b") as f:
        f.truncate(12)
    with pytest.raises(ValueError):
        vector_files.truth(spark, path)


def test_log_lines_and_stored_tables(spark, tmp_path):
    lines = spark.createDataFrame([('x {"event": "a", "n": 1}',), ("broken",), ('{"event": "b", "n": 2}',)], "value string")
    assert [tuple(r) for r in tables.events(lines, "event string, n long").collect()] == [("a", 1), ("b", 2)]
    made = []
    for _ in range(2):
        tables.reuse_or_compute(spark, f"{tmp_path}/t", lambda: made.append(1) or spark.range(3))
    assert made == [1]
    with pytest.raises(ValueError):
        tables.check_rows(spark.range(3), 4)
    with pytest.raises(ValueError):
        V.check_identifier("a; drop")


def test_graph_takes_inserts_and_deletes(spark, sf_dir, tmp_path):
    e = tables.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = catalog.asked(e)
    live = engine.Graph(e.where("vec_id % 5 <> 1"), 16, 64)
    live.insert(e.where("vec_id % 5 = 1"))
    recall = lambda found, rows: metrics.recall(found, search.knn(rows, asked, 10), 10).agg(F.avg("recall")).first()[0]
    assert recall(live.search(asked, 10), e) >= 0.9
    live.remove(e.where("vec_id % 7 = 2").select("vec_id"))
    rest = e.where("vec_id % 7 <> 2")
    assert live.edges.where("dst % 7 = 2 or src % 7 = 2").isEmpty() and live.base.count() == rest.count()
    assert recall(live.search(asked, 10), rest) >= 0.9
    assert live.edges.groupBy("src").count().agg(F.max("count")).first()[0] <= 16
    live.save(f"{tmp_path}/index")
    again = engine.Graph.load(spark, f"{tmp_path}/index")
    assert again.search(asked, 3).count() == 3 * asked.count()
    graph.save(rest.where("vec_id < 100"), live.edges, f"{tmp_path}/broken")
    with pytest.raises(ValueError):
        graph.load(spark, f"{tmp_path}/broken")


def test_seeds_rotation_and_budget(spark, sf_dir):
    e = tables.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    seeds = quantize.seeds_by_distance(e, 6, 1)
    assert seeds.count() == 6 and seeds.select("embedding").distinct().count() == 6
    turned = quantize.rotate(e, 64, 3)
    a, b = (search.knn(x, x.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 3).orderBy("query_id", "rnk").toPandas() for x in (e, turned))
    assert a.neighbor_id.tolist() == b.neighbor_id.tolist() and np.allclose(a.dist, b.dist)
    assert np.allclose(quantize.rotation(5, 1) @ quantize.rotation(5, 1).T, np.eye(5))
    parts = quantize.parts_for_budget(e, 1, 2 * e.count() / 2)
    assert parts.count() >= 3 and search.closest_centers(e, parts, 2).groupBy("center_id").count().agg(F.max("count")).first()[0] <= e.count()
    with pytest.raises(ValueError):
        quantize.parts_for_budget(e.limit(4), 1, 0)


def test_pca_is_stored_and_checked(spark, sf_dir, tmp_path):
    e = tables.table(spark, sf_dir, "embeddings")
    queries = catalog.asked(e).select(F.col("query_id").alias("vec_id"), "embedding")
    quantize.save_pca(quantize.pca(queries, 3), f"{tmp_path}/pca")  # learned from queries
    model = quantize.load_pca(spark, f"{tmp_path}/pca", 64)
    regions = quantize.project(e, model, 8).toPandas().region
    assert all(len(r) == 3 and min(r) >= 0 and max(r) <= 7 for r in regions) and regions.map(tuple).nunique() > 8
    with pytest.raises(ValueError):
        quantize.load_pca(spark, f"{tmp_path}/pca", 32)


def test_steps_of_the_callers_own(spark, vecs):
    asked = vecs.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    shifted = lambda q: q.withColumn("embedding", F.transform("embedding", lambda x: x + 3))
    got = engine.answer(engine.Exact(vecs), asked, 3, transform=shifted, distance=lambda a, b: V.distance("ip", a, b), result=lambda r: r.where("rnk = 1")).collect()
    assert [(r.query_id, r.neighbor_id, r.dist) for r in got] == [(0, 3, -21.0)]
    with pytest.raises(NotImplementedError):
        engine.Backend().search(asked, 1)


def test_sql_functions(spark):
    from tidemark.functions import sql

    sql.register(spark)
    got = spark.sql("SELECT vector_l2(array(0D, 0D), array(3D, 4D)) a, vector_ip(array(1D, 2D), array(3D, 4D)) b, vector_cosine(array(1D, 0D), array(0D, 2D)) c, vector_cosine(array(0D), array(1D)) d").first()
    assert (got.a, got.b, got.c) == (25.0, -11.0, 1.0) and got.d == pytest.approx(3.4028234663852886e38)
    assert [tuple(r) for r in spark.sql("SELECT * FROM neighbors(array(7L, 8L), array(0.5D, 1D))").collect()] == [(1, 7, 0.5), (2, 8, 1.0)]


def test_settings(spark, tmp_path):
    from tidemark.sources import config

    assert config.parse('{"k": 5, "by_region": false}') == cache.CacheConfig(k=5, by_region=False)
    (tmp_path / "c.ini").write_text("[cache]\nk = 7\ndeviation = 0.25\nby_region = no\n[regions]\nbuckets = 16\n")
    assert config.load(spark, str(tmp_path / "c.ini")) == cache.CacheConfig(k=7, deviation=0.25, by_region=False, buckets=16)
    with pytest.raises(ValueError):
        config.parse('{"size": 5}')


def test_database_tables(spark, vecs):
    from tidemark.sources import database

    url = "jdbc:derby:memory:vectors;create=true"
    database.write_vectors(vecs, url, "points", mode="overwrite", createTableColumnTypes="vector VARCHAR(1000)")
    assert [tuple(r) for r in database.read_vectors(spark, url, "points", 2, expected=5).orderBy("vec_id").collect()] == [tuple(r) for r in vecs.collect()]
    with pytest.raises(ValueError):
        database.read_vectors(spark, url, "points", 2, expected=6)
    with pytest.raises(ValueError):
        database.read_vectors(spark, url, "points; drop")


def test_streams(spark, tmp_path):
    from tidemark.streaming import caches

    rows = [(f"2024-01-01 00:{m:02d}:00", u, "click", float(m)) for m, u in ((0, 1), (3, 1), (20, 1), (1, 2), (59, 2))]
    events = spark.createDataFrame(rows, "ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r.user_id, r.n, r.total) for r in caches.sessions(events, "10 minutes").collect()) == [(1, 1, 20.0), (1, 2, 3.0), (2, 1, 1.0), (2, 1, 59.0)]
    assert sum(r.n for r in caches.interval_counts(events, "30 minutes").collect()) == 5
    assert sum(r.n for r in caches.interval_counts(events, "30 minutes", "10 minutes").collect()) == 15
    moves = spark.createDataFrame([("insert", 1, 1, [1.0]), ("delete", 1, 2, None), ("insert", 2, 1, [2.0]), ("insert", 1, 3, [3.0]), ("delete", 2, 1, None)], "op string, vec_id long, seq long, embedding array<float>")
    moves.where("seq = 1").write.parquet(f"{tmp_path}/in/a")
    moves.where("seq > 1").write.parquet(f"{tmp_path}/in/b")
    source = spark.readStream.schema(moves.schema).parquet(f"{tmp_path}/in/*")
    q = source.writeStream.foreachBatch(caches.apply_mutations(f"{tmp_path}/live", f"{tmp_path}/dead")).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    live, dead = spark.read.parquet(f"{tmp_path}/live").drop("batch"), spark.read.parquet(f"{tmp_path}/dead").drop("batch")
    base = spark.createDataFrame([(9, [9.0])], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id, r.embedding) for r in graph.compact(base, live, dead).collect()) == [(1, [3.0]), (9, [9.0])]
    assert sorted(r.seq for r in caches.visible(live, 3, 2).collect()) == [1, 1]


def test_streamed_thresholds(spark, tmp_path):
    from tidemark.streaming import caches

    seen = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (2, 1, 5.0)], "region long, seq long, d double")
    seen.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = caches.thetas(spark.readStream.schema(seen.schema).parquet(f"{tmp_path}/in"), 0.9).writeStream.format("memory").queryName("thetas").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("thetas").collect())) == [(1, pytest.approx(1.9)), (2, 5.0)]


def test_cumulative_in_blocks_equals_one_block(spark):
    rows = spark.range(50).select(F.col("id").alias("interval"), (F.col("id") % 7 + 1).alias("queries"), (F.col("id") % 3).alias("hits"), (F.col("id") * 1.5).alias("sum_ms"))
    one, many = (metrics.cumulative(rows, b).orderBy("interval").toPandas() for b in (1000, 7))
    assert one.completed.tolist() == many.completed.tolist() and np.allclose(one, many)
