"""Vector functions, quantizers, file formats, index storage and streaming on small inputs."""

import dataclasses
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import vectors as V
from orrery.functions import dictionary
from orrery.functions.metrics import mean_recall, recall_by_distance, throughput, truth_rows
from orrery.operators import clustering as C
from orrery.operators import graph as G
from orrery.operators import quantize as Q
from orrery.operators.knn import knn_join, nearest_points
from orrery.plans import experiments
from orrery.plans.index import IndexConfig, VectorIndex
from orrery.sources import hdf5, vecfiles
from orrery.streaming.ingest import ingest, with_ingested


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id bigint, embedding array<float>")


def test_constant_rows_have_known_neighbours(spark):
    rows = frame(spark, [[i] * 10 for i in range(100)])
    got = knn_join(rows.where("vec_id = 50"), rows, 5).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [50, 49, 51, 48, 52]
    assert [r["distance"] for r in got] == [0, 10, 10, 40, 40]


def test_metrics_and_self_exclusion(spark):
    rows = frame(spark, [[1, 0], [0, 1], [-1, 0], [0.7, 0.7]])
    q = rows.where("vec_id = 0")
    assert knn_join(q, rows, 1, "ip", exclude_self=True).first()["vec_id"] == 3
    assert knn_join(q, rows, 4, "cosine").orderBy("rank").collect()[-1]["vec_id"] == 2
    assert knn_join(q, rows.limit(0), 3).count() == 0
    assert nearest_points(rows, rows.limit(0), 3).count() == 0


def test_blocks_of_the_stated_set_change_nothing(spark, monkeypatch):
    from orrery.operators import knn

    rng = np.random.default_rng(1)
    rows = frame(spark, rng.normal(size=(200, 8)))
    whole = sorted(map(tuple, nearest_points(rows, rows, 3).collect()))
    monkeypatch.setattr(knn, "BLOCK_BYTES", 2000)
    assert sorted(map(tuple, nearest_points(rows, rows, 3).collect())) == whole


def test_packing_bits(spark):
    bits = [1, 0, 0, 0, 0, 0, 0, 1, 1]
    row = spark.range(1).select(F.array(*map(F.lit, bits)).alias("b"))
    row = row.select(V.packed(F.col("b")).alias("p")).withColumn("u", V.unpacked(F.col("p"), 9)).first()
    assert row["p"] == [129, 1] and row["u"] == bits


def test_code_products(spark):
    row = spark.range(1).select(F.array(*map(F.lit, [1.0, 2.0, 3.0])).alias("q"), F.array(*map(F.lit, [1, 0, 1])).alias("c"))
    assert row.select(V.binary_ip("q", F.col("c")), V.code_ip("q", F.col("c"))).first()[:] == (2.0, 4.0)


@pytest.mark.parametrize("bits, recall, corr", [(1, 0.30, 0.75), (2, 0.35, 0.85), (4, 0.70, 0.98)])
@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_estimates_are_good_enough(spark, bits, recall, corr, metric):
    rows = vecfiles.generated(spark, 400, 64, "uniform", seed=3)
    center = rows.select(F.posexplode(V.doubles("embedding"))).groupBy("pos").agg(F.avg("col").alias("x")).orderBy("pos")
    center = [r["x"] for r in center.collect()]
    with_center = rows.withColumn("centroid", F.array(*map(F.lit, center))).withColumn("head_id", F.lit(0))
    coded = Q.multi_bit(with_center, bits).join(with_center, ["head_id", "vec_id"])
    q = rows.where("vec_id < 10").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    pairs = coded.crossJoin(q).withColumn("distance", Q.multi_bit_distance(bits, metric))
    pairs = pairs.withColumn("exact", V.distance(metric, "query_vec", "embedding")).cache()
    from pyspark.sql import Window

    by = Window.partitionBy("query_id")
    got = pairs.withColumn("rank", F.row_number().over(by.orderBy("distance", "vec_id"))).where("rank <= 10")
    true = pairs.withColumn("rank", F.row_number().over(by.orderBy("exact", "vec_id"))).where("rank <= 10")
    assert mean_recall(got, true, 10).first()["recall"] >= recall
    assert pairs.select(F.corr("distance", "exact")).first()[0] >= corr
    # unbiased up to the codes' error: exact where the row is the query's own
    assert abs(pairs.select(F.avg(F.col("distance") - F.col("exact"))).first()[0]) < 0.5


def test_codes_of_degenerate_rows():
    made = Q.encode(np.array([[1.0, 2.0], [1.0, 2.0], [3.0, 3.0]]), np.array([[1.0, 2.0]] * 3), 4)
    assert all(np.isfinite(v).all() for v in made.values())
    assert made["r_square"][0] == 0 and made["f_rescale"][0] == 0
    x = made["code"][2] - 7.5
    assert np.allclose(np.array([1.0, 2.0]) + made["scale"][2] * x, [3, 3], atol=0.3)


def test_best_codes_match_a_search_over_scales():
    rng = np.random.default_rng(5)
    r = rng.normal(size=(20, 16))
    for bits in (2, 4):
        codes = Q.best_codes(r, bits)
        a = np.abs(r) / np.linalg.norm(r, axis=1, keepdims=True)
        score = lambda k: ((k + 0.5) * a).sum(1) / np.linalg.norm(k + 0.5, axis=1)
        best = np.max([score(np.minimum(np.floor(t * a), (1 << (bits - 1)) - 1)) for t in np.linspace(0, 80, 4000)], axis=0)
        assert (score(codes) >= best - 1e-6).all()


def test_one_bit_bound_holds_mostly(spark):
    rows = vecfiles.generated(spark, 200, 64, "unit")
    q = rows.where("vec_id = 0").select(F.col("embedding").alias("query_vec"))
    coded = Q.one_bit(rows.withColumn("centroid", F.array_repeat(F.lit(0.0), 64))).crossJoin(q)
    off = coded.select((F.abs(Q.one_bit_l2() - V.l2_distance("query_vec", "embedding")) <= F.col("f_error")).cast("int").alias("ok"))
    assert off.select(F.avg("ok")).first()[0] > 0.9


def test_kmeans_keeps_sizes_even():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (300, 4)), rng.normal(3, 1, (100, 4))])
    free, even = C.balanced_kmeans(x, 8), C.auto_balanced(x, 8)
    assert C.balance(even.counts) <= C.balance(free.counts) and even.counts.sum() == 400
    assert C.balanced_kmeans(x[:1], 3).counts.sum() == 1


@pytest.mark.parametrize("kind", ["vecbin", "fvecs"])
def test_vector_files_round_trip(spark, tmp_path, kind):
    vecfiles.register(spark)
    rows = vecfiles.generated(spark, 23, 5).coalesce(1)
    path = str(tmp_path / f"x.{kind}")
    rows.write.format(kind).mode("append").option("path", path).save()
    back = spark.read.format(kind).option("rowsPerPartition", 7).load(path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert spark.read.format(kind).option("maxRows", 4).load(path).count() == 4


def test_truth_files(spark, tmp_path):
    vecfiles.register(spark)
    path = tmp_path / "x.ivecs"
    path.write_bytes(struct.pack("<iii", 2, 7, 9) + struct.pack("<iii", 2, 1, 0))
    rows = spark.read.format("ivecs").load(str(path)).withColumnRenamed("vec_id", "query_id")
    assert [tuple(r) for r in truth_rows(rows).orderBy("query_id", "rank").collect()] == [(0, 7, 1), (0, 9, 2), (1, 1, 1), (1, 0, 2)]
    other = vecfiles.read_fixed(spark, str(path), "ivecs", 2, "i").orderBy("vec_id").collect()
    assert [r["embedding"] for r in other] == [[7, 9], [1, 0]]
    binary = tmp_path / "t.bin"
    binary.write_bytes(struct.pack("<IIiiii", 2, 2, 5, 6, 7, 8))
    assert [r[1] for r in spark.read.format("vecbin").option("dtype", "int32").load(str(binary)).orderBy("vec_id").collect()] == [[5, 6], [7, 8]]


@pytest.mark.parametrize("more", [{}, {"bits": 1}, {"bits": 2}, {"bits": 4}, {"delta": True}, {"metric": "ip"}])
def test_stored_indexes_answer_alike(spark, tmp_path, more):
    rows = vecfiles.generated(spark, 300, 16, "unit")
    index = VectorIndex.build(rows, IndexConfig(ratio=0.1, probes=16, heads="strided", rerank=5, **more))
    q = rows.where("vec_id < 5")
    first = sorted(map(tuple, index.search(q, 5).collect()))
    index.save(str(tmp_path / "i"))
    loaded = VectorIndex.load(spark, str(tmp_path / "i"), cache=True)
    assert loaded.config == index.config
    assert sorted(map(tuple, loaded.search(q, 5).collect())) == first
    true = knn_join(q, rows, 5, more.get("metric", "l2"))
    assert mean_recall(loaded.search(q, 5), true, 5).first()["recall"] >= 0.8


def test_heads_beyond_the_sample_keep_every_row(spark):
    rows = vecfiles.generated(spark, 2000, 8, "unit")
    index = VectorIndex.build(rows, IndexConfig(ratio=0.05, head_sample=400, replicas=1, posting_limit=1))
    assert 60 <= index.heads.count() <= 140
    assert index.postings.select("vec_id").distinct().count() == 2000


def test_vectors_of_different_lengths_are_refused(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [4.0, 5.0, 6.0, 7.0, 8.0])], "vec_id bigint, embedding array<float>")
    with pytest.raises(Exception, match="different lengths"):
        knn_join(rows, rows, 1).collect()


def test_packed_words_hold_every_code(spark):
    rng = np.random.default_rng(2)
    for bits in (1, 2, 4):
        codes = rng.integers(0, 1 << bits, (3, 70))
        words = Q.packed_words(codes, bits)
        assert words.shape[1] == -(-70 * bits // 64)
        rows = spark.createDataFrame([(w.tolist(),) for w in words], "code array<bigint>")
        got = rows.select(Q.code_values(bits, F.lit(70)).alias("c")).collect()
        assert sorted(r["c"] for r in got) == sorted(codes.tolist())


@pytest.mark.parametrize("metric", ["ip", "cosine"])
def test_recall_on_uneven_norms(spark, metric):
    rng = np.random.default_rng(4)
    rows = frame(spark, rng.normal(size=(600, 12)) * rng.uniform(0.2, 5, (600, 1)))
    index = VectorIndex.build(rows, IndexConfig(metric=metric, ratio=0.1, probes=24, heads="strided", max_check=1 << 20))
    q = rows.where("vec_id < 20")
    assert mean_recall(index.search(q, 5), knn_join(q, rows, 5, metric), 5).first()["recall"] >= 0.9


@pytest.mark.parametrize("max_check", [1 << 20, 60])
def test_lists_read_in_place_answer_alike(spark, tmp_path, max_check):
    rows = vecfiles.generated(spark, 400, 16, "unit")
    config = IndexConfig(ratio=0.1, probes=6, heads="strided", max_check=max_check)
    q = rows.where("vec_id < 30")
    want = sorted(map(tuple, VectorIndex.build(rows, config).search(q, 5).collect()))
    VectorIndex.build(rows, dataclasses.replace(config, inline=True)).save(str(tmp_path / "i"))
    index = VectorIndex.load(spark, str(tmp_path / "i"))
    assert sorted(map(tuple, index.search(q, 5).collect())) == want
    # the scan is told which heads are asked for, and the directory knows all lists
    plan = index.postings.where(F.col("head_id").isin([10, 20]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(head_id" in plan and index.directory.agg(F.sum("n_rows")).first()[0] == index.postings.count()


def test_an_id_is_added_once(spark):
    rows = vecfiles.generated(spark, 100, 8, "unit").cache()
    index = VectorIndex.build(rows.where("vec_id < 80"), IndexConfig(ratio=0.1, heads="strided"))
    more = index.appended(rows.where("vec_id >= 70").union(rows.where("vec_id = 90")))
    assert more.vectors.count() == 100 and more.postings.select("vec_id").distinct().count() == 100
    assert more.postings.count() == more.postings.select("head_id", "vec_id").distinct().count()


def test_searches_of_a_line_of_nodes(spark):
    """A graph where each node knows the next two: single entries, beams and trees walk it."""
    rows = frame(spark, [[i, 0] for i in range(60)])
    edges = spark.createDataFrame([(i, j, float((i - j) ** 2), r) for i in range(60) for r, j in enumerate([i - 1, i + 1, i - 2, i + 2], 1) if 0 <= j < 60], G.EDGES)
    q = rows.where("vec_id = 43")
    tree = spark.createDataFrame(C.bk_tree(np.arange(60), np.array([[i, 0.0] for i in range(60)])).table(), "node_id bigint, parent_id bigint, center_id bigint, is_leaf boolean")
    for more in ({"entries": 1, "max_checks": None}, {"entries": 1, "beam": 20}, {"entries": 1, "max_checks": 30, "tree": tree}):
        got = G.graph_search(q, rows, edges, 3, **more).orderBy("rank").collect()
        assert [r["vec_id"] for r in got] == [43, 42, 44], more
    with pytest.raises(ValueError):
        G.graph_search(q, rows, edges, 3, most_bytes=10)


def test_overfull_leaves_are_split_on(spark):
    rows = vecfiles.generated(spark, 3000, 8, "unit")
    _, x = C.sampled(rows, 100)
    sizes = C.memberships(rows, C.split_tree(x, "tp", 50), 50).groupBy("node_id").count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[0] <= 250 and sizes[1] == 3000


def test_pruning_across_batches(spark):
    rows = vecfiles.generated(spark, 120, 6, "unit")
    edges = G.exact_graph(rows, 20)
    whole = sorted(map(tuple, G.prune_relative(edges, rows, 6).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, G.prune_relative(edges, rows, 6).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_streamed_rows_are_found(spark, tmp_path):
    rows = vecfiles.generated(spark, 200, 8, "unit").cache()
    VectorIndex.build(rows.where("vec_id < 150"), IndexConfig(ratio=0.1, heads="strided")).save(str(tmp_path / "i"))
    rows.where("vec_id >= 150").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = ingest(spark, stream, str(tmp_path / "i"), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    index = with_ingested(spark, str(tmp_path / "i"))
    got = index.search(rows.where("vec_id in (3, 160, 199)"), 1).collect()
    assert {(r["query_id"], r["vec_id"]) for r in got} == {(3, 3), (160, 160), (199, 199)}


def test_truth_of_any_length(spark, tmp_path):
    path = tmp_path / "t.ibin"
    path.write_bytes(struct.pack("<iiiiii", 2, 7, 9, 0, 1, 4))
    got = vecfiles.read_variable(spark, str(path)).orderBy("query_id").collect()
    assert [tuple(r) for r in got] == [(0, [7, 9]), (1, []), (2, [4])]


def test_hdf5(spark, tmp_path):
    path = str(tmp_path / "x.hdf5")
    try:
        import h5py
    except ImportError:
        with pytest.raises(ImportError, match="h5py"):
            hdf5.read_hdf5(spark, path, "train")
        return
    with h5py.File(path, "w") as f:
        f["train"], f["neighbors"] = np.arange(12, dtype="f4").reshape(4, 3), np.arange(4, dtype="i4").reshape(2, 2)
    assert [r["embedding"] for r in hdf5.read_hdf5(spark, path, "train").orderBy("vec_id").collect()][1] == [3, 4, 5]
    hdf5.convert_hdf5(spark, path, "neighbors", "ivecs", str(tmp_path / "t.ivecs"))
    assert [r[1] for r in spark.read.format("ivecs").load(str(tmp_path / "t.ivecs")).collect()] == [[0, 1], [2, 3]]


def test_dictionaries_round_trip(spark):
    rows = spark.range(400).select("id", F.encode(F.concat(F.lit("a list of the same kind, number "), F.col("id").cast("string")), "utf-8").alias("v"))
    rows = rows.union(spark.createDataFrame([(-1, None), (-2, bytearray())], rows.schema))
    for found in (dictionary.trained(rows, "v"), b""):
        small = dictionary.compressed(rows, "v", found)
        assert sorted(map(tuple, dictionary.decompressed(small, "v", found).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert dictionary.trained(rows.limit(0), "v") == b""


def test_recall_by_distance(spark):
    truth = spark.createDataFrame([(0, 1, 0.0, 1), (0, 2, 1.0, 2)], "query_id bigint, vec_id bigint, distance double, rank int")
    got = spark.createDataFrame([(0, 1, 0.0, 1), (0, 9, 1.0, 2)], truth.schema)
    assert recall_by_distance(got, truth, 2).first()["recall"] == 1.0


def test_matrix_of_settings(spark):
    rows = vecfiles.generated(spark, 150, 8, "unit")
    report = experiments.run_matrix(rows, rows.where("vec_id < 4"), 3, probes=(4,), checks=(50,), bits=(0, 4), most=2, ratio=0.1, heads="strided")
    got = report.collect()
    assert len(got) == 2 and all(0 < r["recall"] <= 1 and r["p50"] > 0 and r["qps"] > 0 for r in got)
    assert experiments.markdown(report).count("\n") == 3


def test_throughput(spark):
    assert throughput(spark.createDataFrame([(0.5,), (1.5,)], "s double"), "s").first()["qps"] == 1.0
