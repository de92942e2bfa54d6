"""Sources, index, search, votes, evaluation and streaming."""

import gzip
import json

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_features import GOLDEN, payload, risks

from knnscore.functions import scores as S
from knnscore.operators import evaluate, ivf, kmeans, knn, vote
from knnscore.plans.scoring import build_index, check, payload_vectors, validate
from knnscore.sources import index_store, readers
from knnscore.streaming.scoring import score_stream

DIMS = 14


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [int(x) for x in rng.integers(-10000, 10001, DIMS)], int(i % 3 == 0)) for i in range(400)]
    return spark.createDataFrame(rows, "vec_id long, q array<int>, label int").cache(), rows


@pytest.fixture(scope="module")
def index(data):
    return ivf.build(data[0], 6, DIMS, nprobe=2, iterations=4)


def asked(df):
    return df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "q")


def rows_of(df):
    return sorted(tuple(r) for r in df.select("qid", "vec_id", "d", "rank").collect())


def brute(rows, k, skip):
    out = []
    for i, q, _ in rows[::50]:
        near = sorted((sum((a - b) ** 2 for a, b in zip(q, r, strict=True)), j) for j, r, _ in rows if not (skip and i == j))[:k]
        out += [(i, j, d, n + 1) for n, (d, j) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("strategy", ["sql", "arrow"])
@pytest.mark.parametrize("k,skip", [(1, True), (5, False), (1000, False)])
def test_knn_is_exact(data, strategy, k, skip):
    df, rows = data
    assert rows_of(knn.knn(asked(df), df, k, DIMS, strategy, skip)) == brute(rows, k, skip)


def test_knn_edges(spark, data):
    df, _ = data
    assert knn.knn(asked(df), df, 0, DIMS).count() == 0
    assert knn.knn(asked(df.limit(0)), df, 5, DIMS).count() == 0
    assert knn.knn(asked(df), df.limit(0), 5, DIMS).count() == 0
    ties = spark.createDataFrame([(i, [0] * DIMS, 0) for i in range(20)], "vec_id long, q array<int>, label int").repartition(5)
    for strategy in ("sql", "arrow"):
        got = knn.knn(ties.where("vec_id = 0").select(F.col("vec_id").alias("qid"), "q"), ties, 5, DIMS, strategy, True)
        assert [r.vec_id for r in got.orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_queries_in_blocks(data, monkeypatch):
    df, rows = data
    monkeypatch.setattr(knn, "QUERY_BLOCK", 3 * DIMS)
    assert rows_of(knn.knn(asked(df), df, 5, DIMS)) == brute(rows, 5, False)


def test_queries_that_fit_no_block(data, index, monkeypatch):
    df, rows = data
    few, named = rows_of(knn.knn_ivf(asked(df), index, 5, 2)), asked(df).withColumn("qid", F.concat(F.lit("q"), "qid"))
    texts = sorted((r.qid, r.vec_id, r.rank) for r in knn.knn_ivf(named, index, 5, 2).collect())
    two = sorted(map(tuple, vote.two_stage(asked(df), index, vote.Probes(1, 6)).collect()))
    monkeypatch.setattr(knn, "QUERY_BLOCK", 3 * DIMS)
    monkeypatch.setattr(knn, "PART", 50 * DIMS)
    monkeypatch.setattr(vote, "QUERY_BLOCK", 3 * DIMS)
    assert rows_of(knn.knn(asked(df), df, 5, DIMS, skip_self=True)) == brute(rows, 5, True)
    assert rows_of(knn.knn_ivf(asked(df), index, 5, 2)) == few
    assert sorted((r.qid, r.vec_id, r.rank) for r in knn.knn_ivf(named, index, 5, 2).collect()) == texts
    assert sorted(map(tuple, vote.two_stage(asked(df), index, vote.Probes(1, 6)).collect())) == two
    monkeypatch.setattr(knn, "MAX_PAIRS", 10)
    with pytest.raises(ValueError, match="too many"):
        knn.knn(asked(df), df, 5, DIMS, "sql")


def test_float_routing(data, index):
    df, rows = data
    q = asked(df).withColumn("vector", F.transform("q", lambda x: (x / 10000).cast("float")))
    model = {r.cluster_id: np.array(r.centroid, dtype=np.float32) / np.float32(10000) for r in index.centroids.collect()}
    got = {(r.qid, r.probe): r.cluster_id for r in knn.nearest_clusters(q, index.centroids, 3, DIMS, "float").collect()}
    for i, v, _ in rows[::50]:
        a = np.array(v, dtype=np.float32) / np.float32(10000)
        near = sorted(model, key=lambda c: (float(((a - model[c]) ** 2).sum(dtype=np.float64)), c))[:3]
        assert [got[i, n] for n in (1, 2, 3)] == near
    assert rows_of(knn.knn_ivf(q, index, 5, 6, routing="float")) == brute(rows, 5, False)
    with pytest.raises(ValueError):
        knn.nearest_clusters(q, index.centroids, 3, DIMS, "other")


def test_recall_of_the_index_queries(spark):
    from knnscore.plans import queries

    found = {(r.qid, r.vec_id) for r in queries.QUERIES["ivf_knn_top5"](spark, SF).collect()}
    exact = {(r.qid, r.vec_id) for r in queries.QUERIES["knn_bruteforce_top5"](spark, SF).collect()}
    assert len(found & exact) >= 0.9 * len(exact)


def test_built_index_is_checked(spark, data, tmp_path):
    built = build_index(data[0], str(tmp_path / "i"), 4, DIMS, nprobe=2, iterations=2)
    assert built.vectors.count() == 400
    holes = ivf.Index(built.vectors.withColumn("label", F.lit(None).cast("int")), built.centroids, DIMS, 4, 2)
    check(holes)
    lost = ivf.Index(built.vectors, built.centroids.where("cluster_id < 0"), DIMS, 4, 2)
    with pytest.raises(Exception):
        check(lost)


def test_all_clusters_probed_is_exact(data, index):
    df, rows = data
    exact = knn.knn(asked(df), df, 5, DIMS)
    assert rows_of(knn.knn_ivf(asked(df), index, 5, 100)) == brute(rows, 5, False)
    assert knn.nearest_clusters(asked(df), index.centroids, 100, DIMS).groupBy("qid").count().select("count").distinct().first()[0] == 6
    r = knn.recall(knn.knn_ivf(asked(df), index, 5, 6), exact).first()
    assert r.recall == 1.0


def test_kmeans_paths_agree(data):
    df, _ = data
    c, trace = kmeans.fit(df, 5, DIMS, 3)
    sql = kmeans.iterate_sql(df, kmeans.seeds(df, 5), DIMS, 3).orderBy("cluster_id").collect()
    assert [r.centroid for r in sql] == c.astype(int).tolist()
    assert trace[0] >= trace[-1]
    a = {r.vec_id: (r.cluster_id, r.d) for r in kmeans.assign(df, c).collect()}
    b = {r.vec_id: (r.cluster_id, r.d) for r in kmeans.assign_sql(df, kmeans.table_of(df.sparkSession, c), DIMS).collect()}
    assert a == b
    with pytest.raises(ValueError):
        kmeans.fit(df.limit(3), 5, DIMS, 1)


def test_empty_cluster_keeps_its_centroid(spark, data):
    df, _ = data
    far = spark.createDataFrame([(0, [0] * DIMS), (1, [10**6] * DIMS)], "cluster_id int, centroid array<int>")
    new = {r.cluster_id: r.centroid for r in kmeans.update_sql(kmeans.assign_sql(df, far, DIMS), far, DIMS).collect()}
    assert new[1] == [10**6] * DIMS and new[0] != [0] * DIMS


def test_index_folder(spark, data, index, tmp_path):
    path = str(tmp_path / "index")
    index_store.save(index, path, files=3)
    back = index_store.load(spark, path)
    assert rows_of(knn.knn_ivf(asked(data[0]), back, 5, 3)) == rows_of(knn.knn_ivf(asked(data[0]), index, 5, 3))
    assert index_store.is_ready(spark, path) and not index_store.is_ready(spark, str(tmp_path / "none"))
    v = validate(back, 20).first()
    assert (v.n_sample, v.n_with_neighbours, v.n_finite) == (20, 20, 20)
    spark.createDataFrame([(2, DIMS, 6, 2, 400)], index_store.META).write.mode("overwrite").parquet(f"{path}/meta")
    with pytest.raises(index_store.InvalidIndex, match="version"):
        index_store.load(spark, path)
    spark.createDataFrame([(1, DIMS, 7, 2, 400)], index_store.META).write.mode("overwrite").parquet(f"{path}/meta")
    with pytest.raises(index_store.InvalidIndex, match="centroids"):
        index_store.load(spark, path)
    spark.createDataFrame([(1, DIMS, 6, 2, 399)], index_store.META).write.mode("overwrite").parquet(f"{path}/meta")
    with pytest.raises(index_store.InvalidIndex, match="vectors"):
        index_store.load(spark, path)
    assert not index_store.is_ready(spark, path)


def test_sizes_and_offsets(spark):
    sizes = spark.createDataFrame([(0, 3), (1, 8), (2, 9)], "cluster_id int, size long")
    got = [(r.cluster_id, r.blocks, r.first_block) for r in ivf.offsets(sizes).orderBy("cluster_id").collect()]
    assert got == [(0, 1, 0), (1, 1, 1), (2, 2, 2)]
    found = ivf.cluster_range(ivf.offsets(sizes), spark.createDataFrame([(2,), (9,)], "cluster_id int")).orderBy("cluster_id").collect()
    assert [(r.first_block, r.end_block) for r in found] == [(2, 4), (None, None)]


def test_votes_and_two_stages(spark, data, index):
    q = asked(data[0])
    none = spark.createDataFrame([], "qid long, vec_id long, label int, d long, rank int")
    assert {r.frauds for r in vote.votes(q, none).collect()} == {0}
    fast = {r.qid: r.frauds for r in vote.votes(q, knn.knn_ivf(q, index, 5, 1)).collect()}
    full = {r.qid: r.frauds for r in vote.votes(q, knn.knn_ivf(q, index, 5, 6)).collect()}
    for r in vote.two_stage(q, index, vote.Probes(1, 6)).collect():
        assert r.second == (fast[r.qid] in (2, 3))
        assert r.frauds == (full if r.second else fast)[r.qid]
    voted = spark.createDataFrame([(i, i) for i in range(6)] + [(6, None)], "qid int, frauds int")
    got = [(r.approved, round(r.fraud_score, 4)) for r in vote.decide(voted).orderBy("qid").collect()]
    assert got == [(True, 0.0), (True, 0.2), (True, 0.4), (False, 0.6), (False, 0.8), (False, 1.0), (True, 0.0)]


def test_probe_settings(index):
    p = vote.Probes
    assert p.of(index) == p(2, 6) and p.of(index, 1) == p(1, 3) and p.of(index, 0, 4) == p(2, 4) and p.of(index, 100, 100) == p(6, 6)
    assert p.from_environment(index, {"NPROBE": "x", "FULL_NPROBE": "-3"}) == p(2, 6)
    assert p.from_environment(index, {"NPROBE": "1", "FULL_NPROBE": "5"}) == p(1, 5)


@pytest.mark.parametrize("fp,fn,err,n,p99,errors,det,lat", [
    (0, 2, 0, 54059, 432.0, 6, 2746.47, 364.52), (0, 0, 0, 54059, 0.7, 0, 3000.0, 3000.0), (0, 0, 0, 10, 1.46, 0, 3000.0, 2835.65),
    (16, 0, 0, 100, 2001.0, 16, -3000.0, -3000.0), (0, 0, 0, 0, 0.0, 0, 3000.0, 0.0)])
def test_scores(spark, fp, fn, err, n, p99, errors, det, lat):
    counts = spark.createDataFrame([(fp, fn, err, n)], "fp long, fn long, err long, n long")
    row = evaluate.detection(counts).first()
    assert row.weighted_errors == errors and row.detection_score == pytest.approx(det, abs=0.01)
    assert spark.range(1).select(S.latency_score(F.lit(p99)).alias("v")).first().v == pytest.approx(lat, abs=0.01)


def test_report_and_errors(spark):
    rows = spark.createDataFrame([(1, True, True, True, 1.0), (2, False, True, True, 2.0), (3, True, False, True, 3.0), (4, True, True, False, 4.0)], "qid long, approved boolean, expected_approved boolean, ok boolean, latency_ms double")
    assert [(r.qid, r.kind) for r in evaluate.errors(rows).orderBy("qid").collect()] == [(2, "FP"), (3, "FN"), (4, "ERR")]
    assert [r.qid for r in evaluate.errors(rows, 1).collect()] == [2]
    report = json.loads(evaluate.report(rows).first().report)
    assert (report["tn"], report["fp"], report["fn"], report["err"], report["n"]) == (1, 1, 1, 1, 4)


@pytest.mark.parametrize("array", [True, False])
def test_reference_files(spark, tmp_path, array):
    rows = [{"vector": [float(i)] * DIMS, "label": label} for i, label in enumerate(("fraud", "legit", "other"))]
    text = json.dumps(rows) if array else "\n\n".join(map(json.dumps, rows)) + "\n"
    path = tmp_path / "references.json.gz"
    path.write_bytes(gzip.compress(("  \n" + text).encode()))
    got = sorted((r.vector[0], r.label) for r in readers.read_references(spark, str(path), partitions=2).collect())
    assert got == [(0.0, 1), (1.0, 0), (2.0, 0)]


def test_bad_reference_files(spark, tmp_path):
    def write(text):
        p = tmp_path / f"r{abs(hash(text))}.json"
        p.write_text(text)
        return str(p)

    with pytest.raises(readers.EmptySource):
        readers.read_references(spark, write(" \n"))
    with pytest.raises(readers.EmptySource):
        readers.read_references(spark, write("[]"))
    with pytest.raises(Exception, match="14 numbers|USER_RAISED"):
        readers.read_references(spark, write(json.dumps({"vector": [1.0], "label": "x"}))).collect()
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        readers.read_references(spark, write('{"vector": [1.0')).collect()


def test_risks_and_evaluation_files(spark, tmp_path):
    (tmp_path / "risk.json").write_text('{\n "5411": 0.15,\n "7995": 0.85 }')
    assert {r.mcc: round(r.risk, 2) for r in readers.read_risks(spark, str(tmp_path / "risk.json")).collect()} == {"5411": 0.15, "7995": 0.85}
    entry = {"request": payload(), "expected_approved": True, "expected_fraud_score": 0.2}
    (tmp_path / "eval.json").write_text(json.dumps({"entries": [entry, entry], "stats": {"total": 2}}))
    got = readers.read_evaluation(spark, str(tmp_path / "eval.json"))
    assert got.count() == 2 and got.first().request.id == "tx-1329056812"


def test_stream_scores_like_a_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(json.dumps(p) for p, _ in GOLDEN) + "\n{broken\n")
    q = [q for _, q in GOLDEN]
    refs = spark.createDataFrame([(i * 10 + j, [x + j for x in v], int(i == 2)) for i, v in enumerate(q) for j in range(6)], "vec_id long, q array<int>, label int")
    index = ivf.build(refs, 3, DIMS, nprobe=3, iterations=3)
    got, bad = [], []
    lines = spark.readStream.text(str(source))
    s = score_stream(lines, index, risks(spark), lambda df, n: got.extend(df.collect()), str(tmp_path / "cp"), refused=lambda df, n: bad.extend(df.collect()))
    s.awaitTermination(120)
    assert {r.id: r.approved for r in got} == {"tx-1329056812": True, "tx-3576980410": True, "tx-3330991687": False}
    assert json.loads(next(r.response for r in got if not r.approved)) == {"approved": False, "fraud_score": 1.0}
    assert [r.text for r in bad] == ["{broken"]
    batch = readers.read_payloads(spark, _json_array(tmp_path))
    assert {r.id: r.q for r in payload_vectors(batch, risks(spark)).collect()} == {p['id']: v for p, v in GOLDEN}


def _json_array(folder):
    (folder / "payloads.json").write_text(json.dumps([p for p, _ in GOLDEN]))
    return str(folder / "payloads.json")
