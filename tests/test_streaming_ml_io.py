"""Streaming parity with the batch windows, sinks, dead letters, dedup;
neighbour search and oversampling invariants; sources and model bundles."""
import glob
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF_MED, SF_SMALL
from fraudlens.operators import ml as ML
from fraudlens.operators import monitoring as MO
from fraudlens.operators import rules as R
from fraudlens.operators import windows as W
from fraudlens.plans.q_sources import EVENT_MESSAGE_SCHEMA
from fraudlens.sources import io as IO
from fraudlens.sources import views as V
from fraudlens.streaming import jobs as J


def _write_json_batches(df, out, n_files):
    rows = [json.dumps(r.asDict()) for r in df.orderBy("TransactionDT", "TransactionID").collect()]
    per = max(1, len(rows) // n_files + 1)
    os.makedirs(out, exist_ok=True)
    base = 1_600_000_000
    for n, i in enumerate(range(0, len(rows), per)):
        path = os.path.join(out, f"part-{i:08d}.json")
        with open(path, "w") as fh:
            fh.write("\n".join(rows[i:i + per]) + "\n")
        # the file source orders files by modification time: make it strict
        os.utime(path, (base + n, base + n))


def test_stream_velocity_equals_batch(spark, tmpdir_path):
    t = V.txn_events(spark, SF_SMALL).select("TransactionID", "TransactionDT", "card1", "failed")
    src = os.path.join(tmpdir_path, "in")
    _write_json_batches(t, src, 4)
    schema = "TransactionID long, TransactionDT long, card1 long, failed boolean"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(src)
    q = (J.card_velocity(stream).writeStream.format("memory").queryName("vel_out")
         .outputMode("append").option("checkpointLocation", os.path.join(tmpdir_path, "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM vel_out").collect())
    names = ["TransactionID", *W.VELOCITY_WINDOWS, *W.FAILED_WINDOWS]
    exp = sorted(tuple(r) for r in W.velocity_counts(t, strategy="direct").select(*names)
                 .collect())
    assert got == exp


def test_score_stream_sinks_and_dead_letter(spark, tmpdir_path):
    t = V.txn_events(spark, SF_SMALL).select(*EVENT_MESSAGE_SCHEMA.fieldNames())
    src = os.path.join(tmpdir_path, "raw")
    _write_json_batches(t, src, 2)
    with open(os.path.join(src, "part-poison.json"), "w") as fh:
        fh.write("{not json\n")
        fh.write(json.dumps({"TransactionID": 1, "TransactionDT": 5, "TransactionAmt": -3.0,
                             "card1": 1}) + "\n")
    out = os.path.join(tmpdir_path, "out")
    raw = J.transaction_source(spark, EVENT_MESSAGE_SCHEMA, path=src)
    q = J.score_stream(raw, EVENT_MESSAGE_SCHEMA, out, os.path.join(tmpdir_path, "ck"))
    q.awaitTermination(300)
    dec = spark.read.parquet(os.path.join(out, "decisions"))
    assert dec.count() == t.count() + 0
    dead = spark.read.parquet(os.path.join(out, "dead_letter")).collect()
    reasons = sorted(r["failure_reason"] for r in dead)
    assert reasons == ["invalid: TransactionAmt", "malformed_json"]
    assert all(r["original_topic"] == "txn-events" for r in dead)


def test_dedup_batch_and_stream(spark):
    rows = [(1, 10, "a"), (1, 5, "b"), (2, 7, "c")]
    df = spark.createDataFrame(rows, "TransactionID long, TransactionDT long, v string") \
              .withColumn("ts", F.timestamp_seconds("TransactionDT"))
    got = {r["TransactionID"]: r["v"] for r in MO.dedup_transactions(df).collect()}
    assert got == {1: "b", 2: "c"}


def test_knn_matches_brute_force(spark):
    e = V.read(spark, SF_MED, "embeddings").where("label = 3")
    got = {(r[0], r[2]): r[1] for r in
           ML.knn_within(e, "vec_id", "embedding", 5, block_rows=20).collect()}
    pdf = e.toPandas()
    X = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
    ids = pdf["vec_id"].to_numpy()
    for i, qid in enumerate(ids):
        d = np.sqrt(((X - X[i]) ** 2).sum(axis=1))
        order = sorted((d[j], ids[j]) for j in range(len(ids)) if j != i)[:5]
        for rank, (_, nid) in enumerate(order, start=1):
            assert got[(qid, rank)] == nid


def test_knn_with_equal_vectors_keeps_k_per_cell(spark):
    df = spark.range(600).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    out = ML.knn_within(df, "id", "v", 3, block_rows=200).collect()
    assert len(out) == 1800 and all(r["distance"] == 0.0 for r in out)
    assert sorted(r["neighbor_id"] for r in out if r["vec_id"] == 50) == [0, 1, 2]


def test_oversample_invariants(spark):
    e = V.read(spark, SF_MED, "embeddings").select(
        "vec_id", "embedding", (F.col("label") == 0).cast("int").alias("y"))
    out = ML.oversample(e, "vec_id", "embedding", "y", minority=1, k=5, seed=7)
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts[0] == counts[1]
    syn = out.where("synthetic").limit(20).collect()
    base = {r["vec_id"]: np.array(r["embedding"]) for r in e.where("y = 1").collect()}
    nn = ML.knn_within(e.where("y = 1"), "vec_id", "embedding", 5)
    pairs = {(r[0], r[1]) for r in nn.collect()}
    for s in syn:
        v = np.array(s["vec"])
        ok = False
        for (a, b) in pairs:
            d = base[b] - base[a]
            u = np.dot(v - base[a], d) / max(np.dot(d, d), 1e-30)
            if -1e-5 <= u <= 1 + 1e-5 and np.allclose(base[a] + u * d, v, atol=1e-5):
                ok = True
                break
        assert ok
    balanced = e.withColumn("y", (F.col("vec_id") % 2).cast("int"))
    assert ML.oversample(balanced, "vec_id", "embedding", "y").where("synthetic").count() == 0


def test_csv_sources_and_json(spark, tmpdir_path):
    with pytest.raises(FileNotFoundError):
        IO.read_transactions_csv(spark, os.path.join(tmpdir_path, "missing.csv"))
    assert IO.read_optional_csv(spark, os.path.join(tmpdir_path, "missing.csv")) is None
    t = V.txn_orders(spark, SF_SMALL)
    p = os.path.join(tmpdir_path, "orders_csv")
    IO.write_csv(t, p)
    back = IO.read_transactions_csv(spark, p)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, t.collect()))
    enc = IO.encode_json(t.select("TransactionID", "card4"))
    assert enc.where(F.col("value").contains("null")).count() == 0
    paths = IO.write_splits(t.limit(5), t.limit(3), os.path.join(tmpdir_path, "splits"))
    assert spark.read.parquet(paths["train"]).count() == 5


def test_model_bundle_roundtrip_and_calibration(spark, tmpdir_path):
    from fraudlens.operators import pipeline as P
    t = V.txn_orders(spark, SF_SMALL)
    X, cols = P.build_feature_matrix(t)
    models, long = ML.train_candidates(X, X, cols, names=["gradient_boosted_trees"],
                                       params={"gradient_boosted_trees": {"maxIter": 5}})
    m = models["gradient_boosted_trees"]
    ML.save_bundle(m, cols, {"model_name": "gbt", "version": "1"}, tmpdir_path)
    m2, meta = ML.load_bundle(tmpdir_path, "gradient_boosted_trees")
    assert meta["feature_cols"] == cols and meta["model_name"] == "gbt"
    s = ML.positive_probability(m2, ML.prepare(X, cols)).select(
        F.col("label").alias("y"), "p")
    cal = ML.apply_calibration(ML.platt_calibrate(s), s)
    assert cal.where("p_calibrated < 0 OR p_calibrated > 1").count() == 0
    assert len(ML.feature_importances(m, cols)) > 0
    with pytest.raises(FileNotFoundError):
        ML.load_bundle(os.path.join(tmpdir_path, "nope"), "random_forest")


def test_eda_reports(spark, tmpdir_path):
    from fraudlens.operators import eda
    paths = eda.write_reports(V.txn_orders(spark, SF_SMALL), tmpdir_path)
    assert {"summary", "fraud_rate", "class_counts", "missing_top20",
            "log_amount_hist_80"} <= set(paths)
    hist = spark.read.json(paths["log_amount_hist_80"])
    assert hist.agg(F.sum("n")).first()[0] == V.txn_orders(spark, SF_SMALL).count()


def test_stateful_scoring_stream_matches_batch_windows(spark, tmpdir_path):
    from fraudlens.operators import aggregations as A
    from fraudlens.operators import pipeline as P
    t = V.txn_events(spark, SF_SMALL).withColumns(V.location_columns())
    cols = ["TransactionID", "TransactionDT", "TransactionAmt", "ProductCD", "card1", "failed",
            "P_emaildomain", "R_emaildomain", "lat", "lon", "home_country", "txn_country"]
    src = os.path.join(tmpdir_path, "in")
    _write_json_batches(t.select(*cols), src, 3)
    schema = t.select(*cols).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(src)
    stats = A.card_stats(P.row_features(t), median="none")
    decided = J.decide_stream(stream, R.load_rules(), stats)
    out = os.path.join(tmpdir_path, "out")
    q = J.write_decisions(decided, out, os.path.join(tmpdir_path, "ck"))
    q.awaitTermination(300)
    got = spark.read.parquet(os.path.join(out, "predictions"))
    assert got.count() == t.count()
    # the state-derived inputs equal the batch windows on in-order data
    q2 = (J.stateful_features(stream, stats).writeStream.format("memory")
          .queryName("state_feats").option("checkpointLocation",
                                            os.path.join(tmpdir_path, "ck2"))
          .trigger(availableNow=True).start())
    q2.awaitTermination(300)
    names = ["TransactionID", "card_txn_rank", "card_prev_dt", *W.VELOCITY_WINDOWS,
             *W.FAILED_WINDOWS, "first_international", "impossible_travel"]
    s = sorted(tuple(r) for r in spark.sql("SELECT * FROM state_feats").select(*names).collect())
    cards = V.card_countries(spark, SF_SMALL)
    b = W.velocity_counts(W.sequence_and_geo(t, cards, strategy="direct"), strategy="direct")
    e = sorted(tuple(r) for r in b.select(*names).collect())
    assert s == e


def _brute_shapley(table, x, feats):
    import itertools
    import math as m

    def value(S):
        tot = 0.0
        for tw, leaves in zip(table["weights"], table["trees"]):
            for v, path in leaves:
                p = 1.0
                for f, thr, left, frac in path:
                    if f in S:
                        p *= float((x[f] <= thr) if left else not (x[f] <= thr))
                    else:
                        p *= frac
                tot += tw * v * p
        return tot
    M = len(feats)
    phi = {}
    for j in feats:
        others = [f for f in feats if f != j]
        acc = 0.0
        for r in range(M):
            for S in itertools.combinations(others, r):
                w = m.factorial(r) * m.factorial(M - r - 1) / m.factorial(M)
                acc += w * (value(set(S) | {j}) - value(set(S)))
        phi[j] = acc
    return phi


@pytest.mark.parametrize("kind", ["random_forest", "gradient_boosted_trees"])
def test_tree_shap_additive_and_exact(spark, kind):
    from pyspark.ml.functions import vector_to_array
    from fraudlens.operators import pipeline as P
    from fraudlens.operators import treeshap as TS
    t = V.txn_orders(spark, SF_SMALL)
    X, cols = P.build_feature_matrix(t)
    params = {"random_forest": {"numTrees": 4, "maxDepth": 3},
              "gradient_boosted_trees": {"maxIter": 4, "maxDepth": 3}}
    models, _ = ML.train_candidates(X, X, cols, names=[kind], params=params)
    m = models[kind]
    table = TS.ensemble_table(m)
    pred = m.transform(ML.prepare(X, cols))
    out = "probability" if kind == "random_forest" else "rawPrediction"
    rows = pred.select(vector_to_array("features").alias("x"),
                       vector_to_array(out)[1].alias("y")).limit(40).collect()
    Xn = np.array([r["x"] for r in rows], dtype=float)
    phi, base = TS.shap_values(table, Xn, len(cols))
    margin = TS.predict_margin(table, Xn)
    assert np.allclose(base + phi.sum(axis=1), margin, atol=1e-9)
    assert np.allclose(margin, [r["y"] for r in rows], atol=1e-9)
    used = sorted({f for leaves in table["trees"] for _, p in leaves for f, _, _, _ in p})
    for i in range(3):
        bf = _brute_shapley(table, Xn[i], used)
        for f in used:
            assert abs(bf[f] - phi[i, f]) < 1e-9
    ex = TS.explain(m, ML.prepare(X, cols), cols, top_n=5)
    assert ex.where("rank = 1").count() == X.count()


def test_ml_jobs_are_whole_by_default(spark, tmpdir_path):
    """500 rounds in the library, 30 trials; training searches and explains."""
    import inspect
    from fraudlens.plans import q_ml
    default = lambda f, name: inspect.signature(f).parameters[name].default
    assert ML.CANDIDATES["gradient_boosted_trees"]["maxIter"] == 500
    assert default(q_ml.m07_candidate_models, "boost_rounds") == q_ml.BOOST_ROUNDS
    assert default(q_ml.m26_training_pipeline, "boost_rounds") == q_ml.BOOST_ROUNDS
    assert default(q_ml.m26_training_pipeline, "n_trials") == 30
    assert default(q_ml.m12_random_search, "n_trials") == 30
    assert default(q_ml.m12_random_search, "space") is None
    kind = "gradient_boosted_trees"
    out = ML.run_training(V.txn_orders(spark, SF_SMALL), tmpdir_path, names=[kind],
                          params={kind: {"maxIter": 2, "maxDepth": 2}}, oversampled=False, n_trials=2,
                          search_space={"maxIter": [1, 2], "stepSize": [0.1], "maxDepth": [2]})
    assert {r.stage for r in out.collect()} == {"selection", "search", "final"}
    report = lambda name: spark.read.json(f"{tmpdir_path}/reports/{name}")
    assert report("search").count() == 2 and report("local_explanations").count() > 0
    assert 0 < report("dependence").select("feature").distinct().count() <= 5
    assert 0 < report("global_importance").count() <= 30


def test_stream_dedup_within_watermark(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "dup")
    os.makedirs(src)
    rows = [{"TransactionID": 1, "ts": "2024-01-01T00:00:00Z", "v": "a"},
            {"TransactionID": 1, "ts": "2024-01-01T00:00:05Z", "v": "b"},
            {"TransactionID": 2, "ts": "2024-01-01T00:00:07Z", "v": "c"}]
    with open(os.path.join(src, "part-0.json"), "w") as fh:
        fh.write("\n".join(json.dumps(r) for r in rows) + "\n")
    s = spark.readStream.schema("TransactionID long, ts timestamp, v string").json(src)
    q = (MO.dedup_transactions(s).writeStream.format("memory").queryName("dedup_out")
         .option("checkpointLocation", os.path.join(tmpdir_path, "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = sorted(r[0] for r in spark.sql("SELECT TransactionID FROM dedup_out").collect())
    assert got == [1, 2]


def test_late_rows_flagged(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "late")
    os.makedirs(src)
    batches = [[(1, 5000, 10.0), (2, 6000, 11.0)], [(3, 5200, 12.0), (4, 6500, 9.0)]]
    for n, b in enumerate(batches):
        path = os.path.join(src, f"part-{n}.json")
        with open(path, "w") as fh:
            fh.write("\n".join(json.dumps({"TransactionID": i, "TransactionDT": t,
                                           "TransactionAmt": a, "card1": 7, "failed": False})
                               for i, t, a in b) + "\n")
        os.utime(path, (1_600_000_000 + n, 1_600_000_000 + n))
    schema = "TransactionID long, TransactionDT long, TransactionAmt double, card1 long, " \
             "failed boolean"
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(src)
    q = (J.stateful_features(s).writeStream.format("memory").queryName("late_out")
         .option("checkpointLocation", os.path.join(tmpdir_path, "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    late = {r[0]: r[1] for r in spark.sql("SELECT TransactionID, is_late FROM late_out").collect()}
    assert late == {1: False, 2: False, 3: True, 4: False}


SIMPLE = "TransactionID long, TransactionDT long, TransactionAmt double, card1 long, failed boolean"


def _messages(path, batches):
    os.makedirs(path)
    for n, batch in enumerate(batches):
        file = os.path.join(path, f"part-{n}.json")
        with open(file, "w") as fh:
            for i, dt, amt, card in batch:
                row = {"TransactionID": i, "TransactionDT": dt, "TransactionAmt": amt, "ProductCD": "W"}
                fh.write(json.dumps(row | ({} if card is None else {"card1": card})) + "\n")
        os.utime(file, (1_600_000_000 + n, 1_600_000_000 + n))


def _run_scored(spark, folder, batches):
    _messages(os.path.join(folder, "in"), batches)
    raw = J.transaction_source(spark, EVENT_MESSAGE_SCHEMA, path=os.path.join(folder, "in"))
    J.score_stream(raw, EVENT_MESSAGE_SCHEMA, os.path.join(folder, "out"),
                   os.path.join(folder, "ck")).awaitTermination(300)
    rows = spark.read.parquet(os.path.join(folder, "out", "decisions")).collect()
    return {r["key"]: {k: v for k, v in json.loads(r["value"]).items()} for r in rows}


def test_decisions_do_not_depend_on_batches(spark, tmpdir_path):
    """A burst of one card and rows without a card, in one, two and four batches,
    with a repeated id: the same decisions, and rows without a card are no burst."""
    rows = [(i, 1000 + 5 * i, 20.0 + i, 7) for i in range(12)]
    rows += [(100 + i, 1000 + 5 * i, 30.0, None) for i in range(12)]
    rows.sort(key=lambda r: r[1])
    outs = []
    for n in (1, 2, 4):
        per = len(rows) // n
        batches = [rows[k:k + per] for k in range(0, len(rows), per)]
        batches[-1] = batches[-1] + [rows[0], rows[-2]]
        outs.append(_run_scored(spark, os.path.join(tmpdir_path, f"n{n}"), batches))
    assert outs[0] == outs[1] == outs[2] and len(outs[0]) == 24
    hits = {k: v["triggered_rules"] for k, v in outs[0].items()}
    assert hits["11"] and not any(v for k, v in hits.items() if int(k) >= 100)


def _state_rows(spark, folder, batches, name):
    _messages(os.path.join(folder, "in"), batches)
    s = spark.readStream.schema(SIMPLE).option("maxFilesPerTrigger", 1).json(os.path.join(folder, "in"))
    (J.with_card_state(s).writeStream.format("memory").queryName(name)
     .option("checkpointLocation", os.path.join(folder, "ck")).trigger(availableNow=True).start()
     .awaitTermination(120))
    return {r["TransactionID"]: r for r in spark.sql(f"SELECT * FROM {name}").collect()}


def test_late_and_far_future_events_keep_the_state(spark, tmpdir_path):
    late = _state_rows(spark, os.path.join(tmpdir_path, "a"), [
        [(1, 10_000, 1.0, 7)], [(2, 5_000, 1.0, 7)], [(3, 10_010, 1.0, 7)]], "late_state")
    assert [late[i]["time_since_last_txn"] for i in (1, 2, 3)] == [-1, -1, 10]
    assert late[3]["card_txn_count_1min"] == 2
    far = _state_rows(spark, os.path.join(tmpdir_path, "b"), [
        [(1, 10_000, 1.0, 7), (2, 10_010, 1.0, 7)], [(3, 10 ** 9, 1.0, 7)],
        [(4, 10_020, 1.0, 7)], [(5, 10_030, 1.0, 7)]], "far_state")
    assert [far[i]["card_txn_count_1min"] for i in (1, 2, 3, 4, 5)] == [1, 2, 1, 3, 4]
    assert [far[i]["time_since_last_txn"] for i in (4, 5)] == [10, 10]


def test_rules_are_read_for_every_batch(spark, tmpdir_path):
    calls = []

    def rules():
        calls.append(1)
        return R.load_rules()
    _messages(os.path.join(tmpdir_path, "in"), [[(1, 10, 5.0, 1)], [(2, 20, 5.0, 1)]])
    raw = J.transaction_source(spark, EVENT_MESSAGE_SCHEMA, path=os.path.join(tmpdir_path, "in"))
    J.score_stream(raw, EVENT_MESSAGE_SCHEMA, os.path.join(tmpdir_path, "out"),
                   os.path.join(tmpdir_path, "ck"), rules=rules).awaitTermination(120)
    assert len(calls) == 2
