"""Windows, decomposition, labels, folds and streaming: invariants and brute-force checks."""

import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from wattloom.functions.wavelet import analyse, max_level, smooth, smoothing_matrix, synthesise
from wattloom.operators import clean as C
from wattloom.operators import folds as FO
from wattloom.operators import labels as L
from wattloom.operators import metrics as M
from wattloom.operators import models as MD
from wattloom.operators import splitting as S
from wattloom.operators import windows as WN
from wattloom.params import Params
from wattloom.streaming import operators as SO
from wattloom.streaming.runner import run_available

P = Params(backcast=40, forecast=8, stride=8, block_strides=7, min_len=50, order_span_seconds=40 * 3600)


def make_series(lengths, seed=0):
    rng = np.random.default_rng(seed)
    parts = []
    for i, n in enumerate(lengths):
        parts.append(pd.DataFrame({
            "grp": "g", "building": f"b{i}", "ts": pd.date_range("2024-01-01", periods=n, freq="h"),
            "energy": rng.gamma(2.0, 10.0, n),
        }))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def pdf():
    return make_series([300, 47, 48, 49, 171])


@pytest.fixture(scope="module")
def series(spark, pdf):
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return C.index_series(df, p=P).cache()


def brute(pdf, p=P):
    """Windows, labels and fused labels by plain loops."""
    wins, fused = {}, {}
    m = smoothing_matrix(p.window, p.wavelet_level)
    for b, g in pdf.groupby("building"):
        x = g.energy.to_numpy()
        votes, cover = np.zeros(len(x), int), np.zeros(len(x), int)
        for s in range(0, len(x) - p.window + 1, p.stride):
            w = x[s:s + p.window]
            res = np.round(w - m @ w, 9)
            lo, hi = np.quantile(res, [p.q_low, p.q_high])
            lab = (res < lo) | (res > hi)
            wins[b, s] = (w, m @ w, lab)
            votes[s:s + p.window] += lab
            cover[s:s + p.window] += 1
        for t in np.flatnonzero(cover):
            fused[b, t] = (votes[t], cover[t])
    return wins, fused


def test_windows_match_brute_force(series, pdf):
    wins, _ = brute(pdf)
    got = {(r.building, r.start): r for r in L.label_windows(WN.decompose(WN.make_windows(series, P), P), P).collect()}
    assert set(got) == set(wins)
    for key, (x, trend, lab) in wins.items():
        r = got[key]
        assert np.allclose(r.x, x) and np.allclose(r.trend, trend)
        assert np.allclose(np.array(r.trend) + np.array(r.season), x)
        assert (np.array(r.labels) == lab).all()


@pytest.mark.parametrize("rule", ["any", "majority"])
def test_fusion_paths_agree(series, pdf, rule):
    p = P.with_(merge_rule=rule)
    _, fused = brute(pdf)
    for df in (L.label_fused(series, p), L.fuse(L.label_series(series, p), p)):
        got = {(r.building, r.t): (r.votes, r.cover, r.anomaly) for r in df.collect()}
        assert set(got) == set(fused)
        for key, (v, c) in fused.items():
            assert got[key] == (v, c, int(v > 0 if rule == "any" else v / c > 0.5))


def test_fusion_of_any_windows(spark):
    """Windows of several lengths, in any order, twice, with gaps, over many cells and of null keys."""
    p = P.with_(merge_rule="majority")
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for key in (("g", "b0"), ("g", None), (None, "b0"), ("h", "b0")):
        starts = rng.choice(np.arange(0, 900), 40, replace=False).tolist()
        for start in [*starts, starts[0]]:
            x = [None if v < 0.02 else start + i for i, v in enumerate(rng.random(int(rng.integers(0, 150))).tolist())]
            if start == starts[0]:
                x = [1.5] * 150  # twice, so both are alike
            labels = [int(v < 0.6) for v in rng.random(len(x))]
            rows.append((*key, int(start // p.block), start, [None if v is None else float(v) for v in x], labels))
            for i, (v, m) in enumerate(zip(rows[-1][4], labels)):
                votes, cover, first = want.get((*key, start + i), (0, 0, (10**9, None)))
                want[(*key, start + i)] = (votes + m, cover + 1, (start, v) if start < first[0] else first)
    rng.shuffle(rows)
    made = spark.createDataFrame(rows, "grp string, building string, blk long, start long, x array<double>, labels array<tinyint>")
    out = L.fuse(made, p)
    assert out.dtypes == [("grp", "string"), ("building", "string"), ("t", "bigint"), ("energy", "double"), ("votes", "bigint"), ("cover", "bigint"), ("anomaly", "int")]
    got = out.collect()
    assert len(got) == len(want)
    assert {(r.grp, r.building, r.t): (r.votes, r.cover, r.energy, r.anomaly) for r in got} == {
        k: (v, c, first[1], int(v / c > 0.5)) for k, (v, c, first) in want.items()
    }


def test_fusion_shuffles_windows_not_steps(series):
    """lab_fuse_majority: no step is a row before all its votes are counted, and a window goes through Python once."""
    fused = L.fuse(L.label_series(series, P), P.with_(merge_rule="majority")).select("grp", "building", "t", "anomaly")
    plan = fused._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    above = plan[: plan.index("posexplode")]
    assert "Exchange" not in above and "Aggregate" not in above
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("ArrowEvalPython") == 2


def test_labels_of_one_pass_are_those_of_two(series):
    one = L.label_series(series, P)
    two = L.label_windows(WN.decompose(WN.make_windows(series, P), P), P)
    assert one.dtypes == two.dtypes
    got, want = ({(r.building, r.start): r for r in df.collect()} for df in (one, two))
    assert got.keys() == want.keys()
    for key, r in got.items():
        w = want[key]
        assert (r.n, r.blk, r.labels, r.x) == (w.n, w.blk, w.labels, w.x)
        assert np.allclose([*r.trend, *r.season, r.q_lo, r.q_hi], [*w.trend, *w.season, w.q_lo, w.q_hi], rtol=0, atol=1e-9)


def test_majority_within_any(series):
    rows = L.label_fused(series, P).collect()
    assert all(r.votes > 0 for r in rows if r.votes / r.cover > 0.5)


def test_odd_stride_window_grid(spark):
    """Window length that is no multiple of the stride."""
    p = P.with_(backcast=30, forecast=7, stride=5)
    pdf = make_series([210, 37, 36], seed=3)
    s = C.index_series(spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")), p=p)
    wins, fused = brute(pdf, p)
    assert {(r.building, r.start) for r in WN.make_windows(s, p).collect()} == set(wins)
    assert {(r.building, r.t): (r.votes, r.cover) for r in L.label_fused(s, p).collect()} == fused


def test_reproject_lines_up(series):
    fused = L.label_fused(series, P)
    lengths = fused.groupBy("grp", "building").agg((F.max("t") + 1).alias("n"))
    marks = {(r.building, r.t): r.anomaly for r in fused.collect()}
    for r in L.reproject(fused, lengths, P).collect():
        assert list(r.labels_fused) == [marks[r.building, r.start + i] for i in range(P.window)]


def test_window_depends_on_its_own_rows_only():
    rng = np.random.default_rng(1)
    x = rng.random(300)
    y = x.copy()
    y[:50] += 100
    m = smoothing_matrix(96, 5)
    assert np.allclose(m @ x[100:196], m @ y[100:196])


def test_smoother_facts():
    assert max_level(192) == max_level(168) == 4
    m = smoothing_matrix(192, 5)
    assert np.allclose(m.sum(axis=1), 1) and np.linalg.matrix_rank(m) == 18
    assert np.allclose(smooth(np.full(77, 3.0), 3), 3.0)
    assert analyse(np.zeros(77)).shape == (42,) and synthesise(np.zeros(42), 77).shape == (77,)


@pytest.mark.parametrize("n", [300, 1000, 1501, 2049])
def test_series_wavelet_in_blocks_equals_whole(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=n).cumsum()
    df = spark.createDataFrame(pd.DataFrame({"grp": "g", "building": "b", "t": range(n), "energy": x}))
    got = {r.t: r.trend for r in WN.series_wavelet(df, level=3, block=128).collect()}
    whole = smooth(x, 3)
    assert len(got) == n and max(abs(got[t] - whole[t]) for t in range(n)) < 1e-9


def test_additive_trend(spark):
    n, period = 130, 24
    t = np.arange(n)
    x = 2.0 * t + 5 + np.sin(2 * np.pi * t / period)
    df = spark.createDataFrame(pd.DataFrame({"grp": "g", "building": "b", "t": t, "n": n, "energy": x}))
    got = {r.t: r.trend for r in WN.series_additive(df, block=48).collect()}
    assert len(got) == n and max(abs(got[i] - (2.0 * i + 5)) for i in range(n)) < 1e-6


def test_no_window_crosses_its_split(series):
    parts = S.temporal(series, P.with_(train_frac=0.6))
    for split in ("train", "test"):
        part = parts.where(F.col("split") == split)
        ends = {r.building: r.n for r in part.select("building", "n").distinct().collect()}
        for r in WN.make_windows(part, P).collect():
            assert r.start + P.window <= ends[r.building]


def test_fold_invariants(series):
    wins = WN.make_windows(series, P).select("grp", "building", "n", "start")
    rows = FO.rolling_origin(wins, P.with_(val_horizon=8)).collect()
    train = {(r.fold, r.building, r.start) for r in rows if r.role == "train"}
    val = {(r.fold, r.building, r.start) for r in rows if r.role == "val"}
    assert train and val and not train & val
    assert all(r.start >= r.cutoff - P.backcast for r in rows if r.role == "val")
    assert all(r.start + P.window <= r.cutoff for r in rows if r.role == "train")


def test_unusable_folds_are_an_error(series):
    counts = FO.fold_counts(FO.rolling_origin(WN.make_windows(series, P).where("start < 0"), P))
    with pytest.raises(ValueError):
        FO.require_folds(counts)


def test_hold_out_sides(series):
    wins = WN.make_windows(series, P).select("grp", "building", "n", "start")
    tail = FO.hold_out(wins, P).collect()
    assert all(r.in_train != r.in_val for r in tail)
    per = {}
    for r in tail:
        per.setdefault(r.building, []).append(r)
    for rows in per.values():
        assert sum(r.in_val for r in rows) == max(1, int(len(rows) * P.val_frac))
        assert max([r.start for r in rows if r.in_train], default=-1) < min(r.start for r in rows if r.in_val)
    assert all(r.in_train == r.in_val for r in FO.hold_out(wins, P, "head").collect())


def test_split_fixed_short_series(spark):
    df = spark.createDataFrame([("g", "b", i, 9) for i in range(9)], "grp string, building string, t long, n long")
    rows = S.fixed(df, 6, 4).collect()
    count = lambda s: sum(r.split == s for r in rows)
    assert (count("train"), count("val"), count("test")) == (4, 5, 5)


def test_least_squares_recovers_coefficients(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = x @ np.array([[1.0, 0.5], [-2.0, 0.0], [0.25, 3.0]]) + np.array([4.0, -1.0])
    df = spark.createDataFrame(pd.DataFrame({"k": [i % 2 for i in range(400)], "x": list(x), "y": list(y)}), "k long, x array<double>, y array<double>")
    for m in MD.coefficient_matrices(MD.fit(df, "k", "x", "y", ridge=0.0)).values():
        assert np.allclose(m, [[4, -1], [1, 0.5], [-2, 0], [0.25, 3]], atol=1e-8)


def test_federated_average_weights_by_examples(spark):
    df = spark.createDataFrame([(1, 10, 0, [1.0, 2.0]), (2, 30, 0, [3.0, 6.0])], "key long, n long, horizon int, coef array<double>")
    assert sorted((r.param, r.value) for r in MD.federated_average(df).collect()) == [(0, 2.5), (1, 5.0)]


def test_auroc_edges(spark):
    one = spark.createDataFrame([(1, 0.2), (1, 0.7)], "y_true int, y_prob double")
    assert M.auroc(one).first().auroc is None
    ties = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y_true int, y_prob double")
    assert M.auroc(ties).first().auroc == 0.5
    perfect = spark.createDataFrame([(1, 0.9), (0, 0.1), (0, 0.2)], "y_true int, y_prob double")
    assert M.auroc(perfect).first().auroc == 1.0


def test_confusion_threshold_is_inclusive_or_not(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.4)], "y_true int, y_prob double")
    assert M.confusion(df).first().tp == 1 and M.confusion(df, inclusive=False).first().fn == 1
    zero = M.classification(M.confusion(df.where("y_true = 0"))).first()
    assert zero.precision == 0 and zero.recall == 0 and zero.f1 == 0


@pytest.mark.parametrize("cuts, per_batch, displaced", [(1, 1, 0), (4, 1, 0), (4, 2, 20), (9, 1, 23), (9, 3, 23)])
def test_stream_does_not_depend_on_micro_batches(spark, pdf, tmp_path, cuts, per_batch, displaced):
    """Shuffled files, rows that come up to ``displaced`` hours late, repeated and far too late rows."""
    src = tmp_path / "in"
    src.mkdir()
    pdf = pdf[pdf.building.isin(["b0", "b4"])].copy()
    hour = pdf.groupby("building").cumcount()
    sent = hour + np.random.default_rng(cuts).integers(0, displaced + 1, len(pdf))
    size = -(-(300 + displaced) // cuts)
    beat = pd.DataFrame({"building": [None], "ts": [pdf.ts.max() + pd.Timedelta("30D")], "energy": [None]}).astype({"energy": float, "building": object})
    for i in range(cuts + 1):
        part = pdf[sent // size == i].sample(frac=1, random_state=i)
        part = pd.concat([part, part.head(3).assign(energy=1e6)])  # of one time the least stays
        if cuts == 4 and i == 3:  # the stream is at hour 224 at least, a day before that is released
            part = pd.concat([part, pdf[(pdf.building == "b0") & (hour == 2 * size - 30)].assign(energy=-1e6)])
        if i == cuts:
            part = beat
        path = src / f"p{i}.parquet"
        kinds = pa.schema([("building", pa.string()), ("ts", pa.timestamp("us")), ("energy", pa.float64())])
        pq.write_table(pa.Table.from_pandas(part[kinds.names].assign(ts=part.ts.astype("datetime64[us]")), kinds, preserve_index=False), path)
        os.utime(path, (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    schema = "building string, ts timestamp_ntz, energy double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(str(src))
    out = run_available(SO.label_windows(stream, P, "1 day"), "stream-test").collect()
    wins, _ = brute(pdf)
    got = {(r.building, r.start): r for r in out}
    assert set(got) == set(wins) and len(out) == len(wins)
    for key, (x, _, lab) in wins.items():
        assert np.allclose(got[key].x, x) and (np.array(got[key].labels) == lab).all()
    assert max(r.late_rows for r in out if r.building == "b0") == (1 if (cuts, per_batch) == (4, 1) else 0 if cuts != 4 else max(r.late_rows for r in out))


def test_reprojected_labels_need_one_pass(spark, series):
    """The same windows as from fused labels cut back, and no second shuffle of the rows."""
    one = L.label_reprojected(series, P)
    two = L.reproject(L.label_fused(series, P), p=P)
    pick = lambda df: sorted((r.building, r.start, tuple(np.round(r.x, 6)), tuple(r.labels_fused)) for r in df.collect())
    assert pick(one) == pick(two) and one.count() > 40


@pytest.mark.parametrize("at_once", [1, 3, 2048])
def test_block_kernel_does_not_depend_on_its_slices(spark, at_once):
    from wattloom.functions.arrays import block_kernel, remainder_score

    rng = np.random.default_rng(3)
    pieces = [rng.gamma(2.0, 10.0, n).tolist() for n in (48, 47, 130, 0, 300)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(pieces)], "k int, x array<double>").coalesce(1)
    smoother = smoothing_matrix(P.window, P.wavelet_level)
    run = block_kernel(P.window, P.stride, P.wavelet_level, P.q_low, P.q_high, score=remainder_score, backcast=P.backcast, at_once=at_once)
    for r in df.select("k", "x", run(F.col("x")).alias("v")).select("k", "x", "v.*").collect():
        votes, cover, prob, probs = (np.zeros(len(r.x)) for _ in range(4))
        for at in range(0, len(r.x) - P.window + 1, P.stride):
            x = np.array(r.x[at : at + P.window])
            trend = smoother @ x
            resid = np.round(x - trend, 9)
            lo, hi = np.quantile(resid, [P.q_low, P.q_high])
            votes[at : at + P.window] += (resid < lo) | (resid > hi)
            cover[at : at + P.window] += 1
            prob[at + P.backcast : at + P.window] += remainder_score(trend[None], (x - trend)[None], P.backcast)[0]
            probs[at + P.backcast : at + P.window] += 1
        assert r.votes == votes.tolist() and r.cover == cover.tolist() and r.probs == probs.tolist() and np.allclose(r.prob, prob)


@pytest.mark.parametrize("options", [{"rate": 0.05, "local_steps": 3}, {"proximal": 0.5}])
def test_federated_rounds_equal_plain_averaging(spark, options):
    rng = np.random.default_rng(1)
    clients = {}
    for k, n in ((1, 30), (2, 80), (5, 45)):
        x = rng.normal(size=(n, 2)) + k / 3
        clients[k] = (x, x @ np.array([[1.0, -0.5], [0.5, 2.0]]) + k + rng.normal(size=(n, 2)) * 0.1)
    rows = [(k, a.tolist(), b.tolist()) for k, (x, y) in clients.items() for a, b in zip(x, y)]
    losses, params = MD.federated_rounds(spark.createDataFrame(rows, "k long, x array<double>, y array<double>"), "k", "x", "y", 4, **options)
    w, total = np.zeros((3, 2)), sum(len(x) for x, _ in clients.values())
    want = []
    for _ in range(5):
        ones = {k: (np.hstack([np.ones((len(x), 1)), x]), y) for k, (x, y) in clients.items()}
        want.append((sum(((x @ w - y) ** 2).sum() for x, y in ones.values()) / total / 2, w))
        new = np.zeros_like(w)
        for x, y in ones.values():
            a, b, v = x.T @ x / len(x), x.T @ y / len(x), w
            if "proximal" in options:
                v = np.linalg.solve(2 * a + 0.5 * np.eye(3), 2 * b + 0.5 * w)
            else:
                for _ in range(3):
                    v = v - 0.05 * 2 * (a @ v - b)
            new += v * len(x) / total
        w = new
    got = sorted((r.round, r.loss, r.clients, r.examples) for r in losses.collect())
    assert np.allclose([g[1] for g in got], [l for l, _ in want]) and {g[2:] for g in got} == {(3, total)}
    assert got[0][1] > got[1][1] > got[-1][1]
    last = {(r.param, r.horizon): r.value for r in params.where("round = 4").collect()}
    assert np.allclose([[last[i, j] for j in range(2)] for i in range(3)], want[4][1])


def test_array_functions_give_the_same_in_slices(monkeypatch):
    """A batch is worked on in slices of AT_ONCE windows; the last slice may be short."""
    from wattloom.functions import arrays as A

    rows = np.random.default_rng(5).normal(size=(11, 96))
    x = pa.array(rows.tolist(), pa.list_(pa.float64()))

    def outputs():
        parts = A.decomposer(96, 5).func(x)
        return [parts, A.labeler(96, 0.01, 0.99).func(x, parts.field("trend")), A.standardizer(96).func(x)]

    def flat(struct):
        return [v for k in range(struct.type.num_fields) for v in np.ravel(struct.field(k).to_pylist())]

    whole = outputs()
    monkeypatch.setattr(A, "AT_ONCE", 4)
    for a, b in zip(whole, outputs()):
        assert len(a) == 11 and np.allclose(flat(a), flat(b), rtol=0, atol=1e-9)


def test_classifier_is_fitted_on_written_points(spark, monkeypatch):
    """Counting, fitting and scoring do not cut and label the windows again."""
    import __spark_entry__ as entry

    class Seen(Exception):
        pass

    def stop(points, *_):
        raise Seen(points._jdf.queryExecution().executedPlan().toString())

    monkeypatch.setattr(MD, "fit_classifier", stop)
    with pytest.raises(Seen) as seen:
        entry.queries()["fit_classify"](spark, entry.SMOKE_DIR)
    assert "ArrowEvalPython" not in str(seen.value)
