"""Interval overlap, map data, dimensions, sampling and run logs on hand-made cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from wattloom.operators import dims as D
from wattloom.operators import eda as E
from wattloom.operators import geo as G
from wattloom.operators import history as H
from wattloom.operators import intervals as IV
from wattloom.operators import runlog as RL
from wattloom.operators import sampling as SA


def day(n):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=n)


def sweep(iv):
    """Constant-set segments by checking every boundary."""
    cuts = sorted({t for _, a, z in iv for t in (a, z)})
    out = []
    for a, z in zip(cuts, cuts[1:]):
        s = tuple(sorted({n for n, x, y in iv if x <= a and z <= y}))
        if s and out and out[-1][2] == s and out[-1][1] == a:
            out[-1] = (out[-1][0], z, s)
        elif s:
            out.append((a, z, s))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_segments_and_distinct_sets(spark, seed):
    rng = np.random.default_rng(seed)
    iv = [(f"d{i}", int(a), int(a + w)) for i, (a, w) in enumerate(zip(rng.integers(0, 300, 14), rng.integers(1, 120, 14)))]
    iv += [("touch", 10, 60), ("touch", 60, 90)]
    df = spark.createDataFrame([(n, day(a), day(z)) for n, a, z in iv], "alias string, start timestamp_ntz, end timestamp_ntz")
    seg = IV.segments(df).cache()
    want = sweep(iv)
    got = {(r.start, r.end): tuple(r.datasets) for r in seg.collect()}
    assert got == {(day(a), day(z)): s for a, z, s in want}
    ranked = sorted(want, key=lambda s: (-len(s[2]), -(s[1] - s[0]), s[0]))
    kept = []
    for s in ranked:
        if not any(set(s[2]) <= set(k[2]) for k in kept):
            kept.append(s)
    assert {(r.start, r.end) for r in IV.distinct_sets(seg).collect()} == {(day(a), day(z)) for a, z, _ in kept}
    top = IV.rank_overlaps(seg, df.where("alias <> 'touch'"), 3).orderBy("rank").collect()
    assert [(r.overlap_start, r.n_datasets) for r in top] == [(day(a), len(s)) for a, _, s in kept[:3]]


def test_geocode_first_place_wins_then_country(spark):
    rows = [("a", "Cambridge, USA", "USA"), ("b", "Nowhere", "deu "), ("c", "X", "ZZZ"), ("d", None, None)]
    out = {r.alias: (r.lat, r.lon) for r in G.geocode(spark.createDataFrame(rows, "alias string, location string, iso string")).collect()}
    assert out == {"a": (52.20, 0.12), "b": (51.1, 10.4), "c": (None, None), "d": (None, None)}


def test_fixed_dimensions_are_consistent(spark):
    sub, dev = D.subset_table(spark), D.device_table(spark)
    assert sub.count() == 67 and sub.where("present").count() == 59
    assert D.checks(sub, dev).count() == 0
    assert D.device_groups(sub, dev).count() == 59
    assert D.fix_alias(spark.createDataFrame([("REEDD",)], "alias string")).first().alias == "REED"


def test_preflight_flags_missing_splits(spark):
    items = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "train")], "grp string, split string")
    dev = spark.createDataFrame([(1, "a"), (2, "b")], "device int, grp string")
    bad = [(r.device, r.split) for r in D.preflight(items, dev).where("error").collect()]
    assert bad == [(2, "test")]


@pytest.mark.parametrize("n,k", [(10, 4), (7, 7), (3, 5), (100, 1), (101, 11)])
def test_even_sample(spark, n, k):
    df = spark.range(n).withColumn("total", F.lit(n).cast("long"))
    got = sorted(r.id for r in SA.evenly_spaced(df, "id", "total", k).collect())
    assert got == (list(range(n)) if n <= k else np.linspace(0, n - 1, k).astype(int).tolist())


def test_stratified_keeps_every_group_within_k(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 960, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 4)))
    rows = SA.stratified(df, "g", ["id"], 50, 1).collect()
    assert len(rows) == 50 and {r.g for r in rows} >= {"hot"} and len({r.id for r in rows}) == 50
    again = SA.stratified(df, "g", ["id"], 50, 1).collect()
    assert {r.id for r in rows} == {r.id for r in again}


def test_equalize_with_one_hot_source(spark):
    df = spark.range(500).withColumn("s", F.when(F.col("id") < 30, "small").otherwise("hot"))
    got = {r.s: r["count"] for r in SA.equalize(df, "s", ["id"], 9).groupBy("s").count().collect()}
    assert got == {"small": 30, "hot": 30}


def test_early_stop_against_a_loop(spark):
    rng = np.random.default_rng(4)
    loss = (np.exp(-np.arange(40) / 6) + rng.random(40) * 0.2).tolist()
    best, wait, want = float("inf"), 0, []
    for e, v in enumerate(loss):
        if v < best - 0.01:
            best, wait = v, 0
        else:
            best, wait = min(best, v), wait + 1
        want.append((e, wait))
        if wait >= 3:
            break
    df = spark.createDataFrame([("r", e, v) for e, v in enumerate(loss)], "run string, epoch int, loss double")
    got = H.early_stop(df, ["run"], "epoch", "loss", 3, 0.01, span=7).orderBy("epoch").collect()
    assert [(r.epoch, r.wait) for r in got] == want


def test_log_parsing(spark):
    text = [
        "# run", "  [recursos @ load] RSS=512.0MB | RAM_disp=9.5GB | load=1.0/0.5/0.2 | disco_livre=1.5TB | gpu=- | t+1h02m03s",
        "[step6:fit] ep 2/5 shard 10/40 | train=0.10 val=0.20 (2m00s, x)", "noise shard 3 gravado",
        "[step6:tune] fold 1/4 ep 3: train=0.1 val=0.2 (30.0s)", "[recursos @ bad] RSS=oops", "  last  ", "",
    ]
    lines = spark.createDataFrame([("l", i, x) for i, x in enumerate(text)], "log string, ord long, line string")
    s = RL.snapshots(lines).collect()
    assert len(s) == 1 and (s[0].context, s[0].rss_gb, s[0].ram_free_gb, s[0].disk_free_gb, s[0].elapsed_s) == ("load", 0.5, 9.5, 1536.0, 3723.0)
    e = RL.eta_epochs(RL.shard_progress(lines)).first()
    assert (e.stage, e.epoch, e.shard) == ("fit", 2, 10) and e.epoch_left_s == 360.0 and e.eta_s == 360.0 + 3 * 480.0
    f = RL.eta_folds(RL.fold_progress(lines)).first()
    assert (f.stage, f.closed_folds, f.eta_s) == ("tune", 0, 90.0)
    st = RL.status(lines).first()
    assert (st.lines, st.header_lines, st.finished, st.last_line) == (8, 1, False, "last")
    assert {(r.event, r.events) for r in RL.event_tail(lines).select("event", "events").distinct().collect()} == {("training", 2), ("shard_written", 1)}


def test_extrapolation_names_the_slowest(spark):
    s = spark.createDataFrame([("a", 10.0), ("b", 2.0), ("c", None)], "host string, units_per_min double")
    u = spark.createDataFrame([("a", 100), ("b", 50)], "host string, full_units long")
    hosts, total = RL.extrapolate(s, u, rounds=3, local_epochs=2)
    t = total.first()
    assert (t.straggler, t.t_round_s, t.t_total_s) == ("b", 3030.0, 9090.0) and hosts.count() == 3


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(i),) for i in range(41)] + [(None,)], "v double")
    rows = {r.bin: r["rows"] for r in E.histogram(df, "v").collect()}
    assert rows[39] == 2 and sum(rows.values()) == 41
    flat = E.histogram(spark.createDataFrame([(3.0,)] * 5, "v double"), "v").collect()
    assert [(r.bin, r["rows"]) for r in flat] == [(20, 5)]


def test_column_stats_ignore_non_finite(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,), (float("nan"),), (float("inf"),)], "v double")
    r = E.column_stats(df, ["v"]).first()
    assert (r.n, r.nulls, r["mean"], r["std"], r["min"], r["max"]) == (2, 2, 2.0, 1.0, 1.0, 3.0)


def test_stepwise_early_stop_against_a_loop(spark):
    rng = np.random.default_rng(6)
    runs = {f"r{k}": (np.exp(-np.arange(30) / 5) + rng.random(30) * 0.05).round(4).tolist() for k in range(5)} | {"near": [1.0, 0.995, 0.9875]}
    want = {}
    for run, loss in runs.items():
        best, wait = None, 0
        for e, v in enumerate(loss):
            better = best is None or v <= best - 0.01
            best, wait = (v, 0) if better else (best, wait + 1)
            want[run, e] = (best, better, wait)
            if wait >= 3:
                break
    df = spark.createDataFrame([(k, e, v) for k, x in runs.items() for e, v in enumerate(x)], "run string, epoch int, loss double")
    got = H.early_stop_stepwise(df, ["run"], "epoch", "loss", 3, 0.01).collect()
    assert {(r.run, r.epoch): (r.best, r.improved, r.wait) for r in got} == want
    assert want["near", 2] == (0.9875, True, 0)


def test_lines_stay_whole_and_logs_read_from_files_have_an_order(spark, tmp_path):
    from wattloom.sources import readers as R

    long = "x" * 300 + " shard gravado"
    snap = "[recursos @ c] RSS={}GB | RAM_disp=9GB | load=1/1/1 | disco_livre=5GB | gpu=- | t+{}s"
    (tmp_path / "run.log").write_text("\n".join([snap.format(k, 10 * k) for k in (1, 2, 3)] + [long]) + "\n")
    lines = R.read_log(spark, str(tmp_path)).withColumn("log", F.lit("run"))
    assert RL.status(lines).first().last_line == long
    assert [r.line for r in RL.event_tail(lines).where("event = 'shard_written'").collect()] == [long]
    snaps = RL.snapshots(lines)
    assert snaps.count() == 3
    growth = RL.rss_growth(snaps).first()
    assert growth.growing and growth.rss_delta == 2.0


def test_all_rows_without_a_sample_size_and_no_weight_without_a_value(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(30)], "g int, id int")
    assert SA.stratified(df, "g", ["id"], 0, 1).count() == 30
    m = spark.createDataFrame([(1, "m", 2.0, 10), (1, "m", None, 90)], "round int, metric string, value double, num_examples long")
    assert H.weighted_metrics(m).first().value == 2.0
