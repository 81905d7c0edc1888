"""Column roles, layouts, readers and resumable sinks on small files."""

from dataclasses import replace

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from wattloom.functions import scalars as SC
from wattloom.operators import clean
from wattloom.params import DEFAULT
from wattloom.sources import readers as R
from wattloom.sources import sinks as K
from wattloom.sources.roles import detect, detect_eda, layout


def schema(**cols):
    kinds = {"d": T.DoubleType(), "s": T.StringType(), "t": T.TimestampNTZType(), "l": T.LongType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in cols.items()])


def test_roles_take_the_preferred_name():
    r = detect(schema(id="l", bldg_id="s", Date="s", TimeStamp="t", KWH="d"))
    assert (r.time, r.id, r.value) == ("TimeStamp", "bldg_id", "KWH")
    assert detect(schema(when="t", load="d")).time == "when"


def test_layouts():
    assert layout(schema(timestamp="t", energy="d")).kind == "single"
    assert layout(schema(timestamp="t", meter="s", kwh="d")).kind == "long"
    wide = layout(schema(Timestamp="t", lig_S="d", hvac_N="d", note="s", __index_level_0__="l"))
    assert wide.kind == "wide" and wide.buildings == ("lig_S", "hvac_N") and wide.resolved
    lone = layout(schema(timestamp="t", house="s", measured="d"))
    assert lone.kind == "long" and lone.roles.value == "measured"
    unclear = layout(schema(timestamp="t", house="l", a="d", b="d"))
    assert unclear.kind == "wide" and not unclear.resolved and unclear.buildings == ("house", "a", "b")


def test_eda_roles_match_parts_and_fall_back():
    r = detect_eda(schema(**{"Timestamp UTC": "t", "meter_id": "s", "qty": "d"}))
    assert (r.time, r.id, r.value) == ("Timestamp UTC", "meter_id", "qty")


def test_tree_with_mixed_layouts_and_a_broken_file(spark, tmp_path):
    hours = pd.date_range("2024-01-01", periods=4, freq="h").astype("datetime64[us]")
    a, b = tmp_path / "Commercial" / "A b", tmp_path / "Residential" / "B+c"
    a.mkdir(parents=True)
    b.mkdir(parents=True)
    pd.DataFrame({"Timestamp": hours, "m1": [1.0, 2, 3, 4], "m2": [None, 1, 1, None]}).to_parquet(a / "wide.parquet")
    pd.DataFrame({"timestamp": hours, "energy": [5.0, 6, 7, 8]}).to_parquet(b / "house 7.parquet")
    pd.DataFrame({"meter_id": ["x/1"] * 4, "time": hours.astype(str), "kwh": ["1", "bad", "3", ""]}).to_csv(b / "long.csv", index=False)
    pd.DataFrame({"kwh": [9.0], "meter_id": ["y"]}).to_csv(b / "other_order.csv", index=False)
    (b / "broken.parquet").write_text("not a parquet file")
    rows = R.read_tree(spark, str(tmp_path)).groupBy("grp", "building").agg(
        F.count("*").alias("n"), F.count("energy").alias("f"), F.sum("energy").alias("e"), F.count("ts").alias("t")
    ).collect()
    got = {(r.grp, r.building): (r.n, r.f, r.e, r.t) for r in rows}
    assert got == {
        ("Commercial/A b", "m1"): (4, 4, 10.0, 4),
        ("Commercial/A b", "m2"): (4, 2, 2.0, 4),
        ("Residential/B+c", "house_7"): (4, 4, 26.0, 4),
        ("Residential/B+c", "x_1"): (4, 2, 4.0, 4),
        ("Residential/B+c", "y"): (1, 1, 9.0, 0),
    }


def test_inventory_reports_unreadable_files(spark, tmp_path):
    pd.DataFrame({"a": [1, 2]}).to_parquet(tmp_path / "ok.parquet")
    (tmp_path / "bad.parquet").write_text("x")
    rows = {r.path.rsplit("/", 1)[1]: r for r in R.footers(R.list_files(spark, str(tmp_path))).collect()}
    assert rows["ok.parquet"].n_rows == 2 and rows["ok.parquet"].n_row_groups == 1
    assert rows["bad.parquet"].n_rows is None and rows["bad.parquet"].error


def test_metadata_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text(
        'Type, Alias ,Start,End,No. of Buildings,No. of Obs,Location,iso\n'
        'Commercial,A,1/2/2012,12/23/24,"1,234",NA,"Cambridge, UK",GBR\n'
    )
    r = R.read_metadata(spark, str(tmp_path / "m.csv")).first()
    assert (r.alias, r.start.year, r.end.year, r.n_buildings, r.n_obs) == ("A", 2012, 2024, 1234.0, None)


def test_log_order_survives(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(f"line {i}" for i in range(500)))
    rows = R.read_log(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r.line for r in rows] == [f"line {i}" for i in range(500)]


@pytest.fixture
def parts(spark):
    return spark.createDataFrame([("train", "g1", 1), ("test", "g1", 2), ("train", "g2", 3)], "split string, grp string, v int")


def test_step_writes_each_group_once(spark, parts, tmp_path):
    out, done = str(tmp_path / "out"), str(tmp_path / "done")
    K.run_step(parts.where("grp = 'g1'"), "s", out, done)
    K.run_step(parts.withColumn("v", F.col("v") + 100), "s", out, done)
    K.run_step(parts, "s", out, done)
    assert sorted(r.v for r in spark.read.parquet(out).collect()) == [1, 2, 103]
    assert K.manifest(spark, done).count() == 3
    assert K.pending(parts, K.manifest(spark, done), "other").count() == 3


def test_adopt_leaves_the_last_group_pending(spark, parts, tmp_path):
    out, done = str(tmp_path / "out"), str(tmp_path / "done")
    parts.write.partitionBy("split", "grp").parquet(out)
    K.adopt(spark, out, "s", done)
    left = K.pending(parts, K.manifest(spark, done), "s").collect()
    assert [(r.split, r.grp) for r in left] == [("train", "g2")]


def test_adopt_leaves_the_last_unrecorded_group(spark, parts, tmp_path):
    """g3 is recorded, g2 was interrupted: g2 stays open."""
    out, done = str(tmp_path / "out"), str(tmp_path / "done")
    rows = spark.createDataFrame([("train", "g1", 1), ("train", "g2", 2), ("train", "g3", 3)], "split string, grp string, v int")
    rows.write.partitionBy("split", "grp").parquet(out)
    spark.createDataFrame([("s", "train", "g3")], K.MANIFEST_SCHEMA).write.parquet(done)
    K.adopt(spark, out, "s", done)
    assert [r.grp for r in K.pending(rows, K.manifest(spark, done), "s").collect()] == ["g2"]


def test_scalars(spark):
    df = spark.createDataFrame([("a b/ç-1.x",), ("//",), (None,)], "s string")
    assert [r[0] for r in df.select(SC.safe_name(F.col("s"))).collect()] == ["a_b_ç-1.x", "unnamed", "unnamed"]
    t = spark.createDataFrame([("1h02m03s", 3723.0), ("5m02s", 302.0), ("27.0s", 27.0), ("?", None)], "s string, v double")
    assert all(r[0] == r[1] for r in t.select(SC.duration_seconds(F.col("s")), "v").collect())
    assert [r[0] for r in t.where("v > 0").select(SC.duration_text(F.col("v"))).collect()] == ["1h02m03s", "5m02s", "27.0s"]
    import hashlib
    keys = spark.createDataFrame([(f"g:{i}",) for i in range(300)], "k string")
    got = {r.k: r.m for r in keys.select("k", SC.md5_mod(F.col("k"), 100).alias("m")).collect()}
    assert all(v == int(hashlib.md5(k.encode()).hexdigest(), 16) % 100 for k, v in got.items())
    n = spark.range(0, 300).select("id", SC.window_count(F.col("id"), 48, 8).alias("c")).collect()
    assert all(r.c == (0 if r.id < 48 else (r.id - 48) // 8 + 1) for r in n)


def write_files(folder, tables):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for name, columns in tables.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        if name.lower().endswith(".csv"):
            rows = zip(*columns.values())
            path.write_text("\n".join([",".join(columns), *[",".join("" if v is None else str(v) for v in r) for r in rows]]) + "\n")
        else:
            pq.write_table(pa.table(columns), path)


def sums(spark, folder):
    rows = R.read_tree(spark, str(folder)).groupBy("building").agg(F.count("energy").alias("n"), F.sum("energy").alias("s")).collect()
    return {r.building: (r.n, r.s) for r in rows}


TS = ["2024-01-01 00:00:00", "2024-01-01 01:00:00"]


def test_files_of_any_type_and_suffix_are_kept(spark, tmp_path):
    write_files(tmp_path, {
        "a/one.parquet": {"bldg_id": ["x", "x"], "timestamp": TS, "kwh": [1, 2]},
        "a/two.parquet": {"bldg_id": ["y", "y"], "timestamp": TS, "kwh": [1.5, 2.5]},
        "a/THREE.PARQUET": {"bldg_id": ["z", "z"], "timestamp": TS, "kwh": [3, 4]},
        "a/FOUR.CSV": {"bldg_id": ["w", "w"], "timestamp": TS, "kwh": [5, None]},
        "b/ids.csv": {"bldg_id": [123, 123], "timestamp": TS, "kwh": [1, 2]},
        "b/ids.parquet": {"bldg_id": [123, 123], "timestamp": TS, "kwh": [10.0, 20.0]},
    })
    assert sums(spark, tmp_path) == {"x": (2, 3.0), "y": (2, 4.0), "z": (2, 7.0), "w": (1, 5.0), "123": (4, 33.0)}


def test_digit_times_and_text_columns(spark, tmp_path):
    write_files(tmp_path, {
        "c/days.csv": {"bldg_id": ["d", "d"], "date": [20240101, 20240102], "kwh": [1, 2]},
        "c/wide.parquet": {"Timestamp": TS, "h1": ["7", "x"], "h2": [1.0, 2.0], "note": ["p", "q"]},
        "c/wide.csv": {"Timestamp": TS, "k1": [1, "?"], "k2": [3, 4], "note": ["p", "q"]},
    })
    out = R.read_tree(spark, str(tmp_path))
    assert sums(spark, tmp_path) == {"d": (2, 3.0), "h1": (1, 7.0), "h2": (2, 3.0), "k1": (1, 1.0), "k2": (2, 7.0)}
    assert sorted(str(r.ts) for r in out.where("building = 'd'").collect()) == ["2024-01-01 00:00:00", "2024-01-02 00:00:00"]


def test_series_without_a_time_column_keep_all_rows_in_order(spark, tmp_path):
    values = [float(k % 7) for k in range(1000)]
    write_files(tmp_path, {
        "s/house.parquet": {"energy": values},
        "s/timed.parquet": {"energy": [1.0, 2.0, 3.0], "timestamp": [TS[0], None, None]},
    })
    p = replace(DEFAULT, min_len=1)
    out = clean.clean(R.read_tree(spark, str(tmp_path)), ["file", "row"], p=p)
    house = [r.energy for r in out.where("building = 'house'").orderBy("t").collect()]
    assert house == values
    assert [r.energy for r in out.where("building = 'timed'").orderBy("t").collect()] == [1.0, 2.0]


def test_exploratory_files_without_an_id(spark):
    one = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-02", 2.0)], "date string, energy double")
    assert {(r.building, r.energy) for r in R.eda_readings(one, "g").collect()} == {("g", 1.0), ("g", 2.0)}
    two = spark.createDataFrame([("2024-01-01", 1.0, 5)], "date string, a double, b int")
    assert {(r.building, r.energy) for r in R.eda_readings(two, "g").collect()} == {("a", 1.0), ("b", 5.0)}


def test_scratch_without_a_named_folder(spark, monkeypatch):
    """Spark refuses to set spark.checkpoint.dir at run time, so an own folder must not need that."""
    from wattloom import session

    get = type(spark.conf).get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *a: a[0] if key == "spark.checkpoint.dir" else get(self, key, *a))
    root = session.scratch_root(spark)
    assert session.scratch_root(spark) == root and root.startswith("/")
    assert session.materialize(spark.range(5), "x").count() == 5


def test_many_schemas_are_one_scan(spark, tmp_path):
    write_files(tmp_path, {f"g{k % 3}/f{k}.parquet": {"Timestamp": TS, f"m{k}": [1.0, k], f"n{k}": [k, None]} for k in range(60)})
    out = R.read_tree(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan
    assert sums(spark, tmp_path) == {f"m{k}": (2, 1.0 + k) for k in range(60)} | {f"n{k}": (1, float(k)) for k in range(60)}
    assert {(r.grp, r.n) for r in out.groupBy("grp").agg(F.count("*").alias("n")).collect()} == {(f"g{k}", 80) for k in range(3)}


def test_large_csv_is_read_in_ranges(spark, tmp_path, monkeypatch):
    from wattloom.sources import tree

    monkeypatch.setattr(tree, "SPLIT", 700)
    monkeypatch.setattr(tree, "CHUNK", 256)
    lines = ["bldg_id,timestamp,kwh"] + [f"b{k % 3},2024-01-01 00:00:{k % 60:02d},{k}" for k in range(500)]
    lines[40] += ",one too many"
    lines[90] = "b2,2024-01-01"  # too short
    (tmp_path / "a.csv").write_text("\n".join(lines))
    (tmp_path / "b.csv").write_text('bldg_id,timestamp,kwh\r\n"q,1",2024-01-01,7\r\n')
    rows = R.read_tree(spark, str(tmp_path)).collect()
    own = sorted((r for r in rows if r.file.endswith("a.csv")), key=lambda r: (r.row.block, r.row.line))
    assert [r.energy for r in own] == [None if k == 89 else float(k) for k in range(500)]
    assert len({r.row.block for r in own}) > 10
    assert [(r.building, r.energy) for r in rows if r.file.endswith("b.csv")] == [("q_1", 7.0)]


def test_row_groups_keep_their_place(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"energy": [float(k) for k in range(100)]}), tmp_path / "s.parquet", row_group_size=7)
    rows = R.read_tree(spark, str(tmp_path)).collect()
    assert sorted((r.row.line, r.energy) for r in rows) == [(k, float(k)) for k in range(100)] and not rows[0].timed


def test_one_file_for_each_series(spark, tmp_path):
    df = spark.createDataFrame([(f"s {k % 4}", k, float(k)) for k in range(200)], "name string, t int, energy double")
    made = K.write_single(df, str(tmp_path / "out"), "name", ["t", "energy"]).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.n_rows) for r in made) == [(f"s_{k}.parquet", 50) for k in range(4)]
    got = pd.read_parquet(tmp_path / "out" / "s_1.parquet")
    assert list(got.t) == list(range(1, 200, 4)) and not [f for f in (tmp_path / "out").iterdir() if f.name.startswith("_")]


def test_eight_digit_dates_of_any_number_type(spark):
    for kind in ("int", "bigint", "double", "decimal(10,0)"):
        df = spark.sql(f"SELECT 'a' AS bldg_id, CAST(20240102 AS {kind}) AS date, 1.0D AS kwh")
        assert str(R.to_readings(df, F.lit("g"), F.lit("f"), F.lit(0)).first().ts) == "2024-01-02 00:00:00"


def test_rows_leave_a_file_in_small_batches(spark, tmp_path, monkeypatch):
    """No batch grows with the range of a csv file that is parsed at once, and lines keep their numbers."""
    from wattloom.sources import tree

    monkeypatch.setattr(tree, "ROWS", 10)
    path = tmp_path / "a.csv"
    path.write_text("energy\n" + "".join(f"{k}\n" for k in range(95)))
    got = list(tree._csv_batches(str(path), 0, path.stat().st_size))
    assert [(first, batch.num_rows) for first, batch in got] == [(k, min(10, 95 - k)) for k in range(0, 95, 10)]
    assert [v for _, b in got for v in b.column(0).to_pylist()] == [str(k) for k in range(95)]


def test_folder_and_name_of_a_file_come_with_its_piece(spark, tmp_path):
    """Worked out once a piece, not by expressions on every row."""
    (tmp_path / "in" / "x y").mkdir(parents=True)
    pd.DataFrame({"energy": [1.0, 2.0]}).to_csv(tmp_path / "in" / "x y" / "b (1).csv", index=False)
    out = R.read_tree(spark, str(tmp_path / "in"))
    assert {(r.grp, r.building, r.energy) for r in out.collect()} == {("x y", "b_1", 1.0), ("x y", "b_1", 2.0)}
    plan = out.select("grp")._jdf.queryExecution().executedPlan().toString()
    assert "substring_index" not in plan.split("MapInArrow")[0]
