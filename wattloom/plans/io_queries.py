"""Queries for sources and sinks. Files are written from the given tables into the scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.functions.scalars import safe_name
from wattloom.operators import clean as C
from wattloom.operators import labels as L
from wattloom.operators import splitting as S
from wattloom.operators import windows as WN
from wattloom.plans import tables as T
from wattloom.plans.eda_queries import META_SQL, metadata
from wattloom.plans.log_queries import PROGRESS_SQL, EV_SQL, log_lines, progress
from wattloom.plans.registry import query
from wattloom.plans.series_queries import FUSED_SQL, NATION_SQL, TEMPORAL_SQL, WINDOWS_SQL, P, PN, array_sum, nation_series, rd, supplier_series
from wattloom.plans.sqltext import r
from wattloom.operators import runlog as RL
from wattloom.session import materialize, scratch_path
from wattloom.sources import readers as R
from wattloom.sources import sinks as K

TOTALS_SQL = f"count(*) AS row_count, count(energy) AS filled, {r('sum(energy)', 4)} AS energy"


def no_file():
    """File and row columns of readings that come from a table, not from a file."""
    return F.lit("memory"), F.lit(0)


def totals(readings, *keys):
    return readings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"), F.count("energy").alias("filled"), rd(F.sum("energy"), 4).alias("energy")
    )


# ---- sources --------------------------------------------------------------------------------


def write_tree(spark, sf_dir, fmt="parquet", root=None):
    """A tree <sector>/<group> of long-layout files, one folder per nation."""
    root = root or scratch_path(spark, "tree")
    rows = T.daily(spark, sf_dir).select(
        F.lit("hourly").alias("res"), "grp", F.col("building").alias("bldg_id"), F.col("ts").alias("timestamp"), F.col("energy").alias("kwh")
    )
    w = rows.write.mode("append").partitionBy("res", "grp")
    (w.parquet(root) if fmt == "parquet" else w.option("header", True).csv(root))
    return root


SAFE = "replace(building, '#', '_')"


@query("src_scan_group", f"WITH {T.daily_sql()} SELECT 'res=hourly/grp=' || grp AS grp, {SAFE} AS building, {TOTALS_SQL} FROM daily WHERE grp IN ('AFRICA', 'ASIA') GROUP BY 1, 2")
def src_scan_group(spark, sf_dir):
    """A folder tree read whole, then narrowed by parts of the group name, ignoring case."""
    found = R.read_tree(spark, write_tree(spark, sf_dir))
    return totals(C.group_contains(found, ["GRP=Af", "grp=asia"]), "grp", "building")


@query("src_read_any", f"WITH {T.daily_sql()} SELECT {SAFE} AS building, count(*) * 2 AS row_count, count(energy) * 2 AS filled, {r('sum(energy) * 2', 4)} AS energy FROM daily GROUP BY 1")
def src_read_any(spark, sf_dir):
    """The same rows once as parquet and once as csv in one tree."""
    root = write_tree(spark, sf_dir)
    return totals(R.read_tree(spark, write_tree(spark, sf_dir, "csv", root)), "building")


@query("src_roles", f"SELECT user_id::VARCHAR AS building, count(*) AS row_count, count(value) AS filled, {r('sum(value)', 4)} AS energy FROM events GROUP BY 1")
def src_roles(spark, sf_dir):
    """Roles found in a schema not made for it: time by type, id and value by name."""
    ev = T.table(spark, sf_dir, "events")
    return totals(R.to_readings(ev, F.lit("g"), *no_file()), "building")


@query("src_long", f"WITH {T.daily_sql()} SELECT grp, {SAFE} AS building, ts, {r('energy')} AS energy FROM daily")
def src_long(spark, sf_dir):
    raw = T.daily(spark, sf_dir).select(F.col("building").alias("bldg_id"), F.col("ts").alias("timestamp"), F.col("energy").alias("kwh"), "grp")
    out = R.to_readings(raw, F.col("grp"), *no_file())
    return out.select("grp", "building", "ts", rd(F.col("energy")).alias("energy"))


REGION_NAMES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def wide_frame(spark, sf_dir):
    per = T.daily(spark, sf_dir, "nation").groupBy(F.col("ts").alias("Timestamp"))
    return per.pivot("grp", list(REGION_NAMES)).agg(F.sum("energy"))


WIDE_LONG_SQL = f"""{T.daily_sql()}, w AS (SELECT regexp_replace(grp, ' ', '_') AS building, ts, sum(energy) AS energy FROM daily GROUP BY 1, 2)"""


WIDE_FILES = (("AFRICA", "AMERICA"), ("ASIA",), ("EUROPE", "MIDDLE EAST"))


@query("src_wide", f"WITH {WIDE_LONG_SQL} SELECT building, ts, {r('energy')} AS energy FROM w")
def src_wide(spark, sf_dir):
    """Wide files of different columns, one of them csv, read in one scan."""
    root, frame = scratch_path(spark, "wide"), materialize(wide_frame(spark, sf_dir), "wide-frame")
    for k, columns in enumerate(WIDE_FILES):
        part = frame.select("Timestamp", *columns).write.mode("append")
        part.option("header", True).csv(root) if k == 1 else part.parquet(root)
    out = R.read_tree(spark, root).where("energy IS NOT NULL")
    return out.select("building", "ts", rd(F.col("energy")).alias("energy"))


def single_tree(spark, sf_dir, name, root=None):
    """One file for each series, named after it; the rows hold only time and energy."""
    root = root or scratch_path(spark, "single")
    daily = T.daily(spark, sf_dir).select(name.alias("name"), F.col("ts").alias("timestamp"), "energy")
    K.write_single(daily, root, "name", ["timestamp", "energy"]).agg(F.sum("n_rows")).collect()
    return root


@query(
    "src_layout",
    f"""WITH {WIDE_LONG_SQL}
SELECT 'wide' AS kind, building, {TOTALS_SQL} FROM w GROUP BY 2
UNION ALL SELECT 'long', {SAFE}, {TOTALS_SQL} FROM daily GROUP BY 2
UNION ALL SELECT 'single', 'load_' || replace(grp, ' ', '_'), {TOTALS_SQL} FROM daily GROUP BY 2""",
)
def src_layout(spark, sf_dir):
    """The three layouts of the same readings, each recognised from its files' own columns, in one tree and one scan."""
    root = scratch_path(spark, "layouts")
    wide_frame(spark, sf_dir).write.parquet(f"{root}/wide")
    long = T.daily(spark, sf_dir).select(F.col("building").alias("meter_id"), F.col("ts").alias("date"), F.col("energy").alias("load"))
    long.write.parquet(f"{root}/long")
    single_tree(spark, sf_dir, F.concat(F.lit("load_"), F.col("grp")), f"{root}/single")
    out = R.read_tree(spark, root).withColumnRenamed("grp", "kind")
    return totals(out.where("kind <> 'wide' OR energy IS NOT NULL"), "kind", "building")


@query("src_single", f"WITH {T.daily_sql()} SELECT {SAFE} AS building, ts, {r('energy')} AS energy FROM daily")
def src_single(spark, sf_dir):
    """A file for each building, which only the file's name tells."""
    out = R.read_tree(spark, single_tree(spark, sf_dir, F.col("building")))
    return out.select("building", "ts", rd(F.col("energy")).alias("energy"))


@query("src_ambiguous", f"WITH {T.daily_sql()} SELECT {SAFE} AS building, {TOTALS_SQL} FROM daily GROUP BY 1")
def src_ambiguous(spark, sf_dir):
    """An id, a time and one column of unknown name: that one is the measure."""
    raw = T.daily(spark, sf_dir).select(F.col("building").alias("house"), F.col("ts").alias("ds"), F.col("energy").alias("measured"))
    return totals(R.to_readings(raw, F.lit("g"), *no_file()), "building")


@query("src_eda_value", f"SELECT l_suppkey::VARCHAR AS building, count(*) AS row_count, count(l_quantity) AS filled, {r('sum(l_quantity)', 4)} AS energy FROM lineitem GROUP BY 1")
def src_eda_value(spark, sf_dir):
    """No column named like a measure: the first number is taken."""
    li = T.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("meter_id"), F.col("l_shipdate").alias("ship_date"), F.col("l_quantity").alias("qty"), "l_tax"
    )
    return totals(R.eda_readings(li, "g"), "building")


@query(
    "src_coerce",
    """SELECT event_id::VARCHAR AS building, CASE WHEN event_id % 89 <> 0 THEN date_trunc('second', ts) END AS ts,
       CASE WHEN event_id % 97 <> 0 THEN value END AS energy FROM events""",
)
def src_coerce(spark, sf_dir):
    """Text columns with unreadable times and numbers."""
    text = T.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("meter_id"),
        F.when(F.col("event_id") % 89 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("time"),
        F.when(F.col("event_id") % 97 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("value"),
    )
    return R.to_readings(text, F.lit("g"), *no_file()).select("building", "ts", "energy")


@query(
    "src_safe_name",
    """SELECT c_custkey, coalesce(nullif(trim(regexp_replace(raw, '[^\\p{L}\\p{N}_\\-.]+', '_', 'g'), '_'), ''), 'unnamed') AS name
FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN '#/ ' ELSE '(é) ' || c_name || ' / ' || c_mktsegment || '-1.0 ?' END AS raw FROM customer)""",
)
def src_safe_name(spark, sf_dir):
    raw = F.when(F.col("c_custkey") % 10 == 0, F.lit("#/ ")).otherwise(
        F.concat(F.lit("(é) "), "c_name", F.lit(" / "), "c_mktsegment", F.lit("-1.0 ?"))
    )
    return T.table(spark, sf_dir, "customer").select("c_custkey", safe_name(raw).alias("name"))


@query("src_rowpos", "SELECT row_number() OVER () - 1 AS rn, l_orderkey, l_quantity FROM lineitem")
def src_rowpos(spark, sf_dir):
    return R.row_positions(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"]).drop("file")


@query("src_metadata", f"""WITH {META_SQL} SELECT m.alias, m.type, p.s AS "start", p.e AS "end", m.n_obs, m.n_buildings, m.location, m.iso FROM meta m JOIN periods p USING (alias)""")
def src_metadata(spark, sf_dir):
    """Metadata csv in its published form: padded headers, thousands separators, two date forms, NA."""
    md = metadata(spark, sf_dir)
    path = scratch_path(spark, "metadata")
    md.select(
        F.col("type").alias("Type"), F.col("alias").alias(" Alias "),
        F.date_format("start", "M/d/yyyy").alias("Start"),
        F.when(F.length("alias") % 2 == 0, F.date_format("end", "M/d/yy")).otherwise(F.date_format("end", "M/d/yyyy")).alias("End"),
        F.col("n_buildings").alias("No. of Buildings"), F.col("n_obs").alias("No. of Obs"),
        F.col("location").alias("Location"), "iso",
    ).write.option("header", True).option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)
    return R.read_metadata(spark, path)


@query(
    "src_jsonl",
    f"""SELECT event_type AS stage, count(*) AS records, {r('sum(value)', 4)} AS loss, max(user_id) AS top_step FROM events
WHERE event_id % 97 <> 0 AND event_id % 89 <> 0 GROUP BY 1""",
)
def src_jsonl(spark, sf_dir):
    """Loss records, some lines cut off, some without a loss."""
    ev = T.table(spark, sf_dir, "events")
    rec = F.to_json(
        F.struct(
            (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("event_type").alias("stage"),
            F.col("user_id").alias("step"), F.when(F.col("event_id") % 89 != 0, F.col("value")).alias("loss"),
        )
    )
    line = F.when(F.col("event_id") % 97 == 0, F.substring(rec, 1, 25)).otherwise(rec)
    path = scratch_path(spark, "loss")
    ev.select(line.alias("value")).write.text(path)
    return R.read_loss(spark, path).groupBy("stage").agg(
        F.count(F.lit(1)).alias("records"), rd(F.sum("loss"), 4).alias("loss"), F.max("step").alias("top_step")
    )


@query(
    "src_log_text",
    f"""WITH {EV_SQL} SELECT log, count(*) AS lines, count(*) FILTER (WHERE kind <= 1) AS snapshots,
       arg_max(context, ord) AS last_context FROM (SELECT ev.log, ev.ord, kind, context FROM ev LEFT JOIN snaps USING (log, ord)) GROUP BY 1""",
)
def src_log_text(spark, sf_dir):
    """Log files read line by line; the order of lines survives."""
    path = scratch_path(spark, "logs")
    lines = log_lines(spark, sf_dir)
    lines.repartitionByRange("log", "ord").sortWithinPartitions("log", "ord").select(
        "log", F.col("line").alias("value")
    ).write.partitionBy("log").text(path)
    back = R.read_log(spark, path).withColumn("log", F.regexp_extract("file", r"log=([^/]+)/", 1))
    counts = back.groupBy("log").agg(F.count(F.lit(1)).alias("lines"))
    snaps = RL.snapshots(back).groupBy("log").agg(
        F.count(F.lit(1)).alias("snapshots"), F.max_by("context", "ord").alias("last_context")
    )
    return counts.join(snaps, "log")


@query(
    "src_summaries",
    f"""WITH {PROGRESS_SQL} SELECT host AS hostname, done_units, total_units, {r('elapsed_s', 4)} AS wall_time_s, {r('units_per_min', 4)} AS units_per_min FROM eta""",
)
def src_summaries(spark, sf_dir):
    """One JSON document per device, spread over several lines."""
    path = scratch_path(spark, "summaries")
    rows = RL.rate_and_eta(progress(spark, sf_dir)).select(
        F.regexp_replace("host", " ", "_").alias("folder"), F.col("host").alias("hostname"), "done_units", "total_units",
        F.col("elapsed_s").alias("wall_time_s"), "units_per_min",
    )
    doc = F.regexp_replace(F.to_json(F.struct(*rows.columns[1:])), ",", ",\n")
    rows.select("folder", doc.alias("value")).repartition("folder").write.partitionBy("folder").text(path)
    out = R.read_summaries(spark, path)
    return out.select(
        "hostname", "done_units", "total_units", rd(F.col("wall_time_s"), 4).alias("wall_time_s"), rd(F.col("units_per_min"), 4).alias("units_per_min")
    )


@query(
    "src_multi",
    f"""WITH {T.daily_sql()}, {T.HOURLY_SQL.strip()}
SELECT 'synthetic' AS source, grp, {TOTALS_SQL} FROM daily GROUP BY 2 UNION ALL SELECT 'real', grp, {TOTALS_SQL} FROM hourly GROUP BY 2""",
)
def src_multi(spark, sf_dir):
    return totals(R.combine(synthetic=T.daily(spark, sf_dir), real=T.hourly(spark, sf_dir)), "source", "grp")


INVENTORY = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def inventory(spark, sf_dir):
    return R.footers(R.list_files(spark, sf_dir)).withColumn("file", R.file_stem(F.col("path")))


COLUMNS_SQL = """(SELECT table_name, count(*) AS n, string_agg(column_name, ' | ' ORDER BY column_index) AS names
 FROM duckdb_columns() GROUP BY 1)"""


@query(
    "eda_inventory",
    "WITH c AS (" + " UNION ALL ".join(f"SELECT '{t}' AS file, count(*) AS n_rows FROM {t}" for t in INVENTORY)
    + f") SELECT file, n_rows, n AS n_cols FROM c JOIN {COLUMNS_SQL} k ON k.table_name = c.file",
)
def eda_inventory(spark, sf_dir):
    return inventory(spark, sf_dir).select("file", "n_rows", "n_cols")


@query(
    "eda_schema_census",
    f"SELECT names AS columns, count(*) AS files FROM {COLUMNS_SQL} WHERE table_name IN ({', '.join(repr(t) for t in INVENTORY)}) GROUP BY 1",
)
def eda_schema_census(spark, sf_dir):
    return R.schema_census(inventory(spark, sf_dir))


# ---- sinks ----------------------------------------------------------------------------------


@query("sink_splits", f"WITH {TEMPORAL_SQL} SELECT 'Daily' AS resolution, split, grp, building, count(*) AS row_count, sum(energy)::DOUBLE AS energy FROM splits GROUP BY ALL")
def sink_splits(spark, sf_dir):
    path = scratch_path(spark, "splits")
    K.write_splits(S.temporal(nation_series(spark, sf_dir), PN).withColumn("resolution", F.lit("Daily")), path)
    return spark.read.parquet(path).groupBy("resolution", "split", "grp", "building").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("energy").alias("energy")
    )


@query("sink_windows", f"WITH {WINDOWS_SQL} SELECT grp, building, start, sum(x)::DOUBLE AS total FROM pts GROUP BY 1, 2, 3")
def sink_windows(spark, sf_dir):
    path = scratch_path(spark, "windows")
    wins = WN.make_windows(supplier_series(spark, sf_dir), P).withColumn("split", F.lit("train"))
    K.write_windows(wins, path, P.with_(max_windows_per_file=500))
    return spark.read.parquet(path).select("grp", "building", "start", array_sum(F.col("x")).alias("total"))


@query("sink_labeled", f"WITH {FUSED_SQL} SELECT grp, building, count(*) AS steps, sum(anomaly)::BIGINT AS anomalies, sum(energy)::DOUBLE AS energy FROM fused GROUP BY 1, 2")
def sink_labeled(spark, sf_dir):
    path = scratch_path(spark, "labeled")
    fused = L.label_fused(supplier_series(spark, sf_dir), P)
    K.write_labeled(fused.select("grp", "building", "t", "energy", "anomaly"), path)
    return spark.read.parquet(path).groupBy("grp", "building").agg(
        F.count(F.lit(1)).alias("steps"), F.sum("anomaly").alias("anomalies"), F.sum("energy").alias("energy")
    )


@query("sink_reports", f"WITH {NATION_SQL} SELECT grp, building, count(*) AS row_count, max(energy) AS peak FROM series GROUP BY 1, 2")
def sink_reports(spark, sf_dir):
    """A result table as csv and as json; both read back and compared."""
    res = nation_series(spark, sf_dir).groupBy("grp", "building").agg(F.count(F.lit(1)).alias("row_count"), F.max("energy").alias("peak"))
    out = scratch_path(spark, "report")
    K.write_report(res, f"{out}/csv", "csv")
    K.write_report(res, f"{out}/json", "json")
    csv = spark.read.option("header", True).schema(res.schema).csv(f"{out}/csv")
    return csv.join(spark.read.schema(res.schema).json(f"{out}/json"), res.columns, "left_semi")


@query(
    "sink_idempotent",
    f"WITH {T.daily_sql()} SELECT 'train' AS split, grp, count(*) AS row_count, sum(energy)::DOUBLE AS energy FROM daily GROUP BY 2",
)
def sink_idempotent(spark, sf_dir):
    """First a run over two groups, then one over all: finished groups are left alone."""
    out, done = scratch_path(spark, "step"), scratch_path(spark, "manifest")
    rows = T.daily(spark, sf_dir).withColumn("split", F.lit("train"))
    K.run_step(rows.where(F.col("grp").isin("AFRICA", "ASIA")), "split", out, done)
    K.run_step(rows.withColumn("energy", F.when(F.col("grp") == "ASIA", F.lit(-1.0)).otherwise(F.col("energy")))
               .where(F.col("grp") != "EUROPE"), "split", out, done)
    K.run_step(rows, "split", out, done)
    back = spark.read.parquet(out).join(K.manifest(spark, done).distinct(), ["split", "grp"], "left_semi")
    return back.groupBy("split", "grp").agg(F.count(F.lit(1)).alias("row_count"), F.sum("energy").alias("energy"))
