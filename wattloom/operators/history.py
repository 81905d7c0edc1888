"""Training-history and federated-round analytics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom.fixed_values import LR_STEPS
from wattloom.functions.scalars import halving_rate
from wattloom.operators.ordered import int_bucket, with_halo, with_running


def weighted_metrics(metrics: DataFrame, by: Sequence[str] = ("round", "metric")) -> DataFrame:
    """Mean over clients weighted by their number of examples; a client without the value weighs nothing."""
    return metrics.groupBy(*by).agg(
        (F.sum(F.col("value") * F.col("num_examples")) / F.sum(F.when(F.col("value").isNotNull(), F.col("num_examples")))).alias("value"),
        F.sum("num_examples").alias("num_examples"),
    )


def epoch_curve(runs: DataFrame, local_epochs: int, curve: str = "curve") -> DataFrame:
    """Local epoch losses on one axis: (round - 1) * epochs + epoch."""
    return runs.select("client", "round", F.posexplode(curve).alias("epoch", "loss")).withColumn(
        "global_step", (F.col("round") - 1) * local_epochs + F.col("epoch")
    )


def best_rounds(
    aggregated: DataFrame, keys: Sequence[str], step: str, value: str, lower_is_better: bool = True, span: int = 4096
) -> DataFrame:
    """Rounds whose value beats every earlier one."""
    signed = aggregated.withColumn("__v", F.col(value) if lower_is_better else -F.col(value))
    run = with_running(
        signed, keys, [F.col(step)], int_bucket(step, span), {"__best": ("min", "__v", "before")}
    )
    return run.where(F.col("__best").isNull() | (F.col("__v") < F.col("__best"))).drop("__v", "__best")


def overhead(server: DataFrame, clients: DataFrame) -> DataFrame:
    """Server time per round minus the slowest client's time per round.

    ``server``: run, rounds, wall_s; ``clients``: run, client, wall_s (whole run).
    """
    slowest = clients.groupBy("run").agg(F.max("wall_s").alias("__slow"))
    return server.join(slowest, "run").select(
        "run",
        (F.col("wall_s") / F.col("rounds")).alias("server_s_per_round"),
        (F.col("__slow") / F.col("rounds")).alias("slowest_s_per_round"),
        ((F.col("wall_s") - F.col("__slow")) / F.col("rounds")).alias("overhead_s"),
    )


def early_stop(
    history: DataFrame, keys: Sequence[str], epoch: str, loss: str, patience: int,
    min_delta: float = 0.0, span: int = 4096,
) -> DataFrame:
    """Per epoch: running best, epochs since the last improvement, and whether training stops here.

    An epoch improves when its loss is below the earlier best by more than ``min_delta``. The best is the
    smallest loss so far, improved or not. Only epochs up to the first stop are kept.
    """
    order, bucket = [F.col(epoch)], int_bucket(epoch, span)
    run = with_running(
        history, keys, order, bucket, {"best": ("min", loss), "__before": ("min", loss, "before")}
    )
    limit = F.col("__before") - F.lit(min_delta)
    run = run.withColumn("improved", F.col("__before").isNull() | (F.col(loss) < limit))
    run = run.withColumn("__at", F.when(F.col("improved"), F.col(epoch)))
    run = with_running(run, keys, order, bucket, {"__last": ("max", "__at")})
    run = run.withColumn("wait", F.col(epoch) - F.col("__last"))
    # the first stop is the only one that counts, so later epochs go
    run = run.withColumn("__stop", F.when(F.col("wait") >= patience, F.col(epoch)))
    run = with_running(run, keys, order, bucket, {"__first": ("min", "__stop", "before")})
    return run.where(F.col("__first").isNull()).withColumn("stops", F.col("wait") >= patience).drop(
        "__before", "__at", "__last", "__stop", "__first"
    )


def early_stop_stepwise(
    history: DataFrame, keys: Sequence[str], epoch: str, loss: str, patience: int, min_delta: float = 0.0
) -> DataFrame:
    """The rule whose best moves only on improvement: a loss at or below the best less ``min_delta``.

    Each epoch depends on the decision before it, so a run's epochs are folded in order along a sorted
    partition: only best, wait and the run's key go from row to row, however long a run is. Ties of the epoch
    are taken by loss. A null loss does not improve. Only epochs up to the first stop are kept.
    """
    n_keys = len(keys)
    rows = history.select(*keys, epoch, F.col(loss).cast("double").alias(loss))
    kinds = [T.StructField("best", T.DoubleType()), T.StructField("improved", T.BooleanType()), T.StructField("wait", T.IntegerType()), T.StructField("stops", T.BooleanType())]
    schema = T.StructType([*rows.schema.fields, *kinds])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, wait, done = object(), None, 0, False
        for batch in batches:
            keep, out = [], ([], [], [], [])
            names = zip(*(c.to_pylist() for c in batch.columns[:n_keys])) if n_keys else iter([()] * batch.num_rows)
            for at, (key, value) in enumerate(zip(names, batch.column(n_keys + 1).to_pylist())):
                if key != now:
                    now, best, wait, done = key, None, 0, False
                if done:
                    continue
                improved = best is None or (value is not None and value <= best - min_delta)
                best, wait = (value, 0) if improved else (best, wait + 1)
                done = not improved and wait >= patience
                keep.append(at)
                for column, v in zip(out, (best, improved, wait, wait >= patience)):
                    column.append(v)
            added = [pa.array(c, t) for c, t in zip(out, (pa.float64(), pa.bool_(), pa.int32(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(keep, pa.int64())).columns, *added], names=schema.fieldNames())

    by = [F.col(c) for c in keys]
    spread = rows.repartition(*by) if keys else rows.repartition(1)  # without keys there is one run
    return spread.sortWithinPartitions(*by, F.col(epoch).asc_nulls_last(), F.col(loss).asc_nulls_last()).mapInArrow(fold, schema)


def learning_rate(epoch: Column, start: float, schedule: str = "halve") -> Column:
    """Rate at an epoch: halved every epoch, or the step table (null between its entries)."""
    if schedule == "halve":
        return halving_rate(epoch, start)
    if schedule == "steps":
        table = F.create_map(*[F.lit(x) for kv in LR_STEPS.items() for x in kv])
        return F.try_element_at(table, epoch.cast("int"))
    raise ValueError(f"unknown schedule {schedule!r}")


def effective_rate(epochs: DataFrame, keys: Sequence[str], epoch: str, start: float) -> DataFrame:
    """The step table carried forward: each entry holds until the next."""
    marked = epochs.withColumn("__e", F.when(F.col(epoch).isin(list(LR_STEPS)), F.col(epoch)))
    run = with_running(marked, keys, [F.col(epoch)], int_bucket(epoch, 4096), {"__last": ("max", "__e")})
    return run.withColumn(
        "lr", F.coalesce(learning_rate(F.col("__last"), start, "steps"), F.lit(start))
    ).drop("__e", "__last")


def smoothed(df: DataFrame, keys: Sequence[str], t: str, value: str, k: int, block: int = 8192) -> DataFrame:
    """Trailing mean of up to k points along a dense position ``t``."""
    near = W.partitionBy(*keys, "__blk").orderBy(t).rowsBetween(-(k - 1), 0)
    block = max(block, k)
    placed = with_halo(df, t, block, before=max(k - 1, 0))
    return placed.withColumn("smoothed", F.avg(value).over(near)).where("__own").drop("__own", "__blk")
