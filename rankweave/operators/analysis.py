"""Looking into factors and into event logs of runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import dot, each
from ..session import ship
from .scale import cosine

#: Vectors of a block of a group.
BLOCK = 1024


def similar(h: DataFrame, index: str, vector: str, rank: int, which: int, top: int) -> DataFrame:
    """The ``top`` vectors most like that of ``which`` by cosine; ties go to smaller indexes."""
    one = h.filter(F.col(index) == which).select(F.col(vector).alias("one")).limit(1)
    rated = h.join(F.broadcast(one)).select(index, cosine(vector, "one", rank).alias("similarity"))  # one row
    return rated.orderBy(F.col("similarity").desc(), index).limit(top)


def predictions(w: DataFrame, h: DataFrame, rank: int, which: int, top: int) -> DataFrame:
    """The ``top`` rows by predicted value in column ``which``."""
    one = h.filter(F.col("j") == which).select("h").limit(1)
    return w.join(F.broadcast(one)).select("i", dot("w", "h", rank).alias("prediction")).orderBy(F.col("prediction").desc(), "i").limit(top)  # one row


def cosine_distances(a: DataFrame, b: DataFrame, rank: int, exp: bool = False) -> DataFrame:
    """(a, b, distance) of every vector of ``a`` (id, v) with every one of ``b`` of the same group ``g``, or of their exponentials.

    A group's vectors are dealt to blocks of about ``BLOCK`` by their ids, and a task multiplies one
    block of each side at a time, whatever the size of the group.  The cosine is 0 if a vector is 0, null
    or has null components, or if the quotient is not finite.
    """
    ship(a.sparkSession)
    x = F.col("v")
    part = lambda k: F.exp(x[k]) if exp else x[k]
    sizes = a.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).alias("n1")).join(b.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).alias("n2")), "g")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    vector = each(rank, part)
    left, right = (df.select("g", "id", vector.alias("v")).join(sizes, "g") for df in (a, b))
    left = left.select(F.col("g").alias("g1"), own("n1").alias("a1"), every("n2").alias("a2"), F.col("id").alias("a"), F.col("v").alias("va"))
    right = right.select(F.col("g").alias("g2"), every("n1").alias("b1"), own("n2").alias("b2"), F.col("id").alias("b"), F.col("v").alias("vb"))

    def arrays(side, i, v):
        m = np.asarray(side.column(v).combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(-1, rank)  # null as not a number
        return side.column(i).to_numpy(), m, np.sqrt((m * m).sum(axis=1))

    def run(one, two):
        (i, x, n), (j, y, m) = arrays(one, "a", "va"), arrays(two, "b", "vb")
        with np.errstate(all="ignore"):
            near = (x @ y.T) / (n[:, None] * m[None, :])
        return pa.table({"a": np.repeat(i, len(j)), "b": np.tile(j, len(i)), "distance": 1 - np.where(np.isfinite(near), near, 0.0).ravel()})

    return left.groupBy("g1", "a1", "a2").cogroup(right.groupBy("g2", "b1", "b2")).applyInArrow(run, "a long, b long, distance double")


_LINE = r"^\s*([0-9.eE+-]+)\s+(\S+)\s+(\d+)\s+(\d+)\s+([0-9.eE+-]+)\s+([+-])\s+(.*?)\s*$"


def parse_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """(elapsed, host, rank, task, time, type, event) of the log lines that have that form."""
    names = ("elapsed", "host", "rank", "task", "time", "type", "event")
    kinds = ("double", "string", "int", "int", "double", "string", "string")
    return lines.filter(F.col(column).rlike(_LINE)).select(*(F.regexp_extract(column, _LINE, k + 1).cast(t).alias(n) for k, (n, t) in enumerate(zip(names, kinds))))


def event_stats(events: DataFrame, key: str, value: str) -> DataFrame:
    """Count, least, mean, largest and coefficient of variation (sample) of a value by event."""
    cv = F.stddev_samp(value) / F.when(F.avg(value) != 0, F.avg(value))
    return events.groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.avg(value).alias("mean"), F.max(value).alias("high"), cv.alias("cv"))


def sections(events: DataFrame, keys: list[str], order: str, kind: str, name: str) -> DataFrame:
    """Sections between a start (+) and its end (-) event, nested as a stack by ``keys``.

    An end belongs to the last open start; ``matched`` tells whether both have one name.  Starts
    without an end have a null ``stop``.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    plus = F.col(kind) == "+"
    run = F.sum(F.when(plus, 1).otherwise(-1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    deep = events.withColumn("depth", F.when(plus, run).otherwise(run + 1))
    pair = Window.partitionBy(*keys, "depth").orderBy(order)
    both = deep.withColumns({"stop": F.lead(order).over(pair), "ended": F.lead(kind).over(pair), "closing": F.lead(name).over(pair)})
    fits = F.col("ended") == "-"
    return both.filter(plus).select(*keys, "depth", F.col(name), F.col(order).alias("start"), F.when(fits, F.col("stop")).alias("stop"), F.when(fits, F.col("closing") == F.col(name)).alias("matched"))


def spans(section: DataFrame, keys: list[str]) -> DataFrame:
    """First start, last stop and largest depth by ``keys``."""
    return section.groupBy(*keys).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("depth").alias("depth"))


def slots(tasks: DataFrame, key: str = "rank") -> DataFrame:
    """``slot`` of each task (key, task, start, stop): the lowest that is free when it starts; one key's tasks are one group."""

    def run(k, own):
        free: list[float] = []
        out = {}
        rows = sorted(zip(own.column("start").to_pylist(), own.column("stop").to_pylist(), own.column("task").to_pylist()))
        for start, stop, task in rows:
            at = next((s for s, until in enumerate(free) if until <= start), len(free))
            if at == len(free):
                free.append(stop)
            free[at] = stop
            out[task] = at
        return pa.table({key: pa.array([k[0].as_py()] * len(out), pa.int64()), "task": pa.array(list(out), pa.int64()), "slot": pa.array(list(out.values()), pa.int32())})

    return tasks.select(F.col(key).cast("long").alias(key), F.col("task").cast("long").alias("task"), "start", "stop").groupBy(key).applyInArrow(run, f"{key} long, task long, slot int")


def spread_slots(tasks: DataFrame, write, key: str = "rank") -> DataFrame:
    """``slot`` of each task (key, task, start, stop), as few slots as ever run at once, in no task all tasks of a key.

    Free slots are taken in the order in which they became free: start number n of a key with a peak of
    P has slot n if n < P, and else that of the task whose stop is number n - P.  Numbers come from
    time ranges that are counted alone and shifted by those before; chains of tasks of one slot are
    halved in every round.  ``write`` stores a table and returns it as read back.
    """
    own = tasks.select(F.col(key).cast("long").alias(key), F.col("task").cast("long").alias("task"), "start", "stop")
    # at one time: stops, then starts, then stops of tasks that take no time
    first = own.select(key, "task", F.col("start").alias("at"), F.lit(1).alias("turn"))
    last = own.select(key, "task", F.col("stop").alias("at"), F.when(F.col("start") < F.col("stop"), 0).otherwise(2).alias("turn"))
    events = write(first.union(last).repartitionByRange(key, "at", "turn", "task").withColumn("part", F.spark_partition_id()))
    plus = F.when(F.col("turn") == 1, 1).otherwise(0)
    ahead = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sums = events.groupBy(key, "part").agg(F.sum(plus).alias("n1"), F.sum(1 - plus).alias("n0"))
    sums = sums.select(key, "part", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in ("n1", "n0")))
    within = Window.partitionBy(key, "part").orderBy("at", "turn", "task").rowsBetween(Window.unboundedPreceding, 0)
    counted = events.withColumns({"r1": F.sum(plus).over(within), "r0": F.sum(1 - plus).over(within)}).join(sums, [key, "part"])
    counted = write(counted.select(key, "task", "turn", (F.col("n1") + F.col("r1")).alias("starts"), (F.col("n0") + F.col("r0")).alias("stops")))
    peak = counted.groupBy(key).agg(F.max(F.col("starts") - F.col("stops")).alias("peak"))
    begun = counted.filter("turn = 1").join(peak, key).select(key, "task", (F.col("starts") - 1).alias("n"), "peak")
    ended = counted.filter("turn <> 1").select(key, F.col("task").alias("before"), (F.col("stops") - 1).alias("m"))
    links = begun.withColumn("m", F.col("n") - F.col("peak")).join(ended, [key, "m"], "left")
    links = write(links.select(key, "task", F.when(F.col("m") >= 0, F.col("before")).alias("to"), F.when(F.col("m") < 0, F.col("n").cast("int")).alias("slot")))
    while not links.filter("slot is null").isEmpty():
        far = links.select(key, F.col("task").alias("to"), F.col("to").alias("next"), F.col("slot").alias("found"))
        links = write(links.join(far, [key, "to"], "left").select(key, "task", F.when(F.col("found").isNull(), F.col("next")).alias("to"), F.coalesce("slot", "found").alias("slot")))
    return links.select(key, "task", "slot")


def offsets(sizes: DataFrame, order: str, value: str, keys: list[str]) -> DataFrame:
    """``sizes`` with ``offset``: the sum of what comes before in the order, by ``keys``."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("offset", F.coalesce(F.sum(value).over(w), F.lit(0)))


def trace_lines(trace: DataFrame, name: str = "trace") -> DataFrame:
    """(epoch, line): a trace as the source of an R list, one line an entry between a first and a last one."""
    last = trace.agg(F.max("epoch").alias("last"))
    fields = ["it", "epoch", *(c for c in ("loss", "loss_test", "eps", "t_elapsed", "t_epoch", "t_loss", "t_loss_test") if c in trace.columns)]
    parts = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in fields]
    entry = F.concat(F.lit("list("), F.concat_ws(", ", *parts), F.when(F.col("epoch") == F.col("last"), ")").otherwise("),"))
    ends = trace.sparkSession.createDataFrame([(-1, f"{name} <- list(trace=list(")], "epoch long, line string").union(last.select((F.col("last") + 1).alias("epoch"), F.lit("));").alias("line")))
    return trace.join(F.broadcast(last)).select(F.col("epoch").cast("long").alias("epoch"), entry.alias("line")).union(ends)  # one row
