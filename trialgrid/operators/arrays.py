"""Operators on signals kept as ``samples array<double>``: windows are slices, nothing is exploded unless samples must meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.nullif(F.size(a), F.lit(0))


def window(samples: str, smin: Column, smax: Column) -> Column:
    """Samples smin..smax - 1, counted from 0."""
    return F.slice(samples, smin + 1, smax - smin)


def baseline_corrected(samples: str, smin: int, smax: int) -> Column:
    """Each sample less the mean of a window."""
    base = mean(window(samples, F.lit(smin), F.lit(smax)))
    return F.transform(samples, lambda x: x - base)


def sliding_windows(df: DataFrame, size: int, stride: int, low: int, high: int, ragged: bool = False) -> DataFrame:
    """Rows by window: smin, smax. Full windows only, or the last ones cut at ``high``. The samples aren't copied here."""
    last = high - 1 if ragged else high - size
    starts = F.explode(F.sequence(F.lit(low), F.lit(last), F.lit(stride))).alias("smin")
    return df.select("*", starts).withColumn("smax", F.least(F.lit(high), F.col("smin") + size))


def window_means(df: DataFrame, size: int, stride: int, low: int, high: int, ragged: bool = False) -> DataFrame:
    out = sliding_windows(df, size, stride, low, high, ragged)
    return out.withColumn("x", mean(window("samples", F.col("smin"), F.col("smax")))).drop("samples")


def evoked(df: DataFrame, group: list[str]) -> DataFrame:
    """Mean, standard error and count over trials at each sample position; sums by position, traces come last."""
    long = df.select(*group, F.posexplode("samples").alias("pos", "x"))
    return long.groupBy(*group, "pos").agg(F.avg("x").alias("mean"), (F.stddev_samp("x") / F.sqrt(F.count("x"))).alias("sem"), F.count("x").alias("n"))


def collected(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """A trace by group from rows by position. Its length is the number of positions."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v"))))
    return df.groupBy(*group).agg(F.transform(pairs, lambda p: p["v"]).alias("samples"))


def contrast(df: DataFrame, cls: str, group: list[str]) -> DataFrame:
    """Difference of the class means at each position: group, pos, contrast."""
    long = df.select(*group, cls, F.posexplode("samples").alias("pos", "x"))
    side = lambda k: F.avg(F.when(F.col(cls) == k, F.col("x")))
    return long.groupBy(*group, "pos").agg((side(1) - side(0)).alias("contrast"))


def signed_trace(contrasts: DataFrame, group: list[str], polarity: str) -> DataFrame:
    """Mean and standard error (population deviation) over sites of polarity times contrast, by position."""
    x = F.col("contrast") * F.col(polarity)
    return contrasts.groupBy(*group, "pos").agg(F.avg(x).alias("mean"), (F.stddev_pop(x) / F.sqrt(F.count(x))).alias("sem"))


def realigned(samples: str, shift: Column, length: int) -> Column:
    """Samples from ``shift`` on, ``length`` of them; positions outside the signal are null."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.get(F.col(samples), (i + shift).cast("int")))


def aligned_to_event(df: DataFrame, at: str, anchor: int) -> DataFrame:
    """Signals moved so that the sample ``at`` stands at ``anchor``, null where there is none; ``at`` stays.

    A signal whose event lies behind its end, or has none, goes. All are cut at the end of the longest of those that moved
    to the left; if none did, none is cut.
    """
    shift = F.col(at) - anchor
    rows = df.where(F.col(at) < F.size("samples"))
    longest = rows.agg(F.max(F.when(shift > 0, F.size("samples") - shift)).alias("_n"))  # one row
    moved = F.transform(F.sequence(F.lit(0), F.size("samples") - 1), lambda i: F.get("samples", (i + shift).cast("int")))
    rows = rows.withColumn("samples", moved).crossJoin(F.broadcast(longest))
    return rows.withColumn("samples", F.when(F.col("_n").isNull(), F.col("samples")).otherwise(F.slice("samples", F.lit(1), F.col("_n").cast("int")))).drop("_n")


def aligned_to_peak(df: DataFrame, half: int) -> DataFrame:
    """The samples around the largest one, ``half`` on each side; signals whose window leaves the array go."""
    at = (F.array_position("samples", F.array_max("samples")) - 1).cast("int")
    rows = df.withColumn("peak", at).where((F.col("peak") >= half) & (F.col("peak") + half < F.size("samples")))
    return rows.withColumn("samples", window("samples", F.col("peak") - half, F.col("peak") + half + 1))


def zscored(df: DataFrame, channel: str, clip: float = 3.0) -> DataFrame:
    """Samples standardised by the channel's mean and population deviation over all trials, clipped."""
    s = df.select(channel, F.explode("samples").alias("x")).groupBy(channel).agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"))
    rows = df.join(s, channel)
    z = F.transform("samples", lambda x: F.greatest(F.lit(-clip), F.least(F.lit(clip), (x - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0)))))
    return rows.withColumn("samples", z).drop("_m", "_s")


def jointly_scaled(df: DataFrame, group: list[str]) -> DataFrame:
    """Samples of a group scaled to 0..1 by its joint minimum and maximum."""
    s = df.groupBy(*group).agg(F.min(F.array_min("samples")).alias("_lo"), F.max(F.array_max("samples")).alias("_hi"))
    out = df.join(s, group)
    return out.withColumn("samples", F.transform("samples", lambda x: (x - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)))).drop("_lo", "_hi")


def flattened(df: DataFrame, key: list[str], channel: str, smin: int, smax: int) -> DataFrame:
    """One vector by key: the window of every channel, in channel order."""
    parts = df.select(*key, F.struct(F.col(channel).alias("c"), window("samples", F.lit(smin), F.lit(smax)).alias("w")).alias("p"))
    return parts.groupBy(*key).agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["w"])).alias("vector"))


def without_bad_channels(df: DataFrame, channel: str) -> DataFrame:
    """All rows of channels without a missing sample in any trial."""
    bad = df.where(F.exists("samples", lambda x: x.isNull() | F.isnan(x))).select(channel).distinct()
    return df.join(bad, channel, "left_anti")


def runs_above(df: DataFrame, group: list[str], order: str, value: str, cut: float) -> DataFrame:
    """Segments of consecutive rows above a threshold: group, start, stop (inclusive), n."""
    by = Window.partitionBy(*group).orderBy(order)
    rows = df.select(*group, order, (F.col(value) > cut).alias("_up")).withColumn("_new", F.when(F.col("_up") != F.lag("_up", 1, False).over(by), 1).otherwise(0))
    rows = rows.withColumn("_run", F.sum("_new").over(by)).where("_up")
    return rows.groupBy(*group, "_run").agg(F.min(order).alias("start"), F.max(order).alias("stop"), F.count("*").alias("n")).drop("_run")


def smoothed(df: DataFrame, group: list[str], order: str, value: str, width: int = 3) -> DataFrame:
    """Mean of each row and the next ``width - 1``, at every ``width``-th row that has them all."""
    by = Window.partitionBy(*group).orderBy(order)
    rows = df.select(*group, order, F.avg(value).over(by.rowsBetween(0, width - 1)).alias("smooth"), F.count(value).over(by.rowsBetween(0, width - 1)).alias("_k"), F.row_number().over(by).alias("_i"))
    return rows.where((F.col("_k") == width) & ((F.col("_i") - 1) % width == 0)).drop("_k", "_i")


def warped_distances(pairs: DataFrame) -> DataFrame:
    """Dynamic-time-warping distance of columns a and b (arrays), beside the other columns; a numpy batch by row."""
    import numpy as np

    def distance(a: np.ndarray, b: np.ndarray) -> float:
        row = np.full(len(b) + 1, np.inf)
        row[0] = 0.0
        for x in a:
            cost, new = (b - x) ** 2, np.full(len(b) + 1, np.inf)
            for j in range(len(b)):
                new[j + 1] = cost[j] + min(row[j], row[j + 1], new[j])
            row = new
        return float(np.sqrt(row[-1]))

    def run(batches):
        for part in batches:
            part["distance"] = [distance(np.asarray(a, float), np.asarray(b, float)) for a, b in zip(part["a"], part["b"], strict=True)]
            yield part.drop(columns=["a", "b"])

    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema if f.name not in ("a", "b")]
    return pairs.mapInPandas(run, ", ".join([*rest, "distance double"]))


def resampled(df: DataFrame, new_length: int) -> DataFrame:
    """Signals at another rate by the Fourier method: ``samples`` with ``new_length`` values."""
    import numpy as np

    def run(batches):
        for part in batches:
            out = []
            for x in part["samples"]:
                x = np.asarray(x, float)
                spectrum = np.fft.rfft(x)
                keep = np.zeros(new_length // 2 + 1, complex)
                n = min(len(keep), len(spectrum))
                keep[:n] = spectrum[:n]
                if new_length < len(x) and new_length % 2 == 0:
                    keep[-1] = 2 * keep[-1].real
                out.append(np.fft.irfft(keep, new_length) * new_length / len(x))
            part["samples"] = out
            yield part

    return df.mapInPandas(run, df.schema)


def last_marked_end(intervals: DataFrame, key: list[str], mark: str, end: str) -> DataFrame:
    """``key``, last_end: where the last interval ends whose mark isn't null or blank; keys without one are left out."""
    marked = intervals.where(F.length(F.trim(F.regexp_replace(mark, r"\s", " "))) > 0)
    return marked.groupBy(*key).agg(F.max(end).alias("last_end"))


def windows_until(windows: DataFrame, ends: DataFrame, key: list[str], last: str) -> DataFrame:
    """Windows that end (``last``) at their key's last_end or before, with how far before; keys without an end give none."""
    rows = windows.join(ends.select(*key, "last_end"), key)
    return rows.where(F.col(last) <= F.col("last_end")).withColumn("ahead", F.col("last_end") - F.col(last))


def long_form(rows: DataFrame, keep: list[str], samples: str, start: float, rate: float) -> DataFrame:
    """``keep``, time (of each sample, from ``start`` at ``rate`` a second), value; a null or empty array gives no rows."""
    long = rows.select(*keep, F.posexplode(samples).alias("_i", "value"))
    return long.select(*keep, (F.lit(start) + F.col("_i") / F.lit(rate)).alias("time"), "value")


def with_contrast(own: DataFrame, others: DataFrame, label: str, flags: dict[str, object]) -> DataFrame:
    """Labelled rows above contrast rows: in these ``label`` is ``contrast`` and ``flags`` have the given values; columns that
    one side lacks are null there."""
    contrast = others.withColumn(label, F.lit("contrast")).withColumns({k: F.lit(v) for k, v in flags.items()})
    return own.unionByName(contrast, allowMissingColumns=True)
