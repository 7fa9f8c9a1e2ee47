"""Trial features as column expressions, and the per-subject feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sign_label(x: Column, low: str | Column, high: str | Column, none: str = "~") -> Column:
    return F.when(x < 0, low).when(x > 0, high).otherwise(none)


def coarse_level(x: Column, levels: dict[int, float]) -> Column:
    """Recode integer levels; a level not in ``levels`` becomes null."""
    out = F.lit(None).cast("double")
    for k, v in levels.items():
        out = F.when(x == k, F.lit(float(v))).otherwise(out)
    return out


def response_bin(x: Column, low: float = -1.0, high: float = 1.0, bins: int = 6) -> Column:
    """Centre of the right-closed bin of equal width that holds x; the lowest edge belongs to the first bin."""
    width = (high - low) / bins
    k = F.least(F.greatest(F.ceil((x - low) / width - 1e-9), F.lit(1)), F.lit(bins))
    return F.lit(low) + (k - 0.5) * width


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")


def seconds(sample: Column, t0: float = -0.4, rate: float = 100.0) -> Column:
    return sample / F.lit(rate) + F.lit(t0)


def sample_of(time: Column, t0: float = -0.4, rate: float = 100.0) -> Column:
    return F.round((time - t0) * rate).cast("int")


# fixed values: levels of a belief update of -5 to 5, and of one on mismatch trials
UPDATE_LEVELS = {-5: -5, -4: -5, -3: -2, -2: -2, -1: -2, 0: 0, 1: 2, 2: 2, 3: 2, 4: 5, 5: 5}
MISMATCH_LEVELS = {-5: -5, -4: -5, -3: -2, 3: 2, 4: 5, 5: 5}


def trial_features(trials: DataFrame) -> DataFrame:
    """Cues, mismatches, responses and labels of each trial; all minima, maxima and means are the subject's own.

    ``trials``: subject, epoch, step, lexical, slider, pair, left (the letter shown on the left). The sign of a response
    turns where the left letter isn't the pair's first. Sizes by subject are small, so they are joined back.
    """
    sign = F.when(F.col("left") != F.substring("pair", 1, 1), -1).otherwise(1)
    answer = sign * (F.col("slider") - 5.5) / 4.5
    ranges = [F.min(answer).alias("_low"), F.max(answer).alias("_high")]
    stats = trials.groupBy("subject").agg(F.min("step").alias("_lo"), F.max("step").alias("_hi"), (F.sum_distinct("step") / F.count_distinct("step")).alias("_mid"), *ranges)
    rows = trials.join(stats, "subject")
    span = F.nullif((F.col("_hi") - F.col("_lo")).cast("double"), F.lit(0.0))
    rows = rows.withColumn("linear_cue", (F.col("step") - F.col("_mid")) / span * 2).withColumn("category_cue", F.when(F.col("linear_cue") > 0, 1).otherwise(-1)).withColumn("lexical_cue", 2 * F.col("lexical") - 1)
    rows = rows.withColumn("ambiguity", (2.5 - F.abs(F.col("step") - 3.5)) / 2).withColumn("mismatch", F.when(F.col("category_cue") != F.col("lexical_cue"), 1).otherwise(-1))
    rows = rows.withColumn("directed_mismatch", F.when(F.col("mismatch") == 1, F.col("lexical_cue")).otherwise(0))
    rows = rows.withColumn("belief_update", (F.col("lexical_cue") - F.col("linear_cue")) / 2).withColumn("belief_level", (F.col("belief_update") * 5).cast("int"))
    rows = rows.withColumn("coarse_update", coarse_level(F.col("belief_level"), UPDATE_LEVELS)).withColumn("coarse_mismatch", coarse_level(F.col("belief_level"), MISMATCH_LEVELS))
    rows = rows.withColumn("stratum", F.concat_ws(" ", "pair", F.when(F.col("mismatch") == 1, "mismatch").otherwise("match")))
    first, second = F.substring("pair", 1, 1), F.substring("pair", 2, 1)
    rows = rows.withColumn("heard", F.when(F.col("category_cue") < 0, first).otherwise(second)).withColumn("meant", F.when(F.col("lexical_cue") < 0, first).otherwise(second))
    rows = rows.withColumn("response_sign", sign).withColumn("linear_response", answer).withColumn("response_bin", F.round(response_bin(F.col("linear_response")), 6))
    rows = rows.withColumn("forced_response", F.signum("linear_response").cast("int")).withColumn("dummy_response", F.when(F.col("slider").isin(5.0, 6.0), 0).otherwise(F.col("forced_response"))).withColumn("forced_dummy", (F.col("forced_response") > 0).cast("int"))
    low, high = F.col("_low"), F.col("_high")
    rows = rows.withColumn("rescaled_step", (F.col("step") - F.col("_lo")) / span * (high - low) + low).withColumn("response_shift", F.col("linear_response") - F.col("rescaled_step")).withColumn("bin_shift", F.col("response_bin") - F.col("rescaled_step"))
    rows = rows.withColumn("response_label", sign_label(F.col("dummy_response"), first, second)).withColumn("forced_label", F.when(F.col("forced_response") < 0, first).when(F.col("forced_response") > 0, second))
    rows = rows.withColumn("follows_acoustics", F.col("forced_response") == F.col("category_cue"))
    rows = rows.withColumn("ignores_both", (F.col("meant") == F.col("heard")) & (F.col("meant") != F.col("response_label")))
    rows = rows.withColumn("meant_answered", F.concat(F.lit("L"), "meant", F.lit("B"), "response_label")).withColumn("heard_mark", F.concat(F.lit("A"), "heard")).withColumn("answer_mark", F.concat(F.lit("B"), "response_label"))
    for name, cue in (("answer_by_acoustics", "category_cue"), ("answer_by_lexical", "lexical_cue"), ("answer_by_mismatch", "directed_mismatch")):
        rows = rows.withColumn(name, F.col("dummy_response") * F.col(cue))
    return rows.withColumn("inference", F.concat("heard", F.lit("→"), "meant")).drop("_lo", "_hi", "_mid", "_low", "_high")


def zero_crossings(features: DataFrame) -> DataFrame:
    """Per subject and pair, the place among its steps after which the mean response on match trials changes sign, and
    the side of all their responses' mean (-1 below 0, else 1): subject, pair, crossing, side."""
    match = features.where("mismatch = -1")
    mean = match.groupBy("subject", "pair", "step").agg(F.round(F.avg("linear_response"), 9).alias("m"), F.sum("linear_response").alias("_s"))
    order = Window.partitionBy("subject", "pair").orderBy("step")
    marked = mean.withColumn("place", F.row_number().over(order)).withColumn("change", F.signum("m") != F.signum(F.lag("m").over(order)))
    return marked.groupBy("subject", "pair").agg(F.min(F.when(F.col("change"), F.col("place") - 1)).alias("crossing"), F.when(F.round(F.sum("_s"), 9) < 0, -1).otherwise(1).alias("side"))


def own_acoustics(features: DataFrame) -> DataFrame:
    """Adds own_cue: -1 for steps up to the subject's crossing for the pair and 1 above; without one, the side; 0 for a
    pair without match trials."""
    found = features.join(zero_crossings(features), ["subject", "pair"], "left")
    by_step = F.when(F.col("step") <= F.col("crossing"), -1).when(F.col("crossing").isNotNull(), 1)
    return found.withColumn("own_cue", F.coalesce(by_step, F.col("side"), F.lit(0))).drop("crossing", "side")


TARGETS = {"acoustic": "category_cue", "lexical": "lexical_cue", "response": "forced_response", "mismatch": "mismatch", "directed_mismatch": "directed_mismatch"}


def select_target(features: DataFrame, name: str) -> DataFrame:
    """Rows with a column target: the named feature as 0/1 (above 0). Rows where it is 0 are no part of the task."""
    if name not in TARGETS:
        raise ValueError(f"no target {name}")
    return features.where(F.col(TARGETS[name]) != 0).withColumn("target", (F.col(TARGETS[name]) > 0).cast("int"))
