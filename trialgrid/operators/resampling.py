"""Draws between populations: counterfactual correlations across subjects, size-matched control sets, pooled pseudo-trials.

All draws come from arithmetic on keys and the draw's number, so a rerun has the same ones. Every draw is a row that is
ranked or joined in Spark; no group's trials are gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.operators.quantiles import _small, average_ranks, correlation
from trialgrid.operators.relational import hash_order, seeded_places
from trialgrid.sources.storage import stored

#: Sites whose ranks stand beside each other in a row of draws.
SITES = 8


def counterfactual_draws(outputs: DataFrame, trials: DataFrame, subject: str, condition: list[str], stratum: list[str], trial: str, value: str, repeats: int) -> DataFrame:
    """Another subject's outputs in place of a subject's own: ``subject``, ``condition``, other, repeat, ``trial``, ``value``.

    ``outputs``: subject, condition, stratum, trial, value. ``trials``: subject, condition, stratum, trial. Trials of the
    same condition and stratum stand for each other. In each repeat the other subject's trials of a stratum are put in a
    new order, and those needed are taken from its beginning; where it has too few they are drawn with replacement. A
    subject that lacks a stratum isn't an other of those who have it. Keys are not null.
    """
    drawn, pairs = _drawn(outputs, trials, subject, condition, stratum, trial, value, repeats)
    return drawn.join(_small(pairs.select("_pair", subject, "other", *condition).distinct(), pairs.count()), "_pair").select(subject, *condition, "other", "repeat", trial, value)


def _drawn(outputs: DataFrame, trials: DataFrame, subject: str, condition: list[str], stratum: list[str], trial: str, value: str, repeats: int, beside: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The draws (_pair, repeat, ``trial``, ``value``), and the pairs: subject, other, condition, stratum, _need, _have, _base, _pair.

    ``beside`` (subject, condition, trial and more columns) goes with the trials into the draws. Trials of which the other
    has enough meet all others by place in one join, so they are shuffled once and not once for each other and repeat;
    those drawn anew look their place up by one number.
    """
    key = [*condition, *stratum]
    # tables of groups, not of trials
    have = outputs.groupBy(subject, *key).agg(F.count("*").alias("_have")).withColumnRenamed(subject, "other")
    before = Window.partitionBy(F.lit(0)).orderBy("other", *key).rowsBetween(Window.unboundedPreceding, -1)
    have = stored(have.withColumn("_base", F.coalesce(F.sum("_have").over(before), F.lit(0))))
    need = stored(trials.groupBy(subject, *key).agg(F.count("*").alias("_need")))
    strata = need.groupBy(subject, *condition).agg(F.count("*").alias("_strata"))
    both = need.join(have, key).where(F.col(subject) != F.col("other"))
    whole = both.groupBy(subject, "other", *condition).agg(F.count("*").alias("_met")).join(strata, [subject, *condition]).where("_met = _strata")
    whole = whole.withColumn("_pair", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(subject, "other", *condition)))
    pairs = stored(both.join(whole.select(subject, "other", *condition, "_pair"), [subject, "other", *condition]))
    few = lambda df: _small(df, df.count())

    numbers = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat")
    given = seeded_places(outputs.select(F.col(subject).alias("other"), *key, trial, value, numbers), ["other", *key, "repeat"], hash_order(trial, "repeat"), trial)
    given = stored(given.drop(trial).join(few(have), ["other", *key]))
    wanted = seeded_places(trials.select(subject, *key, trial), [subject, *key], hash_order(trial), trial, "place")
    if beside is not None:
        wanted = wanted.join(beside, [subject, *condition, trial])
    wanted = stored(wanted)
    more = [c for c in wanted.columns if c not in [subject, *key, trial, "place"]]
    out = ["_pair", "repeat", trial, *more, value]

    enough = wanted.join(few(need), [subject, *key]).join(given.drop("_base"), [*key, "place"]).where((F.col(subject) != F.col("other")) & (F.col("_need") <= F.col("_have")))
    enough = enough.join(few(pairs.select(subject, "other", *key, "_pair")), [subject, "other", *key]).select(*out)
    short = wanted.drop("place").join(few(pairs.where("_need > _have")), [subject, *key]).select("*", numbers)
    anew = F.col("_base") + F.pmod(hash_order(trial, F.col("repeat") + repeats), F.col("_have"))
    short = short.select("_pair", "repeat", trial, *more, (anew * repeats + F.col("repeat")).alias("_at"))
    known = given.select(((F.col("_base") + F.col("place") - 1) * repeats + F.col("repeat")).alias("_at"), value)
    return enough.unionByName(short.join(known, "_at").select(*out)), pairs


def counterfactual_correlations(outputs: DataFrame, responses: DataFrame, subject: str, condition: list[str], site: str, stratum: list[str], trial: str, value: str, response: str, repeats: int) -> DataFrame:
    """Spearman's correlation of each site's responses with other subjects' outputs: subject, condition, site, other, repeat, r.

    ``responses``: subject, condition, site, stratum, trial, response, all sites of a subject over the same trials. Draws
    and their ranks are made once for a subject and not once for a site. A trial carries the ranks of its responses, up to
    SITES of them beside each other, into its draws; these are shuffled once, by pair of subjects and repeat, and summed
    by distinct value, and the values' ranks and all sums of a correlation follow from that. r is null where a side is
    constant.
    """
    at = [subject, *condition, trial]
    place = F.row_number().over(Window.partitionBy(subject, *condition).orderBy(site)) - 1
    sites = stored(responses.select(subject, *condition, site).distinct().withColumn("_s", place))
    found = sites.agg(F.max("_s").alias("most"), F.count("*").alias("n")).first()
    width = min(SITES, (found.most or 0) + 1)
    blocks = (found.most or 0) // width + 1
    # the mean of average ranks is known, so ranks are centred before they are multiplied
    means = responses.groupBy(subject, *condition, site).agg(((F.count(response) + 1) / 2).alias("_mean")).join(sites, [subject, *condition, site])
    ranked = average_ranks(responses.select(*at, site, response), response, [subject, *condition, site], "_ry").join(_small(means, found.n), [subject, *condition, site])
    ys = [f"_y{i}" for i in range(width)]
    centred = F.col("_ry") - F.col("_mean")
    beside = ranked.groupBy(*at, F.floor(F.col("_s") / width).alias("_block")).agg(*[F.max(F.when(F.col("_s") % width == i, centred)).alias(y) for i, y in enumerate(ys)])
    drawn, pairs = _drawn(outputs, responses.select(subject, *condition, *stratum, trial).distinct(), subject, condition, stratum, trial, value, repeats, beside)

    draw = ((F.col("_pair").cast("long") * repeats + F.col("repeat")) * blocks + F.col("_block")).alias("_d")
    # dealt by draw before it is summed: a draw's values are too many for sums before the shuffle to save anything
    rows = drawn.select(draw, value, *ys).repartition(int(drawn.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_d")
    cells = rows.groupBy("_d", value).agg(F.count(value).alias("_k"), *[f for y in ys for f in (F.count(y).alias(f"{y}c"), F.sum(y).alias(f"{y}s"), F.sum(F.col(y) * F.col(y)).alias(f"{y}q"))])
    below = F.coalesce(F.sum("_k").over(Window.partitionBy("_d").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = F.when(F.col(value).isNotNull(), below + (F.col("_k") - F.sum("_k").over(Window.partitionBy("_d"))) / 2)
    cells = cells.withColumn("_x", x)
    known, sums = F.col("_x").isNotNull(), []
    for y in ys:
        c, s = F.col(f"{y}c"), F.col(f"{y}s")
        both = [F.sum(F.when(known, v)) for v in (c, F.col("_x") * c, s, F.col("_x") * s)]
        cov = F.try_divide(both[3] - F.try_divide(both[1] * both[2], both[0]), both[0])
        var_y = F.try_divide(F.sum(f"{y}q") - F.try_divide(F.sum(s) * F.sum(s), F.sum(c)), F.sum(c))
        var_x = F.try_divide(F.sum(F.col("_k") * F.col("_x") * F.col("_x")), F.sum("_k"))
        sums.append(F.try_divide(cov, F.sqrt(F.when((var_x > 1e-12) & (var_y > 1e-12), var_x * var_y))))
    r = cells.groupBy("_d").agg(F.array(*sums).alias("_rs")).select("_d", F.posexplode("_rs").alias("_i", "r"))
    number = F.floor(F.col("_d") / blocks)
    r = r.select(F.floor(number / repeats).cast("int").alias("_pair"), (number % repeats).cast("int").alias("repeat"), (F.col("_d") % blocks * width + F.col("_i")).cast("int").alias("_s"), "r")
    named = pairs.select("_pair", subject, *condition, "other").distinct().join(sites, [subject, *condition])
    return named.join(r, ["_pair", "_s"]).select(subject, *condition, site, "other", "repeat", "r")


def observed_correlations(outputs: DataFrame, responses: DataFrame, subject: str, condition: list[str], site: str, trial: str, value: str, response: str) -> DataFrame:
    """The same with the subject's own outputs, trial by trial: subject, condition, site, r."""
    key = [subject, *condition]
    ranked = average_ranks(outputs.select(*key, trial, value), value, key, "_rx").select(*key, trial, "_rx")
    rows = average_ranks(responses.select(*key, site, trial, response), response, [*key, site], "_ry").join(ranked, [*key, trial])
    return rows.groupBy(*key, site).agg(correlation("_rx", "_ry").alias("r"))


def control_sets(targets: DataFrame, candidates: DataFrame, group: list[str], site: str, set_: str, draws: int) -> DataFrame:
    """Size-matched controls: ``set_``, draw, ``group``, ``site``.

    For each set of ``targets`` (set_, group, site) and each draw, as many ``candidates`` (group, site) of a group as the
    set has sites in it, without replacement in a draw, each draw on its own. No site of any set is drawn. A group with
    fewer candidates than that gives all it has. Sets and sites are integers; repeated rows count once.
    """
    targets = targets.select(set_, *group, site).distinct()
    free = candidates.select(*group, site).distinct().join(targets.select(*group, site).distinct(), [*group, site], "left_anti")
    sizes = targets.groupBy(set_, *group).agg(F.count("*").alias("_k"))
    numbered = sizes.select(set_).distinct().select(set_, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    pool = free.join(sizes, group).join(numbered, set_)
    seed = F.col(set_).cast("long") * draws + F.col("draw")
    placed = seeded_places(pool, [set_, "draw", *group], hash_order(site, seed), site)
    return placed.where("place <= _k").select(set_, "draw", *group, site)


def pseudo_trials(trials: DataFrame, subject: str, condition: list[str], stratum: list[str], trial: str, draw: int = 0) -> DataFrame:
    """Trials of several subjects aligned by place: ``condition``, ``stratum``, place (from 1), ``subject``, ``trial``.

    Each subject gives equally many trials of each stratum: as many as the least that any subject has in any stratum of
    the whole table, taken in the draw's order. A stratum that a subject of the condition lacks isn't used.
    """
    key = [*condition, *stratum]
    counts = trials.groupBy(subject, *key).agg(F.count("*").alias("_n"))
    least = counts.agg(F.min("_n").alias("_least"))  # one row
    subjects = counts.select(subject, *condition).distinct().groupBy(*condition).agg(F.count("*").alias("_subjects"))
    shared = counts.groupBy(*key).agg(F.count("*").alias("_in")).join(subjects, condition).where("_in = _subjects").select(*key)
    placed = seeded_places(trials.select(subject, *key, trial).join(shared, key, "left_semi"), [subject, *key], hash_order(trial, draw), trial)
    return placed.crossJoin(F.broadcast(least)).where("place <= _least").select(*key, "place", subject, trial)


def pooled_features(placed: DataFrame, signals: DataFrame, members: DataFrame, population: str, subject: str, condition: list[str], stratum: list[str], trial: str, site: str, x: str) -> DataFrame:
    """Features of pooled populations: ``population``, ``condition``, ``stratum``, place, x, parts.

    ``members`` (population, subject, site) may put a site into many populations. ``signals`` has a vector x a trial and
    site. The vectors of all members are set one after the other in the order of (subject, site); parts says how many.
    A pseudo-trial for which a member has no vector isn't used, so all rows of a population have the same features.
    """
    members = members.select(population, subject, site).distinct()
    sizes = members.groupBy(population).agg(F.count("*").alias("_size"))
    key = [population, *condition, *stratum, "place"]
    rows = placed.join(signals.select(subject, trial, site, x), [subject, trial]).join(members, [subject, site])
    gathered = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(subject, site, x))).alias("_parts")).join(sizes, population).where(F.size("_parts") == F.col("_size"))
    return gathered.select(*key, F.flatten(F.transform("_parts", lambda p: p[x])).alias(x), F.size("_parts").alias("parts"))
