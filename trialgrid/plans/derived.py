"""Derived labels, joins, unions, rankings and checks over the stand-in views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trialgrid.functions import features as ft
from trialgrid.functions.special import t_p
from trialgrid.operators import auc, derived as dv
from trialgrid.plans.registry import FEATURES, GAINS, MEANS, PEAKS, _means, query
from trialgrid.sources.tables import epochs, predictions, table, trials

_MATCH = f"""SELECT subject, pair, min(CASE WHEN s <> p THEN place - 1 END)::INT AS crossing, CASE WHEN round(sum(t), 9) < 0 THEN -1 ELSE 1 END AS side FROM (
  SELECT *, row_number() OVER w AS place, sign(m) AS s, sign(lag(m) OVER w) AS p FROM (SELECT subject, pair, step, sum(linear_response) AS t, round(avg(linear_response), 9) AS m FROM ({FEATURES}) WHERE mismatch = -1 GROUP BY subject, pair, step) WINDOW w AS (PARTITION BY subject, pair ORDER BY step)) GROUP BY subject, pair"""


@query(f"""SELECT f.epoch, CASE WHEN f.step <= z.crossing THEN -1 WHEN z.crossing IS NOT NULL THEN 1 ELSE coalesce(z.side, 0) END AS own_cue FROM ({FEATURES}) f LEFT JOIN ({_MATCH}) z USING (subject, pair)""")
def own_acoustics(spark, d):
    """Each trial's cue by its subject's own crossing."""
    return ft.own_acoustics(ft.trial_features(trials(spark, d))).select("epoch", "own_cue")


@query(" UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n, sum(({c} > 0)::INT)::BIGINT AS n_pos FROM ({FEATURES}) WHERE {c} <> 0" for name, c in ft.TARGETS.items()))
def target_selection(spark, d):
    rows = ft.trial_features(trials(spark, d))
    outs = [ft.select_target(rows, name).agg(F.count("*").alias("n"), F.sum("target").alias("n_pos")).select(F.lit(name).alias("name"), "n", "n_pos") for name in ft.TARGETS]
    return dv.labelled_union(dict(zip(ft.TARGETS, outs, strict=True)), None)


@query("SELECT pair, step, response, count(*) AS n FROM v_trials WHERE NOT (step = 1 AND response = 1) AND NOT (step = 6 AND response = 0) GROUP BY pair, step, response")
def consistent_trials(spark, d):
    return dv.consistent(trials(spark, d)).groupBy("pair", "step", "response").agg(F.count("*").alias("n"))


# curated results: stand-in on orders

_CURATED = """SELECT o_orderkey AS effect, concat_ws('_', o_custkey % 10, o_custkey, ['bm', 'dn', 'pb'][o_custkey % 3 + 1]) AS site_key, CASE o_orderstatus WHEN 'O' THEN '+' WHEN 'F' THEN '-' END AS "left",
  CASE WHEN o_orderpriority < '3' THEN '+' WHEN o_orderpriority < '4' THEN '-' END AS "right", CASE WHEN o_orderpriority LIKE '5%' THEN 'drop' WHEN o_orderpriority LIKE '4%' THEN NULL ELSE 'sustained' END AS pattern,
  CASE o_orderkey % 3 WHEN 0 THEN 'n' WHEN 1 THEN 'y' END AS tracks, ['bm', 'dn', 'pb'][o_custkey % 3 + 1] AS pair, ['/b/ > /m/', '/n/ > /d/', '/p/ = /b/', NULL][o_orderkey % 4 + 1] AS tuning, o_totalprice AS p FROM orders"""


def _curated(spark, d):
    o = table(spark, d, "orders")
    pair = F.element_at(F.array(F.lit("bm"), F.lit("dn"), F.lit("pb")), (F.col("o_custkey") % 3 + 1).cast("int"))
    tuning = F.element_at(F.array(F.lit("/b/ > /m/"), F.lit("/n/ > /d/"), F.lit("/p/ = /b/"), F.lit(None)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("effect"), dv.site_key(F.col("o_custkey") % 10, F.col("o_custkey"), pair).alias("site_key"), F.when(F.col("o_orderstatus") == "O", "+").when(F.col("o_orderstatus") == "F", "-").alias("left"),
        F.when(F.col("o_orderpriority") < "3", "+").when(F.col("o_orderpriority") < "4", "-").alias("right"), F.when(F.col("o_orderpriority").startswith("5"), "drop").when(~F.col("o_orderpriority").startswith("4"), "sustained").alias("pattern"),
        F.when(F.col("o_orderkey") % 3 == 0, "n").when(F.col("o_orderkey") % 3 == 1, "y").alias("tracks"), pair.alias("pair"), tuning.alias("tuning"), F.col("o_totalprice").alias("p"),
    )


_POLAR = "CASE {} WHEN '+' THEN 1 WHEN '-' THEN -1 ELSE 0 END"
_L, _R = _POLAR.format('"left"'), _POLAR.format('"right"')
_CLEAN = f"""SELECT effect, site_key, pair, p, {_L} AS left_polarity, {_R} AS right_polarity, abs({_L}) + abs({_R}) = 1 AND {_L} + {_R} = 1 AS one_sided_positive, abs({_L}) + abs({_R}) = 1 AND {_L} + {_R} = -1 AS one_sided_negative,
  tracks IS NULL OR tracks <> 'n' AS tracking, coalesce(tuning = '/' || pair[1] || '/ > /' || pair[2] || '/', false) AS left_dominant, coalesce(tuning = '/' || pair[2] || '/ > /' || pair[1] || '/', false) AS right_dominant, contains(tuning, '=') AS tuned_both
  FROM ({_CURATED}) WHERE pattern NOT IN ('drop', 'dupe')"""


@query(_CLEAN, ("p",))
def curated_effects(spark, d):
    return dv.clean_effects(_curated(spark, d)).select("effect", "site_key", "pair", "p", "left_polarity", "right_polarity", "one_sided_positive", "one_sided_negative", "tracking", "left_dominant", "right_dominant", "tuned_both")


@query(f"SELECT site_key, effect, p FROM (SELECT *, row_number() OVER (PARTITION BY site_key ORDER BY p, effect) AS k FROM ({_CLEAN})) WHERE k = 1", ("p",))
def strongest_effects(spark, d):
    """One effect a site and pair: the one with the least p."""
    return auc.best_row(dv.clean_effects(_curated(spark, d)), ["site_key"], [F.col("p"), F.col("effect")]).select("site_key", "effect", "p")


@query("SELECT o_orderkey AS id, split_part(o_orderpriority, '-', 1) AS head, CASE WHEN contains(o_orderpriority, '-') AND split_part(o_orderpriority, '-', 2) <> 'NOT SPECIFIED' THEN lower(split_part(o_orderpriority, '-', 2)) ELSE 'none' END AS tail FROM orders")
def split_with_default(spark, d):
    head, tail = dv.split_default(F.col("o_orderpriority"), "-", "none", {"NOT SPECIFIED": "none"})
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), head.alias("head"), F.lower(tail).alias("tail"))


# two-sided results: stand-in on predictions

_SIDES = "SELECT epoch, smin, proba + 0.001 AS p_left, baseline_proba + 0.001 AS p_right, site AS n_left, target AS n_right FROM v_predictions"


@query(f"SELECT epoch, smin, least(p_left, p_right) AS p_min, CASE WHEN p_left <= p_right THEN 'left' ELSE 'right' END AS side, CASE WHEN p_left <= p_right THEN n_left ELSE n_right END AS n, -log10(least(p_left, p_right)) AS strength FROM ({_SIDES})", ("p_min", "strength"))
def winning_side(spark, d):
    rows = predictions(spark, d).select("epoch", "smin", (F.col("proba") + 0.001).alias("p_left"), (F.col("baseline_proba") + 0.001).alias("p_right"), F.col("site").alias("n_left"), F.col("target").cast("long").alias("n_right"))
    return dv.winning_side(rows, "p", ["n"]).select("epoch", "smin", "p_min", "side", "n", (-F.log10("p_min")).alias("strength"))


@query("SELECT epoch, smin, CASE WHEN greatest(proba, baseline_proba) - 0.05 > 0.01 THEN CASE WHEN proba >= baseline_proba THEN 'full' ELSE 'baseline' END WHEN greatest(proba, baseline_proba) - 0.05 < -0.01 THEN 'third' ELSE 'none' END AS preference FROM v_predictions")
def margin_preference(spark, d):
    return predictions(spark, d).select("epoch", "smin", dv.margin_preference({"full": F.col("proba"), "baseline": F.col("baseline_proba")}, F.lit(0.05), "third", 0.01).alias("preference"))


@query("SELECT epoch, smin, CASE WHEN target = 0 THEN 1 - proba ELSE proba END AS p_true, greatest(proba - 0.05, 0) AS clipped, CASE WHEN proba - 0.05 >= 0 THEN proba - 0.05 END AS masked FROM v_predictions", ("p_true", "clipped", "masked"))
def true_class_probability(spark, d):
    x = F.col("proba") - 0.05
    return predictions(spark, d).select("epoch", "smin", F.when(F.col("target") == 0, 1 - F.col("proba")).otherwise(F.col("proba")).alias("p_true"), F.greatest(x, F.lit(0.0)).alias("clipped"), F.when(x >= 0, x).alias("masked"))


@query("SELECT site, smin, mean_auc, mean_auc > 0.5 AND n_folds >= 3 AS kept FROM (" + MEANS + ") WHERE mean_auc > 0.45 AND n_folds >= 2", ("mean_auc",))
def filtered_means(spark, d):
    """A user's filter string, then a threshold and a control threshold."""
    rows = dv.filtered(_means(spark, d), "mean_auc > 0.45 and n_folds >= 2")
    return rows.select("site", "smin", "mean_auc", ((F.col("mean_auc") > 0.5) & (F.col("n_folds") >= 3)).alias("kept"))


# joins

_BY = "SELECT subject, pair, min(step) AS first_step, max(step) AS last_step, avg(value) AS score FROM v_trials GROUP BY subject, pair"


def _by_pair(spark, d):
    return trials(spark, d).groupBy("subject", "pair").agg(F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.avg("value").alias("score"))


@query(f"SELECT a.subject, b.subject AS other, a.pair, a.score - b.score AS gap FROM ({_BY}) a JOIN ({_BY}) b ON a.pair = b.pair AND a.subject <> b.subject", ("gap",))
def other_subjects(spark, d):
    """Same pair, another subject: the rows are subjects and pairs, not trials."""
    a, b = _by_pair(spark, d).alias("a"), _by_pair(spark, d).alias("b")
    return a.join(b, (F.col("a.pair") == F.col("b.pair")) & (F.col("a.subject") != F.col("b.subject"))).select("a.subject", F.col("b.subject").alias("other"), "a.pair", (F.col("a.score") - F.col("b.score")).alias("gap"))


@query("SELECT a.channel AS a, b.channel AS b, corr(a.x, b.x) AS r, sqrt(avg(pow(a.x - b.x, 2))) AS distance FROM (SELECT channel, pos, avg(x) AS x FROM v_samples GROUP BY channel, pos) a JOIN (SELECT channel, pos, avg(x) AS x FROM v_samples GROUP BY channel, pos) b ON a.pos = b.pos AND a.channel < b.channel GROUP BY a.channel, b.channel", ("r", "distance"))
def channel_pairs(spark, d):
    """All pairs of channels once: distance and correlation of their average traces."""
    trace = epochs(spark, d).select("channel", F.posexplode("samples").alias("pos", "x")).groupBy("channel", "pos").agg(F.avg("x").alias("x"))
    both = trace.toDF("a", "pos", "x").join(trace.toDF("b", "pos", "y"), "pos").where("a < b")
    return both.groupBy("a", "b").agg(F.corr("x", "y").alias("r"), F.sqrt(F.avg(F.pow(F.col("x") - F.col("y"), F.lit(2)))).alias("distance"))


_RATIO = f"""SELECT site, word, smin, fold, max("full") AS "full", max(baseline) AS baseline FROM ({GAINS}) GROUP BY site, word, smin, fold"""


@query(f"""SELECT o.site, o.smin, o.fold, o."full" / o.baseline AS ratio_o, f."full" / f.baseline AS ratio_f, o."full" / o.baseline - f."full" / f.baseline AS difference FROM ({_RATIO}) o JOIN ({_RATIO}) f USING (site, smin, fold) WHERE o.word = 'O' AND f.word = 'F' AND o.baseline > 0 AND f.baseline > 0""", ("ratio_o", "ratio_f", "difference"))
def word_ratios(spark, d):
    """Ratios of full to baseline scores of both words on the same site, window and fold; the word is part of each key."""
    rows = auc.compared_auc(predictions(spark, d)).where("baseline > 0").select("site", "smin", "fold", "word", (F.col("full") / F.col("baseline")).alias("ratio"))
    o, f = (rows.where(F.col("word") == w).drop("word").withColumnRenamed("ratio", f"ratio_{w.lower()}") for w in "OF")
    return o.join(f, ["site", "smin", "fold"]).withColumn("difference", F.col("ratio_o") - F.col("ratio_f"))


@query(f"SELECT e.site, e.smin AS smin_early, l.smin AS smin_late, e.mean_auc AS auc_early, l.mean_auc AS auc_late FROM ({MEANS}) e JOIN ({MEANS}) l ON e.site = l.site AND l.smin = e.smin + 3 WHERE e.smin <= 3", ("auc_early", "auc_late"))
def early_with_late(spark, d):
    return dv.early_late(_means(spark, d).select("site", "smin", "mean_auc").withColumnRenamed("mean_auc", "auc"), ["site"], "smin", 3, 3)


@query(f"""SELECT p.site, w.word, p.smin, g.gain FROM ({PEAKS}) p, (SELECT DISTINCT word FROM v_predictions) w LEFT JOIN (SELECT site, word, smin, avg(gain) AS gain FROM ({GAINS}) GROUP BY site, word, smin) g ON g.site = p.site AND g.word = w.word AND g.smin = p.smin""", ("gain",))
def candidate_words(spark, d):
    """Each peak with all words, and their gains in the peak's window."""
    pred = predictions(spark, d)
    gains = auc.compared_auc(pred).groupBy("site", "word", "smin").agg(F.avg("gain").alias("gain"))
    words = pred.select("word").distinct()  # two words
    return auc.peak_windows(pred).select("site", "smin").crossJoin(words).join(gains, ["site", "word", "smin"], "left").select("site", "word", "smin", "gain")


@query("SELECT u.epoch, u.word, w.n FROM (SELECT epoch, unnest(string_split(pair || ' ' || word, ' ')) AS word FROM v_trials) u LEFT JOIN (SELECT word, count(*) AS n FROM v_trials GROUP BY word) w USING (word)")
def exploded_labels(spark, d):
    """List column to rows, then a left join on the element."""
    t = trials(spark, d)
    long = t.select("epoch", F.explode(F.split(F.concat_ws(" ", "pair", "word"), " ")).alias("word"))
    return long.join(t.groupBy("word").agg(F.count("*").alias("n")), "word", "left").select("epoch", "word", "n")


@query(f"""SELECT p.site, p.smin AS peak_smin, p.mean_auc AS peak, g.best_gain, c.o AS n_o, c.f AS n_f, m.n_windows FROM ({PEAKS}) p LEFT JOIN (SELECT site, max(gain) AS best_gain FROM ({GAINS}) GROUP BY site) g USING (site)
  LEFT JOIN (SELECT site, count(*) FILTER (WHERE word = 'O') AS o, count(*) FILTER (WHERE word = 'F') AS f FROM v_predictions GROUP BY site) c USING (site) JOIN (SELECT site, count(*) AS n_windows FROM ({MEANS}) GROUP BY site) m USING (site)""", ("peak", "best_gain"))
def site_summary(spark, d):
    """Peaks with the best gain of another table, a pivoted count by word and the number of windows."""
    pred = predictions(spark, d)
    words = pred.groupBy("site").pivot("word", ["O", "F"]).count().select("site", F.coalesce("O", F.lit(0)).alias("n_o"), F.coalesce("F", F.lit(0)).alias("n_f"))
    gains = auc.compared_auc(pred).groupBy("site").agg(F.max("gain").alias("best_gain"))
    peaks = auc.peak_windows(pred).select("site", F.col("smin").alias("peak_smin"), F.col("mean_auc").alias("peak"))
    return peaks.join(gains, "site", "left").join(words, "site", "left").join(_means(spark, d).groupBy("site").agg(F.count("*").alias("n_windows")), "site")


@query("SELECT e.epoch, e.channel, g.s AS smin, e.cls FROM v_epochs e, (SELECT unnest(range(0, 57, 8))::INT AS s) g WHERE e.channel IN (0, 2)")
def chosen_channel_grid(spark, d):
    """Trials of chosen channels by all windows of a grid."""
    rows = epochs(spark, d).where(F.col("channel").isin(0, 2))
    return rows.select("epoch", "channel", F.explode(F.sequence(F.lit(0), F.lit(56), F.lit(8))).alias("smin"), "cls")


# aggregates, order, unions, checks

_ONCE = "SELECT site, word, epoch, fold, target, baseline_proba FROM (SELECT *, row_number() OVER (PARTITION BY site, word, epoch, fold ORDER BY smin, baseline_proba, target) AS k FROM v_predictions) WHERE k = 1"


@query(f"""SELECT site, word, count(*) AS n, sum(target)::BIGINT AS n_pos, CASE WHEN sum(target) > 0 AND sum(1 - target) > 0 THEN (sum(r * target) - sum(target) * (sum(target) + 1) / 2.0) / (sum(target) * sum(1 - target)) END AS baseline
  FROM (SELECT *, rank() OVER (PARTITION BY site, word ORDER BY baseline_proba) + (count(*) OVER (PARTITION BY site, word, baseline_proba) - 1) / 2.0 AS r FROM ({_ONCE})) GROUP BY site, word""", ("baseline",))
def baseline_once(spark, d):
    """Baseline AUC over one row a trial and fold, that of the earliest window."""
    key = ["site", "word", "epoch", "fold"]
    once = auc.best_row(predictions(spark, d), key, [F.col("smin"), F.col("baseline_proba"), F.col("target")])
    return auc.grouped_auc(once, "target", "baseline_proba", ["site", "word"], "baseline")


@query("SELECT site, min(proba) AS least, row_number() OVER (ORDER BY min(proba), site) AS place FROM v_predictions GROUP BY site", ("least",))
def least_of_site(spark, d):
    rows = predictions(spark, d).groupBy("site").agg(F.min("proba").alias("least"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy("least", "site")))  # a row per site


@query("SELECT min(n) AS fewest, max(n) AS most, count(*) AS cells FROM (SELECT count(*) AS n FROM v_trials GROUP BY subject, pair, step)")
def cell_sizes(spark, d):
    cells = trials(spark, d).groupBy("subject", "pair", "step").agg(F.count("*").alias("n"))
    return cells.agg(F.min("n").alias("fewest"), F.max("n").alias("most"), F.count("*").alias("cells"))


@query("SELECT site, smin, word, coalesce(word <> lag(word) OVER (PARTITION BY site ORDER BY smin, word), false) AS separator FROM (SELECT DISTINCT site, smin, word FROM v_predictions)")
def key_changes(spark, d):
    rows = predictions(spark, d).select("site", "smin", "word").distinct()
    return rows.withColumn("separator", dv.changed("word", ["site"], ["smin", "word"]))


@query(f"SELECT site, score FROM (SELECT site, avg(mean_auc) AS score FROM ({MEANS}) GROUP BY site) WHERE score > (SELECT quantile_cont(score, 0.75) FROM (SELECT site, avg(mean_auc) AS score FROM ({MEANS}) GROUP BY site))", ("score",))
def upper_quarter_sites(spark, d):
    return dv.above_percentile(_means(spark, d).groupBy("site").agg(F.avg("mean_auc").alias("score")), "score", 0.75)


@query("SELECT epoch, channel, list_position(samples, list_max(samples))::INT - 1 AS peak, row_number() OVER (PARTITION BY channel, cls ORDER BY list_position(samples, list_max(samples)), epoch) AS place FROM v_epochs")
def by_peak_position(spark, d):
    """Trials of a channel and class in the order of their largest sample's place."""
    rows = epochs(spark, d).withColumn("peak", (F.array_position("samples", F.array_max("samples")) - 1).cast("int"))
    return rows.select("epoch", "channel", "peak", F.row_number().over(Window.partitionBy("channel", "cls").orderBy("peak", "epoch")).alias("place"))


@query(f"SELECT site, smin, mean_auc, NULL::BIGINT AS n_trials, 'scores' AS source FROM ({MEANS}) UNION ALL SELECT site, smin, NULL, count(*), 'counts' FROM v_predictions GROUP BY site, smin", ("mean_auc",))
def aligned_union(spark, d):
    """Two tables with different columns, one under the other, with their names."""
    counts = predictions(spark, d).groupBy("site", "smin").agg(F.count("*").alias("n_trials"))
    return dv.labelled_union({"scores": _means(spark, d).select("site", "smin", "mean_auc"), "counts": counts}, "source")


@query("SELECT DISTINCT site FROM (SELECT site FROM v_predictions WHERE proba > 0.09 AND smin = 1 UNION ALL SELECT site FROM v_predictions WHERE baseline_proba > 0.07 AND smin = 2)")
def either_population(spark, d):
    p = predictions(spark, d)
    return p.where("proba > 0.09 and smin = 1").select("site").union(p.where("baseline_proba > 0.07 and smin = 2").select("site")).distinct()


@query("SELECT subject, n, n_windows, many FROM (SELECT subject, count(*) AS n, count(DISTINCT pair) AS n_windows, max(k) > 1 AS many FROM (SELECT *, count(*) OVER (PARTITION BY subject, pair, step) AS k FROM v_trials) GROUP BY subject)")
def join_cardinality(spark, d):
    """Whether the right side of a join by subject, pair and step would give a row more than once."""
    t = trials(spark, d)
    many = dv.repeats(t, ["subject", "pair", "step"]).groupBy("subject").agg(F.lit(True).alias("many"))
    return t.groupBy("subject").agg(F.count("*").alias("n"), F.count_distinct("pair").alias("n_windows")).join(many, "subject", "left").withColumn("many", F.coalesce("many", F.lit(False)))


@query("SELECT site, sum((smin <= 2)::INT)::BIGINT AS early, sum((smin BETWEEN 3 AND 5)::INT)::BIGINT AS late, sum((smin >= 6)::INT)::BIGINT AS other, count(*) AS n FROM v_predictions GROUP BY site")
def window_partitions(spark, d):
    """Rows of each window set; the sets cover all windows and are disjoint, or the query ends with an error."""
    parts = {"early": F.col("smin") <= 2, "late": F.col("smin").between(3, 5), "other": F.col("smin") >= 6}
    return dv.counted_partition(predictions(spark, d), parts, ["site"])


_Z = """SELECT site, smin, corr(proba, target) AS r FROM v_predictions GROUP BY site, smin"""


@query(f"SELECT site, true_r, z_mean, z_sd, n, (atanh(true_r) - z_mean) / nullif(z_sd, 0) AS z, n - 1 AS df FROM (SELECT site, max(CASE WHEN smin = 1 THEN r END) AS true_r, avg(CASE WHEN smin <> 1 THEN atanh(r) END) AS z_mean, stddev_samp(CASE WHEN smin <> 1 THEN atanh(r) END) AS z_sd, count(CASE WHEN smin <> 1 THEN r END) AS n FROM ({_Z}) WHERE abs(r) < 1 GROUP BY site)", ("true_r", "z_mean", "z_sd", "z"))
def counterfactual_z(spark, d):
    """The observed correlation (first window) against those of the others as counterfactuals, on Fisher's scale."""
    r = predictions(spark, d).groupBy("site", "smin").agg(F.corr("proba", "target").alias("r")).where("abs(r) < 1")
    return dv.counterfactual_z(r.where("smin = 1").select("site", "r"), r.where("smin != 1").select("site", "r"), ["site"])


def counterfactual_p(spark, d):
    """As ``counterfactual_z``, with the two-sided tail of t."""
    return counterfactual_z(spark, d).where("n > 1 and z is not null").withColumn("p", t_p("z", "df"))


_FIT = "SELECT l_suppkey AS site, l_linenumber AS model, sum(pow(l_extendedprice / 1e5 - l_quantity * 0.015, 2)) AS rss, 1 - sum(pow(l_extendedprice / 1e5 - l_quantity * 0.015, 2)) / (var_pop(l_extendedprice / 1e5) * count(*)) AS r2 FROM lineitem GROUP BY l_suppkey, l_linenumber"


@query(f"SELECT b.site, b.model, b.r2 - a.r2 AS r2_gain, a.rss - b.rss AS rss_drop FROM ({_FIT}) a JOIN ({_FIT}) b ON a.site = b.site AND b.model = a.model + 1 WHERE isfinite(a.r2) AND isfinite(b.r2)", ("r2_gain", "rss_drop"))
def nested_models(spark, d):
    """What each model adds to the one before it."""
    y = F.col("l_extendedprice") / 1e5
    e = F.pow(y - F.col("l_quantity") * 0.015, F.lit(2))
    fit = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("site"), F.col("l_linenumber").alias("model")).agg(F.sum(e).alias("rss"), (1 - F.sum(e) / F.nullif(F.var_pop(y) * F.count("*"), F.lit(0.0))).alias("r2"))
    return dv.nested_gains(fit.where("r2 is not null"), ["site"], "model")
