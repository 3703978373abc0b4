"""Labels, sampling, training rows and rankers."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures
from checks.fixtures import FOLD, MODEL_FEATURES, SEED, World
from checks.registry import check, f32, r, step
from checks.steps import STRATUM, id_hash, is_active, pair_uniform
from morrow.operators import borders, listwise, rankers, sampling, union
from morrow.schemas import PAIR_KEYS


@check("R1_assign_binary_labels", "SELECT user_id, item_id, label FROM lab")
def _(w: World):
    return sampling.assign_labels(w.union, w.labels).select(*PAIR_KEYS, "label")


@check(
    "R2_sampling_uniform",
    f"SELECT user_id, item_id, {pair_uniform('user_id', 'item_id', 'canonical')} AS uniform FROM uni",
)
def _(w: World):
    from morrow.functions.hashing import with_pair_uniform

    return with_pair_uniform(w.union.select(*PAIR_KEYS), seed=SEED, fold=FOLD)


@check(
    "R3_negative_sampling",
    f"SELECT user_id, item_id, label, is_hard_negative, is_training_sample, {r('sampling_probability')} FROM lab",
)
def _(w: World):
    labeled = sampling.assign_labels(w.union, w.labels)
    table = sampling.sample_negatives(labeled, FOLD, fixtures.SAMPLING)
    return table.select(*PAIR_KEYS, "label", *sampling.TRAINING_METADATA)


# Folds for the allocation rows: the strata of retained rows under three fold names.
step("stratified", f"SELECT {STRATUM} AS sampling_stratum, label FROM lab WHERE is_training_sample")
step("foldnames", "SELECT * FROM (VALUES (0, 'rolling_1'), (1, 'rolling_2'), (2, 'canonical')) t(position, fold)")
step(
    "stratarows",
    """SELECT fold, s.name AS sampling_stratum, (SELECT count(*) FROM stratified t WHERE t.sampling_stratum = s.name) AS rows
    FROM foldnames CROSS JOIN (SELECT unnest(['positive', 'multi_collaborative_top50', 'multi_other',
      'single_item2item_top50', 'single_als_top50', 'easy_negative']) AS name) s""",
)
step(
    "budget",
    """SELECT fold, CAST(goal // 3 AS BIGINT) + CAST(position < goal % 3 AS INT) AS allocated, n, p
    FROM foldnames, (SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS p, CAST(3 * ((count(*) + sum(label)) // 2) AS BIGINT) AS goal FROM stratified)""",
)


FOLDS = ("rolling_1", "rolling_2", "canonical")


def _folds(w: World):
    names = F.array(*[F.lit(n) for n in FOLDS])
    return sampling.stratum_counts(w.labeled_union).withColumn("fold", F.explode(names))


def _goal(w: World) -> int:
    """A budget that fits at every scale: all positives and half of the negatives."""
    totals = sampling.fold_totals(_folds(w))
    return totals.agg(F.sum(F.floor((F.col("rows") + F.col("positives")) / 2))).first()[0]


@check(
    "R4_sampling_plan",
    f"""SELECT s.fold, sampling_stratum, rows AS source_rows, allocated AS target_rows, {r('f', 'first_stage_probability')},
    {r('q', 'second_stage_probability')}, {r('f * q', 'full_inclusion_probability')}, {r('1.0 / (f * q)', 'object_weight')}
    FROM (SELECT s.*, allocated, CASE WHEN sampling_stratum = 'easy_negative' THEN 0.05::DOUBLE ELSE 1.0 END AS f,
      CASE WHEN sampling_stratum = 'positive' THEN 1.0 ELSE (allocated - p) / CAST(n - p AS DOUBLE) END AS q
      FROM stratarows s JOIN budget USING (fold)) s""",
)
def _(w: World):
    return sampling.sampling_plan(_folds(w), _goal(w), FOLDS)


@check(
    "R5_allocated_probabilities",
    f"""SELECT fold, n AS source_rows, p AS positive_rows, least(allocated, n) AS target_rows,
    {r('least(1.0, (allocated - p) / CAST(n - p AS DOUBLE))', 'secondary_negative_probability')} FROM budget""",
)
def _(w: World):
    return sampling.allocate_probabilities(sampling.fold_totals(_folds(w)), _goal(w), FOLDS)


def _short(target: int, reason: str) -> str:
    """Folds of a budget that does not fit."""
    return f"""SELECT fold, p AS positives, n AS rows, a AS allocated FROM (
      SELECT fold, p, n, CAST({target} // 3 + CAST(position < {target} % 3 AS INT) AS BIGINT) AS a
      FROM foldnames JOIN budget USING (fold)) WHERE {reason}"""


@check("R4_infeasible_budgets", _short(10**9 + 1, "a <= p OR a > n"))
def _(w: World):
    return sampling.infeasible_plan(_folds(w), 10**9 + 1, FOLDS)


@check("R5_infeasible_budgets", _short(4, "n <= p OR a <= p"))
def _(w: World):
    return sampling.infeasible_allocations(sampling.fold_totals(_folds(w)), 4, FOLDS)


@check(
    "R6_dropped_positives",
    "SELECT user_id, item_id FROM lab WHERE label = 1 AND item_id % 5 = 0",
)
def _(w: World):
    kept = w.labeled_union.filter(F.col("item_id") % 5 != 0)
    return sampling.dropped_positives(w.labeled_union, kept)


def _second(fold_text: str, p: float) -> str:
    full = f"(CAST(sampling_probability AS DOUBLE) * CASE WHEN label = 1 THEN 1.0 ELSE {p} END)"
    return f"""SELECT user_id, item_id, '{FOLD}' AS fold_id, {STRATUM} AS sampling_stratum, label,
    {r(full, 'full_sampling_probability')}, {f32(f'1.0 / {full}', 'sample_weight')}, {r('source_count')}
    FROM (SELECT *, {pair_uniform('user_id', 'item_id', fold_text)} AS u FROM lab WHERE is_training_sample)
    WHERE label = 1 OR u < {p}"""


@check("R6_second_stage_rows", _second("task11:canonical", 0.4))
def _(w: World):
    return sampling.second_stage(
        w.labeled_union, fold=FOLD, seed=SEED, negative_probability=0.4, features=["source_count"]
    )


@check("R6_backtest_rows", _second("task12:train:canonical", 0.3))
def _(w: World):
    return sampling.second_stage(
        w.labeled_union, fold=FOLD, seed=SEED, negative_probability=0.3, features=["source_count"],
        stream=sampling.BACKTEST_STREAM,
    )


@check(
    "R7_weighted_rows",
    f"SELECT label, sample_weight, source_count FROM ({_second('canonical', 0.5)})",
)
def _(w: World):
    return sampling.weighted_rows(
        w.labeled_union, features=["source_count"], fold=FOLD, seed=SEED, negative_probability=0.5
    )


@check(
    "R8_sample_union",
    f"""SELECT user_id, item_id, label, {r('CASE WHEN label = 1 THEN 1.0 ELSE 10.0 END', 'sample_weight')}
    FROM (SELECT *, {pair_uniform('user_id', 'item_id', 'expanded_ranker:canonical')} AS u FROM lab)
    WHERE label = 1 OR u < 0.1""",
)
def _(w: World):
    table = sampling.sample_union(w.union, w.labels, fold=FOLD, seed=SEED, negative_probability=0.1)
    return table.select(*PAIR_KEYS, "label", "sample_weight")


step(
    "query_users",
    f"SELECT user_id FROM (SELECT DISTINCT user_id, {id_hash('user_id', 7)} AS h FROM e_truth) ORDER BY h, user_id LIMIT 30",
)


@check(
    "R9_grouped_rows",
    f"""SELECT label, group_id, item_id, {r('source_count')} FROM lab JOIN grp USING (user_id)
    WHERE is_training_sample AND user_id IN (SELECT user_id FROM query_users)""",
)
def _(w: World):
    users = sampling.complete_query_users(w.labels.select("user_id").distinct(), count=30, seed=7)
    return sampling.grouped_rows(w.labeled_union, w.groups, ["source_count"], users=users)


@check("R10_feature_binning")
def _(w: World):
    names = ["source_count", "cross_score_item2item", "user_daily_rows_all"]
    borders = rankers.border_lists(rankers.learn_borders(w.dataset, names, 16))
    binned = rankers.apply_borders(w.dataset.select(*PAIR_KEYS, *names), borders)
    return binned.groupBy("bin_cross_score_item2item").agg(F.count(F.lit(1)).alias("rows"))


@check("R10_bin_borders")
def _(w: World):
    return rankers.learn_borders(w.dataset, ["source_count", "cross_score_item2item"], 16)


@check(
    "R10_weighted_borders",
    """WITH entry AS (
      SELECT views AS weight, unnest(['watch_time', 'views', 'item_id', 'fixed']) AS feature,
             unnest([CAST(watch_time AS DOUBLE), views, item_id, 1]) AS value
      FROM hist),
    reached AS (
      SELECT feature, value,
             least(floor(sum(sum(weight)) OVER (PARTITION BY feature ORDER BY value)::DOUBLE * 16
                         / (sum(sum(weight)) OVER (PARTITION BY feature))::DOUBLE), 15) AS i
      FROM entry WHERE weight > 0 GROUP BY feature, value),
    crossed AS (
      SELECT feature, value, i > lag(i) OVER (PARTITION BY feature ORDER BY value) AS border FROM reached),
    placed AS (
      SELECT feature, value AS border, row_number() OVER (PARTITION BY feature ORDER BY value) AS place
      FROM crossed WHERE border)
    SELECT feature, coalesce(place, 0) AS place, coalesce(border, 0) AS border
    FROM (SELECT unnest(['watch_time', 'views', 'item_id', 'fixed']) AS feature) LEFT JOIN placed USING (feature)""",
)
def _(w: World):
    """Borders by the weight of the views, also of a feature without any."""
    rows = w.history.select("watch_time", "views", "item_id", F.lit(1).alias("fixed"))
    found = borders.weighted_borders(rows, rows.columns, 16, "views")
    placed = found.select("feature", F.posexplode_outer("borders").alias("place", "border"))
    return placed.select(
        "feature",
        F.coalesce(F.col("place") + 1, F.lit(0)).cast("long").alias("place"),
        F.coalesce("border", F.lit(0.0)).alias("border"),
    )


@check("R11_pointwise_ranker_fit")
def _(w: World):
    trees = w.tree_model.stages[-1]
    return w.spark.createDataFrame(
        [(i, t.numNodes, t.depth) for i, t in enumerate(trees.trees)], "tree int, nodes int, depth int"
    )


@check("R12_pointwise_ranker_predict")
def _(w: World):
    return rankers.predict_trees(w.tree_model, w.dataset).select(*PAIR_KEYS, "ranker_score")


@check("R13_tree_prefix_curve")
def _(w: World):
    margins = rankers.prefix_scores(w.tree_model, w.dataset, [2, 4, 8])
    return rankers.prefix_curve(margins, w.labels, w.targets, [2, 4, 8])


@check("R14_truncated_ranker")
def _(w: World):
    return rankers.truncated_scores(w.tree_model, w.dataset, 4).select(*PAIR_KEYS, "ranker_score")


@check("R15_feature_importance")
def _(w: World):
    return rankers.feature_importance(w.tree_model, MODEL_FEATURES)


@check("R16_group_ranker")
def _(w: World):
    score = w.group_model.score().alias("ranker_score")
    return rankers.evaluate_scores(w.dataset.select(*PAIR_KEYS, score), w.labels, w.targets)


LISTWISE_BORDERS = {
    "source_count": [2.0, 3.0, 4.0],
    "cross_score_item2item": [0.05, 0.1, 0.2, 0.4, 0.8],
    "cross_score_implicit_als": [-4.0, -2.0, 0.0, 2.0, 4.0],
}


def _listwise_rows(w: World):
    names = list(LISTWISE_BORDERS)
    return w.dataset.join(w.groups, "user_id").select("group_id", "label", *names)


def _bin_sql(name: str) -> str:
    return "+".join(f"CAST({name} >= {edge} AS INT)" for edge in LISTWISE_BORDERS[name])


@check(
    "R16_listwise_root_gains",
    f"""WITH wide AS (
      SELECT group_id, lab.label, [{', '.join(_bin_sql(n) for n in LISTWISE_BORDERS)}] AS bins
      FROM lab JOIN (SELECT user_id, item_id, cross_score_item2item, cross_score_implicit_als FROM scored) USING (user_id, item_id)
      JOIN grp USING (user_id)),
    sloped AS (
      SELECT bins, 1.0::DOUBLE / count(*) OVER g AS p, label / sum(label) OVER g AS y, sum(label) OVER g AS hits
      FROM wide WINDOW g AS (PARTITION BY group_id)),
    cells AS (
      SELECT f - 1 AS feature, bins[f] AS bin, count(*) AS n, sum(p - y) AS a, sum(p * (1 - p)) AS b
      FROM (SELECT *, unnest([1, 2, 3]) AS f FROM sloped WHERE hits > 0) GROUP BY ALL),
    sides AS (
      SELECT feature, bin, sum(n) OVER f AS n, sum(a) OVER f AS a, sum(b) OVER f AS b,
             sum(n) OVER l AS ln, sum(a) OVER l AS la, sum(b) OVER l AS lb
      FROM cells WINDOW f AS (PARTITION BY feature),
        l AS (PARTITION BY feature ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    gained AS (
      SELECT *, round(la * la / (lb + 1) + (a - la) * (a - la) / (b - lb + 1) - a * a / (b + 1), 9) AS gain FROM sides WHERE ln > 0)
    SELECT CAST(feature AS INT) AS feature, CAST(bin AS INT) AS bin, CAST(n AS BIGINT) AS rows, CAST(ln AS BIGINT) AS left_rows,
      {r('gain')}, row_number() OVER (ORDER BY gain DESC, feature, bin) = 1 AS chosen FROM gained""",
)
def _(w: World):
    groups = listwise.pack_groups(_listwise_rows(w), LISTWISE_BORDERS)
    gains = listwise.split_gains(listwise.histogram(groups, [], listwise.Tree(), 0, (3, 6)), 1.0)
    best = listwise.best_splits(gains, float("-inf")).select("feature", "bin", F.lit(True).alias("chosen"))
    marked = gains.join(best, ["feature", "bin"], "left")
    return marked.select("feature", "bin", "rows", "left_rows", "gain", F.coalesce("chosen", F.lit(False)).alias("chosen"))


@check("R16_listwise_ranker")
def _(w: World):
    config = listwise.ListwiseConfig(trees=4, depth=3, step=0.3)
    model = listwise.fit_listwise_trees(_listwise_rows(w), LISTWISE_BORDERS, config)
    scores = w.dataset.select(*PAIR_KEYS, model.score().alias("ranker_score"))
    return rankers.evaluate_scores(scores, w.labels, w.targets)


@check(
    "R17_scores_to_candidates",
    f"SELECT user_id, item_id, {r('score')}, rank, source FROM mixed_top",
)
def _(w: World):
    return rankers.rank_scores(w.scores, 20, "ranker")


_PARITY = {"global_popularity": 5, "recency_popularity": 5, "item2item": 10, "implicit_als": 10}


@check(
    "R18_candidate_set_parity",
    f"""SELECT user_id, item_id, {r('ranker_score', 'score')}, rank, 'parity' AS source FROM (SELECT m.*, row_number() OVER
    (PARTITION BY user_id ORDER BY ranker_score DESC, item_id) AS rank FROM mixed_scores m
    SEMI JOIN (SELECT user_id, item_id FROM uni WHERE {' OR '.join(is_active(s, c) for s, c in _PARITY.items())})
    USING (user_id, item_id)) WHERE rank <= 20""",
)
def _(w: World):
    pairs = w.union.filter(union.eligible(_PARITY))
    return rankers.rank_scores(rankers.restrict_to_pairs(w.scores, pairs), 20, "parity")


@check(
    "R19_complete_evaluation_rows",
    "SELECT user_id, item_id FROM uni WHERE user_id IN (SELECT user_id FROM (SELECT user_id, {} AS h FROM target) "
    "ORDER BY h, user_id LIMIT 40)".format(pair_uniform("user_id", "0", "task12:eval_users")),
)
def _(w: World):
    users = sampling.evaluation_users(w.targets, count=40, seed=SEED)
    return sampling.evaluation_rows(w.union, users).select(*PAIR_KEYS)


@check(
    "R19_thin_users",
    "SELECT user_id, count(*) AS rows FROM uni GROUP BY user_id HAVING count(*) < 43",
)
def _(w: World):
    return sampling.thin_users(w.union, w.targets, 43)


