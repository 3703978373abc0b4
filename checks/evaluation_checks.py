"""Metrics, overlap reports and configuration choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import COVISIT, K, World
from checks.fold_checks import ALS, GPOP, ITWO, RPOP
from checks.registry import check, r, step
from checks.steps import is_active
from morrow.functions.joins import pair_join
from morrow.operators import comparison, covisit, metrics, union
from morrow.schemas import PAIR_KEYS

SOURCES = (GPOP, RPOP, ITWO, ALS)
TABLES = {GPOP: "gpop", RPOP: "rpop", ITWO: "itwo", ALS: "als"}

# Short popular lists leave the metrics room to differ between sources.
step("nlabeled", "SELECT count(DISTINCT user_id) AS n FROM e_truth")
step("ntarget", "SELECT count(*) AS n FROM target")
step("ntruth", "SELECT count(*) AS n FROM e_truth")


def precision_sql(hits: str) -> str:
    return f"""SELECT hits AS final_hits, t.n AS target_users, l.n AS labeled_users,
    {r('hits / (20.0 * t.n)', 'precision_at_20_all_targets')},
    {r('CASE WHEN l.n > 0 THEN hits / (20.0 * l.n) ELSE 0 END', 'precision_at_20_labeled_users')}
    FROM (SELECT count(*) AS hits FROM ({hits})), ntarget t, nlabeled l"""


def hits_of(table: str) -> str:
    return f"SELECT DISTINCT x.user_id, x.item_id FROM {table} x SEMI JOIN e_truth USING (user_id, item_id)"


@check("E1_precision_at_20", precision_sql(hits_of("fusefill")))
def _(w: World):
    return metrics.precision_at_20(w.fused_lists, w.labels, w.targets)


def user_counts(pairs: str, extra: str = "") -> str:
    """Per-user candidates, hits and relevant items of a pair table."""
    return f"""SELECT t.user_id, coalesce(a.n, 0) AS relevant, coalesce(b.n, 0) AS count, coalesce(c.n, 0) AS hits{extra}
    FROM target t LEFT JOIN (SELECT user_id, count(*) AS n FROM e_truth GROUP BY user_id) a ON t.user_id = a.user_id
    LEFT JOIN (SELECT user_id, count(DISTINCT item_id) AS n FROM {pairs} GROUP BY user_id) b ON t.user_id = b.user_id
    LEFT JOIN (SELECT user_id, count(*) AS n FROM ({hits_of(pairs)}) GROUP BY user_id) c ON t.user_id = c.user_id"""


def nearest(q: float) -> str:
    return f"list_sort(list(count))[CAST(floor((count(*) - 1) * {q} + 0.5) AS INT) + 1]"


METRIC_COLUMNS = [
    r("CASE WHEN sum(relevant) > 0 THEN sum(hits) / CAST(sum(relevant) AS DOUBLE) ELSE 0 END", "candidate_recall"),
    r("coalesce(avg(CASE WHEN relevant > 0 THEN hits / CAST(relevant AS DOUBLE) END), 0)", "candidate_recall_macro_labeled_users"),
    "CAST(sum(hits) AS BIGINT) AS positive_hits",
    "CAST(sum(count) AS BIGINT) AS candidate_pairs",
    r("count(*) FILTER (WHERE hits > 0) / CAST(count(*) FILTER (WHERE relevant > 0) AS DOUBLE)", "candidate_user_hit_rate"),
    r("sum(least(hits, 20)) / (20.0 * count(*))", "candidate_oracle_p20_all_targets"),
    r("sum(least(hits, 20)) / (20.0 * count(*) FILTER (WHERE relevant > 0))", "candidate_oracle_p20_labeled_users"),
    r("avg(CASE WHEN count > 0 THEN 1.0 ELSE 0 END)", "coverage"),
    r("avg(count)", "mean_candidate_count"),
] + [f"{nearest(q)} AS {n}_candidate_count" for n, q in metrics.COUNT_QUANTILES.items()]


@check("E2_candidate_metrics", f"SELECT {', '.join(METRIC_COLUMNS)} FROM ({user_counts('uni')})")
def _(w: World):
    return metrics.candidate_metrics(w.union, w.labels, w.targets)


@check(
    "E3_single_metrics",
    f"SELECT {METRIC_COLUMNS[0]}, {METRIC_COLUMNS[4]}, {METRIC_COLUMNS[5]}, {METRIC_COLUMNS[7]} FROM ({user_counts('als')})",
)
def _(w: World):
    table = metrics.candidate_metrics(w.sources[ALS], w.labels, w.targets)
    return table.select(
        "candidate_recall", "candidate_user_hit_rate", "candidate_oracle_p20_all_targets", "coverage"
    )


_DEPTHS = {GPOP: 10, RPOP: 15, ITWO: 20, ALS: 12}


def _contribution_sql() -> str:
    count = " + ".join(f"CAST({is_active(s, c)} AS INT)" for s, c in _DEPTHS.items())
    columns = ["count(*) FILTER (WHERE n > 0) AS union_hits"]
    for s, c in _DEPTHS.items():
        columns.append(f"count(*) FILTER (WHERE {is_active(s, c)}) AS source__{s}")
        columns.append(f"count(*) FILTER (WHERE {is_active(s, c)} AND n = 1) AS exclusive__{s}")
    names = list(_DEPTHS)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = f"{is_active(a, _DEPTHS[a])} AND {is_active(b, _DEPTHS[b])}"
            columns.append(f"count(*) FILTER (WHERE {both}) AS overlap__{a}__{b}")
    return f"SELECT {', '.join(columns)} FROM (SELECT *, {count} AS n FROM uni SEMI JOIN e_truth USING (user_id, item_id))"


@check("E4_source_contribution", _contribution_sql())
def _(w: World):
    return union.source_contribution(w.union, w.labels, _DEPTHS)


@check(
    "E5_cross_score_availability",
    "SELECT " + ", ".join(r(f"avg(CAST(cross_score_available_{s} AS DOUBLE))", f"available_{s}") for s in SOURCES) + " FROM scored",
)
def _(w: World):
    return union.availability(w.scored, SOURCES)


@check("E6_hit_pairs", hits_of("uni"))
def _(w: World):
    return metrics.hit_pairs(w.union, w.labels)


@check(
    "E7_source_overlap_hits",
    f"""SELECT count(*) FILTER (WHERE i) AS hits, count(*) FILTER (WHERE g) AS global_hits,
    count(*) FILTER (WHERE i AND g) AS overlap_hits_with_global, count(*) FILTER (WHERE i AND NOT g) AS exclusive_hits_vs_global,
    count(*) FILTER (WHERE e) AS recency_hits, count(*) FILTER (WHERE i AND e) AS overlap_hits_with_recency,
    count(*) FILTER (WHERE i AND NOT e) AS exclusive_hits_vs_recency,
    count(*) FILTER (WHERE i AND NOT (g OR e)) AS exclusive_hits_vs_union, count(*) FILTER (WHERE g OR e) AS union_hits
    FROM (SELECT {', '.join(f"EXISTS (SELECT 1 FROM {t} x WHERE x.user_id = t.user_id AND x.item_id = t.item_id) AS {n}"
          for t, n in (('itwo', 'i'), ('gpop', 'g'), ('rpop', 'e')))} FROM e_truth t)""",
)
def _(w: World):
    others = {"global": w.sources[GPOP], "recency": w.sources[RPOP]}
    return metrics.hit_overlap(w.sources[ITWO], others, w.labels)


@check("E8_final_hit_count", f"SELECT count(*) AS final_hits FROM ({hits_of('fusefill')})")
def _(w: World):
    return metrics.final_hit_count(w.fused_lists, w.labels)


step("basehits", f"SELECT * FROM ({hits_of('gpop')}) UNION SELECT * FROM ({hits_of('rpop')})")


@check(
    "E8_final_hit_contribution",
    f"""SELECT count(*) FILTER (WHERE s) AS final_hits_present_in_source,
    count(*) FILTER (WHERE s AND NOT b) AS final_hits_exclusive_to_source FROM (SELECT
      EXISTS (SELECT 1 FROM als x WHERE x.user_id = f.user_id AND x.item_id = f.item_id) AS s,
      EXISTS (SELECT 1 FROM basehits x WHERE x.user_id = f.user_id AND x.item_id = f.item_id) AS b
      FROM ({hits_of('fusefill')}) f)""",
)
def _(w: World):
    base = metrics.hit_pairs(w.sources[GPOP], w.labels).union(metrics.hit_pairs(w.sources[RPOP], w.labels))
    return metrics.final_hit_contribution(w.fused_lists, w.sources[ALS], base, w.labels)


def _gain_sql(base: str, added: str) -> str:
    both = f"(SELECT user_id, item_id FROM {base} UNION SELECT user_id, item_id FROM {added})"
    old = user_counts(base)
    return f"""SELECT CAST(sum(u.count - o.count) AS BIGINT) AS added_unique_candidates,
    {r('sum(u.count - o.count) / CAST(count(*) AS DOUBLE)', 'mean_added_unique_candidates')},
    CAST(sum(u.hits - o.hits) AS BIGINT) AS new_positive_hits,
    {r('sum(o.hits) / CAST(sum(o.relevant) AS DOUBLE)', 'baseline_recall')},
    {r('sum(u.hits) / CAST(sum(o.relevant) AS DOUBLE)', 'union_recall')},
    {r('sum(u.hits - o.hits) / CAST(sum(o.relevant) AS DOUBLE)', 'delta_recall')},
    {r('sum(least(u.hits, 20) - least(o.hits, 20)) / (20.0 * count(*))', 'oracle_p20_all_targets_gain')}
    FROM ({user_counts(both)}) u JOIN ({old}) o USING (user_id)"""


@check("E9_incremental_union_gain", _gain_sql("itwo", "als"))
def _(w: World):
    return metrics.incremental_gain(w.sources[ITWO], w.sources[ALS], w.labels, w.targets)


step(
    "sides",
    """SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.item_id, b.item_id) AS item_id,
    a.user_id IS NOT NULL AS l, b.user_id IS NOT NULL AS r FROM als a FULL JOIN itwo b ON a.user_id = b.user_id AND a.item_id = b.item_id""",
)
step(
    "overcount",
    """SELECT t.user_id, count(*) FILTER (WHERE l) AS a, count(*) FILTER (WHERE r) AS b, count(*) FILTER (WHERE l AND r) AS c,
    count(*) FILTER (WHERE l AND h) AS ah, count(*) FILTER (WHERE r AND h) AS bh, count(*) FILTER (WHERE l AND r AND h) AS ch
    FROM target t LEFT JOIN (SELECT s.*, e.user_id IS NOT NULL AS h FROM sides s LEFT JOIN e_truth e
      ON s.user_id = e.user_id AND s.item_id = e.item_id) s ON t.user_id = s.user_id GROUP BY t.user_id""",
)


def _overlap_sql() -> str:
    columns = [
        "CAST(sum(a) AS BIGINT) AS left_pairs", "CAST(sum(b) AS BIGINT) AS right_pairs",
        "CAST(sum(c) AS BIGINT) AS intersection_pairs",
        r("sum(c) / CAST(sum(a + b - c) AS DOUBLE)", "micro_jaccard"),
        "CAST(sum(ah) AS BIGINT) AS left_positive_hits", "CAST(sum(bh) AS BIGINT) AS right_positive_hits",
        "CAST(sum(ch) AS BIGINT) AS shared_positive_hits", "CAST(sum(ah - ch) AS BIGINT) AS left_only_positive_hits",
        "CAST(sum(bh - ch) AS BIGINT) AS right_only_positive_hits",
        r("sum(ch) / CAST(nullif(sum(ah), 0) AS DOUBLE)", "shared_share_of_left_hits"),
        r("sum(ch) / CAST(nullif(sum(bh), 0) AS DOUBLE)", "shared_share_of_right_hits"),
    ]
    for name, bottom in (("jaccard", "a + b - c"), ("share_left_in_right", "a"), ("share_right_in_left", "b")):
        value = f"(c / CAST(nullif({bottom}, 0) AS DOUBLE))"
        columns += [
            r(f"avg({value})", f"{name}_mean"), r(f"median({value})", f"{name}_p50"),
            r(f"(list_sort(list({value}) FILTER (WHERE {value} IS NOT NULL)))[CAST(floor((count({value}) - 1) * 0.9 + 0.5) AS INT) + 1]", f"{name}_p90"),
            f"count({value}) AS {name}_defined_users", f"count(*) - count({value}) AS {name}_undefined_users",
        ]
    return f"SELECT {', '.join(columns)} FROM overcount"


@check("E10_overlap_report", _overlap_sql())
def _(w: World):
    return metrics.overlap_report(
        metrics.overlap_counts(w.sources[ALS], w.sources[ITWO], w.labels, w.targets)
    )


_VIEWS = metrics.depth_views(SOURCES, (5, 10, 20))
_POLICIES = {"baseline": (20, 0), "replace": (0, 20), "even": (10, 10), "lean": (5, 15), "both": (20, 20)}
_POLICY_VIEWS = metrics.policy_views({GPOP: 20, RPOP: 20}, ITWO, ALS, _POLICIES)


def _view_rows(views: dict) -> str:
    parts = []
    for name, caps in views.items():
        flag = " OR ".join(is_active(s, c) for s, c in caps.items())
        pairs = f"(SELECT user_id, item_id FROM uni WHERE {flag})"
        parts.append(f"SELECT * FROM ({user_counts(pairs, f''', '{name}' AS view''')})")
    return " UNION ALL ".join(parts)


@check("E11_per_user_additive_counts", f"SELECT user_id, view, relevant, count, hits FROM ({_view_rows(_VIEWS)})")
def _(w: World):
    return metrics.view_counts(w.union, w.labels, w.targets, _VIEWS)


@check("E12_depth_curves", f"SELECT view, {', '.join(METRIC_COLUMNS)} FROM ({_view_rows(_VIEWS)}) GROUP BY view")
def _(w: World):
    return metrics.view_metrics(w.union, w.labels, w.targets, _VIEWS)


@check("E12_cap_policies", f"SELECT view, {', '.join(METRIC_COLUMNS)} FROM ({_view_rows(_POLICY_VIEWS)}) GROUP BY view")
def _(w: World):
    return metrics.view_metrics(w.union, w.labels, w.targets, _POLICY_VIEWS)


@check("E13_macro_recall", f"SELECT {METRIC_COLUMNS[1]} FROM ({user_counts('itwo')})")
def _(w: World):
    table = metrics.candidate_metrics(w.sources[ITWO], w.labels, w.targets)
    return table.select("candidate_recall_macro_labeled_users")


step("policytable", f"SELECT view, {', '.join(METRIC_COLUMNS)} FROM ({_view_rows(_POLICY_VIEWS)}) GROUP BY view")
_ORDER_SQL = "CASE view " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(_POLICIES)) + " END"


@check(
    "E14_policy_selection",
    f"""SELECT view, candidate_recall, {_ORDER_SQL} AS priority FROM policytable WHERE view <> 'both'
    ORDER BY candidate_recall DESC, candidate_oracle_p20_all_targets DESC, priority LIMIT 1""",
)
def _(w: World):
    table = metrics.view_metrics(w.union, w.labels, w.targets, _POLICY_VIEWS)
    priority = F.array_position(F.array(*[F.lit(n) for n in _POLICIES]), F.col("view")) - 1
    equal = table.filter(F.col("view") != "both").withColumn("priority", priority.cast("int"))
    return comparison.choose_policy(equal).select("view", "candidate_recall", "priority")


@check(
    "E15_added_unique_candidates",
    """SELECT count(*) AS added_unique_candidates, count(e.user_id) AS new_positive_hits FROM als a LEFT JOIN e_truth e
    ON a.user_id = e.user_id AND a.item_id = e.item_id WHERE NOT EXISTS
      (SELECT 1 FROM gpop g WHERE g.user_id = a.user_id AND g.item_id = a.item_id)""",
)
def _(w: World):
    table = metrics.incremental_gain(w.sources[GPOP], w.sources[ALS], w.labels, w.targets)
    return table.select("added_unique_candidates", "new_positive_hits")


@check("E16_metrics_from_hits", precision_sql(hits_of("uni")))
def _(w: World):
    hits = metrics.hit_pairs(w.union, w.labels).agg(F.count(F.lit(1)).alias("final_hits"))
    counts = hits.withColumn("target_users", w.targets.agg(F.count(F.lit(1)).alias("n")).scalar())
    labeled = w.labels.agg(F.count_distinct("user_id").alias("n")).scalar()
    return metrics.precision_from_hits(counts.withColumn("labeled_users", labeled))


@check(
    "E17_full_candidate_logloss",
    f"""SELECT count(*) AS rows, {r('sum(greatest(s, 0) + ln(1 + exp(-abs(s))) - y * s)', 'logloss_sum')},
    {r('avg(greatest(s, 0) + ln(1 + exp(-abs(s))) - y * s)', 'full_candidate_logloss')}
    FROM (SELECT ranker_score AS s, label AS y FROM mixed_scores JOIN lab USING (user_id, item_id))""",
)
def _(w: World):
    rows = pair_join(w.scores, w.dataset.select(*PAIR_KEYS, "label"))
    return metrics.log_loss(rows)


# Depths of one source as a curve: the shallow end plays the role of fewer trees.
_COUNTS = (5, 10, 15, 20)
step(
    "curve",
    " UNION ALL ".join(
        f"SELECT {n} AS tree_count, (SELECT count(*) FROM als SEMI JOIN e_truth USING (user_id, item_id) WHERE rank <= {n}) AS final_hits"
        for n in _COUNTS
    ),
)


def _curve(w: World):
    hits = w.sources[ALS].join(w.labels, PAIR_KEYS, "left_semi")
    counts = F.explode(F.array(*[F.lit(n) for n in _COUNTS]))
    rows = hits.withColumn("tree_count", counts).filter(F.col("rank") <= F.col("tree_count"))
    return rows.groupBy("tree_count").agg(F.count(F.lit(1)).alias("final_hits"))


@check("E18_checkpoint_choice", "SELECT tree_count, final_hits FROM curve ORDER BY final_hits DESC, tree_count LIMIT 1")
def _(w: World):
    return comparison.choose_tree_count(_curve(w))


# One row per source (configuration) and week of validation users (fold).
step(
    "results",
    " UNION ALL ".join(
        f"""SELECT '{s}' AS config_id, fold, {i} AS priority, count(*) FILTER (WHERE h) AS final_hits,
        count(*) FILTER (WHERE h) / CAST(count(*) AS DOUBLE) AS precision_at_20_all_targets,
        count(*) FILTER (WHERE h AND rank <= 10) / CAST(count(*) AS DOUBLE) AS precision_at_20_labeled_users
        FROM (SELECT t.*, CASE WHEN item_id < 50 THEN 'low' ELSE 'high' END AS fold,
          EXISTS (SELECT 1 FROM e_truth e WHERE e.user_id = t.user_id AND e.item_id = t.item_id) AS h FROM {t} t) GROUP BY fold"""
        for i, (s, t) in enumerate(TABLES.items())
    ),
)
_METRICS = [comparison.ALL_TARGETS, comparison.LABELED]


def _results(w: World):
    hit = F.col("hit").isNotNull()
    result = None
    for i, source in enumerate(TABLES):
        rows = w.sources[source].join(w.labels.withColumn("hit", F.lit(True)), PAIR_KEYS, "left")
        part = rows.groupBy(F.when(F.col("item_id") < 50, "low").otherwise("high").alias("fold")).agg(
            F.count_if(hit).alias("final_hits"),
            (F.count_if(hit) / F.count(F.lit(1))).alias(comparison.ALL_TARGETS),
            (F.count_if(hit & (F.col("rank") <= 10)) / F.count(F.lit(1))).alias(comparison.LABELED),
        ).select(F.lit(source).alias("config_id"), "fold", F.lit(i).alias("priority"), "final_hits", *_METRICS)
        result = part if result is None else result.unionByName(part)
    return result


step(
    "summary",
    "SELECT config_id, count(*) AS folds, "
    + ", ".join(
        f"avg({m}) AS mean_{m}, min({m}) AS min_{m}, max({m}) - min({m}) AS fold_spread_{m}" for m in _METRICS
    )
    + ", CAST(sum(final_hits) AS BIGINT) AS total_final_hits, min(priority) AS priority FROM results GROUP BY config_id",
)
_SUMMARY_COLUMNS = ["config_id", "folds", "total_final_hits"] + [
    r(f"{p}_{m}") for m in _METRICS for p in ("mean", "min", "fold_spread")
]


@check("E19_fold_aggregation", f"SELECT {', '.join(_SUMMARY_COLUMNS)} FROM summary")
def _(w: World):
    return comparison.aggregate_folds(_results(w), _METRICS, ["final_hits"])


@check(
    "E20_config_choice",
    """SELECT config_id, total_final_hits FROM summary ORDER BY round(mean_precision_at_20_all_targets, 12) DESC,
    round(mean_precision_at_20_labeled_users, 12) DESC, priority LIMIT 1""",
)
def _(w: World):
    results = _results(w)
    table = comparison.aggregate_folds(results, _METRICS, ["final_hits"])
    order = results.groupBy("config_id").agg(F.min("priority").alias("priority"))
    rounded = table.join(order, "config_id").withColumns(
        {f"mean_{m}": F.round(f"mean_{m}", 12) for m in _METRICS}
    ).withColumn("mean_candidate_oracle_p20_all_targets", F.lit(0.0))
    return comparison.choose_config(rounded).select("config_id", "total_final_hits")


@check("E21_epsilon_choice")
def _(w: World):
    table = comparison.aggregate_folds(_results(w), _METRICS, ["final_hits"])
    rows = [
        {**row.asDict(), "mean_tree_count": 0.0} for row in table.orderBy("config_id").collect()
    ]
    best = comparison.choose_with_epsilon(rows, 1e-4, list(TABLES))
    return table.filter(F.col("config_id") == best["config_id"])


@check("E22_staged_sweep")
def _(w: World):
    def evaluate(config: covisit.CovisitConfig, fold: str) -> float:
        neighbors = covisit.fit_neighbors(w.history, config)
        top = covisit.recommend_neighbors(w.seeds, w.seen, neighbors, config, w.cutoff, K)
        return metrics.hit_pairs(top, w.labels).count() / K

    stages = [("normalization", ["raw", "cosine"]), ("neighbor_k", [10, 20])]
    rows = comparison.staged_sweep(COVISIT, stages, ["canonical"], evaluate)
    schema = "stage string, value string, mean double, chosen boolean"
    return w.spark.createDataFrame([(x["stage"], x["value"], x["mean"], x["chosen"]) for x in rows], schema)


@check(
    "E23_metric_verification",
    "SELECT true AS final_hits_equal, true AS target_users_equal, true AS labeled_users_equal, "
    "true AS precision_at_20_all_targets_close, true AS precision_at_20_labeled_users_close",
)
def _(w: World):
    path = w.folder("metrics")
    metrics.precision_at_20(w.fused_lists, w.labels, w.targets).write.parquet(path)
    again = metrics.precision_at_20(w.fused_lists, w.labels, w.targets)
    return comparison.verify_metrics(w.spark.read.parquet(path), again)


step("selected", precision_sql(hits_of("fusefill")))
step("baseline", precision_sql(hits_of("gpop")))


@check(
    "E24_baseline_comparison",
    "SELECT " + ", ".join(
        f"b.{n} AS baseline_{n}, s.{n} - b.{n} AS selected_minus_baseline_{n}" if n == "final_hits"
        else f"b.{n} AS baseline_{n}, " + r(f"(s.final_hits - b.final_hits) / (20.0 * b.{u})", f"selected_minus_baseline_{n}")
        for n, u in (("precision_at_20_all_targets", "target_users"), ("precision_at_20_labeled_users", "labeled_users"), ("final_hits", ""))
    ) + " FROM selected s, baseline b",
)
def _(w: World):
    return comparison.compare_with_baseline(
        metrics.precision_at_20(w.fused_lists, w.labels, w.targets),
        metrics.precision_at_20(w.popular_lists, w.labels, w.targets),
    )


@check(
    "E25_list_precision",
    f"""SELECT t.user_id, {r('coalesce(n, 0) / 20.0', 'prec_k')} FROM (SELECT DISTINCT user_id FROM e_truth) t
    LEFT JOIN (SELECT user_id, count(*) AS n FROM ({hits_of('gpop')}) GROUP BY user_id) h USING (user_id)""",
)
def _(w: World):
    true = w.labels.groupBy("user_id").agg(F.collect_set("item_id").alias("true"))
    joined = w.popular_lists.join(true, "user_id")
    return joined.select("user_id", metrics.list_precision("item_ids", "true", 20).alias("prec_k"))


@check(
    "E26_final_hit_coverage",
    "SELECT count(*) AS final_hits, " + ", ".join(
        f"count(*) FILTER (WHERE EXISTS (SELECT 1 FROM {t} x WHERE x.user_id = f.user_id AND x.item_id = f.item_id)) AS final_hits_in_{s}"
        for s, t in TABLES.items()
    ) + f" FROM ({hits_of('fusefill')}) f",
)
def _(w: World):
    return metrics.final_hit_coverage(w.fused_lists, w.sources, w.labels)


@check(
    "E27_leaderboard",
    """SELECT config_id, total_final_hits, row_number() OVER (ORDER BY total_final_hits DESC, config_id) AS place
    FROM summary""",
)
def _(w: World):
    table = comparison.aggregate_folds(_results(w), _METRICS, ["final_hits"])
    board = comparison.leaderboard(table, [F.desc("total_final_hits"), F.asc("config_id")])
    return board.select("config_id", "total_final_hits", "place")


