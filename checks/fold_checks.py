"""Joins, aggregations, windows and sets on the prepared fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures
from checks.fixtures import COVISIT, World
from checks.registry import check, f32, r
from checks.steps import STRATUM, as_lists, filled, id_hash, pair_uniform
from morrow.functions.joins import lookup_join
from morrow.functions.ranking import global_rank, nearest_quantiles, top_rows
from morrow.operators import (
    covisit,
    factors,
    features,
    interactions,
    metrics,
    popularity,
    profiles,
    quality,
    sampling,
    sequences,
    union,
)
from morrow.schemas import PAIR_KEYS
from morrow.sources import tables

DAILY = "user_id, item_id, date, dt, views, watch_time, is_like, is_favorite, is_positive"
GPOP, RPOP, ITWO, ALS = "global_popularity", "recency_popularity", "item2item", "implicit_als"

# ---- joins --------------------------------------------------------------------------


@check("J1_anti_join_on_pair", "SELECT user_id, item_id FROM e_unseen")
def _(w: World):
    return w.truth.unseen


@check("J2_anti_join_on_item", "SELECT user_id, item_id FROM p_cold")
def _(w: World):
    return w.early.truth.cold


@check("J3_semi_join_on_item", "SELECT user_id, item_id FROM p_elig")
def _(w: World):
    return w.early.truth.eligible


@check("J4_semi_join_on_user", f"SELECT {DAILY} FROM p_hist WHERE user_id IN (SELECT user_id FROM p_target)")
def _(w: World):
    return lookup_join(w.early.daily[0], w.early.targets, "user_id", "left_semi")


@check(
    "J5_semi_join_on_pair",
    "SELECT user_id, item_id FROM als SEMI JOIN e_truth USING (user_id, item_id)",
)
def _(w: World):
    return w.sources[ALS].join(w.labels, PAIR_KEYS, "left_semi").select(*PAIR_KEYS)


@check(
    "J6_seeds_with_neighbors",
    f"""SELECT user_id, seed_item_id, item_id, {r('neighbor_score')}, co_user_count, neighbor_rank,
    {r('contribution')} FROM contrib""",
)
def _(w: World):
    return w.contributions


@check(
    "J7_user_local_item_pairs",
    f"SELECT newer AS newer_item, older AS older_item, {r('gap', 'gap_hours')} FROM duo",
)
def _(w: World):
    pairs = covisit.user_item_pairs(covisit.profile_rows(w.collapsed, COVISIT))
    return pairs.select("newer_item", "older_item", (F.col("gap_us") / 3.6e9).alias("gap_hours"))


@check(
    "J8_full_outer_union",
    f"""SELECT coalesce(g.user_id, a.user_id) AS user_id, coalesce(g.item_id, a.item_id) AS item_id,
    coalesce(g.rank, 0) AS generator_rank_global_popularity, coalesce(a.rank, 0) AS generator_rank_implicit_als,
    CAST(g.rank IS NOT NULL AS INT) + CAST(a.rank IS NOT NULL AS INT) AS source_count
    FROM gpop g FULL JOIN als a ON g.user_id = a.user_id AND g.item_id = a.item_id""",
)
def _(w: World):
    config = union.UnionConfig({GPOP: 20, ALS: 20}, 40)
    table = union.build_union({GPOP: w.sources[GPOP], ALS: w.sources[ALS]}, config)
    return table.select(
        *PAIR_KEYS, union.generator_rank(GPOP), union.generator_rank(ALS), "source_count"
    )


@check(
    "J9_left_lookup",
    f"SELECT u.user_id, u.item_id, {r('k.score', 'score')}, k.global_rank FROM uni u LEFT JOIN rranking k USING (item_id)",
)
def _(w: World):
    return lookup_join(w.union.select(*PAIR_KEYS), w.recency_ranking, "item_id")


@check(
    "J10_left_label_join",
    "SELECT user_id, item_id, label FROM lab",
)
def _(w: World):
    return sampling.assign_labels(w.union, w.labels).select(*PAIR_KEYS, "label")


@check(
    "J11_right_join_zero_fill",
    """SELECT t.user_id, count(c.item_id) AS count FROM target t LEFT JOIN als c ON t.user_id = c.user_id AND c.rank <= 5
    AND c.score > 0 GROUP BY t.user_id""",
)
def _(w: World):
    rows = w.sources[ALS].filter((F.col("rank") <= 5) & (F.col("score") > 0))
    counts = metrics.per_user_counts(rows, w.labels, w.targets)
    return counts.select("user_id", "count")


@check(
    "J12_cardinality_checked_join",
    "SELECT user_id, item_id, group_id, 0 AS duplicate_groups FROM uni JOIN grp USING (user_id)",
)
def _(w: World):
    surplus = quality.unique_keys(w.groups, ["user_id"]).select("violations").scalar()
    joined = lookup_join(w.union.select(*PAIR_KEYS), w.groups, "user_id", "inner")
    return joined.withColumn("duplicate_groups", surplus)


@check("J13_users_by_ranking_minus_seen", f"SELECT user_id, item_id, {r('score')}, rank FROM rpop")
def _(w: World):
    table = popularity.recommend_unseen(w.recency_ranking, w.seen, w.targets, 20, RPOP)
    return table.drop("source")


@check("J14_users_by_catalogue_product", f"SELECT user_id, item_id, {r('score')}, rank FROM als")
def _(w: World):
    queries = w.user_factors.join(w.targets, "user_id", "left_semi")
    return factors.retrieve_top(
        queries, w.item_factors, w.seen, 20, ALS, block_rows=48
    ).drop("source")


# ---- aggregations ----------------------------------------------------------------------


@check("A1_aggregate_daily_interactions", f"SELECT {DAILY} FROM hist")
def _(w: World):
    return interactions.aggregate_daily(w.sides[0])


@check(
    "A2_collapse_history",
    """SELECT user_id, item_id, last_dt, views, watch_time, is_like, is_favorite, is_positive, history_rank FROM coll""",
)
def _(w: World):
    return covisit.rank_history(w.collapsed)


_SUMMARY = """count(*) AS rows, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items"""


@check(
    "A3_raw_diagnostics",
    f"SELECT {_SUMMARY}, min(date) AS min_date, max(date) AS max_date, 0 AS null_cells FROM ev",
)
def _(w: World):
    return interactions.raw_summary(w.raw)


@check("A4_event_counts", "SELECT event_type, count(*) AS rows FROM ev GROUP BY event_type")
def _(w: World):
    return interactions.event_counts(w.raw)


@check(
    "A5_target_diagnostics",
    """SELECT count(*) AS rows, count(DISTINCT user_id) AS unique_users, 0 AS nulls,
    count(*) FILTER (WHERE user_id NOT IN (SELECT user_id FROM p_ev)) AS missing_from_raw FROM p_target""",
)
def _(w: World):
    return interactions.target_summary(w.early.targets, w.early.raw)


@check(
    "A6_daily_diagnostics",
    f"""SELECT {_SUMMARY}, min(date) AS min_date, max(date) AS max_date, min(dt) AS min_dt, max(dt) AS max_dt,
    0 AS null_cells, 0 AS duplicate_rows FROM hist""",
)
def _(w: World):
    return interactions.daily_summary(w.history)


@check("A6_pair_diagnostics", f"SELECT {_SUMMARY}, 0 AS null_cells FROM e_truth")
def _(w: World):
    return interactions.pair_summary(w.labels)


@check(
    "A7_ground_truth_funnel",
    f"""SELECT *, {r('CAST(seen_pairs_removed AS DOUBLE) / positive_unique_pairs', 'seen_pair_share_of_positive')},
    {r('CAST(cold_pairs_removed AS DOUBLE) / positive_unique_pairs', 'cold_pair_share_of_positive')} FROM (SELECT
    (SELECT count(*) FROM p_pos) AS positive_unique_pairs,
    (SELECT count(*) FROM p_pos) - (SELECT count(*) FROM p_unseen) AS seen_pairs_removed,
    (SELECT count(*) FROM p_unseen) AS unseen_positive_pairs, (SELECT count(*) FROM p_cold) AS cold_pairs_removed,
    (SELECT count(DISTINCT item_id) FROM p_cold) AS cold_unique_items, (SELECT count(*) FROM p_elig) AS eligible_pairs,
    (SELECT count(DISTINCT user_id) FROM p_elig) AS eligible_users, (SELECT count(*) FROM p_truth) AS target_eligible_pairs,
    (SELECT count(DISTINCT user_id) FROM p_truth) AS target_labeled_users, (SELECT count(*) FROM p_target) AS target_users)""",
)
def _(w: World):
    return interactions.truth_funnel(w.early.truth, w.early.targets)


@check(
    "A8_item_popularity",
    """SELECT item_id, raw_interaction_count, distinct_interacting_users, relevant_interaction_count,
    distinct_relevant_users FROM stats""",
)
def _(w: World):
    return popularity.item_popularity(w.history)


def _grid_sql() -> str:
    columns = []
    for signal, value in (("raw_views", "views"), ("positive_daily_rows", "is_positive")):
        columns.append(r(f"sum({value})", f"{signal}_window_full"))
        for hours in (6, 24, 72):
            columns.append(
                r(f"sum(CASE WHEN age <= {hours} THEN {value} ELSE 0 END)", f"{signal}_window_{hours}h")
            )
        for hours in (24, 72):
            columns.append(
                r(f"sum({value} * exp(-ln(2.0) * age / {hours}.0))", f"{signal}_decay_{hours}h")
            )
    return f"SELECT item_id, {', '.join(columns)} FROM aged GROUP BY item_id"


@check("A9_recency_statistics", _grid_sql())
def _(w: World):
    return popularity.recency_statistics(w.history, w.cutoff, (6, 24, 72), (24, 72))


def _entity_sql(entity: str, other: str, trends: bool) -> str:
    p, plural = entity[:-3], other[:-3] + "s"

    def inside(low: int, high: int) -> str:
        return f"FILTER (WHERE age > {low} AND age <= {high})"

    base = [
        f"count(*) AS {p}_daily_rows_all", f"CAST(sum(views) AS BIGINT) AS {p}_views_all",
        f"count(DISTINCT {other}) AS {p}_distinct_{plural}_all",
        f"count(DISTINCT date) AS {p}_active_days_all",
    ]
    signals = ("positive", "like", "favorite")
    base += [f"CAST(sum(is_{s}) AS BIGINT) AS {p}_{s}_rows_all" for s in signals]
    for stem, s in (("positive", "positive"), ("liked", "like"), ("favorited", "favorite")):
        base.append(f"count(DISTINCT CASE WHEN is_{s} > 0 THEN {other} END) AS {p}_{stem}_{plural}_all")
    base += ["avg(watch_time) AS mean_all", f"max(watch_time) AS {p}_watch_time_max_all"]
    slices = [("6h", 0, 6), ("24h", 0, 24), ("72h", 0, 72)]
    if trends:
        slices += [("prev_6h", 6, 12), ("prev_24h", 24, 48)]
    for token, low, high in slices:
        f = inside(low, high)
        base += [
            f"count(*) {f} AS {p}_daily_rows_{token}",
            f"CAST(coalesce(sum(views) {f}, 0) AS BIGINT) AS {p}_views_{token}",
            f"count(DISTINCT {other}) {f} AS {p}_distinct_{plural}_{token}",
        ]
        base += [f"CAST(coalesce(sum(is_{s}) {f}, 0) AS BIGINT) AS {p}_{s}_rows_{token}" for s in signals]
        base += [
            f"coalesce(avg(watch_time) {f}, 0) AS mean_{token}",
            f"coalesce(max(watch_time) {f}, 0) AS {p}_watch_time_max_{token}",
        ]
    for event, condition in (("interaction", "true"), ("positive", "is_positive > 0"), ("like", "is_like > 0"), ("favorite", "is_favorite > 0")):
        base.append(f"min(age) FILTER (WHERE {condition}) AS age_{event}")

    def div(top: str, bottom: str, name: str) -> str:
        return f32(f"CASE WHEN {bottom} > 0 THEN CAST({top} AS DOUBLE) / {bottom} ELSE 0 END", f"{p}_{name}")

    out = [f"{entity}", f"{p}_daily_rows_all", f"{p}_views_all", f"{p}_distinct_{plural}_all", f"{p}_active_days_all"]
    out += [f"{p}_{s}_rows_all" for s in signals]
    out += [f"{p}_{s}_{plural}_all" for s in ("positive", "liked", "favorited")]
    out += [f32("mean_all", f"{p}_watch_time_mean_all"), f"{p}_watch_time_max_all"]
    for token, _low, _high in slices:
        out += [f"{p}_{stem}_{token}" for stem in ("daily_rows", "views", f"distinct_{plural}", "positive_rows", "like_rows", "favorite_rows", "watch_time_max")]
        out.append(f32(f"mean_{token}", f"{p}_watch_time_mean_{token}"))
    out.append(f"true AS {p}_history_available")
    out += [div(f"{p}_{s}_rows_all", f"{p}_daily_rows_all", f"{s}_daily_rate_all") for s in signals]
    for rate, stem in (("positive", "positive"), ("like", "liked"), ("favorite", "favorited")):
        out.append(div(f"{p}_{stem}_{plural}_all", f"{p}_distinct_{plural}_all", f"{rate}_counterpart_rate_all"))
    for token in ("6h", "24h", "72h"):
        out += [div(f"{p}_{s}_rows_{token}", f"{p}_daily_rows_{token}", f"{s}_daily_rate_{token}") for s in signals]
        out.append(div(f"{p}_daily_rows_{token}", f"{p}_daily_rows_all", f"daily_row_share_{token}"))
        out.append(div(f"{p}_views_{token}", f"{p}_views_all", f"view_share_{token}"))
    for event in ("interaction", "positive", "like", "favorite"):
        out.append(f"age_{event} IS NOT NULL AS {p}_last_{event}_available")
        out.append(f32(f"coalesce(age_{event}, 0)", f"{p}_hours_since_last_{event}"))
    if trends:
        for token in ("6h", "24h"):
            for stem in ("daily_rows", "views", "positive_rows"):
                out.append(
                    f32(f"ln(1.0 + {p}_{stem}_{token}) - ln(1.0 + {p}_{stem}_prev_{token})",
                        f"{p}_trend_{stem}_log_ratio_{token}")
                )
    return f"SELECT {', '.join(out)} FROM (SELECT {entity}, {', '.join(base)} FROM aged GROUP BY {entity})"


@check("A10_user_features", _entity_sql("user_id", "item_id", False))
def _(w: World):
    return features.user_features(w.history, w.cutoff)


@check("S16_feature_lookup_artifact", _entity_sql("user_id", "item_id", False))
def _(w: World):
    folder = w.folder("lookups")
    tables.write_tables(folder, **w.lookups)
    return tables.read_tables(w.spark, folder, *w.lookups)["user_features"]


@check("A11_item_features", _entity_sql("item_id", "user_id", True))
def _(w: World):
    return features.item_features(w.history, w.cutoff)


_DECAYED = covisit.CovisitConfig(pair_weight="time_decay", history_cap=10)


@check(
    "A12_pair_statistics",
    f"SELECT item_id, neighbor_item_id, {r('decayed', 'weight')}, co_user_count FROM linked",
)
def _(w: World):
    return covisit.pair_statistics(covisit.profile_rows(w.collapsed, _DECAYED), _DECAYED)


_DIRECTED = covisit.CovisitConfig(profile="positive", direction="directed", history_cap=15)


@check(
    "A12_directed_pair_statistics",
    f"""WITH prof15 AS (SELECT * FROM coll WHERE history_rank <= 15 AND is_positive = 1)
    SELECT b.item_id, a.item_id AS neighbor_item_id, {r('count(*)', 'weight')}, count(*) AS co_user_count
    FROM prof15 a JOIN prof15 b ON a.user_id = b.user_id AND a.last_dt > b.last_dt
    GROUP BY b.item_id, a.item_id""",
)
def _(w: World):
    return covisit.pair_statistics(covisit.profile_rows(w.collapsed, _DIRECTED), _DIRECTED)


@check("A13_item_user_counts", "SELECT item_id, users FROM itemn")
def _(w: World):
    return covisit.item_user_counts(covisit.profile_rows(w.collapsed, COVISIT))


_JACCARD = covisit.CovisitConfig(normalization="jaccard", min_pair_users=2)


@check(
    "A14_pair_normalization",
    f"""SELECT l.item_id, l.neighbor_item_id, co_user_count,
    {r('co_user_count / CAST(a.users + b.users - co_user_count AS DOUBLE)', 'score')}
    FROM linked l JOIN itemn a ON l.item_id = a.item_id JOIN itemn b ON l.neighbor_item_id = b.item_id
    WHERE co_user_count >= 2""",
)
def _(w: World):
    profile = covisit.profile_rows(w.collapsed, _JACCARD)
    pairs = covisit.pair_statistics(profile, _JACCARD)
    return covisit.normalize_pairs(pairs, covisit.item_user_counts(profile), _JACCARD)


@check("A15_max_over_seeds", f"SELECT user_id, item_id, {r('score')} FROM best")
def _(w: World):
    return covisit.best_contribution(w.contributions)


EVIDENCE_SQL = f"""SELECT user_id, item_id, count(*) AS covisit_matched_seed_count,
  {f32('sum(contribution)', 'covisit_contribution_sum')}, {f32('avg(contribution)', 'covisit_contribution_mean')},
  {r('max(contribution)', 'covisit_contribution_max')}, {f32('sum(neighbor_score)', 'covisit_neighbor_score_sum')},
  {f32('avg(neighbor_score)', 'covisit_neighbor_score_mean')}, {f32('max(neighbor_score)', 'covisit_neighbor_score_max')},
  max(co_user_count) AS covisit_co_user_count_max, {f32('avg(co_user_count)', 'covisit_co_user_count_mean')},
  min(neighbor_rank) AS covisit_best_neighbor_rank FROM contrib GROUP BY user_id, item_id"""


@check("A16_covisit_evidence", EVIDENCE_SQL)
def _(w: World):
    return covisit.covisit_evidence(w.contributions)


@check(
    "A17_seen_item_lists",
    """SELECT t.user_id, coalesce(string_agg(CAST(s.item_id AS VARCHAR), ',' ORDER BY s.item_id), '') AS seen_item_ids
    FROM p_target t LEFT JOIN (SELECT DISTINCT user_id, item_id FROM p_hist) s ON t.user_id = s.user_id GROUP BY t.user_id""",
)
def _(w: World):
    return popularity.seen_item_lists(interactions.seen_pairs(w.early.daily[0]), w.early.targets)


@check("A18_recommendation_lists", as_lists("gpop"))
def _(w: World):
    return popularity.ordered_lists(w.sources[GPOP])


@check(
    "A19_training_strata_counts",
    f"""SELECT s.name AS sampling_stratum, count(l.stratum) AS rows FROM (SELECT unnest(['positive',
      'multi_collaborative_top50', 'multi_other', 'single_item2item_top50', 'single_als_top50', 'easy_negative']) AS name) s
    LEFT JOIN (SELECT {STRATUM} AS stratum FROM lab WHERE is_training_sample) l ON l.stratum = s.name GROUP BY s.name""",
)
def _(w: World):
    return sampling.stratum_counts(w.labeled_union)


@check(
    "A20_ranker_dataset_diagnostics",
    f"""SELECT *, rows - positive_rows AS negative_rows, training_rows - training_positive_rows AS training_negative_rows,
    {r('positive_rows / CAST(rows AS DOUBLE)', 'positive_rate')},
    {r('training_positive_rows / CAST(training_rows AS DOUBLE)', 'training_positive_rate')}
    FROM (SELECT count(*) AS rows, count(DISTINCT user_id) AS users, CAST(sum(label) AS BIGINT) AS positive_rows,
      count(*) FILTER (WHERE is_hard_negative) AS hard_negative_rows,
      count(*) FILTER (WHERE is_training_sample) AS training_rows,
      count(*) FILTER (WHERE is_training_sample AND label = 1) AS training_positive_rows FROM lab)""",
)
def _(w: World):
    return sampling.dataset_report(w.labeled_union)


def _profile_sql(entity: str, other: str) -> str:
    def nearest(q: float) -> str:
        return f"list_sort(list(watch_time))[CAST(floor((count(*) - 1) * {q} + 0.5) AS INT) + 1]"

    return f"""SELECT {entity}, CAST(sum(views) AS BIGINT) AS views, {r('avg(views)', 'avg_views')},
    {r('avg(watch_time)', 'avg_watch_time')}, {nearest(0.3)} AS p3_watch_time, {nearest(0.8)} AS p8_watch_time,
    {r('median(watch_time)', 'median_watch_time')}, CAST(sum(is_like) AS BIGINT) AS likes,
    CAST(sum(is_favorite) AS BIGINT) AS favorites, CAST(sum(is_positive) AS BIGINT) AS positives,
    {r('avg(is_like)', 'like_rate')}, {r('avg(is_favorite)', 'favorite_rate')}, {r('avg(is_positive)', 'positive_rate')}
    FROM coll GROUP BY {entity}"""


@check("A21_item_profile", _profile_sql("item_id", "user_id"))
def _(w: World):
    return interactions.entity_profile(w.history, "item_id")


@check("A21_user_profile", _profile_sql("user_id", "item_id"))
def _(w: World):
    return interactions.entity_profile(w.history, "user_id")


@check("A22_events_per_day", "SELECT CAST(date AS DATE) AS date, count(*) AS rows FROM ev GROUP BY CAST(date AS DATE)")
def _(w: World):
    return interactions.events_per_day(w.raw)


@check("A23_history_pairs", 'SELECT user_id, item_id, positive, "like", favorite, long_watch FROM hpair')
def _(w: World):
    pairs = profiles.history_pairs(w.history, w.targets)
    kinds = [profiles.carries(kind).cast("int").alias(kind) for kind in profiles.PROFILE_KINDS]
    return pairs.select("user_id", "item_id", *kinds)


@check(
    "A24_profile_vectors",
    f"""SELECT user_id, kind, count, matched, {r('concentration')}, {r('direction[1]', 'first')},
    {r('direction[64]', 'last')}, {r('list_sum(direction)', 'total')} FROM hprof""",
)
def _(w: World):
    d = F.col("direction")
    table = profiles.build_profiles(profiles.history_pairs(w.history, w.targets), w.targets, w.item_factors)
    return table.select(
        "user_id", "kind", "count", "matched", "concentration",
        F.get(d, F.lit(0)).alias("first"), F.get(d, F.lit(63)).alias("last"),
        F.aggregate(d, F.lit(0.0), lambda a, v: a + v).alias("total"),
    )


@check(
    "A25_profile_diagnostics",
    f"""SELECT kind, count(*) FILTER (WHERE count > 0) AS users_with_events,
    count(*) FILTER (WHERE concentration > 1e-12) AS users_with_direction, CAST(sum(count) AS BIGINT) AS memberships,
    CAST(sum(matched) AS BIGINT) AS matched_memberships, {r('avg(concentration)', 'mean_concentration')}
    FROM hprof GROUP BY kind""",
)
def _(w: World):
    return profiles.profile_report(w.profiles)


_SOURCES = (GPOP, RPOP, ITWO, ALS)


@check(
    "A26_candidate_table_diagnostics",
    "SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS users, min(n) AS min_candidates, max(n) AS max_candidates, "
    + ", ".join(f"CAST(sum({s}) AS BIGINT) AS contribution_{s}, count(*) FILTER (WHERE {s} > 0) AS users_{s}" for s in _SOURCES)
    + " FROM (SELECT user_id, count(*) AS n, "
    + ", ".join(f"count(*) FILTER (WHERE generated_by_{s}) AS {s}" for s in _SOURCES)
    + " FROM uni GROUP BY user_id)",
)
def _(w: World):
    return union.union_summary(w.union, _SOURCES)


@check(
    "A27_group_diagnostics",
    """SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS groups, CAST(sum(p) AS BIGINT) AS positive_rows,
    count(*) FILTER (WHERE p > 0) AS positive_groups, count(*) FILTER (WHERE p = 0) AS zero_positive_groups,
    min(n) AS min_group_size, max(n) AS max_group_size
    FROM (SELECT user_id, count(*) AS n, sum(label) AS p FROM lab WHERE is_training_sample GROUP BY user_id)""",
)
def _(w: World):
    return sampling.group_report(sampling.grouped_rows(w.labeled_union, w.groups, ["source_count"]))


@check(
    "A28_inverse_positive_group_weights",
    f"""SELECT group_id, CAST(p AS BIGINT) AS positives, {f32('raw / avg(raw) OVER ()', 'group_weight')} FROM (
      SELECT group_id, sum(label) AS p, 1.0 / greatest(sum(label), 1) AS raw
      FROM lab JOIN grp USING (user_id) WHERE is_training_sample GROUP BY group_id)""",
)
def _(w: World):
    return sampling.group_weights(sampling.grouped_rows(w.labeled_union, w.groups, ["source_count"]))


@check(
    "A29_sequence_length_quantiles",
    "SELECT " + ", ".join(r(f"quantile_cont(length, {q})", n) for n, q in
                          (("q0", 0.0), ("q50", 0.5), ("q90", 0.9), ("q99", 0.99), ("q100", 1.0))) + " FROM seqlen",
)
def _(w: World):
    return sequences.length_quantiles(sequences.sequence_lengths(w.sequences, w.targets))


# ---- windows ------------------------------------------------------------------------------


@check("W1_history_rank", "SELECT user_id, item_id, history_rank FROM coll")
def _(w: World):
    return covisit.rank_history(w.collapsed).select(*PAIR_KEYS, "history_rank")


@check(
    "W2_per_user_top_k",
    f"""SELECT user_id, item_id, {r('score')}, rank FROM (SELECT *, row_number() OVER
    (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM best) WHERE rank <= 10""",
)
def _(w: World):
    scored = covisit.best_contribution(w.contributions)
    return top_rows(scored, "user_id", [F.desc("score"), F.asc("item_id")], 10)


@check("W3_global_rank", f"SELECT item_id, {r('score')}, global_rank FROM rranking")
def _(w: World):
    return popularity.fit_recency_popularity(w.history, w.cutoff, fixtures.RECENCY)


def _score_rank_sql(source: str) -> str:
    there = f"cross_score_available_{source}"
    rank = (
        f"CASE WHEN {there} THEN row_number() OVER (PARTITION BY user_id, {there} "
        f"ORDER BY cross_score_{source} DESC, item_id) ELSE 0 END"
    )
    size = f"count(*) FILTER (WHERE {there}) OVER (PARTITION BY user_id)"
    return (
        f"{rank} AS union_rank_cross_score_{source}, "
        + f32(f"CASE WHEN {there} THEN ({size} - {rank} + 1) / CAST({size} AS DOUBLE) ELSE 0.0 END",
              f"union_rank_norm_cross_score_{source}")
    )


@check(
    "W4_cross_score_rank",
    "SELECT user_id, item_id, union_rank_cross_score_item2item FROM (SELECT *, "
    + _score_rank_sql("item2item") + " FROM scored)",
)
def _(w: World):
    ranked = features.attach_score_ranks(w.scored, ["item2item"])
    return ranked.select(*PAIR_KEYS, "union_rank_cross_score_item2item")


@check(
    "W5_normalized_cross_rank",
    "SELECT user_id, item_id, union_rank_norm_cross_score_implicit_als FROM (SELECT *, "
    + _score_rank_sql("implicit_als") + " FROM scored)",
)
def _(w: World):
    ranked = features.attach_score_ranks(w.scored, ["implicit_als"])
    return ranked.select(*PAIR_KEYS, "union_rank_norm_cross_score_implicit_als")


@check(
    "W7_first_row_per_pair",
    f"""SELECT user_id, item_id, priority, rank, {r('score')}, source FROM (SELECT *, row_number() OVER
    (PARTITION BY user_id, item_id ORDER BY priority, rank, score DESC) AS n FROM
      (SELECT *, 0 AS priority FROM itwo UNION ALL SELECT *, 1 FROM rpop)) WHERE n = 1""",
)
def _(w: World):
    return popularity.first_per_pair(popularity.by_priority(w.sources[ITWO], w.sources[RPOP]))


_FILLED = filled("itwo", "rpop", 20, history=False)


@check("W8_final_rank", f"SELECT user_id, item_id, final_rank FROM ({_FILLED})")
def _(w: World):
    rows = popularity.first_per_pair(popularity.by_priority(w.sources[ITWO], w.sources[RPOP]))
    return popularity.final_ranks(rows, 20).select(*PAIR_KEYS, "final_rank")


@check("W9_contiguous_index", "SELECT item_id, position - 1 AS item_index FROM ucat")
def _(w: World):
    return factors.index_ids(w.history, "item_id", "item_index")


@check("W10_dense_group_id", "SELECT user_id, group_id FROM grp")
def _(w: World):
    return sampling.group_ids(w.targets)


@check(
    "W11_rank_after_catalogue_restriction",
    f"""SELECT user_id, item_id, {r('score')}, source, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS rank
    FROM als WHERE item_id IN (SELECT item_id FROM hist WHERE is_favorite = 1 AND watch_time > 200)""",
)
def _(w: World):
    liked = w.history.filter((F.col("is_favorite") == 1) & (F.col("watch_time") > 200))
    return popularity.restrict_catalogue(w.sources[ALS], interactions.known_items(liked))


# ---- sorts and top-k --------------------------------------------------------------------------


@check("T1_top_neighbors", f"SELECT item_id, neighbor_item_id, {r('score')}, co_user_count, rank FROM nbr")
def _(w: World):
    return covisit.fit_neighbors(w.history, COVISIT)


@check("T2_per_user_head", f"SELECT user_id, item_id, {r('score')}, rank FROM als WHERE rank <= 5")
def _(w: World):
    order = [F.desc("score"), F.asc("item_id")]
    return top_rows(w.sources[ALS].drop("rank", "source"), "user_id", order, 5)


@check("T3_first_list_elements", as_lists("(SELECT * FROM gpop WHERE rank <= 5)"))
def _(w: World):
    return w.popular_lists.select("user_id", F.slice("item_ids", 1, 5).alias("item_ids"))


@check(
    "T5_hash_ordered_user_sample",
    "SELECT user_id FROM (SELECT user_id, {} AS h FROM target) ORDER BY h, user_id LIMIT 40".format(
        pair_uniform("user_id", "0", "task12:eval_users")
    ),
)
def _(w: World):
    return sampling.evaluation_users(w.targets, count=40, seed=fixtures.SEED)


@check(
    "T5_hash_ordered_query_sample",
    "SELECT user_id FROM (SELECT DISTINCT user_id, {} AS h FROM e_truth) ORDER BY h, user_id LIMIT 30".format(
        id_hash("user_id", 7)
    ),
)
def _(w: World):
    return sampling.complete_query_users(w.labels.select("user_id").distinct(), count=30, seed=7)


@check(
    "T6_blockwise_top_k_merge",
    f"SELECT user_id, item_id, {r('score')}, rank FROM als WHERE rank <= 10",
)
def _(w: World):
    queries = w.user_factors.join(w.targets, "user_id", "left_semi")
    top = factors.retrieve_top(queries, w.item_factors, w.seen, 10, ALS, block_rows=16)
    return top.drop("source")


@check(
    "T7_deterministic_order",
    """SELECT user_id, item_id, row_number() OVER (ORDER BY user_id, views DESC, item_id) AS position
    FROM coll""",
)
def _(w: World):
    order = [F.asc("user_id"), F.desc("views"), F.asc("item_id")]
    return global_rank(w.collapsed.select(*PAIR_KEYS, "views"), order, "position").drop("views")


# ---- set operations ----------------------------------------------------------------------------


@check(
    "U1_union_distinct",
    "SELECT user_id, item_id FROM gpop UNION SELECT user_id, item_id FROM rpop UNION SELECT user_id, item_id FROM itwo",
)
def _(w: World):
    parts = [w.sources[s].select(*PAIR_KEYS) for s in (GPOP, RPOP, ITWO)]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@check(
    "U2_union_all_with_priority",
    "SELECT user_id, item_id, rank, 0 AS priority FROM als UNION ALL SELECT user_id, item_id, rank, 1 FROM gpop",
)
def _(w: World):
    tagged = popularity.by_priority(w.sources[ALS], w.sources[GPOP])
    return tagged.select(*PAIR_KEYS, "rank", "priority")


@check("U3_distinct_pairs", "SELECT user_id, item_id FROM seen")
def _(w: World):
    return interactions.seen_pairs(w.history)


@check("U3_distinct_items", "SELECT DISTINCT item_id FROM p_hist")
def _(w: World):
    return interactions.known_items(w.early.daily[0])


@check("U4_intersect", "SELECT user_id, item_id FROM gpop INTERSECT SELECT user_id, item_id FROM als")
def _(w: World):
    return w.sources[GPOP].select(*PAIR_KEYS).intersect(w.sources[ALS].select(*PAIR_KEYS))


@check("U5_except", "SELECT user_id, item_id FROM gpop EXCEPT SELECT user_id, item_id FROM als")
def _(w: World):
    return w.sources[GPOP].select(*PAIR_KEYS).exceptAll(w.sources[ALS].select(*PAIR_KEYS))


@check(
    "U6_table_equality",
    """SELECT 'only_left' AS "check", (SELECT count(*) FROM (SELECT user_id, item_id FROM gpop EXCEPT ALL SELECT user_id, item_id FROM rpop)) AS violations
    UNION ALL SELECT 'only_right', (SELECT count(*) FROM (SELECT user_id, item_id FROM rpop EXCEPT ALL SELECT user_id, item_id FROM gpop))""",
)
def _(w: World):
    return quality.same_rows(w.sources[GPOP].select(*PAIR_KEYS), w.sources[RPOP].select(*PAIR_KEYS))


# ---- vector and quantile functions ------------------------------------------------------------------


@check(
    "F7_vector_products",
    f"""SELECT u.user_id, i.item_id, {r('list_dot_product(u.v, i.v)', 'product')},
    {r('list_cosine_similarity(u.v, i.v)', 'cosine')}, {r('sqrt(list_dot_product(i.v, i.v))', 'length')}
    FROM seen JOIN ufac u USING (user_id) JOIN ifac i USING (item_id)""",
)
def _(w: World):
    scored = factors.score_pairs(w.seen, w.user_factors, w.item_factors, "given")
    return scored.filter("cross_score_available_given").select(
        *PAIR_KEYS,
        F.col("cross_score_given").alias("product"),
        F.col("given_cosine").alias("cosine"),
        F.col("given_item_norm").alias("length"),
    )


@check(
    "F8_unit_factors",
    f"SELECT item_id, {r('d[1]', 'first')}, {r('d[64]', 'last')}, 0 AS non_finite FROM iunit",
)
def _(w: World):
    bad = profiles.non_finite_factors(w.item_factors).agg(F.count(F.lit(1)).alias("n")).scalar()
    d = F.col("direction")
    return profiles.unit_factors(w.item_factors).select(
        "item_id", F.get(d, F.lit(0)).alias("first"), F.get(d, F.lit(63)).alias("last"), bad.alias("non_finite")
    )


@check(
    "F9_nearest_and_linear_quantiles",
    f"""SELECT list_sort(list(n))[CAST(floor((count(*) - 1) * 0.5 + 0.5) AS INT) + 1] AS p50,
    list_sort(list(n))[CAST(floor((count(*) - 1) * 0.9 + 0.5) AS INT) + 1] AS p90, {r('quantile_cont(n, 0.9)', 'linear90')}
    FROM (SELECT user_id, count(*) AS n FROM uni GROUP BY user_id)""",
)
def _(w: World):
    sizes = w.union.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    linear = sizes.agg(F.percentile("n", 0.9).alias("linear90")).scalar()
    return nearest_quantiles(sizes, "n", {"p50": 0.5, "p90": 0.9}).withColumn("linear90", linear)

