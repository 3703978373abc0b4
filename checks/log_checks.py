"""Sources, sinks, projections and predicates on the interaction log."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures
from checks.fixtures import COVISIT, SEED, World
from checks.registry import check, f32, r, step
from checks.steps import STRATUM, as_lists, is_active, pair_uniform
from morrow.functions import expressions as x
from morrow.functions.joins import attach_row
from morrow.functions.ranking import order_breaks
from morrow.operators import covisit, factors, interactions, popularity, profiles, sampling, union
from morrow.schemas import DAILY_INTERACTION, DAILY_KEYS, PAIR_KEYS, TARGET_USER
from morrow.sources import tables, text

RAW = "user_id, item_id, event_type, watch_time, date"
DAILY = "user_id, item_id, date, dt, views, watch_time, is_like, is_favorite, is_positive"


# ---- sources and sinks ------------------------------------------------------------
@check("S1_scan_raw_interactions", f"SELECT {RAW} FROM ev")
def _(w: World):
    path = w.folder("raw")
    w.raw.write.parquet(path)
    return tables.scan_raw(w.spark, path)


@check("S2_scan_target_users", "SELECT user_id FROM target")
def _(w: World):
    path = w.folder("targets")
    w.targets.write.parquet(path)
    return tables.scan_targets(w.spark, path)


@check("S3_daily_and_target_sources", f"SELECT {DAILY} FROM hist WHERE user_id IN (SELECT user_id FROM target)")
def _(w: World):
    path = w.folder("daily")
    w.history.write.parquet(path)
    daily = tables.table_source(w.spark, path, DAILY_INTERACTION, "daily history")
    targets = tables.table_source(w.spark, w.targets, TARGET_USER, "targets")
    return daily.join(targets, "user_id", "left_semi").select(*DAILY_INTERACTION)


@check("S4_multi_part_scan", f"SELECT {DAILY} FROM hist UNION ALL SELECT {DAILY} FROM val")
def _(w: World):
    folder = w.folder("parts")
    tables.write_tables(folder, first=w.history, second=w.validation)
    return tables.scan_parts(w.spark, f"{folder}/first", f"{folder}/second").select(*DAILY_INTERACTION)


@check("S5_projected_scan", "SELECT user_id, views FROM hist")
def _(w: World):
    folder = w.folder("parts")
    tables.write_tables(folder, history=w.history)
    return tables.scan_parts(w.spark, f"{folder}/history", columns=["user_id", "views"])


@check(
    "S6_user_range_read",
    f"SELECT {RAW} FROM p_ev WHERE user_id IN (SELECT user_id FROM p_target)",
)
def _(w: World):
    return tables.read_users(w.early.raw, w.early.targets)


@check("S7_sorted_parquet_sink", f"SELECT {DAILY} FROM hist")
def _(w: World):
    path = w.folder("sorted")
    tables.write_sorted(w.history.select(*DAILY_INTERACTION), path, DAILY_KEYS)
    return w.spark.read.parquet(path)


@check("S8_user_range_shards", "SELECT user_id, CAST(floor(group_id / 40) AS BIGINT) AS shard FROM grp")
def _(w: World):
    return tables.user_shards_of(w.targets, w.groups, 40)


@check(
    "S9_limited_history_scope",
    f"""SELECT {DAILY} FROM p_hist WHERE user_id IN (SELECT user_id FROM p_target)
    OR user_id IN (SELECT DISTINCT user_id FROM p_hist ORDER BY user_id LIMIT 100)""",
)
def _(w: World):
    scope = interactions.limited_history(w.early.daily[0], w.early.targets, 100)
    return scope.select(*DAILY_INTERACTION)


def _csv(w: World):
    path = w.folder("lists")
    text.write_recommendations(w.fused_lists, path)
    return text.read_recommendation_text(w.spark, path)


@check("S10_recommendation_csv_sink", as_lists("fusefill", "final_rank"))
def _(w: World):
    return text.parse_recommendations(_csv(w))


_TEXT_RULES = (
    "user_not_decimal", "user_over_uint64", "not_a_json_list", "wrong_length", "not_integers",
    "outside_int32", "repeated_item", "duplicate_user_id",
)


@check(
    "S11_strict_csv_source",
    "WITH l AS (" + as_lists("fusefill", "final_rank").replace("SELECT user_id,", "SELECT user_id, count(*) AS n,", 1)
    + ") SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{rule}' AS \"check\", (SELECT count(*) FROM l WHERE n <> 20) AS violations"
        if rule == "wrong_length"
        else f"SELECT '{rule}' AS \"check\", 0 AS violations"
        for rule in _TEXT_RULES
    )
    + ")",
)
def _(w: World):
    return text.recommendation_text_checks(_csv(w), fixtures.K)


@check("S12_csv_round_trip", "SELECT 'only_left' AS \"check\", 0 AS violations UNION ALL SELECT 'only_right', 0")
def _(w: World):
    from morrow.operators.quality import same_rows

    return same_rows(text.parse_recommendations(_csv(w)), w.fused_lists.select("user_id", "item_ids"))


# Ids of the upper half of the unsigned range, through a popular list, a file and back.
_UPPER = "9223372036854775808"


@check(
    "S12_unsigned_ids",
    f"""SELECT CAST(CAST(user_id AS HUGEINT) + {_UPPER} AS VARCHAR) AS user_id, item_ids
    FROM ({as_lists("gpop", "rank")})""",
)
def _(w: World):
    upper = lambda df: df.withColumn(
        "user_id", (F.col("user_id").cast("decimal(20,0)") + F.lit(_UPPER).cast("decimal(20,0)")).cast("decimal(20,0)")
    )
    top = popularity.recommend_unseen(
        w.global_ranking, upper(w.seen), upper(w.targets), fixtures.CAPS["global_popularity"], "global_popularity"
    )
    path = w.folder("unsigned")
    text.write_recommendations(popularity.candidates_to_lists(top), path)
    back = text.parse_recommendations(text.read_recommendation_text(w.spark, path))
    return back.withColumn("user_id", F.col("user_id").cast("string"))


_SINK_FEATURES = ["source_count", "generator_rank_norm_item2item"]


@check(
    "S13_training_row_sink",
    f"SELECT label, {f32('1.0 / sampling_probability', 'sample_weight')}, "
    f"{r('source_count')}, {f32('generator_rank_norm_item2item', 'generator_rank_norm_item2item')} "
    "FROM lab WHERE is_training_sample",
)
def _(w: World):
    path = w.folder("train")
    rows = sampling.weighted_rows(w.labeled_union, features=_SINK_FEATURES, fold=fixtures.FOLD, seed=SEED)
    text.write_training_rows(rows, path)
    schema = "label int, sample_weight double, source_count double, generator_rank_norm_item2item double"
    back = w.spark.read.schema(schema).option("sep", "\t").csv(path)
    return back.withColumn("sample_weight", F.col("sample_weight").cast("float"))


@check(
    "S14_grouped_row_sink",
    f"SELECT label, group_id, {r('source_count')}, "
    f"{f32('generator_rank_norm_item2item', 'generator_rank_norm_item2item')} "
    "FROM lab JOIN grp USING (user_id) WHERE is_training_sample",
)
def _(w: World):
    path = w.folder("grouped")
    text.write_grouped_rows(sampling.grouped_rows(w.labeled_union, w.groups, _SINK_FEATURES), path)
    schema = "label int, group_id bigint, source_count double, generator_rank_norm_item2item double"
    return w.spark.read.schema(schema).option("sep", "\t").csv(path)


@check(
    "S15_column_description",
    """SELECT CAST(n + 1 AS INTEGER) AS position, 'Num' AS role,
     ['views', 'watch_time', 'is_like', 'is_favorite', 'is_positive'][n] AS name FROM (SELECT unnest([1, 2, 3, 4, 5]) AS n)
    UNION ALL SELECT 0, 'Label', NULL UNION ALL SELECT 1, 'Weight', NULL""",
)
def _(w: World):
    names = [n for n in w.history.columns if n not in (*DAILY_KEYS, "dt")]
    return text.column_description(w.spark, names)


@check(
    "S17_fitted_state_restore",
    f"SELECT user_id, item_id, {r('score')}, rank, source FROM gpop",
)
def _(w: World):
    folder = w.folder("fitted")
    tables.write_tables(folder, ranking=w.global_ranking)
    restored = tables.read_tables(w.spark, folder, "ranking")["ranking"]
    return popularity.recommend_unseen(restored, w.seen, w.targets, 20, "global_popularity")


@check(
    "S18_reused_neighbors_new_seed_options",
    f"""SELECT user_id, item_id, {r('score')}, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (
        SELECT c.user_id, n.neighbor_item_id AS item_id, max(n.score) AS score
        FROM coll c JOIN nbr n ON c.item_id = n.item_id WHERE c.history_rank <= 3
        AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = c.user_id AND s.item_id = n.neighbor_item_id)
        GROUP BY c.user_id, n.neighbor_item_id)) WHERE rank <= 20""",
)
def _(w: World):
    config = COVISIT.with_seed_options(seed_k=3, seed_half_life_hours=None, seed_strength="uniform")
    top = covisit.recommend_neighbors(w.seeds, w.seen, w.neighbors, config, w.cutoff, 20)
    return top.drop("source")


@check("S19_sequence_store", "SELECT user_id, position, item_id FROM posseq")
def _(w: World):
    path = w.folder("sequences")
    tables.write_sorted(w.sequences, path, ["user_id", "position"])
    return w.spark.read.parquet(path)


@check(
    "S20_profile_store",
    f"SELECT user_id, kind, count, matched, {r('concentration')} FROM hprof",
)
def _(w: World):
    path = w.folder("profiles")
    tables.write_sorted(w.profiles, path, ["user_id", "kind"])
    return w.spark.read.parquet(path).drop("direction")


@check("S21_factor_model_store")
def _(w: World):
    pairs = factors.collapse_with_confidence(w.history, w.cutoff, fixtures.CONFIDENCE)
    fitted = factors.fit_als(pairs, rank=8, iterations=3)
    folder = w.folder("als")
    tables.write_factor_model(folder, fitted.model, fitted.user_factors, fitted.item_factors)
    return tables.read_factor_model(w.spark, folder)[1].select("user_id", F.size("features").alias("rank"))


@check(
    "S22_fusion_parameter_store",
    f"SELECT user_id, item_id, {r('ranker_score')} FROM fuse",
)
def _(w: World):
    import json
    from dataclasses import asdict

    path = w.folder("fusion")
    tables.write_parameters(path, w.spark, "rrf_ensemble", json.dumps(asdict(fixtures.FUSION)))
    stored = tables.read_parameters(w.spark, path).first()["parameters"]
    return union.fusion_scores(w.union, union.FusionConfig(**json.loads(stored)))


@check(
    "S23_experiment_log_append",
    "SELECT event_type AS run_id, count(*) AS rows FROM ev GROUP BY event_type",
)
def _(w: World):
    path = w.folder("runs")
    counts = interactions.event_counts(w.raw).withColumnRenamed("event_type", "run_id")
    tables.append_runs(path, counts.filter(F.col("run_id") != "view"))
    tables.append_runs(path, counts)  # only the missing run is added
    return tables.read_runs(w.spark, path)


# ---- projections and predicates ------------------------------------------------------
@check("P1_infer_cutoff", "SELECT cutoff FROM cut")
def _(w: World):
    return interactions.infer_cutoff(w.raw)


@check(
    "P2_prediction_times",
    """SELECT max(date) AS history_end, max(date) + INTERVAL 1 MICROSECOND AS prediction_start,
    max(date) + INTERVAL 1 MICROSECOND + INTERVAL 1 DAY AS prediction_end_exclusive FROM ev""",
)
def _(w: World):
    return interactions.prediction_times(w.raw)


@check(
    "P3_split_interactions",
    f"SELECT {RAW}, 'history' AS side FROM hist_raw UNION ALL SELECT {RAW}, 'validation' FROM val_raw",
)
def _(w: World):
    history, validation = w.sides
    return history.withColumn("side", F.lit("history")).unionByName(
        validation.withColumn("side", F.lit("validation"))
    )


@check(
    "P4_rolling_folds",
    """WITH f AS (SELECT 'rolling_' || n AS fold, cutoff - to_days(CAST(4 - n AS INTEGER)) AS start
      FROM cut, (SELECT unnest([1, 2, 3]) AS n))
    SELECT fold, CASE WHEN date < start THEN 'history' ELSE 'validation' END AS side, count(*) AS rows,
      count(DISTINCT user_id) AS users
    FROM ev JOIN f ON date < start + INTERVAL 1 DAY GROUP BY ALL""",
)
def _(w: World):
    parts = interactions.rolling_folds(w.raw, interactions.rolling_windows(w.cutoff))
    return parts.groupBy("fold", "side").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("user_id").alias("users")
    )


@check(
    "P5_positive_predicate",
    """SELECT user_id, item_id, date,
    watch_time > 60 OR is_like = 1 OR is_favorite = 1 AS positive FROM hist""",
)
def _(w: World):
    return w.history.select(*DAILY_KEYS, x.positive().alias("positive"))


@check(
    "P6_event_indicator",
    """SELECT user_id, item_id, date, CAST(event_type = 'like' AS INTEGER) AS is_like,
    CAST(event_type = 'favorite' AS INTEGER) AS is_favorite FROM ev""",
)
def _(w: World):
    return w.raw.select(
        *DAILY_KEYS,
        x.event_indicator("like").alias("is_like"),
        x.event_indicator("favorite").alias("is_favorite"),
    )


@check("P7_source_cap_filter", "SELECT user_id, item_id, rank FROM gpop WHERE rank <= 7")
def _(w: World):
    rows = w.sources["global_popularity"]
    return rows.filter(F.col("rank") <= 7).select(*PAIR_KEYS, "rank")


@check(
    "P8_normalized_rank",
    f"SELECT user_id, item_id, {r('(20 - rank + 1) / 20.0', 'rank_norm')} FROM rpop",
)
def _(w: World):
    return w.sources["recency_popularity"].select(
        *PAIR_KEYS, x.normalized_rank("rank", 20).alias("rank_norm")
    )


_CAPS = {"global_popularity": 3, "recency_popularity": 4, "item2item": 5, "implicit_als": 6}


@check(
    "P9_eligibility",
    "SELECT user_id, item_id FROM uni WHERE " + " OR ".join(is_active(s, c) for s, c in _CAPS.items()),
)
def _(w: World):
    return w.union.filter(union.eligible(_CAPS)).select(*PAIR_KEYS)


@check(
    "P10_safe_ratio",
    f"""SELECT item_id, {r('CASE WHEN likes > 0 THEN CAST(favs AS DOUBLE) / likes ELSE 0 END', 'ratio')}
    FROM (SELECT item_id, sum(is_like) AS likes, sum(is_favorite) AS favs FROM p_hist GROUP BY item_id)""",
)
def _(w: World):
    sums = w.early.daily[0].groupBy("item_id").agg(
        F.sum("is_like").alias("likes"), F.sum("is_favorite").alias("favs")
    )
    return sums.select("item_id", x.safe_ratio("favs", "likes").alias("ratio"))


@check(
    "P11_zero_sentinels",
    f"""SELECT t.user_id, coalesce(n, 0) AS n, coalesce(liked, false) AS liked, {r('coalesce(m, 0.0)', 'm')}
    FROM p_target t LEFT JOIN (SELECT user_id, count(*) AS n, bool_or(is_like = 1) AS liked,
      avg(watch_time) AS m FROM p_hist GROUP BY user_id) h ON t.user_id = h.user_id""",
)
def _(w: World):
    per_user = w.early.daily[0].groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or(F.col("is_like") == 1).alias("liked"),
        F.avg("watch_time").alias("m"),
    )
    return x.zero_sentinels(w.early.targets.join(per_user, "user_id", "left"), ["n", "liked", "m"])


@check("P12_age_hours", f"SELECT user_id, item_id, date, {r('age')} FROM aged")
def _(w: World):
    return w.history.select(*DAILY_KEYS, x.age_hours("dt", w.cutoff).alias("age"))


@check(
    "P13_exponential_decay",
    f"SELECT user_id, item_id, date, {r('exp(-ln(2.0) * age / 24.0)', 'decay')}, {r('1', 'no_decay')} FROM aged",
)
def _(w: World):
    age = x.age_hours("dt", w.cutoff)
    return w.history.select(
        *DAILY_KEYS,
        x.half_life_decay(age, 24.0).alias("decay"),
        x.half_life_decay(age, None).alias("no_decay"),
    )


@check(
    "P14_event_strength",
    f"""SELECT user_id, item_id, {r('1 + ln(1.0 + views) + CAST(watch_time > 60 AS INT) + is_like + is_favorite',
    'strength')} FROM coll""",
)
def _(w: World):
    return w.collapsed.select(*PAIR_KEYS, x.event_strength().alias("strength"))


_CONFIDENCE_SQL = """1 + (1.0 + 0.5 * ln(1.0 + greatest(views - 1.0, 0)) + CAST(watch_time > 60 AS INT)
  + 2.0 * is_like + 3.0 * is_favorite)
  * exp(-ln(2.0) * (date_diff('microsecond', last_dt, cutoff) / 3600000000.0) / 72.0)"""


step("confident", f"SELECT user_id, item_id, CAST({_CONFIDENCE_SQL} AS FLOAT) AS confidence FROM coll, cut")


@check(
    "P15_implicit_confidence",
    f"SELECT user_id, item_id, views, {f32(_CONFIDENCE_SQL, 'confidence')} FROM coll, cut",
)
def _(w: World):
    rows = factors.collapse_with_confidence(w.history, w.cutoff, fixtures.CONFIDENCE)
    return rows.select(*PAIR_KEYS, "views", "confidence")


@check("P16_training_stratum", f"SELECT user_id, item_id, {STRATUM} AS stratum FROM lab")
def _(w: World):
    return w.labeled_union.select(*PAIR_KEYS, sampling.training_stratum().alias("stratum"))


@check(
    "P17_feature_columns",
    """SELECT unnest(['source_count'] || list_transform(flatten([[a || b FOR b IN
      ['global_popularity', 'recency_popularity', 'item2item', 'implicit_als']] FOR a IN
      ['generator_score_', 'generator_rank_', 'generator_rank_norm_', 'generated_by_']]), lambda x: x)) AS feature""",
)
def _(w: World):
    names = sampling.check_feature_names(sampling.feature_columns(w.labeled_union))
    return w.spark.createDataFrame([(n,) for n in names], "feature string")


@check(
    "P18_feature_projection",
    f"SELECT user_id, item_id, {r('source_count')}, {f32('generator_score_item2item', 'generator_score_item2item')} FROM uni",
)
def _(w: World):
    return sampling.float_features(w.union, ["source_count", "generator_score_item2item"])


@check(
    "P19_feature_ablation",
    f"SELECT user_id, item_id, {f32('c', 'history_positive_concentration')} FROM uni "
    "JOIN (SELECT user_id, concentration AS c FROM hprof WHERE kind = 'positive') USING (user_id)",
)
def _(w: World):
    table = profiles.profile_features(
        w.union.select(*PAIR_KEYS), w.profiles, w.item_factors
    )
    kept = profiles.ablate(table, "B_positive")
    if [c for c in kept.columns if "like" in c or "long_watch" in c]:
        raise ValueError("an ablated profile kind is still present")
    return kept.select(*PAIR_KEYS, "history_positive_concentration")


@check("P20_retained_rows", "SELECT user_id, item_id, label FROM lab WHERE is_training_sample")
def _(w: World):
    return sampling.retained(w.labeled_union).select(*PAIR_KEYS, "label")


# ---- sorts, order checks, scalar families over the log --------------------------------
@check(
    "W6_order_and_duplicate_check",
    """SELECT count(*) FILTER (WHERE k < p) AS out_of_order_rows, count(*) FILTER (WHERE k = p) AS repeated_neighbours
    FROM (SELECT (user_id, event_type) AS k, lag((user_id, event_type)) OVER (ORDER BY event_id) AS p FROM events)""",
)
def _(w: World):
    return order_breaks(w.table("events"), ["user_id", "event_type"], "event_id", bucket_rows=500)


@check(
    "F1_date_functions",
    f"""SELECT user_id, item_id, CAST(date AS DATE) AS day, date - INTERVAL 1 DAY AS previous,
    date_diff('microsecond', date, cutoff) AS us FROM ev, cut""",
)
def _(w: World):
    return w.raw.select(
        *PAIR_KEYS,
        F.to_date("date").alias("day"),
        (F.col("date") - F.expr("INTERVAL 1 DAY")).alias("previous"),
        F.timestamp_diff("MICROSECOND", F.col("date"), x.instant(w.cutoff)).alias("us"),
    )


@check(
    "F2_numeric_functions",
    f"""SELECT event_id, {r('ln(value + 1)', 'log')}, {r('ln(1.0 + value)', 'log1p')},
    {r('exp(-value / 100)', 'exp')}, {r('pow(2.0, -value / 100)', 'exp2')}, {r('sqrt(value)', 'root')},
    {r('abs(value - 60)', 'absolute')}, {r('least(greatest(value, 10.0), 90.0)', 'clipped')} FROM events""",
)
def _(w: World):
    v = F.col("value")
    return w.table("events").select(
        "event_id",
        F.log(v + 1).alias("log"),
        F.log1p(v).alias("log1p"),
        F.exp(-v / 100).alias("exp"),
        F.pow(F.lit(2.0), -v / 100).alias("exp2"),
        F.sqrt(v).alias("root"),
        F.abs(v - 60).alias("absolute"),
        F.least(F.greatest(v, F.lit(10.0)), F.lit(90.0)).alias("clipped"),
    )


@check(
    "F3_conditional_functions",
    """SELECT event_id, CASE WHEN value > 60 THEN 'long' WHEN value > 10 THEN 'short' ELSE 'skip' END AS length,
    coalesce(nullif(event_type, 'error'), 'none') AS kind, nullif(event_type, 'error') IS NULL AS missing,
    isfinite(value) AS finite, event_type IN ('click', 'view') AS listed, value BETWEEN 10 AND 20 AS ranged
    FROM events""",
)
def _(w: World):
    v, kind = F.col("value"), F.nullif(F.col("event_type"), F.lit("error"))
    return w.table("events").select(
        "event_id",
        F.when(v > 60, "long").when(v > 10, "short").otherwise("skip").alias("length"),
        F.coalesce(kind, F.lit("none")).alias("kind"),
        kind.isNull().alias("missing"),
        x.finite("value").alias("finite"),
        F.col("event_type").isin("click", "view").alias("listed"),
        v.between(10, 20).alias("ranged"),
    )


@check(
    "F4_horizontal_functions",
    """SELECT user_id, item_id, date, is_like + is_favorite + is_positive AS flags,
    is_like = 1 OR is_favorite = 1 AS any_flag FROM hist""",
)
def _(w: World):
    return w.history.select(
        *DAILY_KEYS,
        x.total_of([F.col("is_like"), F.col("is_favorite"), F.col("is_positive")]).alias("flags"),
        x.any_of([F.col("is_like") == 1, F.col("is_favorite") == 1]).alias("any_flag"),
    )


@check(
    "F5_list_functions",
    """SELECT user_id, len(l) AS length, len(list_distinct(l)) AS distinct_items, l[1] AS first_item, l[20] AS last_item
    FROM (SELECT user_id, list(item_id ORDER BY final_rank) AS l FROM fusefill GROUP BY user_id)""",
)
def _(w: World):
    items = F.col("item_ids")
    return w.fused_lists.select(
        "user_id",
        F.size(items).alias("length"),
        F.size(F.array_distinct(items)).alias("distinct_items"),
        F.get(items, F.lit(0)).alias("first_item"),
        F.get(items, F.lit(19)).alias("last_item"),
    )


@check(
    "F6_mixing_hash_uniform",
    f"SELECT user_id, item_id, {pair_uniform('user_id', 'item_id', 'rolling_1')} AS uniform FROM seen",
)
def _(w: World):
    from morrow.functions.hashing import with_pair_uniform

    return with_pair_uniform(w.seen, seed=SEED, fold="rolling_1")


@check(
    "F10_json_list_functions",
    """SELECT user_id, '[' || string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY final_rank) || ']' AS text,
    true AS canonical_id FROM fusefill GROUP BY user_id""",
)
def _(w: World):
    return w.fused_lists.select(
        "user_id",
        F.to_json("item_ids").alias("text"),
        F.col("user_id").cast("string").rlike(text.DECIMAL_ID).alias("canonical_id"),
    )


@check(
    "F11_name_filters",
    """SELECT unnest(['generator_rank_item2item', 'generator_rank_norm_item2item', 'generator_score_item2item'])
    AS feature""",
)
def _(w: World):
    names = w.spark.createDataFrame([(n,) for n in w.union.columns], "feature string")
    return names.filter(
        F.col("feature").startswith("generator") & F.col("feature").contains("item2item")
    )


@check("T4_first_users_by_id", "SELECT user_id FROM target ORDER BY user_id LIMIT 25")
def _(w: World):
    return w.targets.orderBy("user_id").limit(25)


@check(
    "I20_full_history_horizon",
    """SELECT d.*, h.prediction_start FROM (SELECT user_id, item_id, CAST(date AS DATE) AS date, min(date) AS dt,
      count(*) AS views, max(watch_time) AS watch_time FROM ev GROUP BY user_id, item_id, CAST(date AS DATE)) d,
    (SELECT max(date) + INTERVAL 1 MICROSECOND AS prediction_start FROM ev) h""",
)
def _(w: World):
    from morrow.plans.folds import full_history

    daily, times = full_history(w.raw)
    start = times.select("prediction_start").scalar()
    return daily.select(*DAILY_KEYS, "dt", "views", "watch_time", start.alias("prediction_start"))


@check(
    "I21_prepare_temporal_fold",
    """SELECT positive_pairs, target_pairs, history_rows, validation_rows FROM
    (SELECT count(*) AS positive_pairs FROM e_pos), (SELECT count(*) AS target_pairs FROM e_truth),
    (SELECT count(*) AS history_rows FROM hist), (SELECT count(*) AS validation_rows FROM val)""",
)
def _(w: World):
    from morrow.plans.folds import fold_reports, prepare_fold

    fold = prepare_fold(w.raw, w.targets, w.folder("fold"))
    reports = fold_reports(w.raw, fold)
    parts = [
        reports["funnel"].select(
            F.col("positive_unique_pairs").alias("positive_pairs"),
            F.col("target_eligible_pairs").alias("target_pairs"),
        ),
        reports["history"].select(F.col("rows").alias("history_rows")),
        reports["validation"].select(F.col("rows").alias("validation_rows")),
    ]
    joined = parts[0]
    for part in parts[1:]:
        joined = attach_row(joined, part)
    return joined


