"""Data-quality checks on tables that break some of the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures
from checks.fixtures import World
from checks.fold_checks import ALS, GPOP, ITWO, RPOP
from checks.registry import check
from morrow.functions.joins import pair_join
from morrow.operators import factors, features, interactions, quality
from morrow.schemas import CANDIDATE, PAIR_KEYS


def violations(**counts: str) -> str:
    """One SQL row per rule; each value is a query for one number."""
    rows = [f"SELECT '{name}' AS \"check\", CAST(({sql}) AS BIGINT) AS violations" for name, sql in counts.items()]
    return " UNION ALL ".join(rows)


ZERO = "SELECT 0"


@check(
    "V1_no_nulls",
    violations(
        null_c_custkey=ZERO,
        null_c_name=ZERO,
        null_last="SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM p_hist)",
    ),
)
def _(w: World):
    last = w.early.daily[0].groupBy("user_id").agg(F.max("dt").alias("last"))
    rows = w.table("customer").join(last, F.col("c_custkey") == F.col("user_id"), "left")
    return quality.no_nulls(rows.select("c_custkey", "c_name", "last"))


@check(
    "V2_unique_keys",
    violations(duplicate_user_id_item_id="SELECT count(*) FROM (SELECT 1 FROM hist GROUP BY user_id, item_id HAVING count(*) > 1)"),
)
def _(w: World):
    return quality.unique_keys(w.history, PAIR_KEYS)


@check(
    "V3_schema_check",
    violations(**{
        "missing column source": "SELECT 1", "unexpected column source_count": "SELECT 1",
        "item_id is bigint, not int": "SELECT 1",
    }),
)
def _(w: World):
    table = w.sources[GPOP].withColumnRenamed("source", "source_count").withColumn(
        "item_id", F.col("item_id").cast("bigint")
    )
    return quality.schema_check(table, CANDIDATE)


@check(
    "V4_candidate_output",
    violations(
        null_cell=ZERO,
        other_source="SELECT count(*) FROM gpop",
        score_not_finite=ZERO,
        duplicate_user_id_item_id=ZERO,
        ranks_not_contiguous=ZERO,
        more_than_k_rows="SELECT count(*) FROM (SELECT user_id FROM rpop GROUP BY user_id HAVING count(*) > 15)",
        rank_order="""SELECT count(*) FROM (SELECT g.rank, row_number() OVER (PARTITION BY g.user_id
          ORDER BY -s.score DESC, g.item_id) AS e FROM gpop g JOIN granking s USING (item_id)) WHERE rank <> e""",
    ),
)
def _(w: World):
    reversed_scores = w.sources[GPOP].withColumn("score", -F.col("score"))
    return quality.candidate_checks(reversed_scores, RPOP, 15)


@check(
    "V5_neighbor_table",
    violations(
        null_cell=ZERO,
        self_link=ZERO,
        score_not_positive=ZERO,
        too_few_users="SELECT count(*) FROM nbr WHERE co_user_count < 3",
        duplicate_item_id_neighbor_item_id=ZERO,
        ranks_not_contiguous=ZERO,
        more_than_k_rows="SELECT count(*) FROM (SELECT 1 FROM nbr GROUP BY item_id HAVING count(*) > 12)",
        rank_order=ZERO,
    ),
)
def _(w: World):
    return quality.neighbor_checks(w.neighbors, 12, min_pair_users=3)


@check(
    "V6_item_ranking",
    violations(
        null_cell=ZERO,
        score_not_finite=ZERO,
        rank_order="""SELECT count(*) FROM (SELECT g.global_rank, row_number() OVER (ORDER BY r.score DESC, item_id) AS e
          FROM granking g JOIN rranking r USING (item_id)) WHERE global_rank <> e""",
        score_not_positive=ZERO,
        duplicate_item_id=ZERO,
    ),
)
def _(w: World):
    mixed = w.global_ranking.select("item_id", "global_rank").join(
        w.recency_ranking.select("item_id", "score"), "item_id"
    )
    return quality.ranking_checks(mixed, positive_scores=True)


_TIGHT = {GPOP: 10, RPOP: 20, ITWO: 20, ALS: 5}


def _union_sql() -> str:
    rules = {"null_cell": ZERO}
    for source, cap in _TIGHT.items():
        rules[f"sentinel_{source}"] = ZERO
        wrong = f"generated_by_{source} AND NOT (generator_rank_{source} <= {cap} AND abs(generator_rank_norm_{source} - ({cap} - generator_rank_{source} + 1) / {cap}.0) <= 1e-12)"
        rules[f"rank_{source}"] = f"SELECT count(*) FROM uni WHERE {wrong}"
        rules[f"finite_{source}"] = ZERO
    rules["source_count"] = ZERO
    rules["cross_item2item"] = ZERO
    rules["duplicate_user_id_item_id"] = ZERO
    rules["total_cap"] = "SELECT count(*) FROM (SELECT 1 FROM uni GROUP BY user_id HAVING count(*) > 44)"
    return violations(**rules)


@check("V7_union_invariants", _union_sql())
def _(w: World):
    return quality.union_checks(w.scored, _TIGHT, 44, cross=[ITWO])


@check(
    "V8_missing_item_lookup",
    violations(missing_item_features="SELECT count(*) FROM p_cold"),
)
def _(w: World):
    early = w.early
    users = features.user_features(early.daily[0], early.cutoff)
    items = features.item_features(early.daily[0], early.cutoff)
    return quality.missing_item_lookups(
        features.attach_history_features(early.truth.unseen, users, items)
    )


@check(
    "V9_history_cutoff",
    """SELECT count(*) AS rows, min(dt) AS min_dt, max(dt) AS max_dt, 0 AS null_timestamps,
    count(*) FILTER (WHERE dt >= (SELECT cutoff FROM cut)) AS timestamps_at_or_after_cutoff
    FROM (SELECT dt FROM hist UNION ALL SELECT dt FROM val)""",
)
def _(w: World):
    return quality.history_cutoff(w.history.unionByName(w.validation), w.cutoff)


@check(
    "V10_known_and_unseen",
    violations(
        unknown_item="SELECT count(*) FROM p_pos WHERE item_id NOT IN (SELECT item_id FROM p_hist)",
        seen_pair="SELECT count(*) FROM p_pos SEMI JOIN p_hist USING (user_id, item_id)",
    ),
)
def _(w: World):
    return quality.known_and_unseen(w.early.truth.positive, w.early.daily[0])


@check(
    "V11_recommendation_lists",
    violations(
        null_cell=ZERO,
        list_size="SELECT count(*) FROM (SELECT user_id FROM gpop GROUP BY user_id HAVING count(*) <> 15)",
        repeated_item=ZERO,
        null_item=ZERO,
        duplicate_user_id=ZERO,
        missing_user="SELECT count(*) FROM p_target WHERE user_id NOT IN (SELECT user_id FROM gpop)",
        extra_user="SELECT count(*) FROM target WHERE user_id NOT IN (SELECT user_id FROM p_target)",
        unknown_item="SELECT count(*) FROM gpop WHERE item_id NOT IN (SELECT item_id FROM p_hist)",
        seen_pair="SELECT count(*) FROM gpop SEMI JOIN p_hist USING (user_id, item_id)",
    ),
)
def _(w: World):
    return quality.recommendation_checks(w.popular_lists, w.early.targets, w.early.daily[0], 15)


@check(
    "V12_feature_table",
    violations(null_cell=ZERO, not_finite=ZERO, duplicate_user_id_item_id=ZERO),
)
def _(w: World):
    return quality.feature_table_checks(w.inference_rows)


@check(
    "V13_ranker_dataset",
    violations(
        label_not_binary=ZERO,
        positive_dropped=ZERO,
        hard_negative_dropped="SELECT count(*) FROM lab WHERE is_hard_negative AND source_count < 2",
        probability_range=ZERO,
        null_cell=ZERO,
        not_finite=ZERO,
        duplicate_user_id_item_id=ZERO,
    ),
)
def _(w: World):
    kept = F.col("is_training_sample") & ~(F.col("is_hard_negative") & (F.col("source_count") < 2))
    return quality.ranker_dataset_checks(w.labeled_union.withColumn("is_training_sample", kept))


@check("V14_covisit_parity", violations(covisit_availability=ZERO, covisit_score=ZERO))
def _(w: World):
    return quality.covisit_parity(w.inference_rows)


@check("V15_factor_parity", violations(factor_availability=ZERO))
def _(w: World):
    return quality.factor_parity(w.inference_rows)


@check(
    "V16_temporal_scope",
    violations(
        label_day_after_horizon="SELECT count(*) FROM (SELECT DISTINCT CAST(date AS DATE) AS d FROM ev), cut WHERE d + INTERVAL 1 DAY > cutoff",
        duplicate_cutoff=ZERO,
    ),
)
def _(w: World):
    days = w.raw.select(F.to_date("date").cast("timestamp_ntz").alias("cutoff")).distinct()
    return quality.scope_checks(days, w.cutoff)


@check(
    "V17_grouped_source_rows",
    violations(null_cell=ZERO, label_not_binary=ZERO, feature_not_finite=ZERO, duplicate_user_id_item_id=ZERO),
)
def _(w: World):
    return quality.grouped_source_checks(w.labeled_union, ["source_count", "generator_score_item2item"])


@check(
    "V18_metric_universe",
    violations(
        users_outside_targets_truth="SELECT count(DISTINCT user_id) FROM p_elig WHERE user_id NOT IN (SELECT user_id FROM p_target)",
        users_outside_targets_candidates="SELECT count(DISTINCT user_id) FROM gpop WHERE user_id NOT IN (SELECT user_id FROM p_target)",
    ),
)
def _(w: World):
    tables = {"truth": w.early.truth.eligible, "candidates": w.sources[GPOP]}
    return quality.universe_checks(tables, w.early.targets)


@check(
    "V19_daily_contract",
    violations(
        views_not_positive=ZERO,
        like_not_binary=ZERO,
        favorite_not_binary=ZERO,
        duplicate_user_id_item_id_date="""SELECT count(*) FROM (SELECT 1 FROM (SELECT user_id, item_id, date FROM hist
          UNION ALL SELECT user_id, item_id, date FROM val) GROUP BY user_id, item_id, date HAVING count(*) > 1)""",
        confidence_not_positive=ZERO,
    ),
)
def _(w: World):
    both = w.history.unionByName(w.validation)
    rows = factors.collapse_with_confidence(w.history, w.cutoff, fixtures.CONFIDENCE)
    return quality.daily_checks(both, rows)


@check(
    "V20_sequence_candidates_unseen",
    violations(unknown_item=ZERO, seen_pair="SELECT count(*) FROM als SEMI JOIN val USING (user_id, item_id)"),
)
def _(w: World):
    scope = w.validation
    pairs = w.sources[ALS].select(*PAIR_KEYS)
    seen = pair_join(pairs, interactions.seen_pairs(scope), "left_semi")
    known = pairs.join(interactions.known_items(w.history), "item_id", "left_anti")
    return quality.all_checks(
        quality.count_as_violation(known, "unknown_item"),
        quality.count_as_violation(seen, "seen_pair"),
    )


@check(
    "V21_frozen_prefix",
    violations(
        not_in_frozen="SELECT count(*) FROM (SELECT user_id, item_id, rank FROM gpop WHERE rank <= 10 EXCEPT ALL SELECT user_id, item_id, rank FROM rpop WHERE rank <= 12)",
        missing_from_deeper="SELECT count(*) FROM (SELECT user_id, item_id, rank FROM rpop WHERE rank <= 12 EXCEPT ALL SELECT user_id, item_id, rank FROM gpop WHERE rank <= 10)",
    ),
)
def _(w: World):
    return quality.prefix_checks(w.sources[GPOP], w.sources[RPOP].filter(F.col("rank") <= 12), 10)


_CELLS = "user_id, item_id, date, epoch_us(dt), views, watch_time, is_like, is_favorite, is_positive"


@check(
    "V22_table_checksum",
    f"""SELECT count(*) AS rows, bit_xor(h) AS xor, CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR) AS total
    FROM (SELECT CAST('0x' || left(md5(concat_ws(chr(31), {_CELLS})), 15) AS BIGINT) AS h FROM hist)""",
)
def _(w: World):
    exact = w.history.withColumn("dt", F.unix_micros(F.col("dt").cast("timestamp")))
    table = quality.table_checksum(exact)
    return table.select("rows", "xor", F.col("total").cast("string").alias("total"))


