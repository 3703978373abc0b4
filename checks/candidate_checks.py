"""Candidate sources, union, cross scores, fusion and feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures
from checks.fixtures import CAPS, COVISIT, FUSION, SEED, World
from checks.fold_checks import ALS, DAILY, EVIDENCE_SQL, GPOP, ITWO, RPOP, _score_rank_sql
from checks.registry import check, f32, r, step
from checks.steps import as_lists, filled, pair_uniform, unseen_top
from morrow.functions.stages import write_stage
from morrow.operators import (
    confidence_als,
    covisit,
    factors,
    features,
    interactions,
    popularity,
    profiles,
    quality,
    sampling,
    sequences,
    union,
)
from morrow.operators.pruned_retrieval import retrieve_pruned
from morrow.plans import candidates as candidate_plan
from morrow.plans import inference
from morrow.plans import rows as row_plan
from morrow.schemas import CANDIDATE, PAIR_KEYS

SOURCES = (GPOP, RPOP, ITWO, ALS)
CAND = f"user_id, item_id, {r('score')}, rank, source"


@check(
    "I1_build_ground_truth",
    " UNION ALL ".join(
        f"SELECT user_id, item_id, '{s}' AS stage FROM p_{t}"
        for s, t in (("positive", "pos"), ("unseen", "unseen"), ("cold", "cold"), ("eligible", "elig"), ("target", "truth"))
    ),
)
def _(w: World):
    truth, result = w.early.truth, None
    for stage in ("positive", "unseen", "cold", "eligible", "target"):
        part = getattr(truth, stage).select(*PAIR_KEYS, F.lit(stage).alias("stage"))
        result = part if result is None else result.unionByName(part)
    return result


step(
    "views_ranking",
    """SELECT item_id, CAST(raw_interaction_count AS DOUBLE) AS score,
    row_number() OVER (ORDER BY raw_interaction_count DESC, item_id) AS global_rank FROM stats""",
)


@check("I2_global_popularity", f"SELECT {CAND} FROM ({unseen_top('views_ranking', 12, GPOP)})")
def _(w: World):
    ranking = popularity.fit_global_popularity(w.history, "raw_interaction_count")
    return popularity.recommend_unseen(ranking, w.seen, w.targets, 12, GPOP)


@check(
    "I2_short_users",
    """SELECT t.user_id, (SELECT count(*) FROM stats) - count(s.item_id) AS count
    FROM target t LEFT JOIN seen s ON t.user_id = s.user_id GROUP BY t.user_id
    HAVING (SELECT count(*) FROM stats) - count(s.item_id) < 50""",
)
def _(w: World):
    rows = popularity.recommend_unseen(w.global_ranking, w.seen, w.targets, 50, GPOP)
    return popularity.short_users(rows, w.targets, 50)


def _recency(name: str, config: popularity.Recency, score: str) -> None:
    ranking = f"rk_{name}"
    step(
        ranking,
        f"""SELECT item_id, score, row_number() OVER (ORDER BY score DESC, item_id) AS global_rank FROM
        (SELECT item_id, {score} AS score FROM aged GROUP BY item_id) WHERE score > 0""",
    )

    @check(f"I3_recency_{name}", f"SELECT {CAND} FROM ({unseen_top(ranking, 10, RPOP)})")
    def _(w: World):
        fitted = popularity.fit_recency_popularity(w.history, w.cutoff, config)
        return popularity.recommend_unseen(fitted, w.seen, w.targets, 10, RPOP)


_recency("decay", fixtures.RECENCY, "sum(views * exp(-ln(2.0) * age / 24.0))")
_recency(
    "window",
    popularity.WindowViews("positive_daily_rows", hours=12),
    "CAST(sum(CASE WHEN age <= 12 THEN is_positive ELSE 0 END) AS DOUBLE)",
)
_recency(
    "window_blend",
    popularity.BlendedViews({None: 0.1, 24.0: 1.0, 72.0: 0.25}),
    "0.1 * sum(views) + 1.0 * sum(CASE WHEN age <= 24 THEN views ELSE 0 END)"
    " + 0.25 * sum(CASE WHEN age <= 72 THEN views ELSE 0 END)",
)
_SHORT = "CAST(sum(CASE WHEN age <= 24 THEN views ELSE 0 END) AS DOUBLE)"
_LONG = "sum(CASE WHEN age <= 100000 THEN views ELSE 0 END)"
_SHARE = "least(1.0, 24.0 / least(100000.0, (SELECT max(age) FROM aged)))"
_recency(
    "trending",
    popularity.TrendingViews(short=24, long=100000, smoothing=5),
    f"ln(1 + {_SHORT}) * (({_SHORT} + 5.0 * {_SHARE}) / ({_LONG} + 5.0) / {_SHARE})",
)


@check(
    "I4_item_to_item_fit",
    f"SELECT item_id, neighbor_item_id, {r('score')}, co_user_count, rank FROM nbr",
)
def _(w: World):
    return covisit.fit_neighbors(w.history, COVISIT)


step(
    "dirlink",
    """SELECT older AS item_id, newer AS neighbor_item_id, count(*) AS co_user_count,
    sum(pow(2.0, -gap / 24.0)) AS score FROM duo WHERE gap > 0 GROUP BY older, newer HAVING count(*) >= 2""",
)


@check(
    "I4_item_to_item_fit_directed",
    f"""SELECT item_id, neighbor_item_id, {r('score')}, co_user_count, rank FROM (SELECT *, row_number() OVER
    (PARTITION BY item_id ORDER BY score DESC, neighbor_item_id) AS rank FROM dirlink) WHERE rank <= 8""",
)
def _(w: World):
    config = covisit.CovisitConfig(
        direction="directed", pair_weight="time_decay", min_pair_users=2, neighbor_k=8
    )
    return covisit.fit_neighbors(w.history, config)


@check("I5_item_to_item_predict", f"SELECT {CAND} FROM itwo")
def _(w: World):
    return covisit.recommend_neighbors(w.seeds, w.seen, w.neighbors, COVISIT, w.cutoff, CAPS[ITWO])


@check(
    "I6_seed_preparation",
    "SELECT user_id, item_id, history_rank, true AS is_seed FROM coll WHERE history_rank <= 5 "
    "UNION ALL SELECT user_id, item_id, 0, false FROM seen",
)
def _(w: World):
    seeds, seen = covisit.prepare_seeds(w.history, w.targets, 5)
    return seeds.select(*PAIR_KEYS, "history_rank", F.lit(True).alias("is_seed")).unionByName(
        seen.select(*PAIR_KEYS, F.lit(0).alias("history_rank"), F.lit(False).alias("is_seed"))
    )


def _als(w: World) -> factors.FactorModel:
    pairs = factors.collapse_with_confidence(w.history, w.cutoff, fixtures.CONFIDENCE)
    return factors.fit_als(pairs, rank=8, iterations=3)


@check("I7_implicit_als_fit")
def _(w: World):
    fitted = _als(w)
    return fitted.item_factors.select("item_id", F.size("features").alias("rank"))


@check("I7_confidence_factors")
def _(w: World):
    pairs = factors.collapse_with_confidence(w.history, w.cutoff, fixtures.CONFIDENCE)
    fit = confidence_als.fit_confidence_als(pairs, confidence_als.ConfidenceAlsConfig(rank=8, iterations=2))
    sides = [
        table.select(F.lit(side).alias("side"), F.col(key).cast("bigint").alias("entity"), "features")
        for side, key, table in (("user", "user_id", fit.user_factors), ("item", "item_id", fit.item_factors))
    ]
    rounded = F.transform("features", lambda x: F.round(x, 6) + F.lit(0.0))
    return sides[0].unionByName(sides[1]).select("side", "entity", rounded.alias("features"))


# One half step on three components of the given item vectors, solved by Cramer's rule.
@check(
    "I7_confidence_half_step",
    f"""WITH item3 AS (SELECT item_id, v[1] AS a, v[2] AS b, v[3] AS c FROM ifac),
    whole AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * b) AS bb, sum(b * c) AS bc, sum(c * c) AS cc FROM item3),
    own AS (
      SELECT user_id, sum((w - 1) * a * a) AS aa, sum((w - 1) * a * b) AS ab, sum((w - 1) * a * c) AS ac,
        sum((w - 1) * b * b) AS bb, sum((w - 1) * b * c) AS bc, sum((w - 1) * c * c) AS cc,
        sum(w * a) AS x, sum(w * b) AS y, sum(w * c) AS z
      FROM (SELECT user_id, item_id, CAST(confidence AS DOUBLE) AS w FROM confident) JOIN item3 USING (item_id) GROUP BY user_id),
    m AS (
      SELECT user_id, own.aa + whole.aa + 0.1 AS p, own.ab + whole.ab AS q, own.ac + whole.ac AS r,
        own.bb + whole.bb + 0.1 AS s, own.bc + whole.bc AS t, own.cc + whole.cc + 0.1 AS u, x, y, z FROM own, whole),
    d AS (SELECT *, p * (s * u - t * t) - q * (q * u - t * r) + r * (q * t - s * r) AS det FROM m)
    SELECT user_id, {r('(x * (s * u - t * t) - q * (y * u - t * z) + r * (y * t - s * z)) / det', 'x1')},
      {r('(p * (y * u - t * z) - x * (q * u - t * r) + r * (q * z - y * r)) / det', 'x2')},
      {r('(p * (s * z - y * t) - q * (q * z - y * r) + x * (q * t - s * r)) / det', 'x3')} FROM d""",
)
def _(w: World):
    pairs = factors.collapse_with_confidence(w.history, w.cutoff, fixtures.CONFIDENCE)
    three = w.item_factors.select("item_id", F.slice("features", 1, 3).cast("array<double>").alias("features"))
    config = confidence_als.ConfidenceAlsConfig(rank=3, regularization=0.1, steps=6, block_rows=64)
    found = confidence_als.half_step(pairs, "user_id", "item_id", three, config)
    return found.select("user_id", *(F.get("features", F.lit(i)).alias(f"x{i + 1}") for i in range(3)))


@check("I8_implicit_als_predict")
def _(w: World):
    fitted = _als(w)
    queries = fitted.user_factors.join(w.targets, "user_id", "left_semi")
    return factors.retrieve_top(queries, fitted.item_factors, w.seen, 20, ALS)


@check("I8_given_factor_predict", f"SELECT {CAND} FROM als")
def _(w: World):
    return w.sources[ALS].select(*CANDIDATE)


@check("I9_positive_sequences", "SELECT user_id, position, item_id FROM posseq")
def _(w: World):
    return sequences.positive_sequences(w.history)


step(
    "elig_seq",
    """SELECT l.user_id, l.length FROM seqlen l LEFT JOIN (SELECT user_id, count(*) AS n FROM seen GROUP BY user_id) s
    USING (user_id) WHERE l.length >= 2 AND coalesce(s.n, 0) < (SELECT count(*) FROM ucat)""",
)
step(
    "seqend",
    f"""SELECT user_id, stop, least(stop - 1, 6) AS window_length FROM (SELECT user_id,
    CAST(floor({pair_uniform('user_id', '3', 'sequence_windows')} * (length - 1)) AS BIGINT) + 2 AS stop FROM elig_seq)""",
)


def _windows(w: World):
    catalogue = interactions.known_items(w.history).agg(F.count(F.lit(1)).alias("n")).scalar()
    lengths = sequences.sequence_lengths(w.sequences, w.targets)
    users = sequences.eligible_users(lengths, w.seen, catalogue)
    ends = sequences.window_ends(users, epoch=3, seed=SEED, max_length=6)
    return sequences.training_windows(w.sequences, ends)


def _window_list(low: str, high: str) -> str:
    return (
        "string_agg(CASE WHEN position BETWEEN {} AND {} THEN CAST(item_id AS VARCHAR) END, ',' ORDER BY position)"
    ).format(low, high)


@check(
    "I10_sequence_training_windows",
    f"""SELECT user_id, {_window_list('stop - window_length', 'stop - 1')} AS inputs,
    {_window_list('stop - window_length + 1', 'stop')} AS targets
    FROM posseq JOIN seqend USING (user_id) GROUP BY user_id""",
)
def _(w: World):
    return _windows(w)


step(
    "draws",
    f"""SELECT user_id, slot, CAST(floor({pair_uniform('user_id', 'slot', 'negatives:3')} *
      ((SELECT count(*) FROM ucat) - coalesce(n, 0))) AS BIGINT) + 1 AS ordinal
    FROM (SELECT user_id, unnest(range(0, window_length * 2)) AS slot FROM seqend)
    LEFT JOIN (SELECT user_id, count(*) AS n FROM seen GROUP BY user_id) USING (user_id)""",
)
step(
    "unseen_items",
    """SELECT t.user_id, c.item_id, row_number() OVER (PARTITION BY t.user_id ORDER BY c.item_id) AS ordinal
    FROM target t CROSS JOIN ucat c WHERE NOT EXISTS
      (SELECT 1 FROM seen s WHERE s.user_id = t.user_id AND s.item_id = c.item_id)""",
)


@check(
    "I11_unseen_negative_sampling",
    """SELECT user_id, CAST(slot // 2 + 1 AS INTEGER) AS target_number, CAST(slot % 2 AS INTEGER) AS draw, item_id
    FROM draws JOIN unseen_items USING (user_id, ordinal)""",
)
def _(w: World):
    return sequences.unseen_negatives(_windows(w), w.seen, w.history, draws=2, epoch=3, seed=SEED)


@check(
    "I12_prediction_context",
    """SELECT t.user_id, coalesce(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY position), '') AS items
    FROM p_target t LEFT JOIN (SELECT s.user_id, position, item_id FROM (SELECT user_id, item_id,
      row_number() OVER (PARTITION BY user_id ORDER BY dt, item_id) AS position,
      count(*) OVER (PARTITION BY user_id) AS n FROM p_hist WHERE is_positive = 1) s WHERE position > n - 3) c
    ON t.user_id = c.user_id GROUP BY t.user_id""",
)
def _(w: World):
    ordered = sequences.positive_sequences(w.early.daily[0])
    return sequences.prediction_context(ordered, w.early.targets, 3)


@check("I13_pruned_retrieval", f"SELECT user_id, item_id, {r('score')}, rank, 'sasrec' AS source FROM als WHERE rank <= 15")
def _(w: World):
    return retrieve_pruned(w.user_factors, w.item_factors, w.seen, 15, "sasrec", block_rows=16).rows


@check("I13_embedding_retrieval", f"SELECT user_id, item_id, {r('score')}, rank, 'sasrec' AS source FROM als WHERE rank <= 15")
def _(w: World):
    return factors.retrieve_top(w.user_factors, w.item_factors, w.seen, 15, "sasrec", block_rows=64)


_PAIR_SQL = f"""{r('CASE WHEN x.v IS NULL OR y.v IS NULL THEN 0 ELSE list_dot_product(x.v, y.v) END', 'cross_score_sasrec')},
  x.v IS NOT NULL AND y.v IS NOT NULL AS cross_score_available_sasrec,
  {r('CASE WHEN x.v IS NULL OR y.v IS NULL THEN 0 ELSE sqrt(list_dot_product(x.v, x.v)) END', 'sasrec_query_norm')},
  {r('CASE WHEN x.v IS NULL OR y.v IS NULL THEN 0 ELSE sqrt(list_dot_product(y.v, y.v)) END', 'sasrec_item_norm')},
  {r('CASE WHEN x.v IS NULL OR y.v IS NULL THEN 0 ELSE list_cosine_similarity(x.v, y.v) END', 'sasrec_cosine')}"""


@check(
    "I14_embedding_pair_scoring",
    f"""SELECT u.user_id, u.item_id, {_PAIR_SQL} FROM p_truth u LEFT JOIN ufac x ON u.user_id = x.user_id
    LEFT JOIN ifac y ON u.item_id = y.item_id""",
)
def _(w: World):
    return factors.score_pairs(w.early.truth.target, w.user_factors, w.item_factors, "sasrec")


@check("I15_fill_with_popularity", as_lists("(" + filled("itwo", "gpop", 20) + ")", "final_rank"))
def _(w: World):
    rows = popularity.fill_with_popularity(w.sources[ITWO], w.sources[GPOP], w.targets, w.history)
    return popularity.ordered_lists(rows, "final_rank")


@check("I16_candidates_to_recommendations", as_lists("(SELECT * FROM gpop WHERE rank <= 10)"))
def _(w: World):
    return popularity.candidates_to_lists(w.sources[GPOP], 10)


step(
    "mixed_top",
    """SELECT user_id, item_id, ranker_score AS score, rank, 'ranker' AS source FROM (SELECT *, row_number() OVER
    (PARTITION BY user_id ORDER BY ranker_score DESC, item_id) AS rank FROM mixed_scores) WHERE rank <= 20""",
)
step(
    "gfall",
    """SELECT user_id, item_id, generator_score_global_popularity AS score, generator_rank_global_popularity AS rank,
    'global_popularity_fallback' AS source FROM uni WHERE generated_by_global_popularity""",
)
step("rankfill", filled("mixed_top", "gfall", 20, history=False))


@check("I17_recommendations_with_fallback", f"SELECT user_id, item_id, final_rank AS rank, {r('score')}, source FROM rankfill")
def _(w: World):
    return inference.final_lists(w.scores, w.union, w.targets)[1]


@check(
    "I17_fallback_report",
    """SELECT (SELECT count(*) FROM target) AS users, (SELECT count(*) FROM rankfill) AS rows,
    (SELECT count(*) FROM target t WHERE (SELECT count(*) FROM mixed_top m WHERE m.user_id = t.user_id) < 20) AS fallback_users,
    (SELECT count(*) FROM rankfill WHERE source = 'global_popularity_fallback') AS fallback_positions""",
)
def _(w: World):
    return inference.final_lists(w.scores, w.union, w.targets)[2]


@check("I18_standalone_top20", as_lists("(" + filled("als", "gpop", 20, history=False) + ")", "final_rank"))
def _(w: World):
    return popularity.standalone_top(w.sources[ALS], w.sources[GPOP])


@check(
    "I19_fallback_usage",
    """SELECT count(*) AS fallback_positions, count(DISTINCT user_id) AS fallback_users FROM fusefill f
    WHERE NOT EXISTS (SELECT 1 FROM als a WHERE a.user_id = f.user_id AND a.item_id = f.item_id)""",
)
def _(w: World):
    return popularity.fallback_usage(w.fused_lists, w.sources[ALS])


@check("I22_run_candidate_model", f"SELECT {CAND}, 0 AS violations FROM rpop")
def _(w: World):
    rows = popularity.recommend_unseen(w.recency_ranking, w.seen, w.targets, CAPS[RPOP], RPOP)
    stored = write_stage(rows, "validated")
    broken = quality.candidate_checks(stored, RPOP, CAPS[RPOP]).agg(F.sum("violations").alias("n"))
    return stored.withColumn("violations", broken.scalar())


step("p_scope", f"SELECT {DAILY} FROM p_hist WHERE user_id IN (SELECT user_id FROM p_target)")


@check("I23_restricted_ground_truth", "SELECT * FROM p_truth WHERE item_id IN (SELECT item_id FROM p_scope)")
def _(w: World):
    scope = w.early.daily[0].join(w.early.targets, "user_id", "left_semi")
    return interactions.restrict_truth(w.early.truth.target, scope)


# ---- union and cross scores ----------------------------------------------------------------

_UNI = ["user_id", "item_id", "source_count"]
for _s in SOURCES:
    _UNI += [
        r(f"generator_score_{_s}"), f"generator_rank_{_s}", r(f"generator_rank_norm_{_s}"),
        f"generated_by_{_s}",
    ]
_CROSS = [
    r("cross_score_global_popularity"), "cross_rank_global_popularity", "cross_score_available_global_popularity",
    r("cross_score_recency_popularity"), "cross_rank_recency_popularity", "cross_score_available_recency_popularity",
    r("cross_score_item2item"), "cross_score_available_item2item",
    r("cross_score_implicit_als"), "cross_score_available_implicit_als",
]


@check("C1_candidate_union", f"SELECT {', '.join(_UNI)} FROM uni")
def _(w: World):
    return union.build_union(w.sources, fixtures.UNION)


@check(
    "C2_ranking_cross_scores",
    "SELECT user_id, item_id, " + ", ".join(_CROSS[:3]) + " FROM scored",
)
def _(w: World):
    return union.attach_ranking(w.union.select(*PAIR_KEYS), GPOP, w.global_ranking)


@check(
    "C3_item_to_item_cross_scores",
    "SELECT user_id, item_id, " + ", ".join(_CROSS[6:8]) + " FROM scored",
)
def _(w: World):
    return union.attach_covisit(w.union.select(*PAIR_KEYS), w.seeds, w.neighbors, COVISIT, w.cutoff)


@check(
    "C4_factor_cross_scores",
    "SELECT user_id, item_id, " + ", ".join(_CROSS[8:]) + " FROM scored",
)
def _(w: World):
    return union.attach_factor_product(w.union.select(*PAIR_KEYS), w.user_factors, w.item_factors)


def _three_ranks() -> str:
    return ", ".join(_score_rank_sql(s) for s in ("item2item", "implicit_als", "sasrec"))


step(
    "scored5",
    """SELECT u.*, cross_score_implicit_als AS cross_score_sasrec,
    cross_score_available_implicit_als AS cross_score_available_sasrec FROM scored u""",
)


@check(
    "C5_cross_scored_union",
    "SELECT user_id, item_id, union_rank_cross_score_item2item, union_rank_cross_score_implicit_als, "
    f"union_rank_cross_score_sasrec, {r('cross_score_sasrec')} FROM (SELECT *, " + _three_ranks() + " FROM scored5)",
)
def _(w: World):
    table = candidate_plan.expanded_union(w.scored, w.user_factors, w.item_factors)
    ranks = [f"union_rank_cross_score_{s}" for s in ("item2item", "implicit_als", "sasrec")]
    return table.select(*PAIR_KEYS, *ranks, "cross_score_sasrec")


@check("C6_fusion_scores", f"SELECT user_id, item_id, {r('ranker_score')} FROM fuse")
def _(w: World):
    return union.fusion_scores(w.union, FUSION)


@check("C7_fusion_ranks", f"SELECT {CAND} FROM fused")
def _(w: World):
    return union.fusion_candidates(w.union, FUSION)


@check("C8_fusion_recommend", as_lists("fusefill", "final_rank"))
def _(w: World):
    rows = union.fusion_recommend(w.union, FUSION, w.sources[GPOP], w.targets, w.history)
    return popularity.ordered_lists(rows, "final_rank")


@check(
    "C9_history_features_attached",
    f"""SELECT u.user_id, u.item_id, x.n AS user_daily_rows_all, {f32('x.m', 'user_watch_time_mean_all')},
    y.n AS item_daily_rows_all, {f32('y.m', 'item_watch_time_mean_all')}, true AS item_history_available FROM uni u
    JOIN (SELECT user_id, count(*) AS n, avg(watch_time) AS m FROM hist GROUP BY user_id) x ON u.user_id = x.user_id
    JOIN (SELECT item_id, count(*) AS n, avg(watch_time) AS m FROM hist GROUP BY item_id) y ON u.item_id = y.item_id""",
)
def _(w: World):
    table = features.attach_history_features(
        w.union.select(*PAIR_KEYS), w.lookups["user_features"], w.lookups["item_features"]
    )
    return table.select(
        *PAIR_KEYS, "user_daily_rows_all", "user_watch_time_mean_all", "item_daily_rows_all",
        "item_watch_time_mean_all", "item_history_available",
    )


@check(
    "C10_union_score_ranks",
    "SELECT user_id, item_id, " + ", ".join(
        f"union_rank{n}_cross_score_{s}" for s in ("item2item", "implicit_als") for n in ("", "_norm"))
    + " FROM (SELECT *, " + ", ".join(_score_rank_sql(s) for s in ("item2item", "implicit_als")) + " FROM scored)",
)
def _(w: World):
    table = features.attach_score_ranks(w.scored, ("item2item", "implicit_als"))
    names = [f"union_rank{n}_cross_score_{s}" for s in ("item2item", "implicit_als") for n in ("", "_norm")]
    return table.select(*PAIR_KEYS, *names)


step("evidence", EVIDENCE_SQL)
_EVIDENCE = [
    "covisit_matched_seed_count", "covisit_contribution_sum", "covisit_contribution_mean",
    "covisit_contribution_max", "covisit_neighbor_score_sum", "covisit_neighbor_score_mean",
    "covisit_neighbor_score_max", "covisit_co_user_count_max", "covisit_co_user_count_mean",
    "covisit_best_neighbor_rank",
]


@check(
    "C11_covisit_features",
    "SELECT u.user_id, u.item_id, " + ", ".join(f"coalesce({n}, 0) AS {n}" for n in _EVIDENCE)
    + ", e.user_id IS NOT NULL AS covisit_available FROM uni u LEFT JOIN evidence e"
    " ON u.user_id = e.user_id AND u.item_id = e.item_id",
)
def _(w: World):
    return features.attach_covisit_features(w.union.select(*PAIR_KEYS), w.contributions)


@check(
    "C12_factor_norms",
    f"""SELECT 'user' AS side, user_id AS id, {f32('sqrt(list_dot_product(v, v))', 'norm')} FROM ufac
    UNION ALL SELECT 'item', item_id, {f32('sqrt(list_dot_product(v, v))', 'norm')} FROM ifac""",
)
def _(w: World):
    users = features.factor_norms(w.user_factors, "user_id")
    items = features.factor_norms(w.item_factors, "item_id")
    return users.select(
        F.lit("user").alias("side"), F.col("user_id").alias("id"), F.col("als_user_factor_norm").alias("norm")
    ).unionByName(
        items.select(
            F.lit("item").alias("side"), F.col("item_id").cast("bigint").alias("id"),
            F.col("als_item_factor_norm").alias("norm"),
        )
    )


step(
    "normed",
    """SELECT u.user_id, u.item_id, cross_score_implicit_als AS s,
    CAST(sqrt(list_dot_product(x.v, x.v)) AS FLOAT) AS a, CAST(sqrt(list_dot_product(y.v, y.v)) AS FLOAT) AS b
    FROM scored u JOIN ufac x ON u.user_id = x.user_id JOIN ifac y ON u.item_id = y.item_id""",
)


@check(
    "C13_factor_features",
    f"""SELECT user_id, item_id, {f32('a', 'als_user_factor_norm')}, {f32('b', 'als_item_factor_norm')},
    {r('CAST(CAST(a AS DOUBLE) * b AS FLOAT)', 'als_factor_norm_product')}, true AS als_cosine_available,
    {f32('s / CAST(CAST(CAST(a AS DOUBLE) * b AS FLOAT) AS DOUBLE)', 'als_cosine_similarity')} FROM normed""",
)
def _(w: World):
    table = features.attach_factor_features(
        w.scored, w.lookups["als_user_norms"], w.lookups["als_item_norms"]
    )
    return table.select(
        *PAIR_KEYS, "als_user_factor_norm", "als_item_factor_norm", "als_factor_norm_product",
        "als_cosine_available", "als_cosine_similarity",
    )


def _profile_columns() -> str:
    columns = []
    for kind in profiles.PROFILE_KINDS:
        p = f"p_{kind}"
        columns += [
            f32(f"CASE WHEN {p}.direction IS NULL THEN 0 ELSE greatest(-1, least(1, list_dot_product(i.d, {p}.direction))) END",
                f"history_{kind}_cosine"),
            f32(f"{p}.concentration", f"history_{kind}_concentration"),
            f32(f"ln(1.0 + {p}.count)", f"history_{kind}_log_count"),
            f32(f"{p}.matched / CAST(greatest({p}.count, 1) AS DOUBLE)", f"history_{kind}_embedding_coverage"),
            f32(f"CASE WHEN {p}.direction IS NULL THEN 0 ELSE 1 END", f"history_{kind}_available"),
        ]
    return ", ".join(columns)


@check(
    "C14_history_profile_features",
    f"SELECT u.user_id, u.item_id, {_profile_columns()} FROM uni u JOIN iunit i ON u.item_id = i.item_id "
    + " ".join(
        f"JOIN hprof p_{k} ON p_{k}.user_id = u.user_id AND p_{k}.kind = '{k}'" for k in profiles.PROFILE_KINDS
    ),
)
def _(w: World):
    return profiles.profile_features(w.union.select(*PAIR_KEYS), w.profiles, w.item_factors)


@check("C15_inference_ranker_rows")
def _(w: World):
    return row_plan.inference_rows(
        w.scored, w.lookups, w.seeds, w.neighbors, COVISIT, w.cutoff
    )


@check(
    "C15_inference_pair_identity",
    """SELECT 'only_left' AS "check", 0 AS violations UNION ALL SELECT 'only_right', 0""",
)
def _(w: World):
    return quality.same_rows(w.inference_rows.select(*PAIR_KEYS), w.union.select(*PAIR_KEYS))


@check(
    "C16_ranker_rows",
    f"SELECT user_id, item_id, label, is_hard_negative, is_training_sample, {r('sampling_probability')} FROM lab",
)
def _(w: World):
    table = row_plan.ranker_rows(
        w.scored, w.labels, w.lookups, w.seeds, w.neighbors, COVISIT, w.cutoff,
        fixtures.FOLD, fixtures.SAMPLING,
    )
    return table.select(*PAIR_KEYS, "label", *sampling.TRAINING_METADATA)


@check("C17_candidate_table", f"SELECT user_id, item_id, source_count, {', '.join(_CROSS)} FROM scored")
def _(w: World):
    table, _seeds, _sources = candidate_plan.candidate_table(
        w.fitted, w.history, w.targets, w.cutoff, fixtures.UNION
    )
    names = [c for c in table.columns if c.startswith("cross_")]
    return table.select(*PAIR_KEYS, "source_count", *names)


_FROZEN = {
    "source_count": "smallint",
    "cross_score_item2item": "double",
    "covisit_contribution_max": "double",
    "user_daily_rows_all": "bigint",
}


@check(
    "C18_frozen_features",
    f"""SELECT u.user_id, u.item_id, u.source_count, {r('u.cross_score_item2item', 'cross_score_item2item')},
    {r('u.cross_score_item2item', 'covisit_contribution_max')}, x.n AS user_daily_rows_all FROM scored u
    JOIN (SELECT user_id, count(*) AS n FROM hist GROUP BY user_id) x ON u.user_id = x.user_id""",
)
def _(w: World):
    return row_plan.frozen_features(w.inference_rows.select(*PAIR_KEYS, *_FROZEN), _FROZEN)


@check(
    "C19_materialized_features",
    f"""SELECT user_id, item_id, label, {f32('cross_score_item2item', 'covisit_contribution_max')}
    FROM (SELECT s.*, l.label, {pair_uniform('s.user_id', 's.item_id', 'expanded_ranker:canonical')} AS u
      FROM scored s JOIN lab l ON s.user_id = l.user_id AND s.item_id = l.item_id) WHERE label = 1 OR u < 0.25""",
)
def _(w: World):
    sampled = sampling.sample_union(
        w.scored, w.labels, fold=fixtures.FOLD, seed=SEED, negative_probability=0.25
    )
    table = row_plan.materialize_features(
        sampled, w.lookups, w.seeds, w.neighbors, COVISIT, w.cutoff, w.profiles, w.item_factors
    )
    return table.select(*PAIR_KEYS, "label", "covisit_contribution_max")
