"""SQL steps: an independent statement of every stage of the fixtures."""

from __future__ import annotations

from checks.fixtures import CAPS, DIM, FOLD, FUSION, SEED
from checks.registry import step
from morrow.functions.hashing import (
    FIRST_MIX_MULTIPLIER,
    GOLDEN_INCREMENT,
    ITEM_MULTIPLIER,
    SECOND_MIX_MULTIPLIER,
    USER_MULTIPLIER,
    fold_seed,
)

DAILY = """
SELECT user_id, item_id, CAST(date AS DATE) AS date, min(date) AS dt, count(*) AS views,
  max(watch_time) AS watch_time,
  max(CASE WHEN event_type = 'like' THEN 1 ELSE 0 END) AS is_like,
  max(CASE WHEN event_type = 'favorite' THEN 1 ELSE 0 END) AS is_favorite,
  max(CASE WHEN watch_time > 60 OR event_type IN ('like', 'favorite') THEN 1 ELSE 0 END) AS is_positive
FROM {raw} GROUP BY user_id, item_id, CAST(date AS DATE)
"""


def truth_steps(prefix: str, hist: str, val: str, targets: str) -> None:
    step(f"{prefix}pos", f"SELECT DISTINCT user_id, item_id FROM {val} WHERE is_positive = 1")
    step(
        f"{prefix}unseen",
        f"SELECT p.* FROM {prefix}pos p WHERE NOT EXISTS (SELECT 1 FROM {hist} h"
        " WHERE h.user_id = p.user_id AND h.item_id = p.item_id)",
    )
    step(
        f"{prefix}cold",
        f"SELECT * FROM {prefix}unseen WHERE item_id NOT IN (SELECT item_id FROM {hist})",
    )
    step(
        f"{prefix}elig",
        f"SELECT * FROM {prefix}unseen WHERE item_id IN (SELECT item_id FROM {hist})",
    )
    step(
        f"{prefix}truth",
        f"SELECT * FROM {prefix}elig WHERE user_id IN (SELECT user_id FROM {targets})",
    )


step(
    "ev",
    """
SELECT user_id, CAST(json_extract(props, '$.k') AS INTEGER) AS item_id,
  CASE event_type WHEN 'click' THEN 'like' WHEN 'purchase' THEN 'favorite' ELSE 'view' END AS event_type,
  CAST(floor(value) AS BIGINT) AS watch_time, ts AS date
FROM events
""",
)
step("cut", "SELECT max(date) - INTERVAL 1 DAY AS cutoff FROM ev")
step("hist_raw", "SELECT ev.* FROM ev, cut WHERE date < cutoff")
step("val_raw", "SELECT ev.* FROM ev, cut WHERE date >= cutoff")
step("hist", DAILY.format(raw="hist_raw"))
step("val", DAILY.format(raw="val_raw"))
step("target", "SELECT DISTINCT user_id FROM ev")
step("seen", "SELECT DISTINCT user_id, item_id FROM hist")
truth_steps("e_", "hist", "val", "target")

step(
    "p_ev",
    """
SELECT o_custkey AS user_id, CAST(l_partkey AS INTEGER) AS item_id,
  CASE l_returnflag WHEN 'R' THEN 'like' WHEN 'A' THEN 'favorite' ELSE 'view' END AS event_type,
  CAST(l_quantity * 2 AS BIGINT) AS watch_time, o_orderdate AS date
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""",
)
step("p_cut", "SELECT min(date) + INTERVAL 120 DAY AS cutoff, min(date) + INTERVAL 150 DAY AS stop FROM p_ev")
step("p_hist_raw", "SELECT p_ev.* FROM p_ev, p_cut WHERE date < cutoff")
step("p_val_raw", "SELECT p_ev.* FROM p_ev, p_cut WHERE date >= cutoff AND date < stop")
step("p_hist", DAILY.format(raw="p_hist_raw"))
step("p_val", DAILY.format(raw="p_val_raw"))
step("p_target", "SELECT c_custkey AS user_id FROM customer WHERE c_mktsegment = 'BUILDING'")
truth_steps("p_", "p_hist", "p_val", "p_target")

# ---- popularity ----------------------------------------------------------------
step(
    "stats",
    """
SELECT item_id, CAST(sum(views) AS BIGINT) AS raw_interaction_count,
  count(DISTINCT user_id) AS distinct_interacting_users,
  CAST(sum(is_positive) AS BIGINT) AS relevant_interaction_count,
  count(DISTINCT CASE WHEN is_positive = 1 THEN user_id END) AS distinct_relevant_users
FROM hist GROUP BY item_id
""",
)
step(
    "granking",
    """
SELECT item_id, CAST(distinct_relevant_users AS DOUBLE) AS score,
  row_number() OVER (ORDER BY distinct_relevant_users DESC, item_id) AS global_rank FROM stats
""",
)
step("aged", "SELECT hist.*, date_diff('microsecond', dt, cutoff) / 3600000000.0 AS age FROM hist, cut")
step(
    "rranking",
    """
SELECT item_id, score, row_number() OVER (ORDER BY score DESC, item_id) AS global_rank
FROM (SELECT item_id, sum(views * exp(-ln(2.0) * age / 24.0)) AS score FROM aged GROUP BY item_id)
WHERE score > 0
""",
)


def unseen_top(ranking: str, k: int, source: str) -> str:
    return f"""
SELECT user_id, item_id, score, rank, '{source}' AS source FROM (
  SELECT t.user_id, r.item_id, r.score,
    row_number() OVER (PARTITION BY t.user_id ORDER BY r.global_rank) AS rank
  FROM target t CROSS JOIN {ranking} r
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = t.user_id AND s.item_id = r.item_id))
WHERE rank <= {k}
"""


step("gpop", unseen_top("granking", CAPS["global_popularity"], "global_popularity"))
step("rpop", unseen_top("rranking", CAPS["recency_popularity"], "recency_popularity"))

# ---- co-visitation --------------------------------------------------------------
step(
    "coll",
    """
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_dt DESC, item_id) AS history_rank
FROM (SELECT user_id, item_id, max(dt) AS last_dt, CAST(sum(views) AS BIGINT) AS views,
  max(watch_time) AS watch_time, max(is_like) AS is_like, max(is_favorite) AS is_favorite,
  max(is_positive) AS is_positive FROM hist GROUP BY user_id, item_id)
""",
)
step("prof", "SELECT * FROM coll WHERE history_rank <= 10")
step(
    "duo",
    """
SELECT a.item_id AS newer, b.item_id AS older,
  date_diff('microsecond', b.last_dt, a.last_dt) / 3600000000.0 AS gap
FROM prof a JOIN prof b ON a.user_id = b.user_id AND a.history_rank < b.history_rank
""",
)
step(
    "linked",
    """
SELECT item_id, neighbor_item_id, count(*) AS co_user_count, sum(decayed) AS decayed FROM (
  SELECT newer AS item_id, older AS neighbor_item_id, pow(2.0, -gap / 24.0) AS decayed FROM duo
  UNION ALL SELECT older, newer, pow(2.0, -gap / 24.0) FROM duo) GROUP BY item_id, neighbor_item_id
""",
)
step("itemn", "SELECT item_id, count(*) AS users FROM prof GROUP BY item_id")
step(
    "nbr",
    """
SELECT item_id, neighbor_item_id, score, co_user_count, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, neighbor_item_id) AS rank FROM (
    SELECT l.item_id, l.neighbor_item_id, co_user_count,
      co_user_count / sqrt(CAST(a.users AS DOUBLE) * CAST(b.users AS DOUBLE)) AS score
    FROM linked l JOIN itemn a ON l.item_id = a.item_id JOIN itemn b ON l.neighbor_item_id = b.item_id))
WHERE rank <= 20
""",
)
step(
    "seed",
    """
SELECT user_id, item_id AS seed_item_id,
  exp(-ln(2.0) * (date_diff('microsecond', last_dt, cutoff) / 3600000000.0) / 24.0) AS recency,
  1.0 + ln(1.0 + views) + (watch_time > 60)::INT + is_like + is_favorite AS strength
FROM coll, cut WHERE history_rank <= 5
""",
)
step(
    "contrib",
    """
SELECT s.user_id, s.seed_item_id, n.neighbor_item_id AS item_id, n.score AS neighbor_score,
  n.co_user_count, n.rank AS neighbor_rank, n.score * s.recency * s.strength AS contribution
FROM seed s JOIN nbr n ON s.seed_item_id = n.item_id
""",
)
step("best", "SELECT user_id, item_id, max(contribution) AS score FROM contrib GROUP BY user_id, item_id")
step(
    "itwo",
    f"""
SELECT user_id, item_id, score, rank, 'item2item' AS source FROM (
  SELECT b.*, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM best b
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = b.user_id AND s.item_id = b.item_id))
WHERE rank <= {CAPS["item2item"]}
""",
)

# ---- vectors ---------------------------------------------------------------------
step("ifac", "SELECT CAST(vec_id AS INTEGER) AS item_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IN (SELECT item_id FROM ev)")
step("ufac", "SELECT vec_id - 200 AS user_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id - 200 IN (SELECT user_id FROM ev)")
step(
    "als",
    f"""
SELECT user_id, item_id, score, rank, 'implicit_als' AS source FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (
    SELECT u.user_id, i.item_id, list_dot_product(u.v, i.v) AS score
    FROM ufac u JOIN target t ON u.user_id = t.user_id CROSS JOIN ifac i
    WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = u.user_id AND s.item_id = i.item_id)))
WHERE rank <= {CAPS["implicit_als"]}
""",
)

# ---- union -----------------------------------------------------------------------
step("stacked", " UNION ALL ".join(f"SELECT * FROM {t}" for t in ("gpop", "rpop", "itwo", "als")))


def _wide(source: str, cap: int) -> str:
    mine = f"CASE WHEN source = '{source}' THEN"
    return f"""
  coalesce(max({mine} score END), 0.0) AS generator_score_{source},
  coalesce(max({mine} rank END), 0) AS generator_rank_{source},
  coalesce(max({mine} ({cap} - rank + 1) / CAST({cap} AS DOUBLE) END), 0.0) AS generator_rank_norm_{source},
  count({mine} 1 END) > 0 AS generated_by_{source}"""


step(
    "uni",
    "SELECT user_id, item_id,"
    + ",".join(_wide(source, cap) for source, cap in CAPS.items())
    + ", count(*) AS source_count FROM stacked GROUP BY user_id, item_id",
)
step(
    "scored",
    """
SELECT u.*, coalesce(g.score, 0.0) AS cross_score_global_popularity,
  coalesce(g.global_rank, 0) AS cross_rank_global_popularity,
  g.score IS NOT NULL AS cross_score_available_global_popularity,
  coalesce(r.score, 0.0) AS cross_score_recency_popularity,
  coalesce(r.global_rank, 0) AS cross_rank_recency_popularity,
  r.score IS NOT NULL AS cross_score_available_recency_popularity,
  coalesce(b.score, 0.0) AS cross_score_item2item,
  b.score IS NOT NULL AS cross_score_available_item2item,
  CASE WHEN uf.v IS NOT NULL AND f.v IS NOT NULL THEN list_dot_product(uf.v, f.v) ELSE 0.0 END
    AS cross_score_implicit_als,
  uf.v IS NOT NULL AND f.v IS NOT NULL AS cross_score_available_implicit_als
FROM uni u LEFT JOIN granking g ON u.item_id = g.item_id
LEFT JOIN rranking r ON u.item_id = r.item_id
LEFT JOIN best b ON u.user_id = b.user_id AND u.item_id = b.item_id
LEFT JOIN ufac uf ON u.user_id = uf.user_id LEFT JOIN ifac f ON u.item_id = f.item_id
""",
)


def is_active(source: str, cap: int) -> str:
    return f"(generated_by_{source} AND generator_rank_{source} <= {cap})"


step(
    "fuse",
    "SELECT user_id, item_id, "
    + " + ".join(
        f"CASE WHEN {is_active(s, c)} THEN {FUSION.weights[s]} / ({FUSION.constant} + generator_rank_{s}) ELSE 0.0 END"
        for s, c in FUSION.caps.items()
    )
    + " AS ranker_score FROM uni WHERE "
    + " OR ".join(is_active(s, c) for s, c in FUSION.caps.items()),
)
step(
    "fused",
    """
SELECT user_id, item_id, ranker_score AS score,
  row_number() OVER (PARTITION BY user_id ORDER BY ranker_score DESC, item_id) AS rank,
  'rrf_ensemble' AS source FROM fuse
""",
)


def filled(primary: str, popular: str, k: int, *, history: bool = True) -> str:
    """Priority union with dedup, filters and final ranks."""
    rules = (
        """WHERE item_id IN (SELECT item_id FROM hist) AND NOT EXISTS
      (SELECT 1 FROM seen s WHERE s.user_id = x.user_id AND s.item_id = x.item_id)"""
        if history
        else ""
    )
    return f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id
    ORDER BY priority, rank, score DESC, item_id) AS final_rank FROM (
  SELECT * FROM (SELECT x.*, row_number() OVER (PARTITION BY user_id, item_id
      ORDER BY priority, rank, score DESC) AS copy FROM (
    SELECT user_id, item_id, score, rank, source, 0 AS priority FROM {primary}
    UNION ALL SELECT user_id, item_id, score, rank, source, 1 FROM {popular}) x {rules})
  WHERE copy = 1)) WHERE final_rank <= {k}
"""


step("fusefill", filled("fused", "gpop", 20))


def as_lists(rows: str, rank: str = "rank") -> str:
    return (
        f"SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY {rank}) AS item_ids"
        f" FROM {rows} GROUP BY user_id"
    )


# ---- hash ------------------------------------------------------------------------
WRAP = "18446744073709551616::UHUGEINT"


def _times(value: str, factor: int) -> str:
    return f"CAST((CAST({value} AS UHUGEINT) * {factor}::UHUGEINT) % {WRAP} AS UBIGINT)"


def _plus(value: str, addend: int) -> str:
    return f"CAST((CAST({value} AS UHUGEINT) + {addend}::UHUGEINT) % {WRAP} AS UBIGINT)"


def _mixed(value: str) -> str:
    for shift, factor in ((30, FIRST_MIX_MULTIPLIER), (27, SECOND_MIX_MULTIPLIER)):
        value = _times(f"xor({value}, {value} >> {shift})", factor)
    return f"xor({value}, {value} >> 31)"


def pair_hash(user: str, item: str, fold: str, seed: int = SEED) -> str:
    start = (
        f"xor(xor({_times(user, USER_MULTIPLIER)}, {_times(item, ITEM_MULTIPLIER)}),"
        f" {fold_seed(seed, fold)}::UBIGINT)"
    )
    return _mixed(_plus(start, GOLDEN_INCREMENT))


def pair_uniform(user: str, item: str, fold: str, seed: int = SEED) -> str:
    return f"(CAST({pair_hash(user, item, fold, seed)} >> 11 AS DOUBLE) / 9007199254740992.0)"


def id_hash(key: str, seed: int = SEED) -> str:
    return _mixed(_plus(key, seed + GOLDEN_INCREMENT & 2**64 - 1))


# ---- labeled rows ------------------------------------------------------------------
HARD = (
    "(source_count >= 2 OR (generated_by_item2item AND generator_rank_item2item <= 5)"
    " OR (generated_by_implicit_als AND generator_rank_implicit_als <= 5))"
)
STRATUM = """CASE WHEN label = 1 THEN 'positive'
  WHEN source_count >= 2 AND ((generated_by_item2item AND generator_rank_item2item <= 50)
    OR (generated_by_implicit_als AND generator_rank_implicit_als <= 50)) THEN 'multi_collaborative_top50'
  WHEN source_count >= 2 THEN 'multi_other'
  WHEN generated_by_item2item AND generator_rank_item2item <= 50 THEN 'single_item2item_top50'
  WHEN generated_by_implicit_als AND generator_rank_implicit_als <= 50 THEN 'single_als_top50'
  ELSE 'easy_negative' END"""
step(
    "lab",
    f"""
SELECT *, label = 1 OR is_hard_negative OR uniform < 0.05 AS is_training_sample,
  CASE WHEN label = 1 OR is_hard_negative THEN 1.0::FLOAT ELSE 0.05::FLOAT END AS sampling_probability
FROM (SELECT x.*, label = 0 AND {HARD} AS is_hard_negative,
    {pair_uniform("user_id", "item_id", FOLD)} AS uniform
  FROM (SELECT u.*, CASE WHEN t.user_id IS NULL THEN 0 ELSE 1 END AS label
    FROM uni u LEFT JOIN e_truth t ON u.user_id = t.user_id AND u.item_id = t.item_id) x)
""",
)
step("grp", "SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS group_id FROM target")
step(
    "mixed_scores",
    "SELECT user_id, item_id, round(cross_score_item2item + 0.1 * cross_score_implicit_als, 9)"
    " AS ranker_score FROM scored",
)
step(
    "posseq",
    """
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY dt, item_id) AS position, item_id
FROM hist WHERE is_positive = 1
""",
)
step(
    "seqlen",
    """
SELECT t.user_id, count(s.item_id) AS length FROM target t LEFT JOIN posseq s ON t.user_id = s.user_id
GROUP BY t.user_id
""",
)
step("ucat", "SELECT item_id, row_number() OVER (ORDER BY item_id) AS position FROM (SELECT DISTINCT item_id FROM hist)")

# ---- profiles ---------------------------------------------------------------------
step(
    "hpair",
    """
SELECT * FROM (SELECT user_id, item_id, max(is_positive) AS positive, max(is_like) AS "like",
  max(is_favorite) AS favorite, CAST(max(watch_time) > 60 AS INT) AS long_watch
  FROM hist WHERE user_id IN (SELECT user_id FROM target) GROUP BY user_id, item_id)
WHERE positive > 0 OR "like" > 0 OR favorite > 0 OR long_watch > 0
""",
)
step(
    "hkind",
    " UNION ALL ".join(
        f"SELECT user_id, item_id, '{kind}' AS kind FROM hpair WHERE \"{kind}\" > 0"
        for kind in ("positive", "like", "favorite", "long_watch")
    ),
)
step("iunit", "SELECT item_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS d FROM ifac")
step("dims", f"SELECT unnest(range(1, {DIM + 1})) AS n")
step(
    "pmean",
    """
SELECT user_id, kind, list(m ORDER BY n) AS mean FROM (
  SELECT user_id, kind, n, avg(d[n]) AS m FROM hkind JOIN iunit USING (item_id) CROSS JOIN dims
  GROUP BY user_id, kind, n) GROUP BY user_id, kind
""",
)
step(
    "hprof",
    """
SELECT t.user_id, k.kind, coalesce(c.n, 0) AS count, coalesce(c.m, 0) AS matched,
  coalesce(sqrt(list_dot_product(p.mean, p.mean)), 0.0) AS concentration,
  CASE WHEN sqrt(list_dot_product(p.mean, p.mean)) > 1e-12
    THEN list_transform(p.mean, lambda x: x / sqrt(list_dot_product(p.mean, p.mean))) END AS direction
FROM target t CROSS JOIN (SELECT unnest(['positive', 'like', 'favorite', 'long_watch']) AS kind) k
LEFT JOIN (SELECT user_id, kind, count(*) AS n, count(d) AS m FROM hkind LEFT JOIN iunit USING (item_id)
  GROUP BY user_id, kind) c ON t.user_id = c.user_id AND k.kind = c.kind
LEFT JOIN pmean p ON t.user_id = p.user_id AND k.kind = p.kind
""",
)
