"""Independent SQL for the registered queries (DuckDB dialect).

Written from the semantics, not from the Spark plans: plain CTEs over the
driver tables, brute force where that is simplest (e.g. the catalogue
recommendations score every user x item pair).  Tables ``lineitem``,
``orders`` and ``part`` are views the caller registers.
"""

from __future__ import annotations

# ---------------------------------------------------------------- fragments

RATINGS = """
ratings AS (
  SELECT user_id, item_id,
         CAST(least(10, 1 + q % 4 + p_size % 6
                    + CASE WHEN user_id % 4 = item_id % 4 THEN 3 ELSE 0 END) AS DOUBLE) / 2 AS rating,
         ts
  FROM (SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(l_quantity AS BIGINT) AS q,
               p_size, l_shipdate AS ts,
               row_number() OVER (PARTITION BY o_custkey, l_partkey
                                  ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC,
                                           l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS rn
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
                      JOIN part ON l_partkey = p_partkey) t
  WHERE rn = 1)"""

ITEMS = """
items AS (
  SELECT p_partkey AS item_id,
         p_name || ' (' || CAST(1950 + p_size AS VARCHAR) || ')' AS title,
         CASE WHEN p_type = 'PROMO' THEN '(no genres listed)' ELSE p_type END AS genres
  FROM part)"""

CAP_THIRD = """
capped AS (
  SELECT user_id, item_id, rating, ts FROM (
    SELECT *, row_number() OVER (ORDER BY ts, user_id, item_id) AS crn FROM ratings) c
  WHERE crn <= (SELECT count(*) FROM ratings) * {thirds} // 3)"""

CLEAN = """
single_users AS (SELECT user_id FROM {src} GROUP BY user_id HAVING count(*) = 1),
single_items AS (SELECT item_id FROM {src} GROUP BY item_id HAVING count(*) = 1),
genre_items AS (SELECT item_id, title, genres, substr(title, length(title) - 4, 4) AS year
                FROM items WHERE genres <> '(no genres listed)'),
clean AS (
  SELECT * FROM {src} r
  WHERE NOT EXISTS (SELECT 1 FROM single_users s WHERE s.user_id = r.user_id)
    AND NOT EXISTS (SELECT 1 FROM single_items s WHERE s.item_id = r.item_id)
    AND EXISTS (SELECT 1 FROM genre_items g WHERE g.item_id = r.item_id))"""

SPLIT = """
assigned AS (
  SELECT *, ('0x' || substr(md5(CAST(user_id AS VARCHAR) || ':' || CAST(item_id AS VARCHAR) || ':12345'), 1, 8))::BIGINT % 10 < 8
            AS is_train
  FROM clean),
train0 AS (SELECT user_id, item_id, rating, ts FROM assigned WHERE is_train),
test0 AS (SELECT user_id, item_id, rating, ts FROM assigned WHERE NOT is_train),
train1 AS (SELECT * FROM train0 WHERE user_id IN (SELECT user_id FROM test0)),
train AS (SELECT * FROM train1 WHERE item_id IN (SELECT item_id FROM test0)),
test1 AS (SELECT * FROM test0 WHERE user_id IN (SELECT user_id FROM train)),
test AS (SELECT * FROM test1 WHERE item_id IN (SELECT item_id FROM train))"""

STATS = """
stats AS (SELECT item_id, avg(rating) AS avg_rating, count(user_id) AS review_count
          FROM train GROUP BY item_id)"""

POPULAR = """
popular AS (
  SELECT row_number() OVER (ORDER BY review_count DESC, item_id DESC) AS prank, item_id, avg_rating, review_count
  FROM (SELECT * FROM stats WHERE avg_rating >= 4 ORDER BY review_count DESC, item_id DESC LIMIT {k}) p)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def split_ctes(src: str = "ratings") -> str:
    head = [RATINGS, ITEMS]
    return with_(*head, CLEAN.format(src=src), SPLIT)


def r6(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) AS {name}"


SQL: dict[str, str] = {}

# ---------------------------------------------------------------- IO / PR

SQL["ratings_scan"] = with_(RATINGS) + " SELECT user_id, item_id, rating, ts FROM ratings"
SQL["items_scan"] = with_(ITEMS) + " SELECT item_id, title, genres FROM items"
SQL["sample_cap"] = with_(RATINGS, CAP_THIRD.format(thirds=1)) + " SELECT * FROM capped"
LINE_RATINGS = """
lines AS (
  SELECT {user} AS user_id, {item} AS item_id,
         CAST(1 + CAST(l_quantity AS BIGINT) % 10 AS DOUBLE) / 2 AS rating, l_shipdate AS ts FROM lineitem)"""

SQL["drop_singleton_users"] = (
    with_(LINE_RATINGS.format(user="l_orderkey", item="l_partkey"))
    + """ SELECT * FROM lines WHERE user_id NOT IN
          (SELECT user_id FROM lines GROUP BY user_id HAVING count(*) = 1)"""
)
SQL["drop_singleton_items"] = (
    with_(LINE_RATINGS.format(user="l_partkey", item="l_orderkey"))
    + """ SELECT * FROM lines
          WHERE user_id NOT IN (SELECT user_id FROM lines GROUP BY user_id HAVING count(*) = 1)
            AND item_id NOT IN (SELECT item_id FROM lines GROUP BY item_id HAVING count(*) = 1)"""
)
SQL["items_with_genre"] = (
    with_(ITEMS) + " SELECT item_id, title, genres FROM items WHERE genres <> '(no genres listed)'"
)
SQL["item_year"] = (
    with_(ITEMS)
    + " SELECT item_id, title, substr(title, length(title) - 4, 4) AS year FROM items"
    + " WHERE genres <> '(no genres listed)'"
)
SQL["clean_ratings"] = with_(RATINGS, ITEMS, CLEAN.format(src="ratings")) + " SELECT * FROM clean"
SQL["split_assign"] = split_ctes() + " SELECT user_id, item_id, rating, is_train FROM assigned"
SQL["train_split"] = split_ctes() + " SELECT * FROM train"
SQL["test_split"] = split_ctes() + " SELECT * FROM test"

# ---------------------------------------------------------------- baseline

_BASE = split_ctes() + "," + STATS

SQL["item_stats"] = _BASE + f" SELECT item_id, {r6('avg_rating', 'avg_rating')}, review_count FROM stats"
SQL["baseline_predict"] = (
    _BASE
    + f""" SELECT t.item_id, t.user_id, t.rating, {r6('s.avg_rating', 'avg_rating')}, s.review_count
           FROM test t LEFT JOIN stats s ON t.item_id = s.item_id"""
)
SQL["baseline_rmse"] = (
    _BASE
    + f""" SELECT {r6('sqrt(avg(power(t.rating - s.avg_rating, 2)))', 'rmse')}
           FROM test t JOIN stats s ON t.item_id = s.item_id"""
)
SQL["popular_top_k"] = (
    _BASE + "," + POPULAR.format(k=5)
    + f" SELECT CAST(prank AS BIGINT) AS rank, item_id, {r6('avg_rating', 'avg_rating')}, review_count FROM popular"
)
SQL["user_truth_ranking"] = (
    split_ctes()
    + """ SELECT user_id,
                 CAST(row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id DESC) AS BIGINT) AS rank,
                 item_id
          FROM test"""
)
SQL["baseline_precision_at_k"] = (
    _BASE + "," + POPULAR.format(k=5)
    + """, truth AS (
             SELECT user_id, item_id,
                    row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id DESC) AS trank,
                    count(*) OVER (PARTITION BY user_id) AS n
             FROM test),
          per_user AS (
             SELECT user_id,
                    sum(CASE WHEN p.item_id IS NOT NULL THEN 1 ELSE 0 END) / 5.0 AS precision
             FROM truth t LEFT JOIN popular p ON t.item_id = p.item_id AND p.prank <= t.n + 1
             WHERE t.trank <= 5
             GROUP BY user_id)
        """
    + f" SELECT {r6('avg(precision)', 'precision')} FROM per_user"
)

# ---------------------------------------------------------------- neighbourhood

NB_MODEL = """
means AS (SELECT user_id, avg(rating) AS user_mean FROM train GROUP BY user_id),
centered AS (SELECT t.item_id, t.user_id, t.rating - m.user_mean AS x
             FROM train t JOIN means m ON t.user_id = m.user_id),
norms AS (SELECT user_id, sqrt(sum(x * x)) AS nrm FROM centered GROUP BY user_id),
nz AS (SELECT c.item_id, c.user_id, c.x / n.nrm AS xn
       FROM centered c JOIN norms n ON c.user_id = n.user_id WHERE c.x <> 0),
sim AS (SELECT a.user_id AS i, b.user_id AS j, sum(a.xn * b.xn) AS value
        FROM nz a JOIN nz b ON a.item_id = b.item_id AND a.user_id < b.user_id
        GROUP BY a.user_id, b.user_id),
ranked AS (SELECT i, j, value,
                  row_number() OVER (PARTITION BY i ORDER BY round(value, 9) DESC, j) AS row_number
           FROM sim),
top AS (SELECT * FROM ranked WHERE row_number <= 100),
catalog AS (SELECT DISTINCT item_id FROM train)"""


def nb_pred(frame: str, n: int, name: str = "pred") -> str:
    """Predictions for the rows of ``frame`` with ``n`` neighbours."""
    return f"""
{name}_c AS (SELECT p.user_id, p.item_id, sum(a.value * c.x) AS s
             FROM (SELECT DISTINCT user_id, item_id FROM {frame}) p
             JOIN top a ON a.i = p.user_id AND a.row_number <= {n}
             JOIN centered c ON c.user_id = a.j AND c.item_id = p.item_id
             GROUP BY p.user_id, p.item_id),
{name} AS (SELECT p.*, CASE WHEN k.item_id IS NOT NULL THEN coalesce(m.user_mean + coalesce(s.s, 0),
                  CASE WHEN p.user_id BETWEEN 1 AND (SELECT max(user_id) FROM train) THEN 0.5 END) END AS prediction
           FROM {frame} p LEFT JOIN means m ON p.user_id = m.user_id
           LEFT JOIN {name}_c s ON s.user_id = p.user_id AND s.item_id = p.item_id
           LEFT JOIN catalog k ON k.item_id = p.item_id)"""


_NB = split_ctes() + "," + NB_MODEL

SQL["user_mean"] = _NB + f" SELECT user_id, {r6('user_mean', 'user_mean')} FROM means"
SQL["center_ratings"] = _NB + f" SELECT item_id, user_id, {r6('x', 'rating_norm')} FROM centered"
SQL["user_similarity"] = _NB + f" SELECT i, j, {r6('value', 'value')} FROM sim"
SQL["top_neighbors"] = (
    _NB + f" SELECT i, j, {r6('value', 'value')}, CAST(row_number AS BIGINT) AS row_number FROM top"
)
SQL["active_neighbors"] = (
    _NB + f" SELECT i, j, {r6('value', 'value')}, CAST(row_number AS BIGINT) AS row_number"
    " FROM top WHERE row_number <= 20"
)
SQL["item_index"] = (
    _NB + " SELECT item_id, CAST(row_number() OVER (ORDER BY item_id) - 1 AS BIGINT) AS item_index FROM catalog"
)
SQL["gap_user_defaults"] = (
    split_ctes()
    + """, known AS (SELECT DISTINCT user_id FROM train WHERE user_id >= 1),
          gaps AS (SELECT user_id, coalesce(lag(user_id) OVER (ORDER BY user_id), 0) AS before FROM known)
          SELECT before + 1 AS first_id, user_id - 1 AS last_id, 0.5::DOUBLE AS default_rating
          FROM gaps WHERE before + 1 < user_id"""
)
SQL["dedup_ratings"] = f"""
SELECT user_id, item_id, {r6('avg(rating)', 'rating')} FROM (
  SELECT o_custkey AS user_id, l_partkey AS item_id,
         CAST(least(10, 1 + CAST(l_quantity AS BIGINT) % 4 + p_size % 6
              + CASE WHEN o_custkey % 4 = l_partkey % 4 THEN 3 ELSE 0 END) AS DOUBLE) / 2 AS rating
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey) e
GROUP BY user_id, item_id"""

SQL["neighbor_predict"] = (
    _NB + "," + nb_pred("test", 20)
    + f" SELECT user_id, item_id, rating, {r6('prediction', 'prediction')} FROM pred"
)
SQL["neighbor_refit"] = (
    _NB + "," + nb_pred("test", 10)
    + f" SELECT user_id, item_id, rating, {r6('prediction', 'prediction')} FROM pred"
)
SQL["neighbor_predict_pairs"] = (
    _NB + ", asked AS (SELECT user_id, item_id FROM clean)," + nb_pred("asked", 20)
    + f" SELECT user_id, item_id, {r6('prediction', 'prediction')} FROM pred"
)


def nb_recommend(users: str, n: int, k: int) -> str:
    """Brute force: every user x catalogue item scored, then ranked."""
    return f"""
rec_c AS (SELECT a.i AS user_id, c.item_id, sum(a.value * c.x) AS s
          FROM top a JOIN centered c ON c.user_id = a.j
          WHERE a.row_number <= {n} GROUP BY a.i, c.item_id),
rec_all AS (SELECT u.user_id, k.item_id, m.user_mean + coalesce(r.s, 0) AS score
            FROM (SELECT DISTINCT user_id FROM {users}) u
            JOIN means m ON m.user_id = u.user_id
            CROSS JOIN catalog k
            LEFT JOIN rec_c r ON r.user_id = u.user_id AND r.item_id = k.item_id),
recs AS (SELECT * FROM (
           SELECT user_id, item_id, score,
                  row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id DESC) AS rank
           FROM rec_all) x WHERE rank <= {k})"""


SQL["recommend_top_k"] = (
    _NB + "," + nb_recommend("train", 20, 5)
    + f" SELECT user_id, CAST(rank AS BIGINT) AS rank, item_id, {r6('score', 'score')} FROM recs"
)
SQL["neighbor_rmse"] = (
    _NB + "," + nb_pred("test", 20)
    + f" SELECT {r6('sqrt(avg(power(rating - prediction, 2)))', 'rmse')} FROM pred WHERE prediction IS NOT NULL"
)
SQL["neighbor_rmse_train"] = (
    _NB + "," + nb_pred("train", 20)
    + f" SELECT {r6('sqrt(avg(power(rating - prediction, 2)))', 'rmse')} FROM pred WHERE prediction IS NOT NULL"
)
SQL["rmse_by_user"] = (
    _NB + "," + nb_pred("test", 20)
    + f" SELECT user_id, {r6('sqrt(avg(power(rating - prediction, 2)))', 'rmse')} FROM pred"
    " WHERE prediction IS NOT NULL GROUP BY user_id"
)
SQL["rmse_by_item"] = (
    _NB + "," + nb_pred("test", 20)
    + f" SELECT item_id, {r6('sqrt(avg(power(rating - prediction, 2)))', 'rmse')} FROM pred"
    " WHERE prediction IS NOT NULL GROUP BY item_id"
)

PREC = """
prec_r AS (SELECT *,
             row_number() OVER (PARTITION BY {g} ORDER BY rating DESC, item_id DESC) AS trank,
             row_number() OVER (PARTITION BY {g} ORDER BY round(prediction, 9) DESC NULLS LAST,
                                rating DESC, item_id DESC) AS prank
           FROM {src}),
prec AS (SELECT {g}, sum(CASE WHEN trank <= {k} AND prank <= {k} THEN 1 ELSE 0 END) / {k}.0 AS precision
         FROM prec_r GROUP BY {g})"""

SQL["precision_by_user"] = (
    _NB + "," + nb_pred("test", 20) + "," + PREC.format(g="user_id", src="pred", k=5)
    + f" SELECT user_id, {r6('precision', 'precision')} FROM prec"
)
SQL["neighbor_precision_at_k"] = (
    _NB + "," + nb_pred("test", 20) + "," + PREC.format(g="user_id", src="pred", k=5)
    + f" SELECT {r6('avg(precision)', 'precision')} FROM prec"
)
SQL["neighbor_coverage"] = (
    _NB + "," + nb_recommend("test", 20, 10)
    + f""" SELECT {r6('(SELECT count(DISTINCT item_id) FROM recs) * 1.0 / (SELECT count(DISTINCT item_id) FROM test)',
                     'coverage')}"""
)
SQL["coverage"] = (
    _NB + "," + nb_recommend("train", 20, 10)
    + f""" SELECT {r6('(SELECT count(DISTINCT item_id) FROM recs) * 1.0 / (SELECT count(DISTINCT item_id) FROM train)',
                     'coverage')}"""
)

SWEEP = """
grid AS (SELECT t.user_id, t.item_id, t.rating, g.n FROM test t CROSS JOIN range(1, 31) g(n)),
sweep_c AS (SELECT g.user_id, g.item_id, g.n, sum(a.value * c.x) AS s
            FROM grid g JOIN top a ON a.i = g.user_id AND a.row_number <= g.n
            JOIN centered c ON c.user_id = a.j AND c.item_id = g.item_id
            GROUP BY g.user_id, g.item_id, g.n),
sweep_p AS (SELECT g.*, CASE WHEN k.item_id IS NOT NULL THEN m.user_mean + coalesce(s.s, 0) END AS prediction
            FROM grid g LEFT JOIN means m ON m.user_id = g.user_id
            LEFT JOIN sweep_c s ON s.user_id = g.user_id AND s.item_id = g.item_id AND s.n = g.n
            LEFT JOIN catalog k ON k.item_id = g.item_id)"""

SQL["neighbor_sweep"] = (
    _NB + "," + SWEEP + "," + PREC.format(g="n, user_id", src="sweep_p", k=5)
    + f""", err AS (SELECT n, sqrt(avg(power(rating - prediction, 2))) AS rmse FROM sweep_p
                   WHERE prediction IS NOT NULL GROUP BY n)
        SELECT CAST(e.n AS BIGINT) AS n, {r6('e.rmse', 'rmse')}, {r6('p.precision', 'precision')}
        FROM err e JOIN (SELECT n, avg(precision) AS precision FROM prec GROUP BY n) p ON e.n = p.n"""
)

QB = """
qb_src AS ({metric}),
qb_rn AS (SELECT key, value, row_number() OVER (ORDER BY value, key) AS rn, count(*) OVER () AS n
          FROM qb_src WHERE value IS NOT NULL),
qb AS (SELECT CAST(CASE WHEN n <= 1 THEN 0 ELSE greatest(0, ((rn - 1) * {q} + (n - 2)) // (n - 1) - 1) END AS BIGINT)
              AS bucket, avg(value) AS mean_value
       FROM qb_rn GROUP BY 1)"""

SQL["quantile_buckets"] = (
    _NB + "," + nb_pred("test", 20) + ","
    + QB.format(metric="SELECT user_id AS key, sqrt(avg(power(rating - prediction, 2))) AS value FROM pred"
                       " WHERE prediction IS NOT NULL GROUP BY user_id", q=10)
    + f" SELECT bucket, {r6('mean_value', 'mean_value')} FROM qb"
)

# ---------------------------------------------------------------- rankings on baseline scores

BSCORED = """
bscored AS (SELECT t.user_id, t.item_id, t.rating, s.avg_rating
            FROM test t LEFT JOIN stats s ON t.item_id = s.item_id),
branks AS (SELECT user_id, item_id,
             row_number() OVER (PARTITION BY user_id ORDER BY round(avg_rating, 9) DESC NULLS LAST, item_id DESC)
               AS pred_rank,
             row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id DESC) AS truth_rank
           FROM bscored)"""

_BR = _BASE + "," + BSCORED

SQL["pred_rankings"] = (
    _BR + " SELECT user_id, item_id, CAST(pred_rank AS BIGINT) AS pred_rank,"
    " CAST(truth_rank AS BIGINT) AS truth_rank FROM branks"
)
SQL["rankings_top_k"] = (
    _BR + """ SELECT user_id, item_id,
                     CAST(CASE WHEN pred_rank <= 5 THEN pred_rank END AS BIGINT) AS pred_rank,
                     CAST(CASE WHEN truth_rank <= 5 THEN truth_rank END AS BIGINT) AS truth_rank
              FROM branks WHERE pred_rank <= 5 OR truth_rank <= 5"""
)
SQL["precision_uncut"] = (
    _BR + f""" SELECT {r6('avg(p)', 'precision')} FROM (
                 SELECT user_id, sum(CASE WHEN pred_rank <= 5 THEN 1 ELSE 0 END) / 5.0 AS p
                 FROM branks GROUP BY user_id) x"""
)
SQL["ranked_coverage"] = (
    _BR + f""" SELECT {r6('''(SELECT count(DISTINCT b.item_id) FROM branks b
                               WHERE b.pred_rank <= 5 AND b.user_id IN (SELECT user_id FROM test)) * 1.0
                             / (SELECT count(DISTINCT item_id) FROM test
                                WHERE user_id IN (SELECT user_id FROM branks WHERE pred_rank <= 5))''', 'coverage')}"""
)


def qb_named(name: str, metric: str, q: int = 10) -> str:
    return QB.replace("qb_src", f"{name}_src").replace("qb_rn", f"{name}_rn").replace(
        "qb AS", f"{name} AS").format(metric=metric, q=q)


_RMSE_USER = ("SELECT user_id AS key, sqrt(avg(power(rating - {p}, 2))) AS value FROM {src}"
              " WHERE {p} IS NOT NULL GROUP BY user_id")

SQL["quantile_compare"] = (
    _BR + "," + NB_MODEL + "," + nb_pred("test", 5, "p5") + "," + nb_pred("test", 20, "p20") + ","
    + qb_named("qbase", _RMSE_USER.format(p="avg_rating", src="bscored")) + ","
    + qb_named("qnb5", _RMSE_USER.format(p="prediction", src="p5")) + ","
    + qb_named("qnb20", _RMSE_USER.format(p="prediction", src="p20"))
    + f""" SELECT a.bucket, {r6('a.mean_value', 'baseline')}, {r6('b.mean_value', 'nb5')}, {r6('c.mean_value', 'nb20')}
           FROM qbase a FULL JOIN qnb5 b ON a.bucket = b.bucket FULL JOIN qnb20 c ON coalesce(a.bucket, b.bucket) = c.bucket"""
)

# ---------------------------------------------------------------- experiments


def pipeline_ctes(thirds: int | None) -> list[str]:
    head = [RATINGS, ITEMS]
    if thirds is None:
        return [*head, CLEAN.format(src="ratings"), SPLIT]
    return [*head, CAP_THIRD.format(thirds=thirds), CLEAN.format(src="capped"), SPLIT]


def prec_named(name: str, g: str, src: str, k: int) -> str:
    return (PREC.replace("prec_r", f"{name}_r").replace("prec AS", f"{name} AS")
            .format(g=g, src=src, k=k))


def _summary_select(model: str, thirds: int) -> str:
    size = f"CAST((SELECT count(*) FROM ratings) * {thirds} // 3 AS BIGINT) AS sample_size"
    if model == "baseline":
        ctes = pipeline_ctes(thirds) + [STATS, POPULAR.format(k=5)]
        bprec = """(SELECT avg(pr) FROM (
            SELECT user_id, sum(CASE WHEN p.item_id IS NOT NULL THEN 1 ELSE 0 END) / 5.0 AS pr
            FROM (SELECT user_id, item_id,
                         row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id DESC) AS trank,
                         count(*) OVER (PARTITION BY user_id) AS n FROM {f}) t
            LEFT JOIN popular p ON t.item_id = p.item_id AND p.prank <= t.n + 1
            WHERE t.trank <= 5 GROUP BY user_id) x)"""
        brmse = """(SELECT sqrt(avg(power(f.rating - s.avg_rating, 2))) FROM {f} f JOIN stats s ON f.item_id = s.item_id)"""
        body = f"""SELECT 'baseline' AS model, {size},
            {r6(brmse.format(f='train'), 'rmse_train')}, {r6(brmse.format(f='test'), 'rmse_test')},
            {r6(bprec.format(f='train'), 'top_k_precision_train')}, {r6(bprec.format(f='test'), 'top_k_precision_test')},
            CAST(NULL AS DOUBLE) AS coverage_train, CAST(NULL AS DOUBLE) AS coverage_test"""
        return "(" + with_(*ctes) + " " + body + ")"
    ctes = pipeline_ctes(thirds) + [NB_MODEL, nb_pred("train", 20, "ptr"), nb_pred("test", 20, "pte"),
                                    prec_named("prtr", "user_id", "ptr", 5),
                                    prec_named("prte", "user_id", "pte", 5)]
    cov = []
    for side in ("train", "test"):
        rec = nb_recommend(side, 20, 10).replace("rec_c", f"rc_{side}").replace(
            "rec_all", f"ra_{side}").replace("recs AS", f"recs_{side} AS")
        ctes.append(rec)
        cov.append(f"(SELECT count(DISTINCT item_id) FROM recs_{side}) * 1.0 / "
                   f"(SELECT count(DISTINCT item_id) FROM {side})")
    nrmse = "(SELECT sqrt(avg(power(rating - prediction, 2))) FROM {p} WHERE prediction IS NOT NULL)"
    body = f"""SELECT 'neighbor' AS model, {size},
        {r6(nrmse.format(p='ptr'), 'rmse_train')}, {r6(nrmse.format(p='pte'), 'rmse_test')},
        {r6('(SELECT avg(precision) FROM prtr)', 'top_k_precision_train')},
        {r6('(SELECT avg(precision) FROM prte)', 'top_k_precision_test')},
        {r6(cov[0], 'coverage_train')}, {r6(cov[1], 'coverage_test')}"""
    return "(" + with_(*ctes) + " " + body + ")"


SQL["sample_size_sweep"] = " UNION ALL ".join(
    "SELECT * FROM " + _summary_select(m, t) + f" s{t}{m[0]}"
    for t in (1, 2, 3) for m in ("baseline", "neighbor")
)

SQL["fold_mean_curve"] = (
    _NB + "," + SWEEP.replace(
        "SELECT t.user_id, t.item_id, t.rating, g.n FROM test t",
        "SELECT t.user_id, t.item_id, t.rating, g.n, ('0x' || substr(md5(CAST(t.user_id AS VARCHAR) || ':' "
        "|| CAST(t.item_id AS VARCHAR) || ':12347'), 1, 8))::BIGINT % 2 AS fold FROM test t")
    + f""" SELECT CAST(n AS BIGINT) AS n, {r6('avg(rmse)', 'rmse')} FROM (
             SELECT fold, n, sqrt(avg(power(rating - prediction, 2))) AS rmse FROM sweep_p
             WHERE prediction IS NOT NULL GROUP BY fold, n) c GROUP BY n"""
)

SQL["best_params"] = (
    _NB + "," + SWEEP + "," + PREC.format(g="n, user_id", src="sweep_p", k=5)
    + """, err AS (SELECT n, sqrt(avg(power(rating - prediction, 2))) AS rmse FROM sweep_p
                   WHERE prediction IS NOT NULL GROUP BY n),
          curve AS (SELECT e.n, e.rmse, p.precision FROM err e
                    JOIN (SELECT n, avg(precision) AS precision FROM prec GROUP BY n) p ON e.n = p.n),
          lo AS (SELECT n, rmse FROM curve ORDER BY round(rmse, 9), n LIMIT 1),
          hi AS (SELECT n, precision FROM curve ORDER BY round(precision, 9) DESC, n LIMIT 1)"""
    + f""" SELECT CAST(lo.n AS BIGINT) AS best_n_rmse, {r6('lo.rmse', 'min_rmse')},
                  CAST(hi.n AS BIGINT) AS best_n_precision, {r6('hi.precision', 'max_precision')}
           FROM lo CROSS JOIN hi"""
)

SQL["similarity_roundtrip"] = SQL["top_neighbors"]

SQL["summary_at_size"] = (
    "SELECT rmse_test, top_k_precision_test FROM " + _summary_select("neighbor", 2) + " s"
)

# ---------------------------------------------------------------- CSV, run summary, ALS

SQL["ratings_csv"] = (
    with_(RATINGS)
    + """ SELECT user_id, item_id, rating,
                 date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) * 86400 AS seconds FROM ratings"""
)
SQL["items_csv"] = SQL["items_scan"]
SQL["run_summary_metrics"] = (
    "SELECT sample_size, true AS runtime_recorded, rmse_train, rmse_test, top_k_precision_train,"
    " top_k_precision_test, coverage_train, coverage_test FROM (" + SQL["sample_size_sweep"] + ") s WHERE model = 'neighbor'"
)
# What SQL can decide about a factor model: keys, ranks, agreement of two measures, settings.
SQL["als_scored_keys"] = split_ctes() + " SELECT user_id, item_id, rating, false AS lost FROM test"
SQL["als_rank_sums"] = split_ctes() + """
  SELECT user_id, item_id,
         row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id DESC) AS truth_rank,
         CAST(count(*) OVER (PARTITION BY user_id) * (count(*) OVER (PARTITION BY user_id) + 1) // 2 AS BIGINT) AS pred_sum,
         count(*) OVER (PARTITION BY user_id) AS pred_max
  FROM test"""
SQL["als_rmse_agrees"] = split_ctes() + " SELECT true AS agrees, count(*) AS n FROM test"
SQL["als_refit_equal"] = split_ctes() + " SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_different FROM test"
SQL["als_grid_points"] = """
  SELECT round(0.05 + i * 0.25 / 9, 2)::DOUBLE AS reg_param, 10::DOUBLE AS rank, 5::DOUBLE AS max_iter, true AS sound
  FROM range(10) t(i)"""

# ---------------------------------------------------------------- asked pairs, repeated ratings

SQL["pair_similarity"] = (
    _NB + f""", raters AS (SELECT item_id, min(user_id) AS j FROM train GROUP BY item_id),
           asked AS (SELECT DISTINCT t.user_id AS i, r.j FROM test t JOIN raters r USING (item_id) WHERE t.user_id <> r.j),
           dots AS (SELECT a.user_id AS i, b.user_id AS j, sum(a.xn * b.xn) AS value
                    FROM nz a JOIN nz b ON a.item_id = b.item_id GROUP BY a.user_id, b.user_id)
        SELECT q.i, q.j, {r6('d.value', 'value')} FROM asked q LEFT JOIN dots d ON d.i = q.i AND d.j = q.j"""
)

EVENTS = """
train AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id,
         CAST(least(10, 1 + CAST(l_quantity AS BIGINT) % 4 + p_size % 6
              + CASE WHEN o_custkey % 4 = l_partkey % 4 THEN 3 ELSE 0 END) AS DOUBLE) / 2 AS rating
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
asked AS (SELECT DISTINCT user_id, item_id FROM train)"""

SQL["neighbor_predict_events"] = (
    with_(EVENTS, NB_MODEL.replace("centered AS (SELECT", "raw AS (SELECT").replace("FROM centered", "FROM raw"),
          "centered AS (SELECT user_id, item_id, avg(x) AS x FROM raw GROUP BY user_id, item_id)",
          nb_pred("asked", 20))
    + f" SELECT user_id, item_id, {r6('prediction', 'prediction')} FROM pred"
)

# ---------------------------------------------------------------- studies

_ERR = "sqrt(avg(power(rating - prediction, 2)))"


def _study(thirds: int, model: str, *more: str) -> str:
    """CTEs of one run: its scored test rows are ``pred``."""
    ctes = [*pipeline_ctes(thirds)]
    if model == "baseline":
        ctes += [STATS, POPULAR.format(k=5),
                 "pred AS (SELECT t.*, s.avg_rating AS prediction FROM test t JOIN stats s USING (item_id))"]
    else:
        ctes += [NB_MODEL, nb_pred("test", 20)]
    return with_(*ctes, *more)


def _size(thirds: int) -> str:
    return f"CAST((SELECT count(*) FROM ratings) * {thirds} // 3 AS BIGINT) AS sample_size"


def _study_union(select: dict[str, str], thirds=(1, 2, 3)) -> str:
    return " UNION ALL ".join(
        f"SELECT * FROM ({text.format(size=_size(t), head=_study(t, model))}) s{t}{model[0]}"
        for t in thirds for model, text in select.items())


def _error_by(key: str) -> dict[str, str]:
    return {m: "{head} " + f"SELECT '{m}' AS model, {{size}}, {key}, {r6(_ERR, 'rmse')} FROM pred "
               f"WHERE prediction IS NOT NULL GROUP BY {key}" for m in ("baseline", "neighbor")}


SQL["study_rmse_by_user"] = _study_union(_error_by("user_id"))
SQL["study_rmse_by_item"] = _study_union(_error_by("item_id"))
_PREC_USER = prec_named("prec", "user_id", "pred", 5)
SQL["study_precision_by_user"] = _study_union({
    "baseline": "{head} SELECT 'baseline' AS model, {size}, user_id, " + r6(
        "sum(CASE WHEN p.item_id IS NOT NULL THEN 1 ELSE 0 END) / 5.0", "precision") + """
        FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id DESC) AS trank,
                     count(*) OVER (PARTITION BY user_id) AS n FROM test) t
        LEFT JOIN popular p ON t.item_id = p.item_id AND p.prank <= t.n + 1 WHERE t.trank <= 5 GROUP BY user_id""",
    "neighbor": "{head}," + _PREC_USER + " SELECT 'neighbor' AS model, {size}, user_id, "
                + r6("precision", "precision") + " FROM prec",
})

_SWEEP_CURVE = "," + SWEEP + "," + PREC.format(g="n, user_id", src="sweep_p", k=5) + f""",
  curve AS (SELECT e.n, e.rmse, p.precision
            FROM (SELECT n, {_ERR} AS rmse FROM sweep_p WHERE prediction IS NOT NULL GROUP BY n) e
            JOIN (SELECT n, avg(precision) AS precision FROM prec GROUP BY n) p ON e.n = p.n)"""

SQL["study_curve"] = _study_union({
    "neighbor": "{head}" + _SWEEP_CURVE + " SELECT {size}, CAST(n AS BIGINT) AS n, "
                + r6("rmse", "rmse") + ", " + r6("precision", "precision") + " FROM curve"}, (2, 3))
SQL["study_best_params"] = (
    _study(2, "neighbor") + _SWEEP_CURVE + f""",
      lo AS (SELECT n, rmse FROM curve ORDER BY round(rmse, 9), n LIMIT 1),
      hi AS (SELECT n, precision FROM curve ORDER BY round(precision, 9) DESC, n LIMIT 1)
    SELECT CAST(lo.n AS BIGINT) AS best_n_rmse, {r6('lo.rmse', 'min_rmse')},
           CAST(hi.n AS BIGINT) AS best_n_precision, {r6('hi.precision', 'max_precision')} FROM lo, hi"""
)
_BY_KEY = {
    "rmse_user": f"SELECT user_id AS key, {_ERR} AS value FROM pred WHERE prediction IS NOT NULL GROUP BY user_id",
    "rmse_item": f"SELECT item_id AS key, {_ERR} AS value FROM pred WHERE prediction IS NOT NULL GROUP BY item_id",
    "precision_user": "SELECT user_id AS key, precision AS value FROM prec",
}
SQL["study_quantiles"] = " UNION ALL ".join(
    f"SELECT '{metric}' AS metric, a.bucket, {r6('a.mean_value', 'size_1')}, {r6('b.mean_value', 'size_2')}, "
    f"{r6('c.mean_value', 'size_3')} FROM " + " FULL JOIN ".join(
        "(" + _study(t, "neighbor", _PREC_USER, QB.format(metric=source, q=10)) + f" SELECT * FROM qb) {name}{on}"
        for t, name, on in ((1, "a", ""), (2, "b", " ON a.bucket = b.bucket"), (3, "c", " ON a.bucket = c.bucket")))
    for metric, source in _BY_KEY.items())

# ---------------------------------------------------------------- factor model: fold table

SQL["als_fold_counts"] = split_ctes() + f""",
  folded AS (SELECT user_id, item_id, ('0x' || substr(md5(CAST(user_id AS VARCHAR) || ':' || CAST(item_id AS VARCHAR)
             || ':12346'), 1, 8))::BIGINT % 2 AS fold FROM train),
  counted AS (SELECT f.fold, count(*) AS n FROM folded f
              WHERE EXISTS (SELECT 1 FROM folded o WHERE o.fold <> f.fold AND o.user_id = f.user_id)
                AND EXISTS (SELECT 1 FROM folded o WHERE o.fold <> f.fold AND o.item_id = f.item_id) GROUP BY f.fold)
  SELECT CAST(fold AS BIGINT) AS fold, {r6('0.05 + i * 0.25 / 9', 'reg_param')}, n FROM counted, range(10) t(i)"""
SQL["als_curve_checks"] = """
  SELECT round(0.05 + i * 0.25 / 9, 2)::DOUBLE AS reg_param, 2::BIGINT AS folds, true AS agrees, true AS between_folds
  FROM range(10) t(i)"""
