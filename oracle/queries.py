"""Expected result of every registered query, as SQL over the given tables."""

from __future__ import annotations

from oracle import sql

RAW = {"raw": sql.RAW}
INDEXED = RAW | sql.indexed()
POPULARITY = {"pop": sql.popularity("inter")}
CONFIDENCE = POPULARITY | {"conf": sql.confidence("pop", 512.0)}
ONCE = {"pairs": sql.pairs("inter", "distinct")}
MODEL = INDEXED | CONFIDENCE | ONCE
UNIFORM = INDEXED | {
    "conf": "SELECT DISTINCT item_idx, CAST(0.01 AS DOUBLE) AS c_i FROM inter"
} | ONCE
EVENTS = {
    "raw": "SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id FROM events"
}
BIG_PAIR = "CAST(user_idx AS BIGINT) AS user_idx, CAST(item_idx AS BIGINT) AS item_idx"


def starts(k: int, distribution: str = "uniform") -> dict[str, str]:
    return {
        "p0": sql.start("inter", "user_idx", k, distribution),
        "q0": sql.start("inter", "item_idx", k, distribution),
    }


def one_step(side: str, k: int = 2, own: bool = True, base: dict | None = None, **how) -> str:
    vectors, start = ("q0", "p0") if side == "user" else ("p0", "q0")
    distribution = how.pop("distribution", "uniform")
    parts = (base or MODEL) | starts(k, distribution)
    parts |= sql.half_step("fresh_factors", side, vectors, k, start if own else None, **how)
    return sql.query(parts, sql.side_rows("fresh_factors", side, k))


def threshold(k: int) -> str:
    return (
        "SELECT user_id, item_id FROM raw"
        f" WHERE user_id IN (SELECT user_id FROM raw GROUP BY 1 HAVING count(*) >= {k})"
        f" AND item_id IN (SELECT item_id FROM raw GROUP BY 1 HAVING count(*) >= {k})"
    )


def top(col: str, n: int) -> str:
    return f"SELECT {col} FROM raw GROUP BY 1 ORDER BY count(*) DESC, {col} LIMIT {n}"


def history(own: str) -> str:
    other = "item_id" if own == "user" else "user_id"
    return sql.query(
        RAW,
        f"SELECT {own}_id AS {own}_idx, CAST(0 AS BIGINT) AS part,"
        f" string_agg(CAST({other} AS VARCHAR) || ':1', ',' ORDER BY {other}) AS events"
        f" FROM raw GROUP BY {own}_id",
    )


def random_part(sign: str) -> str:
    return sql.query(
        RAW,
        "SELECT user_id, item_id, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber"
        f" FROM raw WHERE {sql.uniform('l_orderkey', 'l_linenumber')} {sign} 0.8",
    )


def loo(n_users: int | None) -> dict[str, str]:
    return INDEXED | sql.leave_one_out(n_users)


def trial(iterations: int = 1, n_users: int | None = None, base: dict | None = None) -> dict[str, str]:
    """Split, weights and model of the evaluation queries."""
    return (
        (base or loo(n_users))
        | {
            "pop": sql.popularity("train"),
            "conf": sql.confidence("pop", 512.0),
            "pairs": sql.pairs("train", "distinct"),
        }
        | sql.fit("train", 2, iterations)
    )


def by_pair(share: float) -> dict[str, str]:
    """A random split by pair."""
    chosen = f"{sql.uniform('user_idx', 'item_idx')} < {share}"
    return INDEXED | {
        "train": f"SELECT * FROM inter WHERE {chosen}",
        "test": f"SELECT * FROM inter WHERE NOT ({chosen})",
    }


CANDIDATE_ROWS = f"SELECT {BIG_PAIR}, CAST(is_true AS BIGINT) AS is_true FROM candidates"


THIN = INDEXED | {
    "train": f"SELECT * FROM inter WHERE {sql.uniform('user_idx', 'item_idx')} < 0.1",
    "pop": sql.popularity("train"),
}


def completed_factors() -> str:
    parts = (
        THIN
        | {"conf": sql.confidence("pop", 64.0), "pairs": sql.pairs("train", "distinct")}
        | sql.fit("train", 2, 1)
        | {
            "start": sql.start("inter", "item_idx", 2, "normal"),
            "whole": "SELECT item_idx, coalesce(q.x0, s.x0) AS x0, coalesce(q.x1, s.x1) AS x1"
            " FROM start s LEFT JOIN q1 q USING (item_idx)",
        }
    )
    return sql.query(parts, sql.side_rows("whole", "item", 2))


def telemetry() -> str:
    base = (
        RAW
        | sql.core(10)
        | sql.indexed("core")
        | sql.leave_one_out(None)
        | {
            "pop": sql.popularity("inter"),
            "conf": sql.confidence("pop", 512.0),
            "pairs": sql.pairs("train", "distinct"),
        }
        | sql.fit("train", 2, 2)
        | sql.negatives()
        | {
            "size": "SELECT count(DISTINCT user_idx) AS n_users, count(DISTINCT item_idx) AS n_items"
            " FROM train"
        }
    )
    rows = []
    for t in (1, 2):
        ranked = sql.ranking(f"p{t}", f"q{t}", 2)
        base |= {
            f"scored{t}": ranked["scored"],
            f"ranked{t}": ranked["ranked"].replace("FROM scored", f"FROM scored{t}"),
        }
        rows.append(
            f"SELECT CAST({t} AS BIGINT) AS iteration, (SELECT n_users FROM size) AS n_users,"
            f" (SELECT n_items FROM size) AS n_items, {sql.metrics(least=False)},"
            f" (SELECT round(sqrt(avg((1.0 - ({sql.dot(2)})) * (1.0 - ({sql.dot(2)})))), 9)"
            f" FROM test JOIN p{t} p USING (user_idx) JOIN q{t} q USING (item_idx)) AS rmse,"
            " (SELECT round((n_users + n_items) * 4.0 / 1000000.0, 6) FROM size)::DOUBLE"
            f" AS mops_elementwise FROM {sql.true_rows(f'ranked{t}')}"
        )
    return sql.query(base, " UNION ALL ".join(rows))


def oracle_sql() -> dict[str, str]:
    out = {
        "implicit_interactions": sql.query(
            RAW, "SELECT user_id, item_id, CAST(1 AS DOUBLE) AS rating FROM raw"
        ),
        "events_interactions": sql.query(
            EVENTS, "SELECT user_id, item_id, CAST(1 AS DOUBLE) AS rating FROM raw"
        ),
        "json_feedback_scan": sql.query(
            RAW,
            "SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS business_id,"
            " CAST(1 AS DOUBLE) AS rating FROM raw",
        ),
        "threshold_filter_k20": sql.query(RAW, threshold(20)),
        "kcore_k20": sql.query(RAW | sql.core(20), "SELECT user_id, item_id FROM core"),
        "kcore_events_k60": sql.query(
            EVENTS | sql.core(60, 8), "SELECT user_id, item_id FROM core"
        ),
        "top_n_filter_500": sql.query(
            RAW,
            f"SELECT user_id, item_id FROM raw WHERE user_id IN ({top('user_id', 500)})"
            f" AND item_id IN ({top('item_id', 500)})",
        ),
        "top_n_filter_uncut": sql.query(
            RAW, f"SELECT user_id, item_id FROM raw WHERE item_id IN ({top('item_id', 500)})"
        ),
        "index_frequency": sql.query(RAW, sql.index("raw", "item_id", "item_idx")),
        "index_first_seen": sql.query(
            RAW,
            "SELECT user_id, row_number() OVER (ORDER BY min(l_orderkey * 8 + l_linenumber),"
            " CAST(user_id AS VARCHAR)) - 1 AS user_idx FROM raw GROUP BY user_id",
        ),
        "prepare_k20": sql.query(
            RAW | sql.core(20) | sql.indexed("core"),
            f"SELECT {BIG_PAIR}, CAST(1 AS DOUBLE) AS rating FROM inter",
        ),
        "prepare_popularity_k20": sql.query(
            RAW | sql.core(20) | sql.indexed("core") | POPULARITY,
            "SELECT CAST(item_idx AS BIGINT) AS item_idx, round(f_i, 12) AS f_i FROM pop",
        ),
        "popularity": sql.query(
            RAW,
            "SELECT item_id AS item_idx, round(CAST(count(*) AS DOUBLE)"
            " / (SELECT count(*) FROM raw), 12) AS f_i FROM raw GROUP BY item_id",
        ),
        "confidence_after_threshold": sql.query(
            RAW
            | {
                "kept": threshold(20),
                "pop": sql.popularity("(SELECT item_id AS item_idx FROM kept)"),
                "conf": sql.confidence("pop", 512.0),
            },
            "SELECT item_idx AS item_id, round(c_i, 9) AS c_i FROM conf",
        ),
        "user_history": history("user"),
        "item_history": history("item"),
        "split_random_train": random_part("<"),
        "split_random_test": random_part(">="),
        "split_loo_train": sql.query(loo(None), f"SELECT {BIG_PAIR} FROM train"),
        "split_loo_test": sql.query(loo(None), f"SELECT {BIG_PAIR} FROM test"),
        "split_loo_500_users": sql.query(loo(500), f"SELECT {BIG_PAIR} FROM test"),
        "init_uniform": sql.query(
            INDEXED | {"p0": sql.start("inter", "user_idx", 4)},
            sql.side_rows("p0", "user", 4, 9),
        ),
        "init_normal": sql.query(
            INDEXED | {"q0": sql.start("inter", "item_idx", 4, "normal")},
            sql.side_rows("q0", "item", 4, 6),
        ),
        "sweep_users_cold": one_step("user", own=False),
        "sweep_users_warm": one_step("user"),
        "sweep_items_cold": one_step("item", own=False),
        "sweep_items_warm": one_step("item"),
        "sweep_users_bag": one_step(
            "user",
            base=INDEXED
            | POPULARITY
            | {"conf": sql.confidence("pop", 64.0), "pairs": sql.pairs("inter", "keep")},
        ),
        "sweep_items_weighted": one_step(
            "item",
            base=INDEXED
            | CONFIDENCE
            | {"pairs": sql.pairs("inter", "distinct", "1.0 + user_idx % 3")},
        ),
        "sweep_users_split": one_step("user", 6),
        "sweep_users_k16": one_step("user", 16),
        "als_items_k16": one_step(
            "item", 16, own=False, base=UNIFORM, method="solve", distribution="normal"
        ),
        "fit_two_iterations": sql.query(
            MODEL | sql.fit("inter", 2, 2), sql.model_rows("p2", "q2", 2)
        ),
        "fit_cold_normal": sql.query(
            MODEL | sql.fit("inter", 4, 2, begin="cold", distribution="normal"),
            sql.model_rows("p2", "q2", 4),
        ),
        "als_users_solve": one_step(
            "user", own=False, base=UNIFORM, method="solve", distribution="normal"
        ),
        "als_items_solve": one_step(
            "item", own=False, base=UNIFORM, method="solve", distribution="normal"
        ),
        "als_fit_two_iterations": sql.query(
            UNIFORM | sql.fit("inter", 2, 2, distribution="normal", method="solve"),
            sql.model_rows("p2", "q2", 2),
        ),
        "model_roundtrip": sql.query(
            MODEL
            | sql.fit("inter", 2, 1)
            | {
                "pr": "SELECT user_id AS user_idx, x0, x1 FROM p1 JOIN user_map USING (user_idx)",
                "qr": "SELECT item_id AS item_idx, x0, x1 FROM q1 JOIN item_map USING (item_idx)",
            },
            sql.model_rows("pr", "qr", 2),
        ),
        "scored_pairs": sql.query(
            trial(),
            "SELECT CAST(t.user_idx AS BIGINT) AS user_idx, CAST(t.item_idx AS BIGINT) AS item_idx,"
            f" round({sql.dot(2)}, 9) + 0.0 AS score FROM test t JOIN p1 p USING (user_idx)"
            " JOIN q1 q USING (item_idx)",
        ),
        "negatives_uniform": sql.query(loo(None) | sql.negatives(), CANDIDATE_ROWS),
        "negatives_unseen": sql.query(loo(None) | sql.unseen(400), CANDIDATE_ROWS),
        "ranked_candidates": sql.query(
            trial() | sql.negatives() | sql.ranking("p1", "q1", 2),
            f"SELECT {BIG_PAIR}, CAST(is_true AS BIGINT) AS is_true,"
            " CAST(rank AS BIGINT) AS rank FROM ranked",
        ),
        "hit_ndcg_uniform": sql.query(
            trial() | sql.negatives() | sql.ranking("p1", "q1", 2),
            f"SELECT {sql.metrics()} FROM {sql.true_rows()}",
        ),
        "hit_ndcg_unseen": sql.query(
            trial() | sql.unseen(400) | sql.ranking("p1", "q1", 2),
            f"SELECT {sql.metrics()} FROM {sql.true_rows()}",
        ),
        "hit_ndcg_sparse_train": sql.query(
            trial(base=by_pair(0.02)) | sql.negatives() | sql.ranking("p1", "q1", 2),
            f"SELECT {sql.metrics()} FROM {sql.true_rows()}",
        ),
        "hit_ndcg_many_per_user": sql.query(
            trial(base=by_pair(0.8)) | sql.negatives() | sql.ranking("p1", "q1", 2),
            f"SELECT {sql.metrics()} FROM {sql.true_rows()}",
        ),
        "scored_pairs_k32": sql.query(
            INDEXED | starts(32),
            f"SELECT {BIG_PAIR}, round({sql.dot(32)}, 9) + 0.0 AS score"
            " FROM (SELECT DISTINCT user_idx, item_idx FROM inter)"
            " JOIN p0 p USING (user_idx) JOIN q0 q USING (item_idx)",
        ),
        "scored_pairs_cells": sql.query(
            INDEXED | starts(32),
            f"SELECT {BIG_PAIR}, round({sql.dot(32)}, 9) + 0.0 AS score"
            " FROM (SELECT DISTINCT user_idx, item_idx FROM inter)"
            " JOIN p0 p USING (user_idx) JOIN q0 q USING (item_idx)",
        ),
        **dict.fromkeys(
            ("hit_ndcg_scored", "hit_ndcg_cells"),
            sql.query(
                trial() | sql.negatives() | sql.ranking("p1", "q1", 2),
                f"SELECT {sql.metrics()} FROM {sql.true_rows()}",
            ),
        ),
        "sweep_items_split": one_step("item"),
        "als_users_split": one_step(
            "user", own=False, base=UNIFORM, method="solve", distribution="normal"
        ),
        "fit_two_iterations_keep": sql.query(
            INDEXED
            | POPULARITY
            | {"conf": sql.confidence("pop", 64.0), "pairs": sql.pairs("inter", "keep")}
            | sql.fit("inter", 2, 2),
            sql.model_rows("p2", "q2", 2),
        ),
        "als_fit_idle_entities": sql.query(
            INDEXED
            | {"train": THIN["train"], "conf": UNIFORM["conf"]}
            | {"pairs": sql.pairs("train", "distinct")}
            | sql.fit("inter", 2, 2, distribution="normal", method="solve", idle=True),
            sql.model_rows("p2", "q2", 2),
        ),
        "user_history_parts": sql.query(
            RAW,
            "SELECT user_id AS user_idx, count(*) AS n, string_agg(CAST(item_id AS VARCHAR),"
            " ',' ORDER BY item_id) AS items FROM raw GROUP BY user_id",
        ),
        "rmse_coverage": sql.query(
            trial(base=by_pair(0.8)),
            "SELECT (SELECT count(*) FROM test) AS n_test, count(*) AS n_covered,"
            " round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM test), 9) AS coverage,"
            f" round(sqrt(sum((1.0 - ({sql.dot(2)})) * (1.0 - ({sql.dot(2)}))) / count(*)), 9)"
            " AS rmse FROM test t JOIN p1 p USING (user_idx) JOIN q1 q USING (item_idx)",
        ),
        "complete_factor_table": completed_factors(),
        "complete_confidence_table": sql.query(
            THIN | {"conf": sql.confidence("pop", 512.0)},
            "SELECT CAST(item_idx AS BIGINT) AS item_idx, round(coalesce(c_i, 0.0), 9) AS c_i"
            " FROM (SELECT DISTINCT item_idx FROM inter) LEFT JOIN conf USING (item_idx)",
        ),
        "telemetry_ops": sql.query(
            INDEXED
            | {
                "size": "SELECT count(*) AS n, count(DISTINCT user_idx) AS n_users,"
                " count(DISTINCT item_idx) AS n_items FROM inter"
            },
            "SELECT n_users, n_items,"
            " round(CAST((n_users + n_items) AS DOUBLE) * 4096 / 1e6, 6) AS mops_elementwise,"
            " round(CAST((n_users + n_items) AS DOUBLE) * 262144 / 1e6, 6) AS mops_exact,"
            " CAST(64 AS DOUBLE) AS gain_factor,"
            " round(CAST(n AS DOUBLE) * 64 / 1e6, 6) AS mops_observed FROM size",
        ),
        "telemetry": telemetry(),
    }
    for name, table, conf in (("gram_items", "q0", "conf"), ("gram_users", "p0", None)):
        parts = INDEXED | CONFIDENCE | starts(4) | {"s": sql.gram(table, 4, conf)}
        cells = [
            f"SELECT CAST({f} AS BIGINT) AS f, CAST({g} AS BIGINT) AS g,"
            f" round({sql.cell('s', f, g)}, 9) + 0.0 AS value FROM s"
            for f in range(4)
            for g in range(4)
        ]
        out[name] = sql.query(parts, " UNION ALL ".join(cells))
    return out
