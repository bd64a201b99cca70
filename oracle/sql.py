"""SQL that states the expected result of each registered query on the same tables.

The statements are put together from named WITH parts.  ``k`` factors are unrolled into
columns x0..x{k-1}; factors pass through FLOAT wherever the factor tables store them.
"""

from __future__ import annotations

RANGE = "CAST(4294967296 AS DOUBLE)"


def draw(*keys: str, seed: int = 42, at: int = 0) -> str:
    """Draw number ``at`` of the four in a digest."""
    digest = f"md5(concat_ws('|', {', '.join(keys)}, '{seed}'))"
    return f"CAST('0x' || substr({digest}, {8 * at + 1}, 8) AS BIGINT)"


def uniform(*keys: str, seed: int = 42, at: int = 0) -> str:
    return f"(CAST({draw(*keys, seed=seed, at=at)} AS DOUBLE) / {RANGE})"


def normal(*keys: str, seed: int = 42, at: int = 0) -> str:
    radius = f"(CAST({draw(*keys, seed=seed, at=2 * at)} AS DOUBLE) + 1.0)"
    angle = uniform(*keys, seed=seed, at=2 * at + 1)
    return f"(sqrt(-2.0 * ln({radius} / {RANGE})) * cos(2.0 * pi() * {angle}))"


def query(parts: dict[str, str], final: str) -> str:
    named = ",\n".join(f"{name} AS ({text})" for name, text in parts.items())
    return f"WITH {named}\n{final}"


RAW = """SELECT o_custkey AS user_id, l_partkey AS item_id, l_orderkey, l_linenumber
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def index(source: str, col: str, idx: str) -> str:
    return (
        f"SELECT {col}, row_number() OVER (ORDER BY count(*) DESC, CAST({col} AS VARCHAR)) - 1"
        f" AS {idx} FROM {source} GROUP BY {col}"
    )


def indexed(source: str = "raw") -> dict[str, str]:
    """Dense ids and the interactions between them, as ``inter``."""
    return {
        "user_map": index(source, "user_id", "user_idx"),
        "item_map": index(source, "item_id", "item_idx"),
        "inter": f"SELECT user_idx, item_idx FROM {source} JOIN user_map USING (user_id)"
        " JOIN item_map USING (item_id)",
    }


def core(k: int, passes: int = 4) -> dict[str, str]:
    """The k-core of ``raw`` as ``core``; surplus passes change nothing."""
    parts, last = {}, "raw"
    for p in range(passes):
        parts[f"u{p}"] = (
            f"SELECT * FROM {last} WHERE user_id IN"
            f" (SELECT user_id FROM {last} GROUP BY 1 HAVING count(*) >= {k})"
        )
        last = "core" if p == passes - 1 else f"i{p}"
        parts[last] = (
            f"SELECT * FROM u{p} WHERE item_id IN"
            f" (SELECT item_id FROM u{p} GROUP BY 1 HAVING count(*) >= {k})"
        )
    return parts


def popularity(source: str) -> str:
    return (
        "SELECT item_idx, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM "
        f"{source}) AS f_i FROM {source} GROUP BY item_idx"
    )


def confidence(source: str, c0: float) -> str:
    """c_i from ``f_i`` of ``source``."""
    return (
        f"SELECT item_idx, pow(f_i, 0.4) / (SELECT sum(pow(f_i, 0.4)) FROM {source})"
        f" * CAST({c0} AS DOUBLE) AS c_i FROM {source}"
    )


def pairs(source: str, duplicates: str, weight: str = "1.0") -> str:
    if duplicates == "keep":
        return (
            f"SELECT user_idx, item_idx, CAST(count(*) AS DOUBLE) AS n, sum({weight}) AS w,"
            f" sum({weight}) AS wr FROM {source} GROUP BY 1, 2"
        )
    return (
        f"SELECT user_idx, item_idx, 1.0 AS n, max({weight}) AS w, max({weight}) AS wr"
        f" FROM {source} GROUP BY 1, 2"
    )


def start(source: str, col: str, k: int, distribution: str = "uniform") -> str:
    def element(f: int) -> str:
        if distribution == "uniform":
            value = f"{uniform(f"'{col}'", col, f"'{f // 4}'", at=f % 4)} * 0.01"
        else:
            value = f"{normal(f"'{col}'", col, f"'{f // 2}'", at=f % 2)} * 0.1"
        return f"CAST(CAST(CAST({value} AS DOUBLE) AS FLOAT) AS DOUBLE) AS x{f}"

    columns = ", ".join(element(f) for f in range(k))
    return f"SELECT {col}, {columns} FROM (SELECT DISTINCT {col} FROM {source})"


def upper(k: int):
    return [(f, g) for f in range(k) for g in range(f, k)]


def gram(table: str, k: int, conf: str | None = None) -> str:
    weight = "c_i * " if conf else ""
    sums = ", ".join(f"sum({weight}x{f} * x{g}) AS s{f}_{g}" for f, g in upper(k))
    join = f" JOIN {conf} USING (item_idx)" if conf else ""
    return f"SELECT {sums} FROM {table}{join}"


def cell(a: str, f: int, g: int) -> str:
    return f"{a}{min(f, g)}_{max(f, g)}"


def system(side: str, pairs: str, vectors: str, conf: str, cache: str, k: int, lam: float) -> str:
    """Full A (upper triangle) and b of every entity of ``side``."""
    own, other = ("user_idx", "item_idx") if side == "user" else ("item_idx", "user_idx")
    sums = ", ".join(f"sum((w - n * c_i) * x{f} * x{g}) AS o{f}_{g}" for f, g in upper(k))
    b = ", ".join(f"sum(wr * x{f}) AS b{f}" for f in range(k))
    scale = "1.0" if side == "user" else "max(c_i)"
    inner = (
        f"SELECT {own}, {sums}, {b}, {scale} AS scale FROM {pairs} JOIN {conf} USING (item_idx)"
        f" JOIN {vectors} USING ({other}) GROUP BY {own}"
    )
    full = ", ".join(
        f"o{f}_{g} + scale * s{f}_{g}{f' + {lam}' if f == g else ''} AS a{f}_{g}"
        for f, g in upper(k)
    )
    bs = ", ".join(f"b{f}" for f in range(k))
    return f"SELECT {own}, {full}, {bs} FROM ({inner}) o CROSS JOIN {cache}"


def sweep(side: str, systems: str, k: int, own: str | None = None) -> str:
    """One Gauss-Seidel pass; ``own`` holds the start vectors, None starts at zero."""
    key = f"{side}_idx"
    text, done = systems, []
    if own is not None:
        olds = ", ".join(f"coalesce(x{f}, 0.0) AS old{f}" for f in range(k))
        text = f"(SELECT s.*, {olds} FROM {systems} s LEFT JOIN {own} USING ({key}))"
    for f in range(k):
        rest = []
        for g in range(k):
            if g < f:
                rest.append(f"{cell('a', f, g)} * y{g}")
            elif g > f and own is not None:
                rest.append(f"{cell('a', f, g)} * old{g}")
        minus = f" - ({' + '.join(rest)})" if rest else ""
        text = f"(SELECT *, (b{f}{minus}) / a{f}_{f} AS y{f} FROM {text})"
        done.append(f"CAST(CAST(y{f} AS FLOAT) AS DOUBLE) AS x{f}")
    return f"SELECT {key}, {', '.join(done)} FROM {text}"


def solve2(side: str, systems: str) -> str:
    """Closed form for two factors."""
    det = "(a0_0 * a1_1 - a0_1 * a0_1)"
    return (
        f"SELECT {side}_idx,"
        f" CAST(CAST((b0 * a1_1 - b1 * a0_1) / {det} AS FLOAT) AS DOUBLE) AS x0,"
        f" CAST(CAST((b1 * a0_0 - b0 * a0_1) / {det} AS FLOAT) AS DOUBLE) AS x1 FROM {systems}"
    )


def solve(side: str, systems: str, k: int) -> str:
    """Elimination and back substitution for any number of factors."""
    key = f"{side}_idx"
    text = systems
    for p in range(k - 1):
        kept = [cell("a", f, g) for f, g in upper(k) if f <= p] + [f"b{f}" for f in range(p + 1)]
        less = [
            f"a{f}_{g} - a{p}_{f} * a{p}_{g} / a{p}_{p} AS a{f}_{g}" for f, g in upper(k) if f > p
        ]
        less += [f"b{f} - a{p}_{f} * b{p} / a{p}_{p} AS b{f}" for f in range(p + 1, k)]
        text = f"(SELECT {key}, {', '.join(kept + less)} FROM {text})"
    for p in reversed(range(k)):
        minus = "".join(f" - a{p}_{g} * y{g}" for g in range(p + 1, k))
        text = f"(SELECT *, (b{p}{minus}) / a{p}_{p} AS y{p} FROM {text})"
    done = ", ".join(f"CAST(CAST(y{f} AS FLOAT) AS DOUBLE) AS x{f}" for f in range(k))
    return f"SELECT {key}, {done} FROM {text}"


def half_step(
    name: str,
    side: str,
    vectors: str,
    k: int,
    own: str | None = None,
    method: str = "sweep",
    lam: float = 0.01,
) -> dict[str, str]:
    """WITH parts that end in the updated factor table ``name``; reads ``pairs`` and ``conf``."""
    cache = gram(vectors, k, "conf" if side == "user" else None)
    parts = {
        f"{name}_s": cache,
        f"{name}_a": system(side, "pairs", vectors, "conf", f"{name}_s", k, lam),
    }
    if method == "solve":
        parts[name] = solve2(side, f"{name}_a") if k == 2 else solve(side, f"{name}_a", k)
    else:
        parts[name] = sweep(side, f"{name}_a", k, own)
    return parts


def fit(
    source: str,
    k: int,
    iterations: int,
    *,
    begin: str = "warm",
    distribution: str = "uniform",
    method: str = "sweep",
    idle: bool = False,
) -> dict[str, str]:
    """Alternating fit over ``pairs`` and ``conf``; ends in tables p{iterations}, q{iterations}.

    With ``idle``, ids of ``source`` without a pair keep their start vectors.
    """
    parts = {
        "p0": start(source, "user_idx", k, distribution),
        "q0": start(source, "item_idx", k, distribution),
    }
    for t in range(1, iterations + 1):
        warm = begin == "warm"
        for side, own, other in (("user", "p", f"q{t-1}"), ("item", "q", f"p{t}")):
            name = f"{own}{t}"
            fresh = f"{name}_fresh" if idle else name
            parts |= half_step(fresh, side, other, k, f"{own}{t-1}" if warm else None, method)
            if idle:
                parts[name] = (
                    f"SELECT * FROM {fresh} UNION ALL"
                    f" SELECT * FROM {own}0 ANTI JOIN pairs USING ({side}_idx)"
                )
    return parts


def model_rows(users: str, items: str, k: int, digits: int = 6) -> str:
    """Both factor tables in long form."""
    rows = [
        f"SELECT '{side}' AS side, CAST({side}_idx AS BIGINT) AS idx, CAST({f} AS BIGINT) AS f,"
        f" round(x{f}, {digits}) + 0.0 AS value FROM {table}"
        for side, table in (("user", users), ("item", items))
        for f in range(k)
    ]
    return "\nUNION ALL ".join(rows)


def side_rows(table: str, side: str, k: int, digits: int = 6) -> str:
    rows = [
        f"SELECT CAST({side}_idx AS BIGINT) AS idx, CAST({f} AS BIGINT) AS f,"
        f" round(x{f}, {digits}) + 0.0 AS value FROM {table}"
        for f in range(k)
    ]
    return "\nUNION ALL ".join(rows)


def dot(k: int) -> str:
    return " + ".join(f"p.x{f} * q.x{f}" for f in range(k))


def leave_one_out(n_users: int | None) -> dict[str, str]:
    """``test`` and ``train`` from ``inter``."""
    sample = "SELECT DISTINCT user_idx FROM inter"
    if n_users is not None:
        sample += (
            f" ORDER BY {draw('user_idx', chr(39) + 'sample' + chr(39))}, user_idx LIMIT {n_users}"
        )
    drawn = f"(CAST({draw('user_idx', 'item_idx')} AS DOUBLE) + 1.0) / {RANGE}"
    return {
        "sampled": sample,
        "hidden": f"SELECT user_idx, item_idx, -ln({drawn}) / count(*) AS wait FROM inter"
        " WHERE user_idx IN (SELECT user_idx FROM sampled) GROUP BY user_idx, item_idx",
        "test": "SELECT user_idx, item_idx FROM (SELECT user_idx, item_idx, row_number() OVER"
        " (PARTITION BY user_idx ORDER BY wait, item_idx) AS pos FROM hidden) WHERE pos = 1",
        "train": "SELECT i.* FROM inter i ANTI JOIN test USING (user_idx, item_idx)",
    }


# The items that can be drawn, numbered, and the distinct test pairs.
FRAME = {
    "frame": "SELECT item_idx, row_number() OVER (ORDER BY item_idx) - 1 AS place"
    " FROM (SELECT DISTINCT item_idx FROM train)",
    "cases": "SELECT DISTINCT user_idx, item_idx AS truth FROM test",
}
TRUE_ROWS = "SELECT user_idx, truth, truth AS item_idx, 1 AS is_true FROM cases"


def places(draws: int) -> str:
    place = f"{draw('user_idx', 'truth', 'j')} % (SELECT count(*) FROM frame)"
    return (
        f"SELECT user_idx, truth, j, {place} AS place FROM cases"
        f" CROSS JOIN (SELECT unnest(range({draws})) AS j)"
    )


def negatives(n: int = 99) -> dict[str, str]:
    """``candidates`` of ``test`` with uniform draws."""
    return FRAME | {
        "candidates": f"{TRUE_ROWS} UNION ALL SELECT user_idx, truth, item_idx, 0"
        f" FROM ({places(n)}) JOIN frame USING (place)"
    }


def unseen(draws: int, n: int = 99) -> dict[str, str]:
    """``candidates`` of ``test`` with the first distinct unseen draws."""
    return FRAME | {
        "drawn": f"SELECT user_idx, truth, item_idx, min(j) AS j FROM ({places(draws)})"
        " JOIN frame USING (place) GROUP BY 1, 2, 3",
        "fresh": "SELECT d.*, row_number() OVER (PARTITION BY user_idx, truth ORDER BY j) AS pos"
        " FROM drawn d ANTI JOIN train USING (user_idx, item_idx) WHERE item_idx <> truth",
        "candidates": f"{TRUE_ROWS} UNION ALL"
        f" SELECT user_idx, truth, item_idx, 0 FROM fresh WHERE pos <= {n}",
    }


def ranking(users: str, items: str, k: int) -> dict[str, str]:
    """``ranked`` from ``candidates``."""
    return {
        "scored": f"SELECT c.*, {dot(k)} AS score FROM candidates c JOIN {users} p USING"
        f" (user_idx) JOIN {items} q USING (item_idx)",
        "ranked": "SELECT *, row_number() OVER (PARTITION BY user_idx, truth"
        " ORDER BY score DESC, item_idx, is_true DESC) AS rank,"
        " count(*) OVER (PARTITION BY user_idx, truth) - 1 AS n FROM scored",
    }


METRICS = (
    "(SELECT count(*) FROM test) AS n_test, CAST(coalesce(sum(c), 0) AS BIGINT) AS n_covered,"
    " {least}round(CAST(sum(n * c) AS DOUBLE) / sum(c), 9) AS mean_candidates,"
    " round(sum(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END * c) / sum(c), 9)::DOUBLE AS hit_ratio,"
    " round(sum(CASE WHEN rank <= 10 THEN ln(2.0) / ln(rank + 1.0) ELSE 0.0 END * c) / sum(c), 9)"
    " AS ndcg"
)


def metrics(least: bool = True) -> str:
    return METRICS.format(least="min(n) AS min_candidates, " if least else "")


def true_rows(ranked: str = "ranked") -> str:
    """The ranked true rows with the number of test rows each stands for."""
    return (
        f"(SELECT * FROM {ranked} WHERE is_true = 1) JOIN (SELECT user_idx, item_idx AS truth,"
        " count(*) AS c FROM test GROUP BY 1, 2) USING (user_idx, truth)"
    )
