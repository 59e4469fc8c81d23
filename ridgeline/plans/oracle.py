"""The same queries in DuckDB's SQL."""

from __future__ import annotations

E = "e AS (SELECT vec_id::BIGINT AS row_id, [x::DOUBLE FOR x IN embedding] AS v, label::INT AS label FROM embeddings)"
M = """m AS (SELECT count(*) AS n, sum(x1 * x1) / count(*) AS g11, sum(x1 * x2) / count(*) AS g12, sum(x2 * x2) / count(*) AS g22, sum(x1 * y) / count(*) AS b1, sum(x2 * y) / count(*) AS b2, sum(y * y) / count(*) AS yy
  FROM (SELECT l_quantity / 50.0::DOUBLE AS x1, l_discount AS x2, l_extendedprice / 1e5::DOUBLE AS y FROM lineitem))"""
REG = "0.1::DOUBLE"
CELLS = "x AS (SELECT row_id, u.i - 1 AS i, v[u.i] AS v, label FROM e, unnest(range(1, len(v) + 1)) AS u(i))"
COST = "0.5::DOUBLE * 0.5::DOUBLE * g11 + 2 * 0.5::DOUBLE * 0.25::DOUBLE * g12 + 0.25::DOUBLE * 0.25::DOUBLE * g22 - 2 * (0.5::DOUBLE * b1 + 0.25::DOUBLE * b2) + yy"
NORM = "0.5::DOUBLE * 0.5::DOUBLE + 0.25::DOUBLE * 0.25::DOUBLE"
PAIRS = "p AS (SELECT a.row_id AS i, b.row_id AS j, list_sum([power(z[1] - z[2], 2) FOR z IN list_zip(a.v, b.v)]) AS d2, list_sum([z[1] * z[2] FOR z IN list_zip(a.v, b.v)]) AS s FROM e a, e b)"


def _key(seed: int, epoch: int, row: str = "row_id") -> str:
    return f"md5('{seed}-{epoch}-' || {row}::VARCHAR)"


def _orders() -> str:
    return "o AS (SELECT o_orderkey AS row_id FROM orders), n AS (SELECT count(*) AS n FROM o)"


def _block(size: int, seed: int, epoch: int, source: str) -> str:
    return f"SELECT *, row_id // {size} AS block_id, row_number() OVER (PARTITION BY row_id // {size} ORDER BY {_key(seed, epoch)}) - 1 AS r FROM {source}"


CUSTOMERS = "c AS (SELECT c_custkey AS row_id, c_acctbal / 1e4::DOUBLE AS x, (c_mktsegment = 'BUILDING')::INT::DOUBLE AS y FROM customer)"
STEP = """f({key}t, w0, w1, d0, d1) AS ({start}
UNION ALL SELECT {key}t + 1, w0 - n0, w1 - n1, n0, n1 FROM (SELECT {fkey}f.t, w0, w1,
  0.01::DOUBLE * power(0.99::DOUBLE, f.t // 100) * (x * (x * w0 + w1 - y) + 0.1::DOUBLE * w0) + 0.9::DOUBLE * d0 AS n0,
  0.01::DOUBLE * power(0.99::DOUBLE, f.t // 100) * ((x * w0 + w1 - y) + 0.1::DOUBLE * w1) + 0.9::DOUBLE * d1 AS n1 FROM f JOIN o ON o.t = f.t{on}))"""
ZERO = "0::BIGINT, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE"
ONE_FOLD = STEP.format(key="", fkey="", start=f"SELECT {ZERO}", on="")
LAST = "l AS (SELECT * FROM f WHERE t = (SELECT max(t) FROM f))"
COEFFICIENTS = "SELECT 0::INT AS j, t, {more}round(w0, 6) + 0.0 AS w FROM l UNION ALL SELECT 1::INT, t, {more}round(w1, 6) + 0.0 FROM l"


def _ordered(places: str) -> str:
    """o: the rows of CUSTOMERS with t, by epoch and place."""
    return f"WITH RECURSIVE {CUSTOMERS}, {places}, o AS MATERIALIZED (SELECT x, y, epoch, place, row_number() OVER (ORDER BY epoch, place) - 1 AS t FROM q)"


def _fold(order: str, epochs: int) -> str:
    rows = " UNION ALL ".join(f"SELECT {e} AS epoch, *, {order.format(epoch=e)} AS place FROM c" for e in range(epochs))
    return f"{_ordered(f'q AS ({rows})')}, {ONE_FOLD}, {LAST} {COEFFICIENTS.format(more='')}"


def _stream() -> str:
    places = f"""n AS (SELECT count(*) AS n FROM c), b AS ({_block(500, 3, 0, 'c')}), s AS (SELECT *, r // greatest(1, 500 // ceil(n.n / 500.0)::BIGINT) AS slice_id FROM b, n),
p AS (SELECT *, row_number() OVER (ORDER BY slice_id, {_key(4, 0)}, row_id) - 1 AS place FROM s), q AS (SELECT e.epoch, x, y, place FROM p, range(2) AS e(epoch))"""
    return f"{_ordered(places)}, {ONE_FOLD}, {LAST} {COEFFICIENTS.format(more='(SELECT ceil(n.n / 200.0)::BIGINT FROM n) AS blocks, ')}"


def _metrics() -> str:
    places = f"p AS (SELECT *, row_number() OVER (ORDER BY {_key(3, 0)}, row_id) - 1 AS place FROM c), q AS (SELECT 0 AS epoch, x, y, place FROM p)"
    return f"""{_ordered(places)}, {ONE_FOLD}, b AS (SELECT place // 200 AS block, max(t) AS t FROM o GROUP BY 1)
SELECT b.t::INT AS i, round(sqrt(sum(power(x * w0 + w1 - y, 2))) + 0.1::DOUBLE * sqrt(any_value(w0 * w0 + w1 * w1)), 6) + 0.0 AS loss, round(avg(((x * w0 + w1 > 0.5)::INT = y)::INT), 9) + 0.0 AS accuracy
FROM b JOIN f ON f.t = b.t + 1 JOIN o ON o.place // 200 = b.block GROUP BY b.t"""


def _log() -> str:
    return f"""{_ordered("q AS (SELECT 0 AS epoch, *, row_id AS place FROM c)")}, {ONE_FOLD}
SELECT (t - 1)::INT AS i, round(sqrt(sum(power(x * w0 + w1 - y, 2))) + 0.1::DOUBLE * sqrt(any_value(w0 * w0 + w1 * w1)), 6) + 0.0 AS loss,
  round(avg(((x * w0 + w1 > 0.5)::INT = y)::INT), 9) + 0.0 AS train_accuracy, round(avg(((x * w0 + w1 > 0.5)::INT = y)::INT), 9) + 0.0 AS test_accuracy
FROM f, c WHERE t > 0 AND (t - 1) % 100 = 0 GROUP BY t"""


def _parts(parts: int) -> str:
    fold = STEP.format(key="part, ", fkey="f.part, ", start=f"SELECT part, {ZERO} FROM range({parts}) AS p(part)", on=" AND o.part = f.part")
    return f"""WITH RECURSIVE {CUSTOMERS}, k AS (SELECT *, {_key(0, 0)} AS k FROM c), p AS (SELECT *, ('0x' || substr(k, 1, 6))::BIGINT % {parts} AS part FROM k),
o AS MATERIALIZED (SELECT part, x, y, row_number() OVER (PARTITION BY part ORDER BY k, row_id, y, x) - 1 AS t FROM p), {fold},
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY part ORDER BY t DESC) = 1)
SELECT 0::INT AS j, round(sum(w0 * t) / sum(t), 6) + 0.0 AS w FROM l UNION ALL SELECT 1::INT, round(sum(w1 * t) / sum(t), 6) + 0.0 FROM l"""


#: The normal equations of embeddings, 64 x (64 + 10), and Gauss-Jordan elimination of them, a pivot a step; they are positive definite.
SOLVED = f"""{{e}}, {{cells}}, a AS (SELECT a.i, b.i AS j, sum(a.v * b.v) + CASE WHEN a.i = b.i THEN 0.1::DOUBLE ELSE 0 END AS v FROM x a JOIN x b USING (row_id) GROUP BY a.i, b.i
  UNION ALL SELECT i, 64 + k.c, sum(CASE WHEN label = k.c THEN v ELSE 0 END) FROM x, range(10) AS k(c) GROUP BY i, k.c),
g(k, m) AS (SELECT 1, (SELECT list(r ORDER BY i) FROM (SELECT i, list(v ORDER BY j) AS r FROM a GROUP BY i))
  UNION ALL SELECT k + 1, [CASE WHEN i = k THEN [z / m[k][k] FOR z IN m[k]] ELSE [m[i][j] - m[i][k] * m[k][j] / m[k][k] FOR j IN range(1, 75)] END FOR i IN range(1, 65)] FROM g WHERE k <= 64),
w AS (SELECT r.i - 1 AS j, k.c AS c, m[r.i][65 + k.c] AS w FROM g, range(1, 65) AS r(i), range(10) AS k(c) WHERE g.k = 65)"""


BLOCK_ORDER = "(row_id // 100) * 100 + row_number() OVER (PARTITION BY row_id // 100 ORDER BY md5('3-{epoch}-' || row_id::VARCHAR)) - 1"

SQL = {
    "matrix_scan": f"WITH {E} SELECT row_id, label, len(v)::INT AS d, round(list_sum(v), 6) + 0.0 AS total FROM e",
    "block_counts": "SELECT vec_id // 100 AS block_id, count(*) AS n, min(vec_id) AS first_row FROM embeddings GROUP BY 1",
    "block_read": "SELECT vec_id AS row_id, label::INT AS label FROM embeddings WHERE vec_id >= 100 AND vec_id < 200",
    "split_features_label": "SELECT l_orderkey, l_linenumber, l_quantity AS x0, l_discount AS x1, 2::INT AS d, trunc(l_extendedprice)::INT AS label FROM lineitem",
    "scale_features": "SELECT p_partkey, round(p_size::DOUBLE / 255.0::DOUBLE, 9) + 0.0 AS s0, round(p_retailprice / 255.0::DOUBLE, 9) + 0.0 AS s1 FROM part",
    "row_subset": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 1000",
    "concat_columns": "SELECT p_partkey, 3::INT AS d, p_size::DOUBLE + p_retailprice + p_partkey::DOUBLE AS total FROM part",
    "union_batches": "SELECT c_custkey AS key, c_acctbal AS balance, 0::INT AS part FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 1 FROM supplier",
    "train_test_split_exact": f"""WITH c AS (SELECT c_custkey AS row_id FROM customer), p AS (SELECT row_id, row_number() OVER (ORDER BY {_key(5, 0)}, row_id) - 1 AS position FROM c)
SELECT row_id, position, position < ceil((SELECT count(*) FROM c) * 0.8::DOUBLE) AS is_train FROM p""",
    "one_hot": "SELECT vec_id AS row_id, k.c::INT AS c, (k.c = label)::INT AS y FROM embeddings, range(10) AS k(c)",
    "argmax_decode": f"WITH {E} SELECT row_id, (list_position(v, list_max(v)) - 1)::INT AS largest, CASE WHEN label BETWEEN 0 AND 9 THEN label ELSE 0 END AS decoded FROM e",
    "threshold_predict": "SELECT CASE WHEN l_quantity / 50.0::DOUBLE > 0.5 THEN 1 ELSE 0 END AS prediction, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "row_norms": f"WITH {E} SELECT row_id, round(list_sum([x * x FOR x IN v]), 6) + 0.0 AS norm2 FROM e",
    "frobenius_norm": f"WITH {E} SELECT round(sqrt(sum(list_sum([x * x FOR x IN v]))), 6) + 0.0 AS norm FROM e",
    "gram_matrix": f"WITH {E}, {CELLS} SELECT a.i::INT AS i, b.i::INT AS j, round(sum(a.v * b.v), 6) + 0.0 AS g FROM x a JOIN x b USING (row_id) GROUP BY 1, 2",
    "cross_moment": f"WITH {E}, {CELLS} SELECT i::INT AS i, k.c::INT AS c, round(sum(CASE WHEN label = k.c THEN v ELSE 0 END), 6) + 0.0 AS b FROM x, range(10) AS k(c) GROUP BY 1, 2",
    "ridge_closed_1d": f"WITH {M} SELECT n, round(b1 / (g11 + {REG}), 6) + 0.0 AS w FROM m",
    "ridge_closed_2d": f"""WITH {M}, d AS (SELECT *, (g11 + {REG}) * (g22 + {REG}) - g12 * g12 AS det FROM m)
SELECT 0::INT AS j, 0::INT AS c, round((b1 * (g22 + {REG}) - b2 * g12) / det, 6) + 0.0 AS w FROM d UNION ALL SELECT 1, 0, round((b2 * (g11 + {REG}) - b1 * g12) / det, 6) + 0.0 FROM d""",
    "ridge_closed_64d": f"WITH RECURSIVE {SOLVED.format(e=E, cells=CELLS)} SELECT j::INT AS j, c::INT AS c, round(w, 6) + 0.0 AS w FROM w",
    "ridge_predict_accuracy": f"""WITH RECURSIVE {SOLVED.format(e=E, cells=CELLS)}, s AS (SELECT row_id, label, c, sum(v * w) AS s FROM x JOIN w ON x.i = w.j GROUP BY ALL),
p AS (SELECT row_id, label, arg_max(c, s) AS prediction FROM s GROUP BY ALL) SELECT label, count(*) AS n, round(avg((prediction = label)::INT), 9) + 0.0 AS accuracy FROM p GROUP BY label""",
    "ridge_loss_norm": f"WITH {M} SELECT round(sqrt({COST}) + {REG} * sqrt({NORM}), 6) AS loss FROM m",
    "ridge_loss_objective": f"WITH {M} SELECT round(0.5::DOUBLE * ({COST}) + 0.5::DOUBLE * {REG} * ({NORM}), 6) AS loss FROM m",
    "ridge_gradient_full": f"""WITH {M} SELECT 0::INT AS j, round(g11 * 0.5::DOUBLE + g12 * 0.25::DOUBLE - b1 + {REG} * 0.5::DOUBLE, 6) + 0.0 AS g FROM m
UNION ALL SELECT 1, round(g12 * 0.5::DOUBLE + g22 * 0.25::DOUBLE - b2 + {REG} * 0.25::DOUBLE, 6) + 0.0 FROM m""",
    "gd_trajectory": f"""WITH RECURSIVE {M}, r(t, w0, w1) AS (SELECT -1, 0::DOUBLE, 0::DOUBLE UNION ALL
SELECT t + 1, w0 - 0.2::DOUBLE * power(0.9::DOUBLE, (t + 1) // 10) * (g11 * w0 + g12 * w1 - b1 + {REG} * w0), w1 - 0.2::DOUBLE * power(0.9::DOUBLE, (t + 1) // 10) * (g12 * w0 + g22 * w1 - b2 + {REG} * w1) FROM r, m WHERE t < 49)
SELECT t::INT AS t, round(w0, 6) + 0.0 AS w0, round(w1, 6) + 0.0 AS w1 FROM r WHERE t >= 0""",
    "lr_schedule": "SELECT event_id, round(0.5::DOUBLE * power(0.99::DOUBLE, event_id // 1000), 9) + 0.0 AS alpha FROM events",
    "log_sampling": "SELECT event_id, event_type FROM events WHERE event_id % 1000 = 0",
    "block_local_shuffle": f"WITH {_orders()}, b AS ({_block(700, 3, 0, 'o')}) SELECT row_id, block_id, block_id * 700 + r AS position FROM b",
    "external_shuffle": f"""WITH {_orders()}, b AS ({_block(700, 3, 0, 'o')}),
s AS (SELECT row_id, r // greatest(1, 700 // ceil(n.n / 700.0)::BIGINT) AS slice_id FROM b, n)
SELECT row_id, slice_id, row_number() OVER (ORDER BY slice_id, {_key(4, 0)}, row_id) - 1 AS position FROM s""",
    "global_shuffle": f"WITH {_orders()} SELECT row_id, row_number() OVER (ORDER BY {_key(3, 0)}, row_id) - 1 AS position FROM o",
    "sgd_fold": _fold("row_id", 1),
    "sgd_fold_block_shuffled": _fold(BLOCK_ORDER, 1),
    "ssgd_two_epochs": _fold(BLOCK_ORDER, 2),
    "ssgd_stream": _stream(),
    "local_sgd_average": _parts(4),
    "training_log_roundtrip": _log(),
    "ssgd_stream_metrics": _metrics(),
    "kernel_unblocked": f"WITH {E}, {PAIRS} SELECT i, j, round(exp(-d2 / 2.0::DOUBLE), 6) + 0.0 AS k FROM p",
    "matrix_saved": f"WITH {E} SELECT row_id, label, len(v)::INT AS d, round(list_sum([x::FLOAT::DOUBLE FOR x IN v]), 6) + 0.0 AS total FROM e",
    "blocks_saved": f"WITH {E} SELECT row_id // 100 AS block_id, count(*) AS n, max(row_id) AS last_row, round(sum(list_sum(v)), 6) + 0.0 AS total FROM e GROUP BY 1",
    "ridge_closed_hooked": f"""WITH {CUSTOMERS}, m AS (SELECT sum(x * x) / 65025.0::DOUBLE + {REG} AS a, sum(x) / 65025.0::DOUBLE AS b, count(*) / 65025.0::DOUBLE + {REG} AS d, sum(x * y) / 255.0::DOUBLE AS u, sum(y) / 255.0::DOUBLE AS v FROM c)
SELECT 0::INT AS j, round((u * d - v * b) / (a * d - b * b), 6) + 0.0 AS w FROM m UNION ALL SELECT 1::INT, round((v * a - u * b) / (a * d - b * b), 6) + 0.0 FROM m""",
    "zero_model": "SELECT label::INT AS label, 0::INT AS prediction, count(*) AS n FROM embeddings GROUP BY label",
    "gather_rows": """SELECT event_id AS position, c_custkey AS row_id, c_acctbal / 1e4::DOUBLE AS x0, (c_mktsegment = 'BUILDING')::INT AS label
FROM events JOIN customer ON c_custkey = event_id * 7 % (SELECT count(*) FROM customer)""",
    "times_held": f"WITH {E} SELECT row_id, "
    + ", ".join(f"round(list_sum([v[j + 1] * (((3 * j + {c}) % 7) - 3) / 4.0::DOUBLE FOR j IN range(64)]), 6) + 0.0 AS p{c}" for c in range(3))
    + " FROM e",
    "kernel_sgd": f"""WITH RECURSIVE {E}, {PAIRS}, k AS MATERIALIZED (SELECT i AS t, list(exp(-d2 / 2.0::DOUBLE) + CASE WHEN i = j THEN {REG} ELSE 0 END ORDER BY j) AS k FROM p GROUP BY i),
o AS MATERIALIZED (SELECT t, k, (label < 5)::INT::DOUBLE AS y FROM k JOIN e ON e.row_id = k.t),
f(t, w, d) AS (SELECT 0::BIGINT, [0::DOUBLE FOR z IN range((SELECT count(*) FROM e))], [0::DOUBLE FOR z IN range((SELECT count(*) FROM e))]
UNION ALL SELECT t + 1, [z[1] - z[2] FOR z IN list_zip(w, n)], n FROM (SELECT f.t, w, [s * z[1] + 0.5::DOUBLE * z[2] FOR z IN list_zip(k, d)] AS n
  FROM (SELECT f.t, w, d, k, 0.001::DOUBLE * power(0.99::DOUBLE, f.t // 100) * (list_inner_product(k, w) - y) AS s FROM f JOIN o ON o.t = f.t) AS f))
SELECT (u.i - 1)::BIGINT AS i, round(w[u.i], 6) + 0.0 AS alpha FROM f, unnest(range(1, len(w) + 1)) AS u(i) WHERE t = (SELECT count(*) FROM e)""",
    "kernel_sqdist": f"WITH {E}, {PAIRS} SELECT i, j, round(d2, 6) + 0.0 AS k FROM p",
    "kernel_rbf": f"WITH {E}, {PAIRS} SELECT i, j, round(exp(-d2 / 2.0::DOUBLE), 6) + 0.0 AS k FROM p",
    "kernel_linear": f"WITH {E}, {PAIRS} SELECT i, j, round(s, 6) + 0.0 AS k FROM p",
    "lambda_matrix": f"WITH {E}, {PAIRS} SELECT i, j, round(exp(-d2 / 2.0::DOUBLE) + CASE WHEN i = j THEN {REG} ELSE 0 END, 6) + 0.0 AS k FROM p",
    "matmul_coo": f"""WITH {E}, {CELLS}, g AS (SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM x a JOIN x b USING (row_id) GROUP BY 1, 2),
b AS (SELECT i, k.c AS j, sum(CASE WHEN label = k.c THEN v ELSE 0 END) AS v FROM x, range(10) AS k(c) GROUP BY 1, 2)
SELECT g.i::INT AS i, b.j::INT AS j, round(sum(g.v * b.v), 6) + 0.0 AS v FROM g JOIN b ON g.j = b.i GROUP BY 1, 2""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
