"""Check statements of the tree models: DuckDB bins, samples, grows, walks and weighs the trees anew.

Only whole numbers are summed, and every formula on doubles is written in the order in which the
library computes it, so that both engines give the same bits.
"""

from __future__ import annotations

from ...operators.trees import BINS, COPIES, LEAST_GAIN, MIX_A, MIX_B, MIX_C, MIX_D, PRIME
from ...operators.training import MODEL_NAMES, TREE_SIZES
from ...schema import FEATURE_COLUMNS, RISK_LABELS
from .base import over_bank
from .learning import CODES, SPLIT

SIZE = len(FEATURE_COLUMNS)
NAMES = "[" + ", ".join(f"'{c}'" for c in FEATURE_COLUMNS) + "]"


def mixed(x: str, y: str, z: str) -> str:
    a = f"(({x} * {MIX_A} + {y} * {MIX_B} + 1) % {PRIME})"
    b = f"(({a} * {MIX_C} + {z}) % {PRIME})"
    return f"(({b} * {b} + {y} * {MIX_D}) % {PRIME})"


def purity(counts: list[str]) -> str:
    parts = [f"({c} * w{i})" for i, c in enumerate(counts)]
    return f"(({' + '.join(f'{p} * {p}' for p in parts)}) / ({' + '.join(parts)}))"


#: Feature values of all customers, training rows, class weights and bins.
INPUTS = f"""{SPLIT},
fv AS MATERIALIZED (SELECT Customer_ID, [{', '.join(f'CAST({c} AS DOUBLE)' for c in FEATURE_COLUMNS)}] AS v
  FROM (SELECT *, {CODES} FROM bank)),
tr AS MATERIALIZED (SELECT Customer_ID, label, v, CAST('0x' || substr(md5(Customer_ID), 1, 7) AS BIGINT) AS num
  FROM fv JOIN spl USING (Customer_ID) WHERE NOT is_test),
cw AS MATERIALIZED (SELECT {', '.join(
    f'coalesce(count(*)::DOUBLE / nullif(3 * count(*) FILTER (WHERE label = {c}), 0), 0) AS w{c}' for c in range(3))} FROM tr),
vals AS MATERIALIZED (SELECT Customer_ID, unnest(range({SIZE})) AS feature, unnest(v) AS value FROM tr),
bins AS MATERIALIZED (SELECT feature, value, CAST(floor((upto - n) * {BINS} / (SELECT count(*) FROM tr)) AS BIGINT) AS bin FROM (
  SELECT feature, value, n, CAST(sum(n) OVER (PARTITION BY feature ORDER BY value) AS BIGINT) AS upto FROM (
    SELECT feature, value, count(*) AS n FROM vals GROUP BY ALL))),
edges AS MATERIALIZED (SELECT feature, bin, max(value) AS upper FROM bins GROUP BY ALL),
binrow AS MATERIALIZED (SELECT Customer_ID, feature, bin FROM vals JOIN bins USING (feature, value))"""


def grown(kind: str) -> str:
    """CTEs down to ``nodes``: the trees of one kind, grown level by level."""
    size = TREE_SIZES[kind]
    trees, depth, least, take = size["trees"], size["depth"], size["least"], size.get("take")
    times = "1"
    if size.get("sampled"):
        drawn = mixed("num", "tree", "num")
        times = " + ".join(f"({drawn} >= {n})::BIGINT" for n in COPIES)
    out = [INPUTS, f"""
a0 AS MATERIALIZED (SELECT * FROM (SELECT tree, Customer_ID, label, {times} AS times, 1 AS node
  FROM tr, (SELECT unnest(range({trees})) AS tree)) WHERE times > 0)"""]
    for d in range(depth):
        looked = f"(SELECT DISTINCT tree, node FROM a{d})"
        if take:
            looked = f"""(SELECT tree, node, feature FROM (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY h, feature) AS rk
              FROM (SELECT tree, node, feature, {mixed('tree', 'node', f'(feature * {MIX_D})')} AS h
                FROM {looked}, (SELECT unnest(range({SIZE})) AS feature))) WHERE rk <= {take})"""
        else:
            looked = f"(SELECT tree, node, feature FROM {looked}, (SELECT unnest(range({SIZE})) AS feature))"
        right = [f"(t{c} - l{c})" for c in range(3)]
        gain = f"(({purity([f'l{c}' for c in range(3)])} + {purity(right)}) - {purity([f't{c}' for c in range(3)])})"
        out.append(f"""
h{d} AS MATERIALIZED (SELECT tree, node, feature, bin, {', '.join(
    f'CAST(coalesce(sum(times) FILTER (WHERE label = {c}), 0) AS BIGINT) AS s{c}' for c in range(3))}
  FROM a{d} JOIN {looked} USING (tree, node) JOIN binrow USING (Customer_ID, feature) GROUP BY ALL),
c{d} AS (SELECT tree, node, feature, bin, {', '.join(
    f'CAST(sum(s{c}) OVER (PARTITION BY tree, node, feature ORDER BY bin) AS BIGINT) AS l{c}, '
    f'CAST(sum(s{c}) OVER (PARTITION BY tree, node, feature) AS BIGINT) AS t{c}' for c in range(3))} FROM h{d}),
g{d} AS (SELECT c{d}.*, {gain} AS gain FROM c{d}, cw WHERE l0 + l1 + l2 >= {least} AND {' + '.join(right)} >= {least}),
b{d} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY gain DESC, feature, bin) AS rk FROM g{d})
  WHERE rk = 1 AND gain > {LEAST_GAIN!r}),
a{d + 1} AS MATERIALIZED (SELECT a.tree, a.Customer_ID, label, times, 2 * a.node + (r.bin > b.bin)::INT AS node
  FROM a{d} a JOIN b{d} b ON a.tree = b.tree AND a.node = b.node
  JOIN binrow r ON r.Customer_ID = a.Customer_ID AND r.feature = b.feature)""")
    splits = " UNION ALL ".join(f"SELECT tree, node, feature, bin, gain, {', '.join(f'l{c}, t{c}' for c in range(3))} FROM b{d}"
                                for d in range(depth))
    counts = lambda v: ", ".join(v.format(c=c) for c in range(3))
    out.append(f"""
splits AS MATERIALIZED ({splits}),
every AS (SELECT tree, 1 AS node, {counts('CAST(coalesce(sum(times) FILTER (WHERE label = {c}), 0) AS BIGINT) AS n{c}')} FROM a0 GROUP BY tree
  UNION ALL SELECT tree, 2 * node, {counts('l{c}')} FROM splits UNION ALL SELECT tree, 2 * node + 1, {counts('t{c} - l{c}')} FROM splits),
nodes AS MATERIALIZED (SELECT e.tree, e.node, s.feature, x.upper AS threshold, s.gain, {counts('e.n{c}')}
  FROM every e LEFT JOIN splits s ON s.tree = e.tree AND s.node = e.node
  LEFT JOIN edges x ON x.feature = s.feature AND x.bin = s.bin)""")
    return ",".join(out)


def scored(kind: str, rows: str) -> str:
    """CTEs down to ``sco``: prediction and probabilities of ``rows`` (Customer_ID, v) by the nodes."""
    size = TREE_SIZES[kind]
    out = [f"""
k0 AS MATERIALIZED (SELECT Customer_ID, v, tree, 1 AS node FROM ({rows}), (SELECT unnest(range({size['trees']})) AS tree))"""]
    for d in range(size["depth"]):
        out.append(f"""
k{d + 1} AS MATERIALIZED (SELECT Customer_ID, v, k.tree, CASE WHEN n.feature IS NULL THEN k.node
  ELSE 2 * k.node + (v[n.feature + 1] > n.threshold)::INT END AS node
  FROM k{d} k LEFT JOIN (SELECT * FROM nodes WHERE feature IS NOT NULL) n ON n.tree = k.tree AND n.node = k.node)""")
    total = " + ".join(f"(n{c} * w{c})" for c in range(3))
    share = lambda c: f"CAST(round(((n{c} * w{c}) / ({total})) * 1e12) AS BIGINT)"
    scale = f"(1e12 * {size['trees']})"
    out.append(f"""
sco AS MATERIALIZED (SELECT Customer_ID, CAST(CASE WHEN q0 = greatest(q0, q1, q2) THEN 0 WHEN q1 = greatest(q1, q2) THEN 1 ELSE 2 END AS INTEGER)
    AS prediction, {', '.join(f'q{c} / {scale} AS p_{v.lower()}' for c, v in enumerate(RISK_LABELS))}
  FROM (SELECT Customer_ID, {', '.join(f'CAST(sum({share(c)}) AS BIGINT) AS q{c}' for c in range(3))}
    FROM k{size['depth']} k JOIN nodes n ON n.tree = k.tree AND n.node = k.node, cw GROUP BY Customer_ID))""")
    return ",".join(out)


IMPORTANCE = f"""
gain1 AS (SELECT tree, feature, CAST(sum(CAST(round(gain * 1e6) AS BIGINT)) AS BIGINT) AS g FROM nodes WHERE feature IS NOT NULL GROUP BY ALL),
gain2 AS (SELECT feature, CAST(sum(CAST(round(g / al * 1e12) AS BIGINT)) AS BIGINT) AS s
  FROM gain1 JOIN (SELECT tree, CAST(sum(g) AS BIGINT) AS al FROM gain1 GROUP BY tree) USING (tree) GROUP BY feature),
imp AS (SELECT position, name AS feature, coalesce(s, 0) / (SELECT CAST(sum(s) AS BIGINT) FROM gain2) AS importance
  FROM (SELECT unnest(range({SIZE})) AS position, unnest({NAMES}) AS name) LEFT JOIN gain2 ON gain2.feature = position)"""


def statements() -> dict[str, str]:
    """The best model of the given tables is the forest; were it another, these would not match."""
    tested = """SELECT Customer_ID, CAST(label AS INTEGER) AS label, prediction, p_low, p_medium, p_high
        FROM sco JOIN spl USING (Customer_ID)"""
    test_rows = "SELECT Customer_ID, v FROM fv JOIN spl USING (Customer_ID) WHERE is_test"
    applicant = {"Credit_Card_Usage": "1", "Debit_Card_Usage": "1", "Days_Since_Transaction": "7",
                 "Support_Calls": "Complaints + 1",
                 "Average_Transaction_Value": "floor(Transaction_Amount / greatest(Transaction_Count, 1))",
                 "Debt_to_Income_Ratio": "dti"}
    values = ", ".join(f"CAST({applicant.get(c, c)} AS DOUBLE)" for c in FEATURE_COLUMNS)
    forest = grown("forest")
    best = MODEL_NAMES["forest"]
    size = TREE_SIZES["forest"]
    return {
        "train_decision_tree": over_bank(tested, grown("tree") + "," + scored("tree", test_rows)),
        "train_random_forest": over_bank(tested, forest + "," + scored("forest", test_rows)),
        "predict_risk": over_bank("SELECT * FROM sco", forest + "," + scored("forest", "SELECT * FROM fv")),
        "feature_importance": over_bank("SELECT feature, importance FROM imp", forest + "," + IMPORTANCE),
        "feature_importance_top20": over_bank(
            "SELECT feature, importance FROM imp ORDER BY importance DESC, position LIMIT 20", forest + "," + IMPORTANCE),
        "feature_importance_top10": over_bank(
            "SELECT feature, importance FROM imp ORDER BY importance DESC, position LIMIT 10", forest + "," + IMPORTANCE),
        "save_risk_model": over_bank(f"""SELECT '{best}' AS best_name, 'Trees' AS kind, {size['trees']} AS trees,
            {size['depth']} AS depth, CAST({SIZE} AS BIGINT) AS features, count(*) AS nodes, count(feature) AS splits,
            CAST(sum(n0 + n1 + n2) FILTER (WHERE node = 1) AS BIGINT) AS sampled FROM nodes""", forest),
        "load_risk_model": over_bank(f"""SELECT CAST(tree AS INTEGER) AS tree, CAST(node AS INTEGER) AS node,
            {NAMES}[feature + 1] AS feature, threshold, n0, n1, n2 FROM nodes""", forest),
        "score_applicants": over_bank(APPLICANTS, forest + f""",
            app AS (SELECT Customer_ID, dti, [{values}] AS v FROM (SELECT * EXCLUDE (Debt_to_Income_Ratio), {CODES},
              {RATIO} AS dti FROM bank)),""" + scored("forest", "SELECT Customer_ID, v FROM app")),
        "logistic_gradient": over_bank(f"""SELECT CAST(class AS INTEGER) AS class, feature, 0.0::DOUBLE AS gradient
            FROM (SELECT DISTINCT label AS class FROM spl WHERE NOT is_test),
            (SELECT unnest(list_append({NAMES}, 'constant')) AS feature)""", SPLIT),
    }


def _rounded(expr: str, digits: int) -> str:
    from .base import rnd

    return rnd(expr, digits)


RATIO = f"CASE WHEN EMI > 0 THEN {_rounded('EMI / greatest(Monthly_Income, 1.0::DOUBLE)', 3)} ELSE 0.0::DOUBLE END"
APPLICANTS = f"""SELECT Customer_ID, dti AS Debt_to_Income_Ratio,
    ['LOW RISK', 'MEDIUM RISK', 'HIGH RISK'][prediction + 1] AS Risk_Category,
    {_rounded('[p_low, p_medium, p_high][prediction + 1] * 100', 1)} AS Risk_Probability_Pct,
    {', '.join(f"{_rounded(f'p_{v.lower()} * 100', 2)} AS {v}_Risk_Pct" for v in RISK_LABELS)}
    FROM sco JOIN app USING (Customer_ID)"""
