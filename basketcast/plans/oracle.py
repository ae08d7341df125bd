"""DuckDB SQL for each registered query, written independently of the Spark code.

Tables ``lineitem orders part`` are views; everything else is built here. Item sets
are brute-forced (every 1..4-subset of every basket, then thresholded), which
equals the level-wise result because support is anti-monotone.
"""

from __future__ import annotations

from basketcast.operators import features as ft
from basketcast.operators import validate as v
from basketcast.plans import fixed_model, series_sql


def _expand_r6(sql: str) -> str:
    """``r6(x, 6)`` -> ``round((x) + 1e-10, 6)``: the same tie-robust rounding the Spark side uses."""
    out, i = [], 0
    while True:
        j = sql.find("r6(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        depth, k, comma = 0, j + 3, -1
        while True:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                if depth == 0:
                    break
                depth -= 1
            elif ch == "," and depth == 0:
                comma = k
            k += 1
        inner = _expand_r6(sql[j + 3:comma])
        out.append(f"round(({inner}) + 1e-10, {sql[comma + 1:k].strip()})")
        i = k + 1


def tx(product: str = "p_brand") -> str:
    return f"""transactions AS (
  SELECT CAST(l.l_orderkey AS VARCHAR) AS TransactionID, CAST(o.o_orderdate AS DATE) AS Date,
         pt.{product} AS ProductID, l.l_quantity AS Quantity, pt.p_retailprice AS Price
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part pt ON l.l_partkey = pt.p_partkey)"""


LINES = """lines AS MATERIALIZED (
  SELECT TransactionID, ProductID, SUM(Quantity) AS Quantity FROM transactions
  GROUP BY TransactionID, ProductID HAVING SUM(Quantity) > 0)"""

DAILY = """daily AS (SELECT Date, ProductID, SUM(Quantity) AS Quantity FROM transactions GROUP BY Date, ProductID)"""

FORECAST = """fc AS (
  SELECT g.Date, g.ProductID, COALESCE(w.m, g.m) AS Predicted_Quantity
  FROM (SELECT CAST(m.d + CAST(r.k AS INTEGER) AS DATE) AS Date, a.ProductID, a.m
        FROM (SELECT ProductID, AVG(Quantity) AS m FROM daily GROUP BY ProductID) a,
             (SELECT MAX(Date) AS d FROM daily) m, range(1, 31) r(k)) g
  LEFT JOIN (SELECT ProductID, isodow(Date) AS dow, AVG(Quantity) AS m FROM daily GROUP BY 1, 2) w
    ON w.ProductID = g.ProductID AND w.dow = isodow(g.Date))"""


def itemsets(min_support: float) -> str:
    return f"""nb AS (SELECT COUNT(DISTINCT TransactionID) AS n FROM lines),
bl AS (SELECT DISTINCT TransactionID AS t, ProductID AS i FROM lines),
c1 AS (SELECT [i] AS items, COUNT(*) AS freq FROM bl GROUP BY i),
c2 AS (SELECT [a.i, b.i] AS items, COUNT(*) AS freq FROM bl a JOIN bl b ON a.t = b.t AND a.i < b.i
       GROUP BY a.i, b.i),
c3 AS (SELECT [a.i, b.i, c.i] AS items, COUNT(*) AS freq FROM bl a
       JOIN bl b ON a.t = b.t AND a.i < b.i JOIN bl c ON b.t = c.t AND b.i < c.i
       GROUP BY a.i, b.i, c.i),
c4 AS (SELECT [a.i, b.i, c.i, d.i] AS items, COUNT(*) AS freq FROM bl a
       JOIN bl b ON a.t = b.t AND a.i < b.i JOIN bl c ON b.t = c.t AND b.i < c.i
       JOIN bl d ON c.t = d.t AND c.i < d.i
       GROUP BY a.i, b.i, c.i, d.i),
itemsets AS MATERIALIZED (
  SELECT items, CAST(len(items) AS INTEGER) AS size, freq, freq / n AS support,
         array_to_string(items, ', ') AS itemsets_str
  FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3 UNION ALL SELECT * FROM c4) u, nb
  WHERE freq / n >= CAST({min_support} AS DOUBLE))"""


def _splits() -> str:
    """``(size, left positions, right positions)`` of every split of a set of 2 to 4 items."""
    rows = []
    for size in (2, 3, 4):
        for mask in range(1, (1 << size) - 1):
            left = [i + 1 for i in range(size) if mask >> i & 1]
            right = [i + 1 for i in range(size) if not mask >> i & 1]
            rows.append(f"({size}, {left}, {right})")
    return ", ".join(rows)


def rules(min_confidence: float, min_lift: float) -> str:
    return f"""splits(size, l, r) AS (VALUES {_splits()}),
sides AS MATERIALIZED (
  SELECT list_select(i.items, p.l) AS ant, list_select(i.items, p.r) AS con, i.support,
         array_to_string(list_select(i.items, p.l), ', ') AS ant_str,
         array_to_string(list_select(i.items, p.r), ', ') AS con_str
  FROM itemsets i JOIN splits p ON p.size = i.size),
r0 AS (
  SELECT s.ant, s.con, a.support AS a, c.support AS c, s.support AS s
  FROM sides s JOIN itemsets a ON a.itemsets_str = s.ant_str JOIN itemsets c ON c.itemsets_str = s.con_str),
rules AS MATERIALIZED (
  SELECT ant AS antecedents, con AS consequents, a AS antecedent_support, c AS consequent_support, s AS support,
         s / a AS confidence, (s / a) / c AS lift, s - a * c AS leverage,
         CASE WHEN s / a >= 1 THEN CAST('Infinity' AS DOUBLE) ELSE (1 - c) / (1 - s / a) END AS conviction,
         CASE WHEN greatest(s * (1 - a), a * (c - s)) = 0 THEN 0.0
              ELSE (s - a * c) / greatest(s * (1 - a), a * (c - s)) END AS zhangs_metric,
         s / (a + c - s) AS jaccard,
         CASE WHEN 1 - c = 0 THEN 0.0 ELSE ((s / a) - c) / (1 - c) END AS certainty,
         ((s / a) + (s / c)) / 2 AS kulczynski,
         array_to_string(ant, ', ') AS antecedents_str, array_to_string(con, ', ') AS consequents_str
  FROM r0
  WHERE s / a >= CAST({min_confidence} AS DOUBLE) AND (s / a) / c >= CAST({min_lift} AS DOUBLE))"""


ORDER_LIFT = "lift DESC, confidence DESC, support DESC, antecedents_str, consequents_str"
ORDER_CONF = "confidence DESC, lift DESC, support DESC, antecedents_str, consequents_str"
RULE_COLS = "antecedents_str, consequents_str, support, confidence, lift"
METRIC_COLS = ("antecedents_str, consequents_str, antecedent_support, consequent_support, support, confidence, "
               "lift, leverage, conviction, zhangs_metric, jaccard, certainty, kulczynski")


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def brand_rules() -> list[str]:
    return [tx("p_brand"), LINES, itemsets(0.01), rules(0.1, 1.0)]


def type_rules() -> list[str]:
    return [tx("p_type"), LINES, itemsets(0.01), rules(0.1, 1.0)]


PARTNERS = """partners AS (
  SELECT p AS ProductID, unnest(consequents) AS partner, lift, confidence, support, antecedents_str, consequents_str
  FROM (SELECT unnest(antecedents) AS p, consequents, lift, confidence, support, antecedents_str, consequents_str
        FROM rules) x
  UNION ALL
  SELECT p AS ProductID, unnest(antecedents) AS partner, lift, confidence, support, antecedents_str, consequents_str
  FROM (SELECT unnest(consequents) AS p, antecedents, lift, confidence, support, antecedents_str, consequents_str
        FROM rules) y)"""

ASSOC = """assoc AS (
  SELECT ProductID, partner AS AssociatedProductID,
         CAST(row_number() OVER (PARTITION BY ProductID ORDER BY max_lift DESC, partner) AS INTEGER) AS rank, max_lift
  FROM (SELECT ProductID, partner, MAX(lift) AS max_lift FROM partners GROUP BY ProductID, partner) g)"""

FEATURES = """feat AS (
  SELECT Date, ProductID, Quantity,
    CAST(year(Date) AS INTEGER) AS Year, CAST(month(Date) AS INTEGER) AS Month,
    CAST(day(Date) AS INTEGER) AS Day, CAST(isodow(Date) - 1 AS INTEGER) AS DayOfWeek,
    CAST(quarter(Date) AS INTEGER) AS Quarter, CAST(weekofyear(Date) AS INTEGER) AS WeekOfYear,
    CAST(isodow(Date) >= 6 AS INTEGER) AS IsWeekend, CAST(day(Date) = 1 AS INTEGER) AS IsMonthStart,
    CAST(Date = last_day(Date) AS INTEGER) AS IsMonthEnd,
    COALESCE(lag(Quantity, 1) OVER w, 0.0) AS Quantity_Lag1,
    COALESCE(lag(Quantity, 7) OVER w, 0.0) AS Quantity_Lag7,
    COALESCE(lag(Quantity, 14) OVER w, 0.0) AS Quantity_Lag14,
    COALESCE(lag(Quantity, 30) OVER w, 0.0) AS Quantity_Lag30,
    COALESCE(avg(Quantity) OVER (PARTITION BY ProductID ORDER BY Date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0.0)
      AS Quantity_RollingMean7,
    COALESCE(avg(Quantity) OVER (PARTITION BY ProductID ORDER BY Date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 0.0)
      AS Quantity_RollingMean14,
    COALESCE(avg(Quantity) OVER (PARTITION BY ProductID ORDER BY Date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 0.0)
      AS Quantity_RollingMean30,
    COALESCE(stddev_samp(Quantity) OVER (PARTITION BY ProductID ORDER BY Date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
      0.0) AS Quantity_RollingStd7
  FROM daily WINDOW w AS (PARTITION BY ProductID ORDER BY Date))"""

ASSOC_FEATURE = """rp AS (
  SELECT a AS antecedent, unnest(consequents) AS consequent, confidence
  FROM (SELECT unnest(antecedents) AS a, consequents, confidence FROM rules) x),
hits AS (
  SELECT rp.antecedent AS ProductID, d.Date, SUM(d.Quantity * rp.confidence) AS s, COUNT(*) AS n
  FROM rp JOIN daily d ON d.ProductID = rp.consequent GROUP BY rp.antecedent, d.Date),
af AS (
  SELECT f.*, COALESCE(h.s / h.n, 0.0) AS AssociatedProductSales
  FROM feat f LEFT JOIN hits h ON h.ProductID = f.ProductID AND h.Date = f.Date)"""

SPLIT = """frame AS (SELECT * FROM feat),
split AS (
  SELECT f.*, row_number() OVER (ORDER BY Date, ProductID) <= (SELECT CAST(floor(CAST(COUNT(*) AS DOUBLE) * CAST(0.8 AS DOUBLE)) AS BIGINT) FROM frame)
         AS is_train
  FROM frame f)"""

# The newest lag state of every product, and the days to forecast.
STATE_COLUMNS = """
         MAX(CASE WHEN rn = 1 THEN Quantity END) AS Quantity_Lag1,
         COALESCE(MAX(CASE WHEN rn = 7 THEN Quantity END), MAX(CASE WHEN rn = 1 THEN Quantity END)) AS Quantity_Lag7,
         COALESCE(MAX(CASE WHEN rn = 14 THEN Quantity END), MAX(CASE WHEN rn = 1 THEN Quantity END)) AS Quantity_Lag14,
         COALESCE(MAX(CASE WHEN rn = 30 THEN Quantity END), MAX(CASE WHEN rn = 1 THEN Quantity END)) AS Quantity_Lag30,
         AVG(CASE WHEN rn <= 7 THEN Quantity END) AS Quantity_RollingMean7,
         AVG(CASE WHEN rn <= 14 THEN Quantity END) AS Quantity_RollingMean14,
         AVG(Quantity) AS Quantity_RollingMean30,
         COALESCE(stddev_samp(CASE WHEN rn <= 7 THEN Quantity END), 0.0) AS Quantity_RollingStd7"""
SCORING = f"""scoring AS (
  SELECT g.Date, CAST(year(g.Date) AS INTEGER) AS Year, CAST(month(g.Date) AS INTEGER) AS Month, CAST(day(g.Date) AS INTEGER) AS Day,
         CAST(isodow(g.Date) - 1 AS INTEGER) AS DayOfWeek, CAST(quarter(g.Date) AS INTEGER) AS Quarter,
         CAST(weekofyear(g.Date) AS INTEGER) AS WeekOfYear, CAST(isodow(g.Date) >= 6 AS INTEGER) AS IsWeekend,
         CAST(day(g.Date) = 1 AS INTEGER) AS IsMonthStart, CAST(g.Date = last_day(g.Date) AS INTEGER) AS IsMonthEnd, s.*
  FROM (SELECT ProductID, {STATE_COLUMNS}
        FROM (SELECT *, row_number() OVER (PARTITION BY ProductID ORDER BY Date DESC) AS rn FROM daily) r WHERE rn <= 30 GROUP BY ProductID) s,
       (SELECT CAST(m.d + CAST(r.k AS INTEGER) AS DATE) AS Date FROM (SELECT MAX(Date) AS d FROM daily) m, range(1, 31) r(k)) g)"""


def _value(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else repr(x)


def walked(rows: str) -> str:
    """The written model's nodes, and every node that each row of ``rows`` comes to, tree by tree."""
    nodes = ",\n    ".join("(" + ", ".join(map(_value, r)) + ")" for r in fixed_model.NODES)
    feature = " ".join(f"WHEN '{f}' THEN CAST(r.{f} AS DOUBLE)" for f in [*ft.TIME_FEATURES, *ft.LAG_FEATURES])
    return f"""nodes(tree, node, feature, cut, yes, no, value, gain) AS (VALUES
    {nodes}),
rows_ AS (SELECT row_number() OVER () AS row_no, x.* FROM {rows} x),
walk AS (
  SELECT row_no, tree, 0 AS node FROM rows_, (SELECT DISTINCT tree FROM nodes WHERE tree >= 0) t
  UNION ALL
  SELECT w.row_no, w.tree, CASE WHEN CASE n.feature {feature} END < CAST(n.cut AS DOUBLE) THEN n.yes ELSE n.no END
  FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node JOIN rows_ r ON r.row_no = w.row_no
  WHERE n.feature IS NOT NULL),
scored AS (
  SELECT r.*, p.prediction FROM rows_ r JOIN (
    SELECT w.row_no, SUM(CAST(n.value AS DOUBLE)) + (SELECT CAST(value AS DOUBLE) FROM nodes WHERE tree = -1) AS prediction
    FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE n.value IS NOT NULL GROUP BY w.row_no) p ON p.row_no = r.row_no)"""


STATS = """st AS (
  SELECT ProductID, AVG(Quantity) AS mean, stddev_samp(Quantity) AS std FROM transactions GROUP BY ProductID),
ss AS (
  SELECT ProductID, mean, std,
         CAST(ceil(CASE WHEN std IS NULL OR std = 0 THEN mean * 0.2 ELSE std * 1.645 * sqrt(7) END) AS BIGINT)
           AS safety_stock
  FROM st),
ltd AS (
  SELECT ProductID, SUM(Predicted_Quantity) AS lead_time_demand FROM fc
  WHERE Date >= (SELECT MAX(Date) + 1 FROM transactions) AND Date <= (SELECT MAX(Date) + 8 FROM transactions)
  GROUP BY ProductID),
rop AS (
  SELECT ss.ProductID, mean, std, safety_stock, COALESCE(lead_time_demand, mean * 7.0) AS lead_time_demand,
         CAST(ceil(COALESCE(lead_time_demand, mean * 7.0) + safety_stock) AS BIGINT) AS reorder_point
  FROM ss LEFT JOIN ltd ON ltd.ProductID = ss.ProductID),
eoq AS (
  SELECT ProductID, annual_demand, Price,
         CASE WHEN Price * 0.25 > 0 AND annual_demand >= 0
              THEN CAST(ceil(sqrt((2.0 * annual_demand * 25.0) / (Price * 0.25))) AS BIGINT) END AS eoq
  FROM (SELECT ProductID, SUM(Quantity) * (CAST(365 AS DOUBLE) / (SELECT greatest(MAX(Date) - MIN(Date), 1) FROM transactions))
               AS annual_demand, AVG(Price) AS Price
        FROM transactions GROUP BY ProductID) p),
recs AS (
  SELECT rop.ProductID, mean AS avg_daily_demand, std AS demand_std_dev, safety_stock, lead_time_demand,
         reorder_point, CAST(COALESCE(eoq.eoq, reorder_point * 2) AS BIGINT) AS eoq,
         CASE WHEN mean <> 0 THEN CAST(ceil(COALESCE(eoq.eoq, reorder_point * 2) / mean) AS BIGINT) END
           AS days_of_supply
  FROM rop LEFT JOIN eoq ON eoq.ProductID = rop.ProductID)"""


def bundle_stock(where: str) -> str:
    return f"""bundles AS (
  SELECT antecedents_str, consequents_str, list_sort(list_concat(antecedents, consequents)) AS items, confidence, lift
  FROM rules WHERE {where}),
per AS (
  SELECT ProductID, SUM(Quantity) AS total, AVG(Price) AS price, MIN(Date) AS first_d, MAX(Date) AS last_d
  FROM transactions GROUP BY ProductID),
mem AS (
  SELECT b.antecedents_str, b.consequents_str, b.items, b.confidence, b.lift, unnest(b.items) AS ProductID
  FROM bundles b WHERE len(b.items) >= 2),
j AS (
  SELECT m.*, r.safety_stock, r.reorder_point, r.mean, p.total, p.price, p.first_d, p.last_d
  FROM mem m JOIN rop r ON r.ProductID = m.ProductID JOIN per p ON p.ProductID = m.ProductID),
span AS (
  SELECT antecedents_str, consequents_str, greatest(MAX(last_d) - MIN(first_d), 1) AS days
  FROM j GROUP BY antecedents_str, consequents_str),
j2 AS (
  SELECT j.*, COALESCE(
      CASE WHEN j.price * 0.25 > 0 AND j.total * (CAST(365 AS DOUBLE) / s.days) >= 0
           THEN CAST(ceil(sqrt((2.0 * (j.total * (CAST(365 AS DOUBLE) / s.days)) * 25.0) / (j.price * 0.25))) AS BIGINT) END,
      j.reorder_point * 2) AS e
  FROM j JOIN span s ON s.antecedents_str = j.antecedents_str AND s.consequents_str = j.consequents_str),
bstock AS (
  SELECT array_to_string(items, '-') AS bundle_id, array_to_string(items, ', ') AS products,
         antecedents_str, consequents_str,
         CAST(round_even(AVG(safety_stock), 0) AS BIGINT) AS avg_safety_stock,
         CAST(round_even(AVG(reorder_point), 0) AS BIGINT) AS avg_reorder_point,
         MIN(CASE WHEN mean <> 0 THEN CAST(ceil(e / mean) AS BIGINT) END) AS min_days_supply,
         CAST(round_even((AVG(reorder_point) * confidence) * (1.0 + 0.1 * (lift - 1)), 0) AS BIGINT)
           AS suggested_bundle_stock
  FROM j2 GROUP BY antecedents_str, consequents_str, items, confidence, lift)"""


def _sql(b: list[str]) -> dict[str, str]:
    """All SQL; ``b`` are the CTEs of the rules (the product is theirs)."""
    t = type_rules()
    q: dict[str, str] = {}
    q["clean_transactions"] = with_(tx()) + "SELECT TransactionID, Date, ProductID, Quantity, Price FROM transactions"
    q["synth_txn_id"] = """
SELECT strftime(Date, '%Y%m%d') || '_' || CAST(row_number() OVER (PARTITION BY Date ORDER BY k1, k2, ProductID, Quantity) - 1 AS VARCHAR)
         AS TransactionID, Date, ProductID, Quantity, k1, k2
FROM (SELECT CAST(o.o_orderdate AS DATE) AS Date, pt.p_brand AS ProductID, l.l_quantity AS Quantity,
             l.l_orderkey AS k1, l.l_linenumber AS k2
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part pt ON l.l_partkey = pt.p_partkey) s"""
    q["validation_profile"] = with_(tx()) + f"""
SELECT n_rows, n_products, n_transactions, min_date, max_date, date_span_days, n_nonpositive,
       NOT (n_rows < 10 OR n_products < 2 OR n_transactions < 5 OR COALESCE(date_span_days, 0) < 7) AS is_valid,
       CASE WHEN n_rows < 10 THEN '{v.MSG_ROWS}' WHEN n_products < 2 THEN '{v.MSG_PRODUCTS}'
            WHEN n_transactions < 5 THEN '{v.MSG_TXNS}' WHEN COALESCE(date_span_days, 0) < 7 THEN '{v.MSG_SPAN}'
            WHEN n_nonpositive > 0 THEN '{v.MSG_WARN}' ELSE '{v.MSG_OK}' END AS message
FROM (SELECT COUNT(*) AS n_rows, COUNT(DISTINCT ProductID) AS n_products,
             COUNT(DISTINCT TransactionID) AS n_transactions, MIN(Date) AS min_date, MAX(Date) AS max_date,
             CAST(MAX(Date) - MIN(Date) AS INTEGER) AS date_span_days,
             COUNT(*) FILTER (WHERE Quantity <= 0) AS n_nonpositive
      FROM transactions) p"""
    q["basket_lines"] = with_(tx(), LINES) + "SELECT TransactionID, ProductID, Quantity FROM lines"
    q["product_list"] = with_(tx()) + "SELECT DISTINCT ProductID FROM transactions"
    q["dataset_stats"] = with_(tx()) + """
SELECT COUNT(DISTINCT TransactionID) AS n_transactions, COUNT(DISTINCT ProductID) AS n_products,
       MIN(Date) AS min_date, MAX(Date) AS max_date, COUNT(*) AS n_rows, 5 AS n_columns FROM transactions"""
    q["preview"] = with_(tx()) + """
SELECT TransactionID, Date, ProductID, Quantity FROM transactions
ORDER BY TransactionID, ProductID, Date, Quantity LIMIT 10"""
    q["baskets"] = with_(tx(), LINES) + "SELECT DISTINCT TransactionID, ProductID FROM lines"
    q["frequent_itemsets"] = with_(tx("p_type"), LINES, itemsets(0.01)) + \
        "SELECT itemsets_str, size, freq, support FROM itemsets"
    q["frequent_itemsets_brand"] = with_(tx("p_brand"), LINES, itemsets(0.01)) + \
        "SELECT itemsets_str, size, freq, support FROM itemsets"
    q["association_rules"] = with_(*t) + f"SELECT {RULE_COLS} FROM rules"
    q["rule_metrics"] = with_(*t) + f"SELECT {METRIC_COLS} FROM rules"
    q["association_rules_brand"] = with_(*b) + f"SELECT {METRIC_COLS} FROM rules"
    q["top_associations"] = with_(*b) + f"""
SELECT ProductID, rank, {RULE_COLS} FROM (
  SELECT p AS ProductID, r.*, CAST(row_number() OVER (PARTITION BY p ORDER BY {ORDER_LIFT}) AS INTEGER) AS rank
  FROM (SELECT unnest(antecedents) AS p, * FROM rules) r) x WHERE rank <= 5"""
    q["product_bundles"] = with_(*b) + """
SELECT antecedents_str, consequents_str, array_to_string(list_sort(list_concat(antecedents, consequents)), ', ')
         AS items_str, confidence, lift
FROM rules WHERE confidence >= CAST(0.12 AS DOUBLE) AND lift >= CAST(1.02 AS DOUBLE)"""
    q["cross_sell"] = with_(*b) + f"""
SELECT DISTINCT ProductID, {RULE_COLS} FROM (
  SELECT unnest(antecedents) AS ProductID, * FROM rules
  UNION ALL SELECT unnest(consequents) AS ProductID, * FROM rules) u"""
    q["all_rule_bundles"] = with_(*b) + """
SELECT antecedents_str, consequents_str, array_to_string(list_sort(list_concat(antecedents, consequents)), ', ')
         AS items_str, CAST(len(antecedents) + len(consequents) AS INTEGER) AS n_items, confidence, lift
FROM rules"""
    q["associated_products"] = with_(*b, PARTNERS, ASSOC) + \
        "SELECT ProductID, AssociatedProductID, rank, max_lift FROM assoc WHERE rank <= 5"
    q["associated_forecast"] = with_(*b, DAILY, FORECAST, PARTNERS, ASSOC) + f"""
SELECT a.ProductID, a.AssociatedProductID, a.rank, r6(f.avg_predicted_demand, 6) AS avg_predicted_demand,
       l.lift, l.confidence
FROM assoc a
JOIN (SELECT ProductID, AVG(Predicted_Quantity) AS avg_predicted_demand FROM fc GROUP BY ProductID) f
  ON f.ProductID = a.AssociatedProductID
JOIN (SELECT ProductID, partner, lift, confidence FROM (
        SELECT *, row_number() OVER (PARTITION BY ProductID, partner ORDER BY {ORDER_LIFT}) AS r FROM partners) z
      WHERE r = 1) l ON l.ProductID = a.ProductID AND l.partner = a.AssociatedProductID
WHERE a.rank <= 3"""
    q["daily_sales"] = with_(tx(), DAILY) + "SELECT Date, ProductID, Quantity FROM daily"
    q["sales_trend_day"] = with_(tx()) + \
        "SELECT Date, ProductID, SUM(Quantity) AS Quantity FROM transactions GROUP BY Date, ProductID"
    for period in ("week", "month"):
        q[f"sales_trend_{period}"] = with_(tx()) + f"""
SELECT CAST(date_trunc('{period}', Date) AS DATE) AS Date, ProductID, SUM(Quantity) AS Quantity
FROM transactions GROUP BY 1, 2"""
    q["sales_trend_stats"] = with_(tx()) + """
SELECT ProductID, round_even(AVG(Quantity), 2) AS Mean, round_even(median(Quantity), 2) AS Median,
       MIN(Quantity) AS Min, MAX(Quantity) AS Max, SUM(Quantity) AS Total
FROM (SELECT CAST(date_trunc('week', Date) AS DATE) AS Date, ProductID, SUM(Quantity) AS Quantity
      FROM transactions GROUP BY 1, 2) w GROUP BY ProductID"""
    q["top_products"] = with_(tx()) + """
SELECT ProductID, SUM(Quantity) AS total_quantity FROM transactions GROUP BY ProductID
ORDER BY total_quantity DESC, ProductID LIMIT 15"""
    q["associated_sales_comparison"] = with_(*b, DAILY, PARTNERS, ASSOC) + """
SELECT m.SelectedProduct, m.ProductID, d.Date, d.Quantity
FROM (SELECT ProductID AS SelectedProduct, AssociatedProductID AS ProductID FROM assoc WHERE rank <= 2
      UNION ALL
      SELECT DISTINCT ProductID, ProductID FROM assoc WHERE rank <= 2) m
JOIN daily d ON d.ProductID = m.ProductID"""
    q["forecast_summary"] = with_(tx(), DAILY, FORECAST) + """
SELECT ProductID, r6(SUM(Predicted_Quantity), 6) AS total, r6(AVG(Predicted_Quantity), 6) AS average,
       r6(MIN(Predicted_Quantity), 6) AS min, r6(MAX(Predicted_Quantity), 6) AS max
FROM fc GROUP BY ProductID"""
    q["rule_item_frequency"] = with_(*b) + f"""
SELECT ProductID, COUNT(*) AS frequency FROM (
  SELECT unnest(list_concat(antecedents, consequents)) AS ProductID FROM (
    SELECT * FROM rules ORDER BY {ORDER_LIFT} LIMIT 20) t) x
GROUP BY ProductID ORDER BY frequency DESC, ProductID LIMIT 15"""
    q["demand_stats"] = with_(tx()) + """
SELECT ProductID, r6(AVG(Quantity), 6) AS mean, r6(stddev_samp(Quantity), 6) AS std,
       MAX(Quantity) AS max, MIN(Quantity) AS min
FROM transactions GROUP BY ProductID"""
    feat = [tx(), DAILY, FEATURES]
    q["time_features"] = with_(*feat) + \
        "SELECT Date, ProductID, Year, Month, Day, DayOfWeek, Quarter, WeekOfYear, IsWeekend, IsMonthStart, IsMonthEnd FROM feat"
    q["lag_features"] = with_(*feat) + \
        "SELECT Date, ProductID, Quantity, Quantity_Lag1, Quantity_Lag7, Quantity_Lag14, Quantity_Lag30 FROM feat"
    q["rolling_means"] = with_(*feat) + """
SELECT Date, ProductID, r6(Quantity_RollingMean7, 6) AS Quantity_RollingMean7,
       r6(Quantity_RollingMean14, 6) AS Quantity_RollingMean14,
       r6(Quantity_RollingMean30, 6) AS Quantity_RollingMean30 FROM feat"""
    q["rolling_std"] = with_(*feat) + \
        "SELECT Date, ProductID, r6(Quantity_RollingStd7, 6) AS Quantity_RollingStd7 FROM feat"
    bf = [*b, DAILY, FEATURES, ASSOC_FEATURE]
    q["association_feature"] = with_(*bf) + \
        "SELECT Date, ProductID, r6(AssociatedProductSales, 6) AS AssociatedProductSales FROM af"
    q["forecast_features"] = with_(*bf) + """
SELECT Date, ProductID, Quantity, Year, Month, Day, DayOfWeek, Quarter, WeekOfYear, IsWeekend, IsMonthStart,
       IsMonthEnd, Quantity_Lag1, Quantity_Lag7, Quantity_Lag14, Quantity_Lag30,
       r6(Quantity_RollingMean7, 6) AS Quantity_RollingMean7, r6(Quantity_RollingMean14, 6) AS Quantity_RollingMean14,
       r6(Quantity_RollingMean30, 6) AS Quantity_RollingMean30, r6(Quantity_RollingStd7, 6) AS Quantity_RollingStd7,
       r6(AssociatedProductSales, 6) AS AssociatedProductSales FROM af"""
    q["latest_lag_state"] = with_(tx(), DAILY) + """
SELECT ProductID, r6(Quantity_Lag1, 6) AS Quantity_Lag1, r6(Quantity_Lag7, 6) AS Quantity_Lag7,
       r6(Quantity_Lag14, 6) AS Quantity_Lag14, r6(Quantity_Lag30, 6) AS Quantity_Lag30,
       r6(Quantity_RollingMean7, 6) AS Quantity_RollingMean7, r6(Quantity_RollingMean14, 6) AS Quantity_RollingMean14,
       r6(Quantity_RollingMean30, 6) AS Quantity_RollingMean30, r6(Quantity_RollingStd7, 6) AS Quantity_RollingStd7
FROM (
  SELECT ProductID,
         MAX(CASE WHEN rn = 1 THEN Quantity END) AS Quantity_Lag1,
         COALESCE(MAX(CASE WHEN rn = 7 THEN Quantity END), MAX(CASE WHEN rn = 1 THEN Quantity END)) AS Quantity_Lag7,
         COALESCE(MAX(CASE WHEN rn = 14 THEN Quantity END), MAX(CASE WHEN rn = 1 THEN Quantity END)) AS Quantity_Lag14,
         COALESCE(MAX(CASE WHEN rn = 30 THEN Quantity END), MAX(CASE WHEN rn = 1 THEN Quantity END)) AS Quantity_Lag30,
         AVG(CASE WHEN rn <= 7 THEN Quantity END) AS Quantity_RollingMean7,
         AVG(CASE WHEN rn <= 14 THEN Quantity END) AS Quantity_RollingMean14,
         AVG(Quantity) AS Quantity_RollingMean30,
         COALESCE(stddev_samp(CASE WHEN rn <= 7 THEN Quantity END), 0.0) AS Quantity_RollingStd7
  FROM (SELECT *, row_number() OVER (PARTITION BY ProductID ORDER BY Date DESC) AS rn FROM daily) r
  WHERE rn <= 30 GROUP BY ProductID) s"""
    q["train_split"] = with_(*feat, SPLIT) + "SELECT Date, ProductID, is_train FROM split"
    q["future_grid"] = with_(tx()) + """
SELECT p.ProductID, CAST(m.d + CAST(r.k AS INTEGER) AS DATE) AS Date
FROM (SELECT DISTINCT ProductID FROM transactions) p, (SELECT MAX(Date) AS d FROM transactions) m, range(1, 31) r(k)"""
    q["forecast_accuracy"] = with_(*feat, SPLIT) + """
SELECT r6(sqrt(AVG(pow(Quantity - Quantity_Lag1, 2))), 6) AS RMSE,
       r6(AVG(CASE WHEN Quantity <> 0 THEN abs((Quantity - Quantity_Lag1) / Quantity) END) * 100, 6) AS MAPE
FROM split WHERE NOT is_train"""
    fixed = "WITH RECURSIVE " + ",\n".join([tx(), DAILY, SCORING, walked("scoring")]) + "\n"
    q["demand_forecast_fixed"] = fixed + "SELECT Date, ProductID, r6(greatest(prediction, 0.0), 6) AS Predicted_Quantity FROM scored"
    held_out = "WITH RECURSIVE " + ",\n".join([*feat, SPLIT, walked("(SELECT * FROM split WHERE NOT is_train)")]) + "\n"
    q["holdout_accuracy_fixed"] = held_out + """
SELECT r6(sqrt(AVG(pow(Quantity - prediction, 2))), 6) AS RMSE,
       r6(AVG(CASE WHEN Quantity <> 0 THEN abs((Quantity - prediction) / Quantity) END) * 100, 6) AS MAPE FROM scored"""
    names = ", ".join(f"('{f}')" for f in [*ft.TIME_FEATURES, *ft.LAG_FEATURES])
    q["feature_importance_fixed"] = held_out + f"""
SELECT f.feature, r6(COALESCE(g.gain / (SELECT SUM(gain) FROM (SELECT AVG(gain) AS gain FROM nodes WHERE feature IS NOT NULL GROUP BY feature)), 0.0), 6)
         AS importance, CAST(COALESCE(p.n, 0) AS BIGINT) AS rows
FROM (VALUES {names}) f(feature)
LEFT JOIN (SELECT feature, AVG(CAST(gain AS DOUBLE)) AS gain FROM nodes WHERE feature IS NOT NULL GROUP BY feature) g ON g.feature = f.feature
LEFT JOIN (SELECT n.feature, COUNT(*) AS n FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node
           WHERE n.feature IS NOT NULL GROUP BY n.feature) p ON p.feature = f.feature"""
    q["scenario_forecast"] = with_(tx(), DAILY, FORECAST) + """
SELECT s.scenario, fc.Date, fc.ProductID, r6(fc.Predicted_Quantity * COALESCE(a.factor, 1.0), 6) AS Predicted_Quantity
FROM fc CROSS JOIN (VALUES ('base'), ('promotion'), ('shortage')) s(scenario)
LEFT JOIN (VALUES ('promotion', 'Brand#11', 1.25), ('promotion', 'Brand#23', 1.5), ('shortage', 'Brand#11', 0.6))
  a(scenario, ProductID, factor) ON a.scenario = s.scenario AND a.ProductID = fc.ProductID"""
    q["actual_vs_forecast"] = with_(tx(), DAILY, FORECAST) + """
SELECT 'actual' AS series, ProductID, Date, r6(Quantity, 6) AS Quantity FROM daily
UNION ALL
SELECT 'forecast' AS series, ProductID, Date, r6(Predicted_Quantity, 6) AS Quantity FROM fc"""
    q["forecast_report"] = with_(tx(), DAILY, FORECAST) + """
SELECT ProductID,
       CAST((SELECT MAX(Date) FROM transactions) + CAST(row_number() OVER (PARTITION BY ProductID ORDER BY Date) AS INTEGER)
            AS DATE) AS ForecastDate,
       r6(Predicted_Quantity, 6) AS Predicted_Quantity FROM fc"""
    inv = [tx(), DAILY, FORECAST, STATS]
    q["safety_stock"] = with_(*inv) + \
        "SELECT ProductID, r6(mean, 6) AS mean, r6(std, 6) AS std, safety_stock FROM ss"
    q["reorder_points"] = with_(*inv) + \
        "SELECT ProductID, safety_stock, r6(lead_time_demand, 6) AS lead_time_demand, reorder_point FROM rop"
    q["economic_order_quantity"] = with_(*inv) + \
        "SELECT ProductID, r6(annual_demand, 6) AS annual_demand, r6(Price, 6) AS Price, eoq FROM eoq"
    q["inventory_recommendations"] = with_(*inv) + """
SELECT ProductID, r6(avg_daily_demand, 6) AS avg_daily_demand, r6(demand_std_dev, 6) AS demand_std_dev,
       safety_stock, r6(lead_time_demand, 6) AS lead_time_demand, reorder_point, eoq, days_of_supply FROM recs"""
    q["top_reorder"] = with_(*inv) + \
        "SELECT ProductID, reorder_point FROM recs ORDER BY reorder_point DESC, ProductID LIMIT 10"
    binv = [*b, DAILY, FORECAST, STATS]
    q["bundle_inventory"] = with_(*binv, bundle_stock("TRUE")) + "SELECT * FROM bstock"
    q["bundle_stock"] = with_(*binv, bundle_stock("confidence >= CAST(0.12 AS DOUBLE) AND lift >= CAST(1.02 AS DOUBLE)")) \
        + "SELECT * FROM bstock"
    q["inventory_plan"] = with_(tx(), DAILY, FORECAST) + """
SELECT ProductID, r6(a, 6) AS avg_daily_demand, r6(mx, 6) AS max_daily_demand, r6(s, 6) AS safety_stock,
       r6(a * 7.0 + s, 6) AS reorder_point, r6(a * 14.0, 6) AS suggested_order_quantity
FROM (SELECT ProductID, a, mx, CASE WHEN mx > a THEN (mx - a) * 1.5 ELSE a * 0.2 END AS s
      FROM (SELECT ProductID, AVG(Predicted_Quantity) AS a, MAX(Predicted_Quantity) AS mx FROM fc GROUP BY ProductID) g) h"""
    q["top_rules_table"] = with_(*b) + f"""
SELECT antecedents_str AS Antecedents, consequents_str AS Consequents, printf('%.3f', support) AS Support,
       printf('%.3f', confidence) AS Confidence, printf('%.3f', lift) AS Lift
FROM (SELECT * FROM rules ORDER BY {ORDER_LIFT} LIMIT 10) t"""
    q["top_rules_by_lift"] = with_(*b) + f"""
SELECT {RULE_COLS} FROM rules WHERE lift >= CAST(1.01 AS DOUBLE) ORDER BY {ORDER_LIFT} LIMIT 20"""
    q["top_rules_by_confidence"] = with_(*b) + f"""
SELECT {RULE_COLS} FROM rules WHERE lift >= CAST(1.01 AS DOUBLE) ORDER BY {ORDER_CONF} LIMIT 10"""
    q["rule_labels"] = with_(*t) + """
SELECT antecedents_str, consequents_str,
       antecedents[1] || CASE WHEN len(antecedents) > 1 THEN '+' || CAST(len(antecedents) - 1 AS VARCHAR) ELSE '' END
         || ' → ' || consequents[1] AS label, lift, confidence
FROM rules"""
    q["lift_matrix"] = with_(*b, PARTNERS) + """,
top AS (SELECT ProductID FROM transactions GROUP BY ProductID ORDER BY SUM(Quantity) DESC, ProductID LIMIT 15),
cell AS (
  SELECT least(ProductID, partner) AS lo, greatest(ProductID, partner) AS hi, MAX(lift) AS lift FROM partners
  WHERE ProductID IN (SELECT ProductID FROM top) AND partner IN (SELECT ProductID FROM top) GROUP BY 1, 2)
SELECT a.ProductID AS product_a, b.ProductID AS product_b,
       CASE WHEN a.ProductID = b.ProductID THEN NULL ELSE COALESCE(c.lift, 0.0) END AS lift
FROM top a CROSS JOIN top b
LEFT JOIN cell c ON c.lo = least(a.ProductID, b.ProductID) AND c.hi = greatest(a.ProductID, b.ProductID)"""
    q["association_report"] = with_(*b) + f"""
SELECT antecedents_str AS Antecedents, consequents_str AS Consequents, printf('%.4f', support) AS Support,
       printf('%.4f', confidence) AS Confidence, printf('%.4f', lift) AS Lift
FROM (SELECT * FROM (SELECT * FROM rules WHERE lift >= CAST(10 * 0.102 AS DOUBLE) ORDER BY {ORDER_LIFT} LIMIT 20) x
      ORDER BY {ORDER_LIFT} LIMIT 10) t"""
    q["rules_min_lift"] = with_(*b) + f"SELECT {RULE_COLS} FROM rules WHERE lift >= CAST(1.05 AS DOUBLE)"
    ins = [*b, DAILY, FORECAST]
    insights = f"""insights AS (
  SELECT r.p AS main_product, t.main_product_forecast, r.consequents_str AS associated_products, r.confidence,
         r.lift, t.product_rank, r.rule_rank
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY p ORDER BY {ORDER_LIFT}) AS INTEGER) AS rule_rank
        FROM (SELECT unnest(antecedents) AS p, * FROM rules) u) r
  JOIN (SELECT ProductID, main_product_forecast,
               CAST(row_number() OVER (ORDER BY main_product_forecast DESC, ProductID) AS INTEGER) AS product_rank
        FROM (SELECT ProductID, SUM(Predicted_Quantity) AS main_product_forecast FROM fc GROUP BY ProductID) g
        ORDER BY main_product_forecast DESC, ProductID LIMIT 10) t ON t.ProductID = r.p
  WHERE r.rule_rank <= 3)"""
    q["combined_insights"] = with_(*ins, insights) + """
SELECT main_product, r6(main_product_forecast, 6) AS main_product_forecast, associated_products, confidence,
       lift, product_rank, rule_rank FROM insights"""
    q["recommendation_text"] = with_(*ins, insights) + """
SELECT main_product, product_rank, rule_rank,
       printf('%s: %.2f units forecast. Often sold together with %s (confidence %.2f, lift %.2f): '
              || 'stock them together or offer a bundle.',
              main_product, main_product_forecast, associated_products, confidence, lift) AS recommendation
FROM insights ORDER BY product_rank, rule_rank LIMIT 5"""
    series = "WITH RECURSIVE " + tx() + ",\n" + DAILY + ",\n"
    q["arima_forecast"] = series + series_sql.arima()
    q["trend_season_forecast"] = series + series_sql.forecast()
    q["forecast_intervals"] = series + series_sql.intervals()
    q["association_adjusted_forecast"] = "WITH RECURSIVE " + ",\n".join([*b, DAILY, FORECAST]) + """,
best AS (
  SELECT source, target, MAX(confidence) AS c
  FROM (SELECT antecedents[1] AS source, unnest(consequents) AS target, confidence FROM rules WHERE len(antecedents) = 1) u
  GROUP BY 1, 2),
weights AS (SELECT source, target, c / greatest(SUM(c) OVER (PARTITION BY target), 1.0) AS w FROM best),
base AS (SELECT ProductID, SUM(Quantity) / ((SELECT MAX(Date) FROM daily) - MIN(Date) + 1) AS m FROM daily GROUP BY ProductID),
dev AS (SELECT ProductID, AVG(Predicted_Quantity) / ANY_VALUE(m) - 1 AS d FROM fc JOIN base USING (ProductID) GROUP BY ProductID),
moves AS (
  SELECT 0 AS k, ProductID, d FROM dev
  UNION ALL
  SELECT k + 1, target, SUM(0.5::DOUBLE * w * d) FROM moves JOIN weights ON source = ProductID WHERE k < 60 GROUP BY k, target),
reached AS (SELECT ProductID, SUM(d) FILTER (k > 0) AS influence FROM moves GROUP BY ProductID)
SELECT Date, ProductID, r6(Predicted_Quantity, 4) AS Predicted_Quantity, r6(COALESCE(influence, 0.0), 4) AS influence,
       r6(greatest(Predicted_Quantity * (1 + COALESCE(influence, 0.0)), 0.0), 4) AS Adjusted_Quantity
FROM fc JOIN reached USING (ProductID)"""
    q["bundle_forecast"] = with_(*type_rules(), DAILY, FORECAST) + """,
named AS (SELECT DISTINCT list_sort(list_concat(antecedents, consequents)) AS items FROM rules),
held AS (
  SELECT k.t, n.items, array_to_string(n.items, ', ') AS bundle
  FROM (SELECT t, list(i) AS b FROM bl GROUP BY t) k, named n WHERE list_has_all(k.b, n.items)),
chosen AS (
  SELECT t, i, bundle FROM (SELECT t, unnest(items) AS i, bundle, len(items) AS size FROM held) u
  QUALIFY row_number() OVER (PARTITION BY t, i ORDER BY size DESC, bundle) = 1),
hist AS (SELECT l.i AS p, COALESCE(c.bundle, '') AS bundle, COUNT(*) AS n
         FROM bl l LEFT JOIN chosen c ON c.t = l.t AND c.i = l.i GROUP BY 1, 2),
shares AS (SELECT p, bundle, n, SUM(n) OVER (PARTITION BY p ORDER BY bundle) AS upto, SUM(n) OVER (PARTITION BY p) AS total FROM hist),
parts AS (
  SELECT f.Date, f.ProductID, s.bundle, CAST((u * upto) // total - (u * (upto - n)) // total AS BIGINT) AS units
  FROM (SELECT Date, ProductID, CAST(round(Predicted_Quantity * 1000) AS HUGEINT) AS u FROM fc) f JOIN shares s ON s.p = f.ProductID)
SELECT CASE GROUPING(ProductID) * 2 + GROUPING(bundle) WHEN 0 THEN 'part' WHEN 1 THEN 'product' WHEN 2 THEN 'bundle' ELSE 'total' END AS level,
       Date, ProductID, bundle, CAST(SUM(units) AS BIGINT) AS units
FROM parts GROUP BY GROUPING SETS ((Date, ProductID, bundle), (Date, ProductID), (Date, bundle), (Date))"""
    q["sales_by_category"] = with_(tx()) + """
SELECT strftime(Date, '%Y-%m') AS SaleMonth, ProductID AS Category, SUM(Quantity) AS quantity, COUNT(*) AS n
FROM transactions WHERE Date BETWEEN DATE '1996-01-15' AND DATE '1997-06-30'
  AND ProductID IN ('Brand#11', 'Brand#23', 'Brand#3') GROUP BY 1, 2"""
    q["sales_in_periods"] = with_(tx("p_partkey")) + """
SELECT period, SUM(Quantity) AS quantity, COUNT(*) AS n, COUNT(DISTINCT ProductID) AS products
FROM (SELECT *, year(Date) || 'Q' || quarter(Date) AS period FROM transactions) t
WHERE period IN ('1996Q3', '1997Q1') GROUP BY period"""
    sel = "('Brand#11', 'Brand#23', 'Brand#3', 'Brand#14')"
    q["inventory_selected"] = with_(tx().replace("transactions AS (", "every AS ("),
        "transactions AS (SELECT * FROM every WHERE ProductID <> 'Brand#23' OR Date < DATE '1998-06-01')",
        DAILY.replace("transactions", "every"), FORECAST,
        STATS.replace("SELECT greatest(MAX(Date) - MIN(Date), 1) FROM transactions",
                      f"SELECT greatest(MAX(Date) - MIN(Date), 1) FROM transactions WHERE ProductID IN {sel}")) + f"""
SELECT ProductID, safety_stock, r6(lead_time_demand, 6) AS lead_time_demand, reorder_point, eoq, days_of_supply
FROM recs WHERE ProductID IN {sel}"""
    q["safety_stock_99"] = with_(tx()) + """
SELECT ProductID, r6(mean, 6) AS mean, r6(std, 6) AS std,
       CAST(ceil(CASE WHEN std IS NULL OR std = 0 THEN mean * 0.2 ELSE std * 2.326 * sqrt(14) END) AS BIGINT) AS safety_stock
FROM (SELECT ProductID, AVG(Quantity) AS mean, stddev_samp(Quantity) AS std FROM transactions GROUP BY ProductID) s"""
    q["product_filter"] = with_(tx()) + f"""
SELECT ProductID, COUNT(*) AS n, 'list' AS how FROM transactions WHERE ProductID IN {sel} GROUP BY ProductID
UNION ALL
SELECT ProductID, COUNT(*) AS n, 'semi' AS how FROM transactions GROUP BY ProductID HAVING SUM(Quantity) % 2 = 0"""
    q["product_history"] = with_(tx(), DAILY) + "SELECT Date, ProductID, Quantity FROM daily WHERE ProductID = 'Brand#11'"
    q["forecast_stats_one"] = with_(tx(), DAILY, FORECAST) + """
SELECT ProductID, r6(SUM(Predicted_Quantity), 6) AS total, r6(AVG(Predicted_Quantity), 6) AS average,
       r6(MIN(Predicted_Quantity), 6) AS min, r6(MAX(Predicted_Quantity), 6) AS max
FROM fc WHERE ProductID = 'Brand#23' GROUP BY ProductID"""
    q["display_rounding"] = with_(tx()) + """
SELECT TransactionID, ProductID, round_even(Quantity / 8, 2) AS eighths, round_even(Quantity / 2, 0) AS halves, Quantity
FROM transactions"""
    q["clean_messy"] = """
SELECT TransactionID, Date, ProductID, SUM(Quantity) AS Quantity, COUNT(*) AS n, r6(SUM(Price), 6) AS price
FROM (SELECT CAST(l.l_orderkey AS VARCHAR) AS TransactionID, CAST(o.o_orderdate AS DATE) AS Date, pt.p_brand AS ProductID,
             CASE WHEN CAST(l.l_quantity AS INTEGER) % 10 = 5 THEN -CAST(CAST(l.l_quantity AS INTEGER) AS DOUBLE)
                  ELSE CAST(CAST(l.l_quantity AS INTEGER) AS DOUBLE) END AS Quantity, pt.p_retailprice AS Price
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part pt ON l.l_partkey = pt.p_partkey
      WHERE l.l_linenumber NOT IN (6, 7) AND CAST(l.l_quantity AS INTEGER) % 10 NOT IN (3, 7)) c
GROUP BY TransactionID, Date, ProductID"""
    q["csv_upload"] = q["clean_messy"]
    tt = [*type_rules(), DAILY, FORECAST]
    q["csv_roundtrip"] = with_(*tt, insights) + """
SELECT 'rules' AS report, antecedents_str || '|' || consequents_str AS line FROM rules
UNION ALL SELECT 'forecast', CAST(Date AS VARCHAR) || '|' || ProductID FROM fc
UNION ALL SELECT 'summary', ProductID FROM (SELECT DISTINCT ProductID FROM fc) a
UNION ALL SELECT 'insights', main_product || '|' || associated_products FROM insights
UNION ALL SELECT 'plan', ProductID FROM (SELECT DISTINCT ProductID FROM fc) b"""
    return q


def _all() -> dict[str, str]:
    """The queries over brands, and the rule queries again over product types (``_multi``)."""
    sql = _sql(brand_rules())
    typed = _sql(type_rules())
    sql |= {f"{name}_multi": typed[name] for name in MULTI}
    return {k: _expand_r6(text) for k, text in sql.items()}


# Rule queries that are registered over both products.
MULTI = [
    "top_associations", "product_bundles", "cross_sell", "all_rule_bundles", "associated_products", "associated_forecast",
    "associated_sales_comparison", "rule_item_frequency", "association_feature", "forecast_features", "bundle_inventory",
    "top_rules_table", "top_rules_by_lift", "top_rules_by_confidence", "lift_matrix", "association_report",
    "combined_insights", "recommendation_text",
]
ORACLE_SQL: dict[str, str] = _all()
