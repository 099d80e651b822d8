"""The registered queries in SQL over the given tables."""

from __future__ import annotations

#: Tables that queries are built from, in the order in which they refer to each other.
BASE = {
    "customers": """SELECT CAST(c.c_custkey AS BIGINT) AS customer_id,
      CASE WHEN c.c_custkey % 97 = 0 THEN DATE '2001-03-01'
           ELSE CAST(DATE '1995-01-01' - CAST(30 + (c.c_custkey * 37) % 700 AS INTEGER) AS DATE) END AS signup_date,
      CASE r.r_name WHEN 'AFRICA' THEN 'Organic' WHEN 'AMERICA' THEN 'Paid Search' WHEN 'ASIA' THEN 'Social Ads'
           WHEN 'EUROPE' THEN 'Referral' ELSE 'Partnership' END AS channel,
      CASE c.c_mktsegment WHEN 'BUILDING' THEN 'Mid-Market' WHEN 'HOUSEHOLD' THEN 'Enterprise' ELSE 'SMB' END AS segment
      FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "canon_orders": """SELECT concat('O', lpad(CAST(o_custkey AS VARCHAR), 7, '0'), '-', lpad(CAST(o_orderkey AS VARCHAR), 9, '0')) AS order_id,
      CAST(o_custkey AS BIGINT) AS customer_id, CAST(o_orderdate AS DATE) AS order_date, CAST(o_totalprice AS DECIMAL(12,2)) AS order_value FROM orders""",
    "base_cac": """SELECT * FROM (VALUES ('Organic', 70), ('Paid Search', 180), ('Social Ads', 150), ('Referral', 55), ('Partnership', 130)) t(channel, cost)""",
    "marketing": """SELECT c.channel, CAST(count(*) * max(b.cost) AS DOUBLE) AS marketing_spend FROM customers c JOIN base_cac b ON b.channel = c.channel GROUP BY c.channel""",
    "two": "SELECT 0 AS copy UNION ALL SELECT 1",
    "dirty_orders": """SELECT concat('O', lpad(CAST(o_custkey AS VARCHAR), 7, '0'), '-', lpad(CAST(o_orderkey AS VARCHAR), 9, '0')) AS order_id,
      CAST(CASE WHEN o_orderkey % 103 = 0 THEN 999999999 ELSE o_custkey END AS VARCHAR) AS customer_id,
      CASE WHEN o_orderkey % 107 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS order_date,
      CASE WHEN o_orderkey % 100 = 0 AND d.copy = 0 THEN '-1' WHEN o_orderkey % 101 = 0 THEN 'n/a'
           ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) + d.copy AS VARCHAR) END AS order_value,
      CAST(o_orderkey * 2 + d.copy AS BIGINT) AS _row_seq
      FROM orders CROSS JOIN two d WHERE d.copy = 0 OR o_orderkey % 50 = 0""",
    "dirty_customers": """SELECT CAST(customer_id AS VARCHAR) AS customer_id, signup_date, CASE WHEN customer_id % 53 = 0 THEN NULL ELSE channel END AS channel,
      CASE WHEN d.copy = 1 THEN 'Enterprise' ELSE segment END AS segment, customer_id * 2 + d.copy AS _row_seq
      FROM customers CROSS JOIN two d WHERE d.copy = 0 OR customer_id % 59 = 0""",
    "dirty_marketing": """SELECT channel, CASE WHEN d.copy = 1 THEN '1' WHEN channel = 'Referral' THEN '-5' WHEN channel = 'Partnership' THEN 'n/a'
      ELSE CAST(CAST(marketing_spend AS DECIMAL(20,2)) AS VARCHAR) END AS marketing_spend, d.copy AS _row_seq
      FROM marketing CROSS JOIN two d WHERE d.copy = 0 OR channel = 'Organic'""",
    "silver_all": """SELECT CAST(customer_id AS BIGINT) AS customer_id, signup_date, channel, segment FROM dirty_customers
      QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY _row_seq) = 1""",
    "silver_customers": "SELECT * FROM silver_all WHERE signup_date IS NOT NULL AND channel IS NOT NULL AND segment IS NOT NULL",
    "silver_orders": """SELECT order_id, TRY_CAST(customer_id AS BIGINT) AS customer_id, TRY_CAST(order_date AS DATE) AS order_date,
      TRY_CAST(order_value AS DECIMAL(12,2)) AS order_value
      FROM (SELECT * FROM dirty_orders QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY _row_seq) = 1)
      WHERE TRY_CAST(customer_id AS BIGINT) IN (SELECT customer_id FROM silver_all) AND TRY_CAST(order_value AS DECIMAL(12,2)) > 0 AND order_date IS NOT NULL""",
    "silver_marketing": """SELECT channel, greatest(coalesce(TRY_CAST(marketing_spend AS DOUBLE), 0), 0) AS marketing_spend
      FROM (SELECT * FROM dirty_marketing QUALIFY row_number() OVER (PARTITION BY channel ORDER BY _row_seq) = 1)""",
    "dim_date": """SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, CAST(d AS DATE) AS date, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month,
      monthname(d) AS month_name, CAST(quarter(d) AS INTEGER) AS quarter, CAST(weekofyear(d) AS INTEGER) AS week_of_year, CAST(isodow(d) AS INTEGER) AS day_of_week
      FROM (SELECT unnest(generate_series(min(order_date), max(order_date), INTERVAL 1 DAY)) AS d FROM canon_orders)""",
    "dim_channel": """SELECT CAST(row_number() OVER (ORDER BY channel) AS INTEGER) AS channel_key, channel, count(*) AS acquired_customers FROM customers GROUP BY channel""",
    "dim_customers": "SELECT *, customer_id AS customer_key, strftime(signup_date, '%Y-%m') AS signup_month FROM customers",
    "fact_orders": """SELECT o.order_id, o.customer_id, o.order_date, o.order_value, CAST(strftime(o.order_date, '%Y%m%d') AS INTEGER) AS date_key,
      k.channel_key, o.order_value AS order_amount, 1 AS order_count
      FROM canon_orders o LEFT JOIN customers c ON c.customer_id = o.customer_id LEFT JOIN dim_channel k ON k.channel = c.channel""",
    "as_of": "SELECT CAST(max(order_date) - 120 AS DATE) AS d FROM canon_orders",
    "history": """SELECT customer_id, max(order_date) FILTER (order_date <= d) AS last_order_date, count(*) FILTER (order_date <= d) AS frequency,
      CAST(sum(order_value) FILTER (order_date <= d) AS DOUBLE) AS monetary,
      count(*) FILTER (order_date > d AND order_date <= d + 30) AS future_orders_30d, count(*) FILTER (order_date > d AND order_date <= d + 90) AS future_orders_90d
      FROM canon_orders, as_of GROUP BY customer_id""",
    "features_0": """SELECT c.*, h.last_order_date, coalesce(h.frequency, 0) AS frequency, coalesce(h.monetary, 0) AS monetary, coalesce(h.future_orders_30d, 0) AS future_orders_30d,
      coalesce(h.future_orders_90d, 0) AS future_orders_90d, d AS as_of_date,
      CASE WHEN coalesce(h.frequency, 0) = 0 THEN 0 ELSE coalesce(h.monetary, 0) / h.frequency END AS avg_order_value,
      CAST(greatest(coalesce(date_diff('day', h.last_order_date, d), 999), 0) AS INTEGER) AS recency_days,
      CAST(greatest(date_diff('day', c.signup_date, d), 1) AS INTEGER) AS tenure_days
      FROM customers c LEFT JOIN history h ON h.customer_id = c.customer_id CROSS JOIN as_of""",
    "customer_features": """SELECT *, CASE WHEN frequency > 0 AND tenure_days >= 60 THEN CAST(future_orders_90d = 0 AS INTEGER) END AS is_churned,
      CASE WHEN frequency > 0 AND tenure_days >= 60 THEN CAST(future_orders_30d > 0 AS INTEGER) END AS next_purchase_30d,
      monetary / (tenure_days / CAST(30 AS DOUBLE)) AS arpu FROM features_0""",
    "scored": """SELECT *, CASE WHEN is_churned = 1 THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END AS churn_probability,
      CASE WHEN next_purchase_30d = 1 THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS next_purchase_probability FROM customer_features""",
    "ltv": """SELECT *, 1 / greatest(least(churn_probability, CAST(0.99 AS DOUBLE)), CAST(0.05 AS DOUBLE)) AS expected_retention_months,
      greatest(arpu * (1 / greatest(least(churn_probability, CAST(0.99 AS DOUBLE)), CAST(0.05 AS DOUBLE))) * CAST(0.68 AS DOUBLE), CAST(0 AS DOUBLE)) AS ltv FROM scored""",
    "cac": """SELECT m.channel, m.marketing_spend, coalesce(a.n, 1) AS customers_acquired, m.marketing_spend / greatest(coalesce(a.n, 1), 1) AS cac
      FROM marketing m LEFT JOIN (SELECT channel, count(*) AS n FROM customers GROUP BY channel) a ON a.channel = m.channel""",
    "unit_0": """SELECT c.*, round(coalesce(a.arpu, 0), 9) AS avg_arpu FROM cac c LEFT JOIN (SELECT channel, avg(arpu) AS arpu FROM ltv GROUP BY channel) a ON a.channel = c.channel""",
    "unit": """SELECT *, avg_arpu * 8 * CAST(0.68 AS DOUBLE) / greatest(cac, 1) AS ltv_cac_ratio, avg_arpu * CAST(0.68 AS DOUBLE) - cac / 6 AS contribution_margin,
      coalesce(cac / nullif(avg_arpu * CAST(0.68 AS DOUBLE), 0), 0) AS payback_period_months FROM unit_0""",
    "rfm_0": """SELECT c.customer_id, c.channel, CAST(coalesce(date_diff('day', o.last, (SELECT max(order_date) FROM canon_orders) + 1), 0) AS INTEGER) AS recency,
      coalesce(o.n, 0) AS frequency, coalesce(o.total, 0) AS monetary
      FROM customers c LEFT JOIN (SELECT customer_id, max(order_date) AS last, count(*) AS n, sum(order_value) AS total FROM canon_orders GROUP BY customer_id) o ON o.customer_id = c.customer_id""",
    "rfm_1": """SELECT *, row_number() OVER (ORDER BY recency, customer_id) AS r, row_number() OVER (ORDER BY frequency, customer_id) AS f,
      row_number() OVER (ORDER BY monetary, customer_id) AS m, count(*) OVER () AS n FROM rfm_0""",
    "rfm_2": """SELECT customer_id, channel, recency, frequency, CAST(monetary AS DOUBLE) AS monetary, CAST(5 - greatest(1, (4 * (r - 1) + n - 2) // (n - 1)) AS INTEGER) AS r_score,
      CAST(greatest(1, (4 * (f - 1) + n - 2) // (n - 1)) AS INTEGER) AS f_score, CAST(greatest(1, (4 * (m - 1) + n - 2) // (n - 1)) AS INTEGER) AS m_score FROM rfm_1""",
    "cohorts_0": """SELECT strftime(c.signup_date, '%Y-%m') AS cohort_month,
      CAST((year(o.order_date) - year(c.signup_date)) * 12 + month(o.order_date) - month(c.signup_date) AS INTEGER) AS cohort_index, count(DISTINCT o.customer_id) AS active_customers
      FROM canon_orders o JOIN customers c ON c.customer_id = o.customer_id GROUP BY 1, 2""",
    "cohorts": """SELECT a.*, s.n AS cohort_size, least(greatest(a.active_customers / CAST(greatest(s.n, 1) AS DOUBLE), 0), 1) AS retention_rate
      FROM cohorts_0 a LEFT JOIN (SELECT strftime(signup_date, '%Y-%m') AS m, count(DISTINCT customer_id) AS n FROM customers GROUP BY 1) s ON s.m = a.cohort_month""",
    "rec_0": """SELECT l.customer_id, l.channel, l.segment, l.ltv, coalesce(c.cac, 0) AS cac, l.ltv / CASE WHEN coalesce(c.cac, 0) = 0 THEN 1 ELSE c.cac END AS ltv_cac_ratio,
      l.churn_probability, l.next_purchase_probability FROM ltv l LEFT JOIN cac c ON c.channel = l.channel""",
    "limits": "SELECT quantile_cont(ltv, 0.3) AS q30, quantile_cont(ltv, 0.7) AS q70, median(cac) AS m FROM rec_0",
    "rec": """SELECT r.customer_id, r.channel, r.segment, r.ltv, r.cac, r.ltv_cac_ratio, r.churn_probability, r.next_purchase_probability,
      CAST(0.45 AS DOUBLE) * ((rank() OVER (ORDER BY ltv) + (count(*) OVER (PARTITION BY ltv) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER ())
        + CAST(0.35 AS DOUBLE) * (1 - churn_probability) + CAST(0.2 AS DOUBLE) * next_purchase_probability AS strategic_score,
      CASE WHEN churn_probability > 0.7 THEN 'Retention Campaign' WHEN ltv > q70 AND churn_probability < 0.4 THEN 'Upsell Offer'
           WHEN ltv < q30 AND cac > m THEN 'Reduce Acquisition Spend' ELSE 'Nurture' END AS recommended_action FROM rec_0 r CROSS JOIN limits""",
    "policy": "SELECT * FROM (VALUES ('Retention Campaign', 0.35, 0.08), ('Upsell Offer', 0.15, 0.05), ('Reduce Acquisition Spend', 0.50, 0.01), ('Nurture', 0.03, 0.02)) t(action, up, cost)",
    "sim_0": """SELECT r.*, CASE r.recommended_action WHEN 'Retention Campaign' THEN ltv * churn_probability WHEN 'Reduce Acquisition Spend' THEN cac
      ELSE ltv * next_purchase_probability END * CAST(p.up AS DOUBLE) AS expected_uplift,
      CASE r.recommended_action WHEN 'Reduce Acquisition Spend' THEN cac ELSE ltv END * CAST(p.cost AS DOUBLE) AS action_cost FROM rec r JOIN policy p ON p.action = r.recommended_action""",
    "sim": """SELECT *, expected_uplift - action_cost AS net_impact, CASE WHEN action_cost > 0 THEN (expected_uplift - action_cost) / action_cost ELSE 0 END AS roi_simulated,
      ltv * next_purchase_probability AS baseline_revenue_90d, ltv * next_purchase_probability + expected_uplift AS scenario_revenue_90d,
      row_number() OVER (ORDER BY strategic_score DESC, customer_id) AS priority_rank FROM sim_0""",
    "records": """SELECT customer_id AS record_id, recency_days, frequency, CASE WHEN customer_id % 67 = 0 THEN -monetary - 1 ELSE monetary END AS monetary, avg_order_value, tenure_days, arpu,
      CASE WHEN customer_id % 71 = 0 THEN '' ELSE channel END AS channel, segment FROM customer_features""",
    "request_log": """SELECT ts, event_type AS endpoint, json_extract_string(CAST(props AS VARCHAR), '$.k') AS status, CAST(value AS DOUBLE) AS latency FROM events""",
}
REC = "customer_id, channel, segment, ltv, cac, ltv_cac_ratio, churn_probability, next_purchase_probability, strategic_score, recommended_action"
SUM_TABLES = "('dim_customers'), ('dim_date'), ('dim_channel'), ('fact_orders')"
COLUMNS = {
    "dim_customers": ["customer_id", "signup_date", "channel", "segment"],
    "dim_date": ["date_key", "date", "year", "month", "week_of_year", "day_of_week"],
    "dim_channel": ["channel_key", "channel"],
    "fact_orders": ["order_id", "customer_id", "channel_key", "date_key", "order_date", "order_amount", "order_count"],
}
KEYS = {"dim_customers": "customer_id", "dim_date": "date_key", "dim_channel": "channel_key", "fact_orders": "order_id"}

ROC = """SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, fp / nt AS fpr, tp / pt AS tpr, tp / (tp + fp) AS precision FROM (SELECT threshold,
      CAST(sum(p) OVER (ORDER BY threshold DESC) AS DOUBLE) AS tp, CAST(sum(n) OVER (ORDER BY threshold DESC) AS DOUBLE) AS fp, CAST(sum(p) OVER () AS DOUBLE) AS pt, CAST(sum(n) OVER () AS DOUBLE) AS nt
      FROM (SELECT CAST(recency_days // 7 * 7 AS INTEGER) AS threshold, count(*) FILTER (is_churned = 1) AS p, count(*) FILTER (is_churned = 0) AS n
            FROM customer_features WHERE is_churned IS NOT NULL GROUP BY 1))"""

QUERIES = {
    "revenue_kpis": """SELECT d.year, d.month, CAST(sum(order_amount) AS DOUBLE) AS gross_revenue, count(DISTINCT customer_id) AS active_customers, count(*) AS order_count,
      CAST(sum(order_amount) AS DOUBLE) / count(*) AS avg_ticket FROM fact_orders f JOIN dim_date d ON d.date_key = f.date_key GROUP BY d.year, d.month""",
    "channel_efficiency": """SELECT c.channel, CAST(sum(order_amount) AS DOUBLE) AS revenue, count(DISTINCT customer_id) AS customers,
      CAST(sum(order_amount) AS DOUBLE) / nullif(count(DISTINCT customer_id), 0) AS arpu FROM fact_orders f JOIN dim_channel c ON c.channel_key = f.channel_key GROUP BY c.channel""",
    "churn_watchlist": """SELECT * FROM (SELECT c.customer_id, c.segment, c.channel, max(f.order_date) AS last_order_date, CAST(sum(f.order_amount) AS DOUBLE) AS lifetime_revenue
      FROM dim_customers c LEFT JOIN fact_orders f ON f.customer_id = c.customer_id GROUP BY 1, 2, 3) WHERE last_order_date IS NULL OR last_order_date < DATE '2001-08-01' - INTERVAL 90 DAY""",
    "customer_summary_ingest": """SELECT c.customer_id, CASE WHEN c.customer_id % 61 = 0 THEN 'Platinum' WHEN segment = 'SMB' THEN 'Bronze' WHEN segment = 'Mid-Market' THEN 'Silver' ELSE 'Gold' END AS membership_type,
      CASE WHEN c.customer_id % 61 = 0 THEN 'SMB' ELSE segment END AS segment, c.channel, c.signup_date,
      CAST(greatest(coalesce(date_diff('day', o.last, DATE '2001-08-01'), 30), 1) AS INTEGER) AS recency_days
      FROM customers c LEFT JOIN (SELECT customer_id, max(order_date) AS last FROM canon_orders GROUP BY 1) o ON o.customer_id = c.customer_id""",
    "summary_rejects": """SELECT CAST(customer_id AS INTEGER) AS customer_id, CASE WHEN broken THEN 'rejected' ELSE 'accepted' END AS outcome, CASE WHEN broken THEN true END AS line_kept, true AS has_place
      FROM (SELECT customer_id, customer_id % 83 = 0 OR customer_id % 89 = 0 AS broken FROM customers)""",
    "summary_csv_ingest": """SELECT CAST(c.customer_id AS INTEGER) AS customer_id, CASE WHEN c.customer_id % 61 = 0 THEN 'Platinum' WHEN segment = 'SMB' THEN 'Bronze' WHEN segment = 'Mid-Market' THEN 'Silver' ELSE 'Gold' END AS membership_type,
      CASE WHEN c.customer_id % 61 = 0 THEN 'SMB' ELSE segment END AS segment, CAST(greatest(coalesce(date_diff('day', o.last, DATE '2001-08-01'), 30), 1) AS INTEGER) AS recency_days
      FROM customers c LEFT JOIN (SELECT customer_id, max(order_date) AS last FROM canon_orders GROUP BY 1) o ON o.customer_id = c.customer_id WHERE c.customer_id % 83 <> 0 AND c.customer_id % 89 <> 0""",
    "marketing_from_customers": "SELECT channel, marketing_spend FROM marketing",
    "bronze_orders": "SELECT *, 'orders.parquet' AS _source_file FROM dirty_orders",
    "silver_customers": "SELECT * FROM silver_customers",
    "silver_orders": "SELECT * FROM silver_orders",
    "silver_marketing": "SELECT * FROM silver_marketing",
    "dim_date": "SELECT * FROM dim_date",
    "dim_channel": "SELECT * FROM dim_channel",
    "dim_customers": "SELECT * FROM dim_customers",
    "fact_orders": "SELECT * FROM fact_orders",
    "customer_features": "SELECT * FROM customer_features",
    "customer_features_bucketed": "SELECT * FROM customer_features",
    "ltv": "SELECT customer_id, channel, segment, arpu, churn_probability, expected_retention_months, ltv FROM ltv",
    "cac_by_channel": "SELECT * FROM cac",
    "unit_economics": """SELECT channel, marketing_spend, customers_acquired, cac, round(avg_arpu, 6) AS avg_arpu, round(ltv_cac_ratio, 6) AS ltv_cac_ratio,
      round(contribution_margin, 6) AS contribution_margin, round(payback_period_months, 6) AS payback_period_months, avg_arpu * CAST(0.68 AS DOUBLE) > 0 AS pays_back FROM unit""",
    "rfm_segments": """SELECT *, r_score + f_score + m_score AS rfm_total, CASE WHEN r_score + f_score + m_score >= 10 THEN 'VIP' WHEN r_score + f_score + m_score >= 8 THEN 'Loyal'
      WHEN r_score <= 2 THEN 'At Risk' ELSE 'Hibernating' END AS segment FROM rfm_2""",
    "cohort_retention": "SELECT * FROM cohorts",
    "cohort_matrix": "PIVOT (SELECT cohort_month, 'm' || replace(CAST(cohort_index AS VARCHAR), '-', '_') AS k, retention_rate * 100 AS pct FROM cohorts) ON k USING max(pct) GROUP BY cohort_month",
    "cohort_matrix_cells": "SELECT cohort_month, cohort_index, retention_rate * 100 AS retention_pct FROM cohorts",
    "recommendations": f"SELECT {REC} FROM rec",
    "executive_kpis": """SELECT count(DISTINCT customer_id) AS customers_in_scope, count(*) AS rows_in_recommendation_table, round(avg(ltv), 6) AS avg_ltv, round(avg(cac), 6) AS avg_cac,
      round(avg(ltv_cac_ratio), 6) AS avg_ltv_cac_ratio, round(avg(churn_probability), 6) AS avg_churn_probability, round(avg(next_purchase_probability), 6) AS avg_next_purchase_probability FROM rec""",
    "summary_kpis": """SELECT (SELECT round(sum(monetary), 2) FROM scored) AS total_revenue_proxy, (SELECT round(avg(arpu), 6) FROM scored) AS avg_arpu,
      (SELECT round(avg(churn_probability), 6) FROM rec) AS avg_churn_probability""",
    "top_churn_risk": "SELECT customer_id, segment, channel, churn_probability FROM rec ORDER BY churn_probability DESC, customer_id LIMIT 20",
    "top_actions": "SELECT customer_id, recommended_action, strategic_score, ltv_cac_ratio FROM rec ORDER BY strategic_score DESC, customer_id LIMIT 20",
    "channel_ranking": "SELECT channel, round(ltv_cac_ratio, 6) AS ltv_cac_ratio FROM unit",
    "top_10_actions": """SELECT CAST(priority_rank AS INTEGER) AS priority_rank, customer_id, channel, segment, recommended_action AS action, strategic_score AS strategic_priority_score, expected_uplift,
      action_cost, net_impact, roi_simulated, baseline_revenue_90d, scenario_revenue_90d, ltv_cac_ratio FROM sim WHERE priority_rank <= 10""",
    "business_outcomes": """SELECT (SELECT round(avg(ltv_cac_ratio), 6) FROM rec) AS avg_ltv_cac_ratio, (SELECT round(avg(CAST(churn_probability >= 0.7 AS DOUBLE)), 6) FROM rec) AS high_churn_risk_pct,
      round(sum(baseline_revenue_90d), 6) AS baseline_revenue_90d, round(sum(scenario_revenue_90d), 6) AS scenario_revenue_90d,
      round(sum(scenario_revenue_90d) - sum(baseline_revenue_90d), 6) AS delta_revenue_90d, round(sum(action_cost), 6) AS total_action_cost, round(sum(net_impact), 6) AS net_impact,
      round(CASE WHEN sum(action_cost) > 0 THEN sum(net_impact) / sum(action_cost) ELSE 0 END, 6) AS roi_simulated FROM sim WHERE priority_rank <= 10""",
    "portfolio_slice_kpis": """SELECT count(DISTINCT customer_id) AS customers, round(avg(ltv), 6) AS avg_ltv, round(avg(churn_probability), 6) AS avg_risk, round(avg(ltv_cac_ratio), 6) AS avg_efficiency,
      round(sum(expected_uplift), 4) AS total_impact FROM sim WHERE segment = 'SMB'""",
    "action_mix": """SELECT action, n, CAST(round_even(n / CAST(sum(n) OVER () AS DOUBLE) * 100, 1) AS DOUBLE) AS pct FROM (SELECT recommended_action AS action, count(*) AS n FROM rec GROUP BY 1)""",
    "segment_risk": "SELECT segment, round(avg(churn_probability), 6) AS avg_risk FROM rec GROUP BY segment",
    "channel_next_purchase": "SELECT channel, round(avg(next_purchase_probability), 6) AS avg_next_purchase FROM rec GROUP BY channel",
    "action_board": f"SELECT {REC}, expected_uplift AS potential_impact FROM sim ORDER BY strategic_score DESC, customer_id LIMIT 120",
    "action_board_by_score": f"SELECT {REC}, expected_uplift AS potential_impact FROM sim ORDER BY strategic_score DESC, customer_id LIMIT 120",
    "portfolio_leaders": """SELECT * FROM (SELECT customer_id AS top_customer, round(expected_uplift, 6) AS top_impact FROM sim ORDER BY expected_uplift DESC, customer_id LIMIT 1)
      CROSS JOIN (SELECT segment AS riskiest_segment, round(avg(churn_probability), 6) AS avg_risk FROM rec GROUP BY segment ORDER BY 2 DESC, 1 LIMIT 1)
      CROSS JOIN (SELECT recommended_action AS top_action, CAST(round_even(count(*) / CAST((SELECT count(*) FROM rec) AS DOUBLE) * 100, 1) AS DOUBLE) AS action_pct
        FROM rec GROUP BY recommended_action ORDER BY count(*) DESC, 1 LIMIT 1)""",
    "slicer_values": """SELECT array_to_string(list_sort(list(DISTINCT segment)), '|') AS segments, array_to_string(list_sort(list(DISTINCT channel)), '|') AS channels,
      array_to_string(list_sort(list(DISTINCT recommended_action)), '|') AS actions FROM rec""",
    "gold_contract_report": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, true AS present, (SELECT count(*) FROM {t}) AS n_rows" for t, cs in COLUMNS.items() for c in cs
    ),
    "key_checks": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, CAST((SELECT count(*) FROM {t} WHERE {k} IS NULL) AS BIGINT) AS null_keys, (SELECT count(*) FROM (SELECT {k} FROM {t} WHERE {k} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS repeated_keys"
        for t, k in KEYS.items()
    ),
    "referential_checks": " UNION ALL ".join(
        f"SELECT 'silver_fact' AS table_name, '{c}' AS column_name, (SELECT count(*) FROM sf WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {c} FROM {p})) AS orphans, (SELECT count(*) FROM sf WHERE {c} IS NULL) AS null_references"
        for c, p in (("customer_id", "silver_customers"), ("date_key", "sd"), ("channel_key", "sk"))
    ),
    "retention_range": "SELECT count(*) FILTER (NOT retention_rate BETWEEN 0 AND 1) AS out_of_range, count(*) AS n_rows FROM cohorts",
    "score_record_validation": """SELECT record_id, concat_ws(',', CASE WHEN monetary < 0 THEN 'monetary' END, CASE WHEN length(channel) < 1 THEN 'channel' END) AS errors FROM records""",
    "temporal_split_80": """SELECT customer_id, CASE WHEN row_number() OVER (ORDER BY signup_date, customer_id) <= greatest(1, least(CAST(floor(count(*) OVER () * CAST(0.8 AS DOUBLE)) AS BIGINT), count(*) OVER () - 1))
      THEN 'train' ELSE 'test' END AS split FROM customer_features WHERE is_churned IS NOT NULL""",
    "roc_points": ROC,
    "roc_hull": f"""SELECT threshold, tp, fp, fpr, tpr, precision FROM (SELECT *, lag(tp) OVER o AS tp0, lag(fp) OVER o AS fp0, lead(tp) OVER o AS tp1, lead(fp) OVER o AS fp1
      FROM ({ROC}) WINDOW o AS (ORDER BY threshold DESC)) WHERE tp0 IS NULL OR tp1 IS NULL OR (fp - fp0) * (tp1 - tp) <> (fp1 - fp) * (tp - tp0)""",
    "roc_curve_areas": f"""SELECT curve, true AS within, area FROM (SELECT round(sum((fpr - x) * (tpr + y) / 2), 9) AS area FROM (SELECT fpr, tpr, lag(fpr, 1, 0.0) OVER o AS x, lag(tpr, 1, 0.0) OVER o AS y
      FROM ({ROC}) WINDOW o AS (ORDER BY threshold DESC))) CROSS JOIN (VALUES ('full'), ('hull'), ('thinned')) AS c(curve)""",
    "model_version_usage": """SELECT model, strftime(date_trunc('hour', TIMESTAMP '2001-08-01 00:00:00' + to_minutes(CAST(record_id % 2880 AS INTEGER))), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS predictions,
      CAST(1 AS BIGINT) AS versions FROM records CROSS JOIN (VALUES ('churn'), ('next_purchase_30d')) AS m(model) WHERE monetary >= 0 AND length(channel) >= 1 GROUP BY 1, 2""",
    "request_metrics": """SELECT endpoint, status, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS requests, round(avg(latency), 6) AS mean_latency,
      arg_max(latency, ts) AS last_latency FROM request_log GROUP BY 1, 2, 3""",
    "silver_customers_text": """SELECT * FROM (SELECT CAST(customer_id AS BIGINT) AS customer_id, TRY_CAST(CASE WHEN CAST(customer_id AS BIGINT) % 83 = 0 THEN '2001-13-45' WHEN CAST(customer_id AS BIGINT) % 89 = 0 THEN 'n/a'
      ELSE CAST(signup_date AS VARCHAR) END AS DATE) AS signup_date, channel, segment FROM dirty_customers QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY _row_seq) = 1)
      WHERE signup_date IS NOT NULL AND channel IS NOT NULL AND segment IS NOT NULL""",
    "silver_rejects": """SELECT 'customers' AS table_name, 'x' || customer_id AS key FROM dirty_customers WHERE CAST(customer_id AS BIGINT) % 109 = 0
      UNION ALL SELECT 'orders', 'x' || customer_id FROM dirty_orders WHERE CAST(customer_id AS BIGINT) % 109 = 0""",
    "bronze_csv_orders": "SELECT order_id, customer_id, order_date, order_value, true AS from_csv FROM dirty_orders",
    "silver_csv_orders": "SELECT * FROM silver_orders",
    "silver_stream_orders": "SELECT * FROM silver_orders",
    "stratified_fold_sizes": """SELECT is_churned, CAST(f AS INTEGER) AS fold, CAST((n - f + 4) // 5 AS BIGINT) AS n FROM (SELECT is_churned, count(*) AS n FROM customer_features WHERE is_churned IS NOT NULL GROUP BY 1)
      CROSS JOIN (SELECT unnest(range(5)) AS f)""",
    "model_split_sizes": " UNION ALL ".join(
        f"""SELECT '{name}' AS model_name, 'temporal' AS split_strategy, CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT) AS train_size, n - CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT) AS test_size
      FROM (SELECT count(*) AS n FROM customer_features WHERE {target} IS NOT NULL)"""
        for name, target in (("churn", "is_churned"), ("next_purchase_30d", "next_purchase_30d"))
    ),
    "batch_score_outcomes": "SELECT record_id, CASE WHEN monetary < 0 OR length(channel) < 1 THEN 'rejected' ELSE 'scored' END AS outcome FROM records",
    "stream_score_outcomes": "SELECT record_id, CASE WHEN monetary < 0 OR length(channel) < 1 THEN 'rejected' ELSE 'scored' END AS outcome FROM records",
    "fingerprint_checks": "SELECT count(*) AS n_rows, true AS same_rows, true AS changed_rows FROM customer_features",
    "summary_report_sections": """SELECT 'ltv_cac_by_channel' AS section, CAST(row_number() OVER (ORDER BY round(ltv_cac_ratio, 12) DESC, channel) - 1 AS INTEGER) AS place, channel AS key, round(ltv_cac_ratio, 6) AS value FROM unit
      UNION ALL SELECT 'top_churn_risk_customers', CAST(r - 1 AS INTEGER), CAST(customer_id AS VARCHAR), round(churn_probability, 6) FROM (SELECT *, row_number() OVER (ORDER BY churn_probability DESC, customer_id) AS r FROM rec) WHERE r <= 20
      UNION ALL SELECT 'top_20_recommended_actions', CAST(r - 1 AS INTEGER), CAST(customer_id AS VARCHAR), round(strategic_score, 6) FROM (SELECT *, row_number() OVER (ORDER BY strategic_score DESC, customer_id) AS r FROM rec) WHERE r <= 20""",
    "outcomes_report_sections": """WITH t AS (SELECT sum(baseline_revenue_90d) AS b, sum(scenario_revenue_90d) AS s, sum(action_cost) AS c, sum(net_impact) AS n FROM sim WHERE priority_rank <= 10)
      SELECT 'kpis' AS section, 'avg_ltv_cac_ratio' AS key, (SELECT round(avg(ltv_cac_ratio), 6) FROM rec) AS value
      UNION ALL SELECT 'kpis', 'high_churn_risk_pct', (SELECT round(avg(CAST(churn_probability >= 0.7 AS DOUBLE)), 6) FROM rec)
      UNION ALL SELECT 'kpis', 'simulated_net_impact_top10', round(n, 6) FROM t
      UNION ALL SELECT 'simulation_summary_top10', 'total_action_cost', round(c, 6) FROM t
      UNION ALL SELECT 'simulation_summary_top10', 'delta_revenue_90d', round(s - b, 6) FROM t
      UNION ALL SELECT 'simulation_summary_top10', 'roi_simulated', round(n / c, 6) FROM t
      UNION ALL SELECT 'simulation_assumptions', action || ' uplift_rate', CAST(up AS DOUBLE) FROM policy
      UNION ALL SELECT 'simulation_assumptions', action || ' cost_rate', CAST(cost AS DOUBLE) FROM policy
      UNION ALL SELECT 'ltv_cac_by_channel', channel, round(ltv_cac_ratio, 6) FROM unit
      UNION ALL SELECT 'top_10_actions', concat(priority_rank, ' ', recommended_action), round(net_impact, 6) FROM sim WHERE priority_rank <= 10""",
    "executive_report_top": f"SELECT CAST(r - 1 AS INTEGER) AS place, (SELECT count(DISTINCT customer_id) FROM rec) AS customers_in_scope, {REC} FROM (SELECT *, row_number() OVER (ORDER BY strategic_score DESC, customer_id) AS r FROM rec) WHERE r <= 20",
    "bronze_stream": "SELECT order_id, customer_id, order_date, order_value FROM canon_orders",
}
QUERIES["churn_watchlist_bucketed"] = QUERIES["churn_watchlist"]
EXTRA = {
    "referential_checks": {
        "sk": "SELECT CAST(row_number() OVER (ORDER BY channel) AS INTEGER) AS channel_key, channel FROM silver_customers GROUP BY channel",
        "sd": "SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key FROM (SELECT unnest(generate_series(min(order_date), max(order_date), INTERVAL 1 DAY)) AS d FROM silver_orders)",
        "sf": """SELECT o.*, CAST(strftime(o.order_date, '%Y%m%d') AS INTEGER) AS date_key, k.channel_key FROM silver_orders o
          LEFT JOIN silver_customers c ON c.customer_id = o.customer_id LEFT JOIN sk k ON k.channel = c.channel""",
    }
}


def oracle_sql() -> dict[str, str]:
    return {name: "WITH " + ", ".join(f"{n} AS ({q})" for n, q in (BASE | EXTRA.get(name, {})).items()) + f" SELECT * FROM ({text})" for name, text in QUERIES.items()}
