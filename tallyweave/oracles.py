"""DuckDB SQL for the registered queries, written against the same tables independently of the Spark code."""

from __future__ import annotations

TX = """ledger AS (
  SELECT substr(sha256('o|' || o_orderkey), 1, 16) AS row_hash, strftime(o_orderdate, '%Y-%m-%d') AS date,
    lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') AS time,
    CASE WHEN o_orderstatus = 'P' THEN '수입' ELSE '지출' END AS type_raw,
    CASE WHEN o_orderstatus = 'P' THEN 'income' ELSE 'expense' END AS type_norm,
    r_name AS major_raw, n_name AS minor_raw, c_name AS merchant_raw,
    CASE WHEN o_orderkey % 3 = 0 THEN 'memo ' || (o_orderkey % 7) END AS memo_raw,
    CAST(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE -o_totalprice END AS DECIMAL(18,2)) AS amount,
    o_orderpriority AS account, 'KRW' AS currency,
    CASE WHEN o_orderkey % 4 = 0 THEN c_mktsegment END AS category_rule,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN '' ELSE c_mktsegment END AS category_final,
    CASE WHEN o_orderkey % 4 = 0 THEN ['rule'] ELSE CAST([] AS VARCHAR[]) END AS tags_rule_list,
    CASE WHEN o_orderkey % 29 = 0 THEN ['vip'] ELSE CAST([] AS VARCHAR[]) END AS tags_manual_list,
    CASE WHEN o_orderkey % 5 = 0 THEN CAST([] AS VARCHAR[]) ELSE [lower(c_mktsegment), lower(o_orderpriority)] END AS tags_list,
    CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey % 10) / 10.0 END AS confidence,
    CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS needs_review,
    CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS is_transfer,
    CASE WHEN o_orderkey % 22 = 0 THEN 'T_' || substr(sha256('o|' || o_orderkey), 1, 8) WHEN o_orderkey % 33 = 0 THEN ' ' END AS transfer_group_id,
    'f' || (o_orderkey % 3) AS file_id, o_orderkey AS source_row
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
), tx AS (
  SELECT *, substr(date, 1, 7) AS month, is_transfer = 1 AND trim(coalesce(transfer_group_id, '')) <> '' AS is_transfer_bool FROM ledger
), spend AS (SELECT * FROM tx WHERE amount < 0 AND NOT is_transfer_bool)"""
# Fixed value: what marks a row as no consumption.
NON = (
    "regexp_matches(lower(concat_ws(' ', coalesce(category_final, ''), coalesce(major_raw, ''), coalesce(minor_raw, ''), coalesce(array_to_string(tags_list, ' '), ''))), "
    "'(카드대금|카드결제|결제대금|상환|이체|송금|투자|증권|주식|펀드|isa|irp|연금|저축|적금|예금|savings?|investment|소비제외|금융|금융비용|외화)')"
)
SUM = "CAST(abs(sum(amount)) AS DOUBLE)"
SIGNED = "CAST(sum(amount) AS DOUBLE)"
N = "count(*) AS transaction_count"
AVG = f"round({SUM} / count(*), 0)"


def q(select: str, more: str = "") -> str:
    return f"WITH {TX}{', ' + more if more else ''} {select}"


CONSUMED = f"SELECT * FROM spend WHERE type_norm = 'expense' AND NOT {NON}"
WHOLE = "CAST(round(coalesce({0}, 0), 0) AS BIGINT)"


def _age(rows: str = "tx") -> str:
    return f"aged AS (SELECT *, date_diff('day', CAST(date AS DATE), CAST((SELECT max(date) FROM tx) AS DATE)) AS age FROM {rows})"


def _compare(key: str, types: str, b: str, c: str) -> str:
    rows = f"r AS (SELECT month, coalesce(nullif(trim({key}), ''), '(unknown)') AS group_key, abs(amount) AS size FROM tx WHERE {types})"
    counts = f"k AS (SELECT count(DISTINCT month) FILTER (month IN ({b})) AS bm, count(DISTINCT month) FILTER (month IN ({c})) AS cm FROM r)"
    sums = (
        f"s AS (SELECT group_key, coalesce(CAST(sum(size) FILTER (month IN ({b})) AS DOUBLE) / nullif(bm, 0), 0) AS b, "
        f"coalesce(CAST(sum(size) FILTER (month IN ({c})) AS DOUBLE) / nullif(cm, 0), 0) AS c FROM r, k WHERE month IN ({b}, {c}) GROUP BY group_key, bm, cm)"
    )
    return q(
        "SELECT group_key, round(b, 1) AS baseline_monthly_avg, round(c, 1) AS current_monthly_avg, round(c - b, 1) AS diff, "
        "CASE WHEN b <> 0 THEN round((c - b) / b * 100, 1) END AS pct_change FROM s",
        f"{rows}, {counts}, {sums}",
    )


_months = lambda *ms: ", ".join(f"'{m}'" for m in ms)
_STATES = "TRIM(coalesce(category_final, '')) IN ('', '미분류')"
_ATTENTION = f"(needs_review = 1 OR len(tags_list) = 0 OR {_STATES})"
_RULE0, _RULE1, _RULE2 = "contains(lower(coalesce(merchant_raw, '')), '0000001')", "lower(merchant_raw) = 'customer#000000123'", "(regexp_matches(merchant_raw, '9{2}$') AND date >= '1998-01-01')"
_RULE3, _RULE4 = "coalesce(category_final = 'MACHINERY', false)", "date BETWEEN '1996-02-01' AND '1996-03-15'"
_ANY = f"({_RULE0} OR {_RULE1} OR {_RULE2} OR {_RULE3} OR {_RULE4})"
_SNAP = """snap AS (SELECT strftime(last_day(o_orderdate), '%Y-%m-%d') AS snapshot_date, o_orderpriority AS account_id,
  o_orderstatus || (o_orderkey % 5) AS instrument_id, CAST(o_totalprice AS DECIMAL(18,2)) AS market_value FROM orders),
manual AS (SELECT * FROM (VALUES ('Flat', 'real_estate', 250000.0), (' f1 ', 'cash', 1000.0), ('Car', 'other', 9000.5)) AS t(name, category, value))"""
_ASSETS = f"""{_SNAP}, picked AS (SELECT * FROM snap WHERE snapshot_date = (SELECT max(snapshot_date) FROM snap WHERE snapshot_date <= '1999-12-31')),
assets AS (SELECT name, category, CAST(value AS DECIMAL(18,2)) AS value, 'manual' AS source FROM manual
  UNION ALL SELECT instrument_id, 'financial', sum(market_value), 'snapshot' FROM picked
  WHERE lower(trim(instrument_id)) NOT IN (SELECT lower(trim(name)) FROM manual) GROUP BY instrument_id)"""
_EVENTS = """e AS (SELECT substr(sha256('e|' || event_id), 1, 16) AS row_hash, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS at, event_type AS major_raw,
  CAST(CASE WHEN event_id % 2 = 0 THEN -value ELSE value END AS DECIMAL(18,2)) AS amount FROM events),
pairs AS (SELECT o.major_raw, o.row_hash AS out_row_hash, i.row_hash AS in_row_hash, o.at AS out_at, i.at AS in_at,
  CAST(abs(-o.amount - i.amount) AS DOUBLE) / CAST(greatest(-o.amount, i.amount) AS DOUBLE) AS ratio, abs(o.at - i.at) AS delta_s
  FROM e o JOIN e i ON o.major_raw = i.major_raw AND o.amount < 0 AND i.amount > 0 AND i.at BETWEEN o.at - 300 AND o.at + 300),
near AS (SELECT * FROM pairs WHERE ratio <= 0.25)"""
_BUDGET = "t AS (SELECT * FROM (VALUES ('BUILDING', 3000000), ('MACHINERY', 100), ('FURNITURE', 90000000), ('Travel', 5)) AS v(category, target))"
_RULES = """flags AS (SELECT *,
  contains(lower(coalesce(major_raw,'')), 'asia') OR contains(lower(coalesce(minor_raw,'')), 'asia') OR contains(lower(coalesce(major_raw,'')), 'japan') OR contains(lower(coalesce(minor_raw,'')), 'japan') AS m_asia,
  amount < -300000 AS m_big, amount BETWEEN -200000 AND -100000 AND starts_with(account, '1-') AS m_mid,
  contains(lower(account), 'urgent') AND NOT contains(lower(coalesce(memo_raw,'')), 'memo 3') AS m_urgent,
  lower(minor_raw) = 'france' OR regexp_matches(merchant_raw, '0{3}7[0-9]$') AS m_any,
  type_norm <> 'expense' AND amount > 250000 AS m_income FROM tx)"""

ORACLES: dict[str, str] = {
    "monthly_spend": q(f"SELECT month, {N}, {SUM} AS total_spend FROM spend GROUP BY month"),
    "monthly_spend_window": q(f"SELECT month, {N}, {SUM} AS total_spend FROM spend WHERE month BETWEEN '1997-03' AND '1998-10' GROUP BY month"),
    "tag_breakdown": q(f"SELECT tag, {N}, {SUM} AS total_spend FROM (SELECT amount, unnest(tags_list) AS tag FROM spend) GROUP BY tag ORDER BY total_spend DESC, tag LIMIT 10"),
    "monthly_consumption_summary": q(
        f"SELECT month, count(*) FILTER (NOT non) AS transaction_count, {WHOLE.format('sum(-amount) FILTER (NOT non)')} AS consumption_spend, "
        f"{WHOLE.format('sum(-amount) FILTER (non)')} AS excluded_non_consumption_spend FROM (SELECT *, {NON} AS non FROM spend WHERE type_norm = 'expense') GROUP BY month"
    ),
    "consumption_category_breakdown": q(
        f"SELECT coalesce(category_final, minor_raw, major_raw, '미분류') AS category, {N}, {WHOLE.format('sum(-amount)')} AS consumption_spend FROM ({CONSUMED}) WHERE month = '1997-05' "
        "GROUP BY 1 ORDER BY consumption_spend DESC, category LIMIT 10"
    ),
    "merchant_top_spend": q(
        f"SELECT coalesce(merchant_raw, '미상') AS merchant, {N}, {WHOLE.format('sum(-amount)')} AS consumption_spend FROM ({CONSUMED}) WHERE month = '1997-05' "
        "GROUP BY 1 ORDER BY consumption_spend DESC, merchant LIMIT 20"
    ),
    "event_adjusted_spend": q(
        f"SELECT '1997-05' AS month, 'building, machinery' AS event_tags, {N}, count(*) FILTER (ev) AS event_transaction_count, {WHOLE.format('sum(-amount)')} AS total_consumption_spend, "
        f"{WHOLE.format('sum(-amount) FILTER (ev)')} AS event_spend, {WHOLE.format('sum(-amount) FILTER (NOT ev)')} AS adjusted_consumption_spend "
        f"FROM (SELECT *, list_has_any(tags_list, ['building', 'machinery']) AS ev FROM ({CONSUMED}) WHERE month = '1997-05')"
    ),
    "recurring_candidates": q(
        "SELECT merchant_raw, CAST(abs(amount) AS DOUBLE) AS amount_krw, count(*) AS occurrences, min(date) AS first_seen, max(date) AS last_seen, "
        "CASE WHEN bool_or(regexp_matches(t, '(적금|예금|저축|savings?|deposit|isa|연금|펀드)')) THEN 'savings' WHEN bool_or(regexp_matches(t, '(대출|이자|상환|loan|interest|mortgage)')) THEN 'loan_or_interest' "
        "WHEN bool_or(regexp_matches(t, '(구독|정기지출|통신|보험|렌탈|관리비|월세|subscription|netflix|spotify|disney|gym|membership|멤버십)')) THEN 'spending' ELSE 'unknown' END AS intent, "
        "(CASE WHEN bool_or(regexp_matches(t, '(적금|예금|저축|savings?|deposit|isa|연금|펀드|대출|이자|상환|loan|interest|mortgage)')) THEN 0.9 "
        "WHEN bool_or(regexp_matches(t, '(구독|정기지출|통신|보험|렌탈|관리비|월세|subscription|netflix|spotify|disney|gym|membership|멤버십)')) THEN 0.75 ELSE 0.0 END)::DOUBLE AS intent_confidence "
        "FROM c GROUP BY merchant_raw, amount HAVING count(*) >= 3 AND abs(amount) >= 5000 ORDER BY occurrences DESC, amount_krw DESC, merchant_raw LIMIT 50",
        "c AS (SELECT minor_raw AS merchant_raw, CAST(floor(amount / 50000) * 50000 AS DECIMAL(18,2)) AS amount, date, lower(concat_ws(' ', coalesce(minor_raw,''), coalesce(major_raw,''), "
        "coalesce(minor_raw,''), coalesce(category_final,''), coalesce(memo_raw,''), array_to_string(tags_list, ' '))) AS t FROM tx WHERE amount < 0 AND NOT is_transfer_bool)",
    ),
    "anomaly_large_txn": q("SELECT date, merchant_raw, account, category_final, CAST(-amount AS DOUBLE) AS amount_krw FROM spend WHERE -amount >= 300000 ORDER BY -amount DESC, row_hash LIMIT 50"),
    "card_spend_summary": q(f"SELECT account, {N}, {SUM} AS total_spend, {AVG} AS avg_spend FROM spend GROUP BY account"),
    "merchant_monthly_trend": q(
        f"SELECT month, {N}, {SUM} AS total_spend, {AVG} AS avg_spend FROM spend, b WHERE merchant_raw ILIKE '%00001%' AND month BETWEEN b.since AND b.until GROUP BY month ORDER BY month DESC LIMIT 12",
        "b AS (SELECT max(month) AS until, strftime(CAST(max(month) || '-01' AS DATE) - INTERVAL 11 MONTH, '%Y-%m') AS since FROM spend)",
    ),
    "spend_by_weekday_hour": q(
        f"SELECT wd AS weekday_idx, ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][wd + 1] AS weekday_name, h AS hour, {N}, {SUM} AS total_spend, {AVG} AS avg_spend FROM "
        "(SELECT CAST((CAST(strftime(CAST(date AS DATE), '%w') AS INTEGER) + 6) % 7 AS INTEGER) AS wd, CAST(split_part(time, ':', 1) AS INTEGER) AS h, amount FROM spend) GROUP BY wd, h"
    ),
    "weekly_anomalies": q(
        "SELECT * FROM x WHERE abs(change_pct) > 5 OR change_type IN ('new', 'gone')",
        _age("spend") + ", c AS (SELECT category_final, sum(amount) AS t FROM aged WHERE age < 14 GROUP BY 1), p AS (SELECT category_final, sum(amount) AS t FROM aged WHERE age >= 14 AND age < 28 GROUP BY 1), "
        "x AS (SELECT coalesce(c.category_final, p.category_final) AS category, CAST(abs(coalesce(c.t, 0)) AS DOUBLE) AS current_spend, CAST(abs(coalesce(p.t, 0)) AS DOUBLE) AS prior_spend, "
        "CASE WHEN c.t IS NULL THEN 'gone' WHEN p.t IS NULL THEN 'new' ELSE 'changed' END AS change_type, "
        "CASE WHEN c.t IS NOT NULL AND p.t IS NOT NULL THEN round((CAST(abs(c.t) AS DOUBLE) - CAST(abs(p.t) AS DOUBLE)) / CAST(abs(p.t) AS DOUBLE) * 100, 1) END AS change_pct "
        "FROM c FULL JOIN p ON c.category_final = p.category_final)",
    ),
    "new_merchants": q(
        f"SELECT merchant_raw, {N}, {SUM} AS total_spend FROM aged WHERE amount < 0 AND type_norm = 'expense' AND NOT is_transfer_bool AND age < 60 AND merchant_raw NOT IN "
        "(SELECT merchant_raw FROM aged WHERE age >= 60 AND merchant_raw IS NOT NULL AND type_norm = 'expense' AND NOT is_transfer_bool) GROUP BY merchant_raw",
        _age(),
    ),
    "spending_comparison": q(
        "SELECT *, CASE WHEN prior_spend = 0 AND current_spend = 0 THEN 0.0 WHEN prior_spend <> 0 THEN round((current_spend - prior_spend) / prior_spend * 100, 1) END AS change_pct FROM "
        "(SELECT count(*) FILTER (age < 30) AS current_txn_count, CAST(coalesce(abs(sum(amount) FILTER (age < 30)), 0) AS DOUBLE) AS current_spend, "
        "count(*) FILTER (age >= 30 AND age < 60) AS prior_txn_count, CAST(coalesce(abs(sum(amount) FILTER (age >= 30 AND age < 60)), 0) AS DOUBLE) AS prior_spend FROM aged)",
        _age("spend"),
    ),
    "compare_months": _compare("category_final", "type_norm = 'expense'", _months(*[f"1996-0{k}" for k in range(1, 7)]), _months("1997-01", "1997-02")),
    "compare_accounts_all_types": _compare("account", "true", _months("1996-01"), _months("1999-01", "2010-01")),
    "confirmed_transfers": q("SELECT month, count(*) FILTER (is_transfer_bool) AS transfers, count(*) FILTER (NOT is_transfer_bool) AS others FROM tx GROUP BY month"),
    "exclude_transfers_flag_only": q(f"SELECT account, count(*) AS n, {SIGNED} AS total FROM tx WHERE is_transfer <> 1 GROUP BY account"),
    "non_consumption": q(
        f"SELECT {NON} AS excluded, major_raw, count(*) AS n FROM (SELECT * REPLACE (CASE WHEN minor_raw LIKE '%1%' THEN '주식 투자' ELSE minor_raw END AS minor_raw) FROM tx) GROUP BY 1, 2"
    ),
    "report_filter_kept": q(f"SELECT month, count(*) AS kept, {SIGNED} AS total FROM tx WHERE NOT {_ANY} GROUP BY month"),
    "report_filter_excluded": q(f"SELECT count(*) FILTER ({_ANY}) AS excluded, " + ", ".join(f"count(*) FILTER ({r}) AS rule_{k}" for k, r in enumerate((_RULE0, _RULE1, _RULE2, _RULE3, _RULE4))) + " FROM tx"),
    "untagged_rows": q("SELECT account, count(*) AS n FROM tx WHERE len(tags_list) = 0 GROUP BY account"),
    "rule_matched_rows": q("SELECT account, count(*) AS n FROM tx WHERE len(tags_rule_list) > 0 OR trim(coalesce(category_rule, '')) <> '' GROUP BY account"),
    "review_predicates": q(
        f"SELECT account, count(*) FILTER ({_ATTENTION}) AS attention, count(*) FILTER (confidence IS NULL OR confidence < 0.5) AS low, count(*) FILTER (list_contains(tags_list, 'building')) AS tagged FROM tx GROUP BY account"
    ),
    "search_ilike": q("SELECT date, row_hash, merchant_raw, memo_raw FROM tx WHERE merchant_raw ILIKE '%memo 5%' OR memo_raw ILIKE '%memo 5%' ORDER BY date DESC, row_hash LIMIT 10"),
    "date_range_filter": q("SELECT date, time, row_hash, account FROM tx WHERE date BETWEEN '1996-05-10' AND '1996-05-20'"),
    "period_filter": q("SELECT row_hash, merchant_raw, CAST(amount AS DOUBLE) AS amount FROM tx WHERE month = '1997-11' AND contains(merchant_raw, '#00000000')"),
    "signed_monthly_spend": q(f"SELECT month, {N}, {SIGNED} AS total_amount FROM tx GROUP BY month"),
    "signed_tag_breakdown": q(f"SELECT tag, {N}, {SIGNED} AS total_amount FROM (SELECT amount, unnest(tags_list) AS tag FROM spend) GROUP BY tag ORDER BY total_amount, tag LIMIT 100"),
    "top_merchants": q(f"SELECT merchant_raw, {N}, {SIGNED} AS total_amount, {SIGNED} / count(*) AS avg_amount FROM spend GROUP BY merchant_raw ORDER BY total_amount, merchant_raw LIMIT 25"),
    "account_summary": q(
        f"SELECT account, {N}, CAST(coalesce(sum(amount) FILTER (amount < 0), 0) AS DOUBLE) AS total_expense, CAST(coalesce(sum(amount) FILTER (amount > 0), 0) AS DOUBLE) AS total_income, "
        f"{SIGNED} AS net FROM tx WHERE NOT is_transfer_bool GROUP BY account"
    ),
    "spend_movers": q(
        "SELECT label, now - before AS delta_krw, CASE WHEN now >= before THEN 'up' ELSE 'down' END AS direction FROM "
        f"(SELECT coalesce(nullif(category_final, ''), '미분류') AS label, {WHOLE.format('sum(-amount) FILTER (age < 30)')} AS now, {WHOLE.format('sum(-amount) FILTER (age >= 30 AND age < 60)')} AS before "
        "FROM aged GROUP BY 1) WHERE now <> 0 OR before <> 0 ORDER BY abs(now - before) DESC, label LIMIT 10",
        _age("spend").replace("FROM tx)", "FROM spend)"),
    ),
    "report_monthly_refunds": q(
        f"SELECT month, {N}, CAST(round(-sum(CASE WHEN source_row % 9 = 0 THEN abs(amount) ELSE amount END), 0) AS DOUBLE) AS total_spend FROM tx WHERE type_norm = 'expense' AND NOT is_transfer_bool GROUP BY month"
    ),
    "report_by_tag": q(
        "SELECT tag, transaction_count, CAST(-s AS DOUBLE) AS total_spend, round(CAST(s AS DOUBLE) / CAST((SELECT sum(s) FROM g) AS DOUBLE) * 100, 1) AS percentage FROM g ORDER BY total_spend DESC, tag LIMIT 6",
        f"g AS (SELECT tag, {N}, sum(amount) AS s FROM (SELECT amount, unnest(tags_list) AS tag FROM tx WHERE type_norm = 'expense' AND NOT is_transfer_bool) GROUP BY tag)",
    ),
    "report_by_category": q(f"SELECT coalesce(nullif(trim(category_final), ''), '미분류') AS category_final, {N}, CAST(-sum(amount) AS DOUBLE) AS total_spend FROM tx WHERE type_norm = 'expense' AND NOT is_transfer_bool GROUP BY 1"),
    "report_by_account": q(f"SELECT account, {N}, CAST(-sum(amount) AS DOUBLE) AS total_spend FROM tx WHERE type_norm = 'expense' AND NOT is_transfer_bool GROUP BY 1"),
    "report_transfers": q("SELECT date, time, merchant_raw, account, CAST(amount AS DOUBLE) AS amount, transfer_group_id, row_hash FROM tx WHERE is_transfer_bool"),
    "report_top_merchants": q(f"SELECT merchant_raw, {N}, CAST(-sum(amount) AS DOUBLE) AS total_spend FROM tx WHERE type_norm = 'expense' AND NOT is_transfer_bool GROUP BY 1 ORDER BY total_spend DESC, merchant_raw LIMIT 15"),
    "summary_stats": q(
        f"SELECT {N}, -CAST(coalesce(sum(amount) FILTER (type_norm = 'expense'), 0) AS DOUBLE) AS total_expense, CAST(coalesce(sum(amount) FILTER (type_norm = 'income'), 0) AS DOUBLE) AS total_income, "
        f"{SIGNED} AS net, min(date) AS first_date, max(date) AS last_date FROM tx WHERE NOT is_transfer_bool"
    ),
    "date_range": q("SELECT min(date) AS first_date, max(date) AS last_date, count(DISTINCT month) AS months FROM tx"),
    "structural_savings": q(
        "SELECT category, label, CAST(sum(w) AS BIGINT) AS amount, count(*) AS transaction_count, count(DISTINCT month) AS months, "
        "CAST(round(CAST(sum(w) AS DOUBLE) / (SELECT count(DISTINCT month) FROM tx), 0) AS BIGINT) AS monthly_amount FROM s GROUP BY category, label",
        "s AS (SELECT coalesce(nullif(trim(category_final), ''), '미분류') AS category, array_to_string(list_sort(list_intersect(tags_list, ['building', 'machinery'])), ', ') AS label, "
        "CAST(round(-amount, 0) AS BIGINT) AS w, month FROM spend WHERE list_has_any(tags_list, ['building', 'machinery']))",
    ),
    "savings_rate": q(
        "SELECT CAST(round(CAST(sum(income) AS DOUBLE) / count(*), 0) AS BIGINT) AS monthly_avg_income, CAST(round(CAST(sum(expense) AS DOUBLE) / count(*), 0) AS BIGINT) AS monthly_avg_expense, "
        "CAST(round(CAST(sum(greatest(expense - st, 0)) AS DOUBLE) / count(*), 0) AS BIGINT) AS monthly_avg_consumption_expense, CAST(round(CAST(sum(least(st, expense)) AS DOUBLE) / count(*), 0) AS BIGINT) AS structural_monthly_avg, "
        "CASE WHEN any_value(i) > 0 THEN round((any_value(i) - any_value(e)) / any_value(i), 2) END AS savings_rate_3mo, "
        "CASE WHEN any_value(i) > 0 THEN round((any_value(i) - greatest(any_value(e) - any_value(s), 0.0)) / any_value(i), 2) END AS consumption_savings_rate_3mo FROM m, r",
        "m AS (SELECT month, coalesce(sum(amount) FILTER (amount > 0), 0) AS income, coalesce(sum(-amount) FILTER (amount < 0), 0) AS expense, "
        "coalesce(sum(round(-amount, 0)) FILTER (amount < 0 AND list_has_any(tags_list, ['building', 'machinery'])), 0) AS st FROM tx WHERE NOT is_transfer_bool GROUP BY month), "
        "r AS (SELECT CAST(sum(income) AS DOUBLE) AS i, CAST(sum(expense) AS DOUBLE) AS e, CAST(sum(st) AS DOUBLE) AS s FROM (SELECT * FROM m ORDER BY month DESC LIMIT 3))",
    ),
    "monthly_income_expense": q(
        "SELECT month, CAST(coalesce(sum(amount) FILTER (amount > 0), 0) AS DOUBLE) AS income, CAST(coalesce(sum(-amount) FILTER (amount < 0), 0) AS DOUBLE) AS expense FROM tx WHERE NOT is_transfer_bool GROUP BY month"
    ),
    "top_categories": q(
        "SELECT coalesce(nullif(trim(category_final), ''), nullif(trim(category_rule), ''), nullif(trim(minor_raw), ''), nullif(trim(major_raw), ''), '미분류') AS name, CAST(round(-sum(amount), 0) AS BIGINT) AS amount "
        "FROM spend GROUP BY 1 ORDER BY amount DESC, name LIMIT 8"
    ),
    "status_metrics": q(
        "SELECT count(*) AS total_rows, min(date) AS first_date, max(date) AS last_date, count(*) FILTER (len(tags_list) = 0) AS untagged_count, count(*) FILTER (len(tags_list) = 0 AND NOT is_transfer_bool) AS suggestable_untagged_count, "
        "count(*) FILTER (is_transfer = 1) AS transfer_candidate_count, count(*) FILTER (is_transfer_bool) AS transfer_excluded_count, count(*) FILTER (is_transfer_bool AND len(tags_list) = 0) AS transfer_excluded_untagged_count, "
        "greatest(count(*) FILTER (is_transfer = 1) - count(*) FILTER (is_transfer_bool), 0) AS unconfirmed_transfer_candidate_count FROM tx"
    ),
    "top_untagged_merchants": q('SELECT merchant_raw, count(*) AS "count" FROM tx WHERE len(tags_list) = 0 AND trim(merchant_raw) <> \'\' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20'),
    "suggestion_coverage": q(
        "SELECT *, round((total_count - untagged_count) / total_count * 100, 2) AS coverage_before_pct, round((suggestable_total_count - suggestable_untagged_count) / suggestable_total_count * 100, 2) AS suggestable_coverage_before_pct FROM "
        "(SELECT count(*) AS total_count, count(*) FILTER (len(tags_list) = 0) AS untagged_count, count(*) FILTER (NOT is_transfer_bool) AS suggestable_total_count, count(*) FILTER (NOT is_transfer_bool AND len(tags_list) = 0) AS suggestable_untagged_count, "
        "count(*) FILTER (is_transfer_bool) AS transfer_excluded_count, count(*) FILTER (is_transfer_bool AND len(tags_list) = 0) AS transfer_excluded_untagged_count FROM tx)"
    ),
    "merchant_context": q(
        "SELECT merchant_raw AS merchant, count(*) AS transaction_count, CAST(sum(abs(amount)) AS DOUBLE) AS total_amount, CAST(sum(abs(amount)) AS DOUBLE) / count(*) AS avg_amount, "
        "round(coalesce(stddev_samp(CAST(abs(amount) AS DOUBLE)), 0), 2) AS amount_stddev, string_agg(DISTINCT month, ',' ORDER BY month) AS active_months, min(major_raw) AS major_raw, min(minor_raw) AS minor_raw, "
        "(SELECT account FROM u v WHERE v.merchant_raw = u.merchant_raw GROUP BY account ORDER BY count(*) DESC, account LIMIT 1) AS payment_method, "
        "count(*) FILTER (isodow(CAST(date AS DATE)) <= 5) / count(*) AS weekday_pct, count(*) FILTER (CAST(substr(time, 1, 2) AS INTEGER) BETWEEN 11 AND 13) / count(*) AS lunch_pct, "
        "count(DISTINCT month) >= 2 AS is_recurring, coalesce((SELECT string_agg(memo_raw, ',' ORDER BY n DESC, memo_raw) FROM (SELECT v.memo_raw, count(*) AS n FROM u v WHERE v.merchant_raw = u.merchant_raw AND trim(v.memo_raw) <> '' GROUP BY v.memo_raw ORDER BY n DESC, v.memo_raw LIMIT 3)), '') AS sample_memos FROM u GROUP BY merchant_raw HAVING count(*) >= 2 ORDER BY transaction_count DESC, merchant LIMIT 200",
        "u AS (SELECT * FROM tx WHERE len(tags_list) = 0 AND NOT is_transfer_bool AND trim(merchant_raw) <> '' AND NOT regexp_matches(merchant_raw, '^[0-9]+$'))",
    ),
    "tagged_merchants": q(
        "SELECT merchant_raw AS merchant, coalesce(nullif(trim(category_rule), ''), nullif(trim(minor_raw), ''), nullif(trim(major_raw), ''), '미분류') AS category, CAST(sum(abs(amount)) AS DOUBLE) / count(*) AS avg_amount, "
        "count(*) AS transaction_count FROM tx WHERE len(tags_list) > 0 AND NOT is_transfer_bool AND trim(merchant_raw) <> '' AND NOT regexp_matches(merchant_raw, '^[0-9]+$') GROUP BY 1, 2 HAVING count(*) >= 2"
    ),
    "nearest_merchants": q(
        "SELECT name, near, category, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY name ORDER BY d, near) AS INTEGER) AS rank FROM (SELECT a.name, b.name AS near, b.category, abs(a.v - b.v) / greatest(a.v, b.v) AS d FROM a JOIN b ON a.name <> b.name) WHERE d < 0.5) WHERE rank <= 3",
        "a AS (SELECT minor_raw AS name, CAST(sum(abs(amount)) AS DOUBLE) / count(*) AS v FROM tx WHERE len(tags_list) = 0 AND NOT is_transfer_bool GROUP BY 1 HAVING count(*) >= 2), "
        "b AS (SELECT minor_raw || '-' || account AS name, coalesce(category_rule, minor_raw) AS category, CAST(sum(abs(amount)) AS DOUBLE) / count(*) AS v FROM tx WHERE len(tags_list) > 0 AND NOT is_transfer_bool GROUP BY 1, 2 HAVING count(*) >= 2)",
    ),
    "merchant_clusters": q(
        "SELECT lower(regexp_replace(m, '[^a-zA-Z0-9]', '', 'g')) AS cluster, count(DISTINCT m) AS names, count(*) AS transaction_count, min(m) AS first_name FROM "
        "(SELECT CASE WHEN source_row % 2 = 0 THEN upper(replace(merchant_raw, '#', ' ')) ELSE merchant_raw END AS m FROM tx WHERE NOT is_transfer_bool AND merchant_raw IS NOT NULL) GROUP BY 1 HAVING count(DISTINCT m) >= 2"
    ),
    "coverage_simulation": q(
        "SELECT CAST(n AS BIGINT) AS top_n, CAST(t.tagged + g AS BIGINT) AS expected_tagged, round((t.tagged + g) / t.total * 100, 4) AS expected_coverage_pct, round((t.tagged + g) / t.total * 100 - t.tagged / t.total * 100, 4) AS improvement_pct FROM "
        "(SELECT count(*) AS total, count(*) FILTER (len(tags_list) > 0) AS tagged FROM tx) t, (SELECT n, sum(c) FILTER (r <= n) AS g FROM k, (VALUES (5), (10), (20)) AS v(n) GROUP BY n)",
        "k AS (SELECT count(*) AS c, row_number() OVER (ORDER BY count(*) DESC, merchant_raw) AS r FROM tx WHERE len(tags_list) = 0 GROUP BY merchant_raw)",
    ),
    "budget_status": q(
        "SELECT category, target, actual, target - actual AS remaining, CASE WHEN target > 0 THEN round(actual / target * 100, 1) END AS used_pct, "
        "CASE WHEN target IS NULL THEN 'unbudgeted' WHEN actual > target THEN 'over' WHEN actual >= 0.9 * target THEN 'on-track' ELSE 'under' END AS status FROM "
        "(SELECT coalesce(t.category, a.category) AS category, CAST(target AS BIGINT) AS target, coalesce(actual, 0) AS actual FROM t FULL JOIN a ON t.category = a.category)",
        f"{_BUDGET}, a AS (SELECT coalesce(nullif(trim(category_final), ''), '미분류') AS category, {WHOLE.format('sum(-amount)')} AS actual FROM ({CONSUMED}) WHERE month = '1997-05' GROUP BY 1)",
    ),
    "budget_name_hints": "SELECT t.n AS target, c AS category FROM (VALUES ('build'), ('automobile club'), ('none')) t(n), (SELECT DISTINCT c_mktsegment AS c FROM customer) WHERE contains(lower(c), lower(t.n)) OR contains(lower(t.n), lower(c))",
    "recurring_obligations": q(
        'SELECT label, count(*) AS months, min(month) AS first_month, max(month) AS last_month, round(CAST(sum(t) AS DOUBLE) / count(*), 2) AS monthly_mean, round((CAST(max(t) AS DOUBLE) - CAST(min(t) AS DOUBLE)) / CAST(max(t) AS DOUBLE), 4) AS "range" '
        "FROM m WHERE lower(label) <> 'france' GROUP BY label HAVING count(*) >= 6 AND max(o) - min(o) + 1 = count(*) AND CAST(sum(t) AS DOUBLE) / count(*) >= 300000 AND (CAST(max(t) AS DOUBLE) - CAST(min(t) AS DOUBLE)) / CAST(max(t) AS DOUBLE) <= 0.95",
        "m AS (SELECT minor_raw AS label, month, CAST(substr(month, 1, 4) AS INTEGER) * 12 + CAST(substr(month, 6, 2) AS INTEGER) AS o, -sum(amount) AS t FROM spend WHERE type_norm = 'expense' GROUP BY 1, 2, 3)",
    ),
    "review_pressure": q(
        f"SELECT count(*) AS total, count(*) FILTER (needs_review = 1) AS flagged, count(*) FILTER (len(tags_list) = 0) AS untagged, count(*) FILTER (confidence IS NULL OR confidence < 0.7) AS low_confidence, count(*) FILTER ({_STATES}) AS uncategorised, count(*) FILTER ({_ATTENTION}) AS queue FROM tx"
    ),
    "review_queue": q(f"SELECT row_hash, date, merchant_raw, CAST(amount AS DOUBLE) AS amount, CAST(confidence AS DOUBLE) AS confidence FROM tx WHERE {_ATTENTION} ORDER BY confidence ASC NULLS FIRST, date DESC, row_hash LIMIT 40"),
    "large_transactions": q('SELECT row_hash, date, merchant_raw, CAST(-amount AS DOUBLE) AS amount, (SELECT count(*) FROM spend WHERE -amount >= 400000) AS "count" FROM spend WHERE -amount >= 400000 ORDER BY -amount DESC, row_hash LIMIT 10'),
    "retry_recovery": (
        "WITH l AS (SELECT event_id, ts, CASE WHEN (event_id // 4) % 2 = 0 THEN 'spend' WHEN event_type = 'click' THEN 'asset_list' ELSE event_type END AS t, CASE WHEN event_id % 10 = 0 THEN 'asset' WHEN (event_id // 4) % 2 <> 0 AND event_type = 'click' THEN 'asset' ELSE 'transaction' END AS domain, "
        "event_id // 4 AS p, event_id % 3 <> 0 AS ok, value FROM events), w AS (SELECT *, lag(t) OVER o AS pt, lag(p) OVER o AS pp, lag(ok) OVER o AS pok, lag(domain) OVER o AS pd FROM l WINDOW o AS (ORDER BY ts, event_id)), "
        "r AS (SELECT pd AS domain, count(*) AS a, count(*) FILTER (ok) AS k FROM w WHERE pt = t AND pp = p AND NOT pok GROUP BY pd) "
        "SELECT l.domain, count(*) AS runs, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(*), 4) AS avg_duration, "
        "coalesce(any_value(a), 0) AS retry_attempts, coalesce(any_value(k), 0) AS recovered_retries, round(count(*) FILTER (ok) / count(*), 4) AS success_rate, "
        "CASE WHEN coalesce(any_value(a), 0) > 0 THEN round(any_value(k) / any_value(a), 4) ELSE 0.0 END AS recovery_rate FROM l LEFT JOIN r ON l.domain = r.domain GROUP BY l.domain"
    ),
    "freshness": (
        "SELECT domain, strftime(latest, '%Y-%m-%d') AS latest, CAST(date_diff('day', latest, DATE '2024-12-31') AS INTEGER) AS days_since, threshold_days, CASE WHEN latest IS NULL THEN 'missing' WHEN date_diff('day', latest, DATE '2024-12-31') > threshold_days THEN 'stale' ELSE 'fresh' END AS status FROM "
        "(SELECT 'orders' AS domain, max(CAST(o_orderdate AS DATE)) AS latest, 30 AS threshold_days FROM orders UNION ALL SELECT 'events', max(CAST(ts AS DATE)), 400 FROM events UNION ALL SELECT 'none', NULL, 1)"
    ),
    "anti_join": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) GROUP BY 1",
    "nullsafe_anti_join": (
        "WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders), b AS (SELECT l_orderkey AS k, CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE l_linestatus END AS s FROM lineitem WHERE l_returnflag = 'R') "
        "SELECT s, count(*) AS n FROM a ANTI JOIN b ON a.k = b.k AND a.s IS NOT DISTINCT FROM b.s GROUP BY s"
    ),
    "dedup_keep_first": q("SELECT account, month, row_hash, CAST(amount AS DOUBLE) AS amount FROM (SELECT *, row_number() OVER (PARTITION BY account, month ORDER BY source_row, file_id) AS r FROM tx) WHERE r = 1"),
    "asof_snapshot": f"WITH {_SNAP} SELECT snapshot_date, account_id, count(*) AS n FROM snap WHERE snapshot_date = (SELECT max(snapshot_date) FROM snap WHERE snapshot_date <= '1997-07-15') GROUP BY 1, 2",
    "asset_status": f"WITH {_SNAP} SELECT snapshot_date, account_id, CAST(sum(market_value) AS DOUBLE) AS total_value, count(*) AS positions FROM snap WHERE snapshot_date = (SELECT max(snapshot_date) FROM snap) GROUP BY 1, 2",
    "holdings": f"WITH {_SNAP} SELECT account_id, instrument_id, CAST(count(*) AS DOUBLE) AS quantity, CAST(sum(market_value) AS DOUBLE) AS market_value, 'KRW' AS currency FROM snap WHERE snapshot_date = (SELECT max(snapshot_date) FROM snap) AND contains(account_id, 'URGENT') GROUP BY 1, 2 ORDER BY market_value DESC, account_id, instrument_id LIMIT 50",
    "merge_precedence": f"WITH {_ASSETS} SELECT name, category, CAST(value AS DOUBLE) AS value, source FROM assets",
    "networth_position": f"WITH {_ASSETS} SELECT CAST(sum(value) AS DOUBLE) AS total_assets, 120000.0::DOUBLE AS total_liabilities, CAST(sum(value) - 120000 AS DOUBLE) AS net_worth FROM assets",
    "networth_breakdown": f"WITH {_ASSETS} SELECT category, CAST(sum(value) AS DOUBLE) AS value, round(CAST(sum(value) AS DOUBLE) / CAST((SELECT sum(value) FROM assets) AS DOUBLE) * 100, 2) AS share_pct FROM assets GROUP BY category",
    "networth_history": (
        f"WITH {_SNAP}, p AS (SELECT substr(snapshot_date, 1, 7) AS m, max(snapshot_date) AS d FROM snap GROUP BY 1) SELECT d AS as_of, "
        "CAST(coalesce((SELECT sum(market_value) FROM snap WHERE snapshot_date = d AND lower(trim(instrument_id)) NOT IN (SELECT lower(trim(name)) FROM manual)), 0) + (SELECT CAST(sum(value) AS DECIMAL(18,2)) FROM manual) AS DOUBLE) - 5000.0 AS net_worth FROM p ORDER BY as_of DESC LIMIT 12"
    ),
    "transfer_candidates": f"WITH {_EVENTS} SELECT major_raw, out_row_hash, in_row_hash, ratio, delta_s FROM near",
    "set_operators": (
        "SELECT count(*) AS n, CAST(sum(k) AS BIGINT) AS total, 'intersect' AS op FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL "
        "SELECT count(*), CAST(sum(k) AS BIGINT), 'except' FROM (SELECT c_custkey AS k FROM customer EXCEPT ALL SELECT o_custkey FROM orders) UNION ALL "
        "SELECT count(*), CAST(sum(k) AS BIGINT), 'union_all' FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT c_custkey FROM customer)"
    ),
    "grouping_sets": q(f"SELECT account, type_norm, count(*) AS n, {SIGNED} AS total FROM tx GROUP BY ROLLUP (account, type_norm)"),
    "unnest_tags": q("SELECT row_hash, CAST(unnest(range(len(tags_list))) AS INTEGER) AS pos, unnest(tags_list) AS tag FROM tx"),
    "row_hash": q("SELECT source_row, substr(sha256(concat_ws('|', date, time, type_raw, merchant_raw, CAST(amount AS VARCHAR), currency, account)), 1, 16) AS row_hash FROM tx"),
    "normalize_type": (
        "WITH r AS (SELECT ['카드지출','출금이체','급여수입','입금','계좌이체','기타',''][o_orderkey % 7 + 1] AS raw, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders), t AS (SELECT raw, p, CASE WHEN raw LIKE '%지출%' OR raw LIKE '%출금%' THEN 'expense' "
        "WHEN raw LIKE '%수입%' OR raw LIKE '%입금%' THEN 'income' WHEN raw LIKE '%이체%' THEN 'transfer' ELSE 'other' END AS type_norm FROM r) "
        "SELECT raw, type_norm, count(*) AS n, CAST(sum(CASE WHEN type_norm = 'income' THEN p ELSE -p END) AS DOUBLE) AS total, count(*) FILTER (p < 0.01 OR p > 999000000) AS suspicious FROM t GROUP BY 1, 2"
    ),
    "category_chain": q("SELECT CASE WHEN source_row % 23 = 0 THEN 'own' ELSE coalesce(nullif(trim(category_rule), ''), CASE WHEN source_row % 3 = 0 THEN nullif(trim(minor_raw), '') END, '미분류') END AS category, count(*) AS n FROM tx GROUP BY 1"),
    "merged_tags": q(
        "SELECT array_to_string(tags, ',') AS tags, 'Own' AS category, count(*) AS n FROM (SELECT list_filter(c, lambda x, i: list_position(c, x) = i) AS tags FROM "
        "(SELECT list_concat(list_concat(tags_rule_list, tags_list), list_concat(tags_manual_list, ['rule'])) AS c FROM tx)) GROUP BY 1, 2"
    ),
    "parse_numbers": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN round(p_retailprice, 2) WHEN 1 THEN -round(p_retailprice, 2) WHEN 2 THEN CAST(p_size * 10000 AS DOUBLE) END AS number FROM part",
    "parse_dates": (
        "SELECT CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS parsed, CASE o_orderkey % 4 WHEN 0 THEN '2000-01' WHEN 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m') END AS period, count(*) AS n FROM orders GROUP BY 1, 2"
    ),
    "derived_ids": "SELECT c_custkey, 'acc_' || substr(sha256(regexp_replace(lower(c_name), '[ _-]', '', 'g')), 1, 12) AS account_id, substr(sha256(lower(trim(c_name)) || '||' || c_nationkey), 1, 16) AS fact_id FROM customer",
    "clean_times": "SELECT CASE WHEN o_orderkey % 5 < 2 THEN '00:00' ELSE lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':05' END AS time, count(*) AS n FROM orders GROUP BY 1",
    "text_cleanup": (
        "SELECT c_custkey, CASE WHEN starts_with(n, '=') THEN '''' || n ELSE n END AS safe, regexp_replace(n, '[0-9]+', '#', 'g') AS masked, lower(regexp_replace(n, '[^\\p{L}\\p{N}]', '', 'g')) AS key, 'see [path] and [file] ' || n AS redacted FROM "
        "(SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '=' || c_name ELSE c_mktsegment || ' 강남점 12' END AS n FROM customer)"
    ),
    "export_master": q("SELECT row_hash, date, time, merchant_raw, array_to_string(tags_list, ', ') AS tags_final, category_final, CAST(amount AS DOUBLE) AS amount FROM tx"),
    "tag_rules": q(
        "SELECT row_hash, array_to_string(list_concat(list_concat(list_concat(CASE WHEN m_asia THEN ['asia','far'] ELSE CAST([] AS VARCHAR[]) END, CASE WHEN m_big THEN ['big'] ELSE CAST([] AS VARCHAR[]) END), list_concat(CASE WHEN m_mid THEN ['mid'] ELSE CAST([] AS VARCHAR[]) END, "
        "CASE WHEN m_urgent THEN ['urgent'] ELSE CAST([] AS VARCHAR[]) END)), list_concat(CASE WHEN m_any THEN ['any'] ELSE CAST([] AS VARCHAR[]) END, CASE WHEN m_income THEN ['income'] ELSE CAST([] AS VARCHAR[]) END)), ',') AS tags, "
        "c AS category_rule, coalesce(c, nullif(trim(minor_raw), ''), nullif(trim(major_raw), ''), '미분류') AS category_final, CAST(CASE WHEN hit THEN 1.0 ELSE 0.0 END AS DOUBLE) AS confidence, CAST(CASE WHEN hit THEN 0 ELSE 1 END AS BIGINT) AS needs_review FROM "
        "(SELECT *, CASE WHEN m_asia THEN 'Asia' WHEN m_mid THEN 'Middle' WHEN m_urgent THEN 'Urgent' WHEN m_income THEN 'Income' END AS c, m_asia OR m_big OR m_mid OR m_urgent OR m_any OR m_income AS hit FROM flags)",
        _RULES,
    ),
    "explain_rules": q(
        "SELECT concat_ws(',', CASE WHEN m_asia THEN 'asia' END, CASE WHEN m_big THEN 'big' END, CASE WHEN m_mid THEN 'mid' END, CASE WHEN m_urgent THEN 'urgent' END, CASE WHEN m_any THEN 'any' END, CASE WHEN m_income THEN 'income' END) AS rules, count(*) AS n FROM flags GROUP BY 1",
        _RULES,
    ),
    "rule_dry_run": q(
        "SELECT count(*) AS total, count(*) FILTER (m_asia) AS matched, CAST(coalesce(sum(abs(amount)) FILTER (m_asia), 0) AS DOUBLE) AS matched_amount, count(*) FILTER (m_asia AND len(tags_list) = 0) AS newly_tagged, count(*) FILTER (m_asia OR len(tags_list) > 0) AS tagged_after FROM flags",
        _RULES,
    ),
    "rule_month_distribution": q("SELECT month, count(*) AS matched FROM flags WHERE m_mid GROUP BY month", _RULES),
    "rule_cotags_top": q('SELECT tag, count(*) AS "count" FROM (SELECT unnest(tags_list) AS tag FROM flags WHERE m_asia) GROUP BY tag ORDER BY 2 DESC, tag LIMIT 5', _RULES),
    "query_page": q("SELECT * FROM (SELECT account, month, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM tx WHERE NOT is_transfer_bool GROUP BY account, month) WHERE n > 1 ORDER BY month, account OFFSET 20 LIMIT 30"),
    "overview_balance": (
        "WITH s AS (SELECT s_nationkey, CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS v FROM supplier GROUP BY 1) SELECT side, category, item_name, amount, source_row FROM "
        "(SELECT 'asset' AS side, r_name AS category, n_name AS item_name, v AS amount, CAST(n_nationkey + 4 AS BIGINT) AS source_row FROM nation JOIN region ON n_regionkey = r_regionkey JOIN s ON s_nationkey = n_nationkey "
        "UNION ALL SELECT 'liability', r_name, 'L ' || n_name, -1000.0, CAST(n_nationkey + 4 AS BIGINT) FROM nation JOIN region ON n_regionkey = r_regionkey)"
    ),
    "tpch_q1": (
        "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS sum_base_price, "
        "CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2)))) AS DOUBLE) AS sum_disc_price, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"
    ),
}

_CELL = "coalesce(CAST({agg} FILTER (WHERE b = '{v}') AS {t}), 0) AS \"{v}\""


def _pivot(row: str, name: str, rows: str, values: tuple[str, ...], agg: str = "sum(abs(amount))", kind: str = "DOUBLE") -> str:
    cells = ", ".join(_CELL.format(agg=agg, v=v, t=kind) for v in values)
    return q(f'SELECT {row} AS "{name}", {cells} FROM ({rows}) GROUP BY 1')


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_TAGS = (*map(str.lower, _SEGMENTS), "1-urgent", "2-high", "3-medium", "4-not specified", "5-low")
# the column values of the other-bucket pivot depend on the data, so that query has no fixed SQL
ORACLES |= {
    "pivot_month_category": _pivot("month", "month", "SELECT month, amount, coalesce(nullif(trim(category_final), ''), '_unknown_') AS b FROM tx WHERE NOT is_transfer_bool", (*_SEGMENTS, "_unknown_")),
    "pivot_quarter_count": _pivot(
        "substr(date, 1, 4) || '-Q' || quarter(CAST(date AS DATE))", "quarter", "SELECT date, amount, type_norm AS b FROM tx WHERE NOT is_transfer_bool", ("expense", "income"), "count(*)", "BIGINT"
    ),
    "pivot_tags": _pivot("account", "account", "SELECT account, amount, unnest(tags_list) AS b FROM tx WHERE NOT is_transfer_bool", _TAGS, "max(abs(amount))"),
    "gap_analysis": q(
        "SELECT merchant_raw, transaction_count, total_amount, array_to_string(t, ',') AS tags, raw AS category, CASE WHEN len(t) > 0 THEN want END AS expected_category, "
        "CASE WHEN len(t) = 0 THEN 'CRITICAL' WHEN raw = want THEN 'COMPLETE' WHEN contains(raw, '기타') THEN 'MISMATCH' ELSE 'PARTIAL' END AS gap_type, "
        "CASE WHEN len(t) = 0 OR raw = want THEN 'none' WHEN noise THEN 'low' WHEN split_part(raw, ':', 1) <> split_part(want, ':', 1) AND split_part(raw, ':', 1) <> '기타' AND split_part(want, ':', 1) <> '기타' THEN 'high' ELSE 'medium' END AS severity, "
        "len(t) = 0 OR raw = want OR NOT noise AS actionable FROM (SELECT *, coalesce(mapped[1], '기타:기타') AS want, len(t) > 1 AND list_contains(mapped, raw) AND raw <> coalesce(mapped[1], '기타:기타') AS noise FROM g)",
        "g AS (SELECT merchant_raw, transaction_count, total_amount, t, raw, list_filter(list_transform(t, lambda x: CASE x WHEN 'building' THEN 'ASIA:INDIA' WHEN 'machinery' THEN 'AMERICA:CANADA' WHEN '1-urgent' THEN 'EUROPE:FRANCE' END), lambda x: x IS NOT NULL) AS mapped FROM "
        "(SELECT merchant_raw, count(*) AS transaction_count, CAST(abs(sum(amount)) AS DOUBLE) AS total_amount, first(tags_list ORDER BY date, time, row_hash) AS t, first(coalesce(major_raw, '기타') || ':' || coalesce(minor_raw, '기타') ORDER BY date, time, row_hash) AS raw FROM tx GROUP BY merchant_raw))",
    ),
    "next_actions": q(
        "SELECT * FROM (SELECT 2 AS priority, 'freshness' AS domain, 'import' AS command, 'stale' AS status UNION ALL SELECT DISTINCT 2, 'budget', 'budget', 'over' FROM a JOIN t ON a.category = t.category WHERE actual > target)",
        f"{_BUDGET}, a AS (SELECT coalesce(nullif(trim(category_final), ''), '미분류') AS category, {WHOLE.format('sum(-amount)')} AS actual FROM ({CONSUMED}) WHERE month = '1997-05' GROUP BY 1)",
    ),
}

# every item folds by itself, so the fold is a recursion per item; format rounds the exact binary value, as the fold does
_FORECAST = """rates(scenario, fin, est) AS (VALUES ('bear', -0.02, 0.0), ('base', 0.04, 0.02), ('bull', 0.08, 0.03)),
start AS (SELECT c_mktsegment AS item, c_mktsegment = 'BUILDING' AS estate, CAST(sum(CAST(greatest(c_acctbal, 0) AS DECIMAL(18,2))) AS DOUBLE) AS v FROM customer GROUP BY 1),
items AS (SELECT scenario, item, CASE WHEN estate THEN est ELSE fin END::DOUBLE AS r, v, 0.0::DOUBLE AS plus, true AS own FROM start, rates
  UNION ALL SELECT scenario, 'savings', fin, 0.0, 1500.0, true FROM rates UNION ALL SELECT scenario, 'mortgage', 0.035 + 0.005, 80000.0, 0.0, false FROM rates UNION ALL SELECT scenario, 'card', 0.0, 1200.0, 0.0, false FROM rates),
fold(scenario, item, own, r, plus, k, d, v) AS (SELECT scenario, item, own, r, plus, 0, DATE '2024-01-31', v FROM items
  UNION ALL SELECT scenario, item, own, r, plus, k + 1, CAST(d + INTERVAL 1 MONTH AS DATE), CAST(format('{:.2f}', CAST(format('{:.2f}', v * (1.0 + r / 12.0)) AS DOUBLE) + plus) AS DOUBLE) FROM fold WHERE k < 120),
points AS (SELECT scenario, strftime(d, '%Y-%m-%d') AS date, round(sum(v) FILTER (own), 2) AS total_assets, round(sum(v) FILTER (NOT own), 2) AS total_liabilities,
  round(round(sum(v) FILTER (own), 2) - round(sum(v) FILTER (NOT own), 2), 2) AS net_worth, 0 AS events FROM fold GROUP BY scenario, d)"""
ORACLES |= {
    "forecast": f"WITH RECURSIVE {_FORECAST} SELECT * FROM points",
    "forecast_summary": (
        f"WITH RECURSIVE {_FORECAST}, s AS (SELECT scenario, min(date) AS \"start\", max(date) AS \"end\", arg_min(net_worth, date) AS start_net_worth, arg_max(net_worth, date) AS end_net_worth, CAST(sum(events) AS BIGINT) AS events_count, "
        "min(date) FILTER (net_worth >= 1000000) AS target_reached_at FROM points GROUP BY scenario) SELECT *, CASE WHEN start_net_worth > 0 AND end_net_worth > 0 THEN round(pow(end_net_worth / start_net_worth, 0.1) - 1, 6) END AS cagr FROM s"
    ),
    "overview_facts": (
        "WITH v AS (SELECT count(DISTINCT s_nationkey) AS n FROM supplier) SELECT 'balance' AS block_id, t AS value_type, k AS n, k AS ids FROM (SELECT 'number' AS t, n + 25 + 1 AS k FROM v UNION ALL SELECT 'text', 100 + (25 - n) + 6 + 1 FROM v) "
        "UNION ALL SELECT 'insurance', 'text', 1, 1"
    ),
}

# after the oracles above, as some are made of them
from .store_oracles import STORE_ORACLES  # noqa: E402

ORACLES |= STORE_ORACLES(ORACLES)
