"""DuckDB SQL for the queries that go through the store and files, and for those made of other queries' SQL."""

from __future__ import annotations


def STORE_ORACLES(known: dict[str, str]) -> dict[str, str]:
    from .oracles import _ATTENTION, _EVENTS, SUM, q

    total = "CAST(sum(amount) AS DOUBLE) AS total"
    months = f"SELECT month, count(*) AS n, {total} FROM r GROUP BY month"
    odd = "(SELECT count(*) FROM tx WHERE source_row % 20 = 0) + (SELECT count(*) FROM tx WHERE source_row % 7 = 1)"
    first = "SELECT 'first' AS step, count(*) AS new, 0 AS duplicates, count(DISTINCT month) AS partitions FROM tx WHERE source_row % 2 = 0"
    second = f"SELECT '{{0}}', count(*), {odd}, count(DISTINCT month) FROM tx WHERE source_row % 2 = 1"
    twice = q("SELECT month, count(*) AS n, count(DISTINCT row_hash) AS hashes, " + total + " FROM tx GROUP BY month")
    by_account = f"SELECT account, count(*) AS n, {total} FROM tx"
    good = "event_id % 11 <> 0 AND event_id % 7 <> 0"
    stamp = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"
    asset = "SELECT strftime(last_day(o_orderdate), '%Y-%m-%d') AS d, o_orderpriority AS a, 'fund ' || (o_orderkey % 40) AS i, CAST(o_totalprice AS DECIMAL(18,2)) AS v, o_orderkey AS k FROM orders"
    imported = "SELECT * FROM tx WHERE source_row % 97 <> 0 AND source_row % 89 <> 0 AND source_row % 83 <> 0"
    flow = "SELECT o_custkey, year(o_orderdate) AS y, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders"
    sums = f"SELECT c_nationkey AS k, y, sum(v) AS v FROM ({flow}) JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"
    out = {
        "append_preview": q(f"{first} UNION ALL {second.format('preview')}"),
        "append_results": q(f"{first} UNION ALL {second.format('second')} UNION ALL SELECT 'again', 0, count(*) + {odd}, 0 FROM tx WHERE source_row % 2 = 1"),
        "append_twice": twice,
        "streamed_import": twice,
        "upsert_moves": q(months, "r AS (SELECT CASE WHEN source_row % 9 = 0 THEN '2002' || substr(month, 5) ELSE month END AS month, CASE WHEN source_row % 9 = 0 THEN 2 * amount ELSE amount END AS amount FROM tx)"),
        "replace_month": q(months, "r AS (SELECT month, CASE WHEN month = '1997-05' THEN -abs(amount) ELSE amount END AS amount FROM tx WHERE month <> '1997-05' OR source_row % 2 = 0)"),
        "month_scan": q("SELECT row_hash, date, account, CAST(amount AS DOUBLE) AS amount FROM tx WHERE month = '1996-05'"),
        "range_scan": q("SELECT row_hash, date, merchant_raw FROM tx WHERE date BETWEEN '1996-12-20' AND '1997-01-10'"),
        "full_scan": q(f"{by_account} GROUP BY account"),
        "partition_glob": q(f"{by_account} WHERE date LIKE '1997%' GROUP BY account"),
        "store_view_spend": q(f"SELECT month, count(*) AS transaction_count, {SUM} AS total_spend FROM spend WHERE coalesce(category_final, '') <> 'MACHINERY' AND month BETWEEN '1996-11' AND '1997-02' GROUP BY month"),
        "index_counts": q("SELECT 'transactions' AS \"table\", CAST(substr(month, 1, 4) AS INTEGER) AS \"year\", CAST(substr(month, 6) AS INTEGER) AS \"month\", count(*) AS n FROM tx GROUP BY ALL"),
        "row_count": q("SELECT count(*) AS n, 0 AS problems, count(DISTINCT month) AS months FROM tx"),
        "point_lookup": q("SELECT row_hash, date, merchant_raw, CAST(amount AS DOUBLE) AS amount FROM tx ORDER BY merchant_raw NULLS FIRST, date, source_row LIMIT 1"),
        "asset_aliases": (
            f"WITH r AS ({asset}) SELECT 'acc_' || substr(sha256(regexp_replace(lower(a), '[ _-]', '', 'g')), 1, 12) AS account_id, CASE WHEN k % 3 = 0 THEN 'USD' ELSE 'KRW' END AS currency, "
            "count(*) AS n, count(DISTINCT i) AS instruments, CAST(sum(v) AS DOUBLE) AS total FROM r GROUP BY 1, 2"
        ),
        "asset_append": (
            f"WITH r AS ({asset}), f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY d, a, i ORDER BY k) = 1) "
            "SELECT d AS snapshot_date, a AS account_id, count(*) AS n, CAST(sum(v) AS DOUBLE) AS total FROM f WHERE d BETWEEN '1997-05-01' AND '1997-07-31' GROUP BY 1, 2"
        ),
        "overview_append": (
            "SELECT CASE WHEN s_acctbal < 0 THEN 'liability' ELSE 'asset' END AS side, CASE WHEN s_suppkey % 4 > 0 THEN 'n' || s_nationkey END AS category, count(*) AS n, "
            "CAST(sum(CAST(abs(s_acctbal) AS DECIMAL(18,2))) AS DOUBLE) AS total FROM supplier GROUP BY 1, 2"
        ),
        "balance_sides": (
            "SELECT CASE WHEN s_acctbal < 0 THEN 'liability' ELSE 'asset' END AS side, CAST(sum(CAST(abs(s_acctbal) AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS items FROM supplier WHERE s_suppkey % 5 <> 0 GROUP BY 1"
        ),
        "cashflow_months": "SELECT CAST(year(o_orderdate) AS INTEGER) AS \"year\", CAST(month(o_orderdate) AS INTEGER) AS \"month\", count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1, 2",
        "sheet_cashflow": f"SELECT '2024-0' || (y - 1994) AS period_month, n_name AS category, CAST(v AS DOUBLE) AS amount FROM ({sums}) JOIN nation ON k = n_nationkey",
        "sheet_insurance": (
            "SELECT s_name AS institution, CASE WHEN s_suppkey % 10 <> 3 THEN 'plan ' || s_nationkey END AS policy_name, CAST(CAST(abs(s_acctbal) AS DECIMAL(18,2)) AS DOUBLE) AS paid_amount, "
            "'2020-' || lpad(CAST(s_suppkey % 12 + 1 AS VARCHAR), 2, '0') || '-05' AS contract_date, s_suppkey + 12 AS source_row FROM supplier"
        ),
        "sheet_inspect": (
            f"SELECT '현황' AS sheet, 61 AS \"rows\", 9 AS cols, (SELECT count(*) FROM ({sums})) + (SELECT count(*) FROM nation) + 11 AS cells, '보험현황,현금흐름현황' AS anchors, true AS found UNION ALL "
            "SELECT 's', CAST(max(s_suppkey) + 12 AS INTEGER), 5, 4 * count(*) - count(*) FILTER (s_suppkey % 10 = 3) + 5, '보험현황', false FROM supplier"
        ),
        "snapshot_dates": "SELECT strftime(CASE WHEN o_orderkey % 4 = 3 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END, '%Y-%m-%d') AS snapshot_date, o_orderkey % 4 AS kind, count(*) AS n FROM orders GROUP BY 1, 2",
        "import_rows": q(f"SELECT type_norm, 'KRW' AS currency, coalesce(nullif(trim(minor_raw), ''), nullif(trim(major_raw), ''), '미분류') AS category_final, count(*) AS n, {total}, min(date || 'T' || time || ':00') AS first FROM r GROUP BY ALL", f"r AS ({imported})"),
        "import_rejects": q("SELECT CASE WHEN source_row % 97 = 0 THEN 'no date' WHEN source_row % 89 = 0 THEN 'no amount' ELSE 'no account' END AS reason, count(*) AS n FROM tx WHERE source_row % 97 = 0 OR source_row % 89 = 0 OR source_row % 83 = 0 GROUP BY 1"),
        "import_aliases": q("SELECT type_raw AS type, CASE WHEN source_row % 83 = 0 THEN ' ' ELSE account END AS account, count(*) AS n, count(*) FILTER (source_row % 97 <> 0) AS dated, count(*) FILTER (source_row % 89 <> 0) AS amounts FROM tx GROUP BY 1, 2"),
        "import_validation": "SELECT count(*) AS \"rows\", 0 AS blank_rows, false AS all_dates_null, true AS valid, 0 AS missing FROM orders",
        "ledger_run": q(f"SELECT CASE WHEN lower(major_raw) LIKE '%asia%' THEN 'Asia' ELSE coalesce(nullif(trim(minor_raw), ''), nullif(trim(major_raw), ''), '미분류') END AS category_final, CASE WHEN lower(major_raw) LIKE '%asia%' THEN 'asia' ELSE '' END AS tags_final, count(*) AS n, {total} FROM r GROUP BY 1, 2", f"r AS ({imported})"),
        "import_history": "SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'b' ELSE 'a' END || s_suppkey AS file_id, '/in/' || s_name AS imported_from, CAST(s_nationkey AS VARCHAR) AS source_rows FROM supplier",
        "normalize_tag_lists": "SELECT CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || ',even' ELSE c_mktsegment END AS tags, count(*) AS n FROM customer GROUP BY 1",
        "audit_read": f"SELECT event_type AS command, event_id % 2 = 0 AS success, count(*) AS n, min({stamp}) AS first FROM events WHERE {good} GROUP BY 1, 2",
        "audit_skipped": f"SELECT count(*) FILTER ({good}) AS events, count(*) FILTER (event_id % 7 = 0 AND event_id % 11 <> 0) AS skipped FROM events",
        "audit_trim": (
            f"SELECT false AS again, count(*) AS n, min({stamp}) AS first FROM (SELECT ts FROM events WHERE {good} ORDER BY ts DESC LIMIT 100) UNION ALL "
            f"SELECT true, count(*), min({stamp}) FROM events WHERE {good} AND event_type = 'click'"
        ),
        "csv_round_trip": q(f"SELECT month, account, count(*) AS n, {total}, CAST(sum(len(tags_list)) AS BIGINT) AS tags FROM tx GROUP BY 1, 2"),
        "csv_legacy": q("SELECT is_transfer, is_transfer AS is_transfer_candidate, source_row % 2 = 0 AS no_seconds, count(*) AS n, count(*) FILTER (source_row % 2 = 1 AND source_row % 33 = 0) AS grouped FROM (SELECT CAST(is_transfer AS BIGINT) AS is_transfer, source_row FROM tx) GROUP BY ALL"),
        "rule_changes": q(
            "SELECT row_hash, array_to_string(list_filter([CASE WHEN lower(major_raw) LIKE '%asia%' THEN 'asia' END, CASE WHEN contains(merchant_raw, '0000001') THEN 'big' END, CASE WHEN source_row % 29 = 0 THEN 'vip' END], lambda x: x IS NOT NULL), ',') AS tags_after, "
            "CASE WHEN lower(major_raw) LIKE '%asia%' THEN 'Asia' ELSE coalesce(nullif(trim(minor_raw), ''), nullif(trim(major_raw), ''), '미분류') END AS category_after FROM tx ORDER BY row_hash LIMIT 50"
        ),
        "manual_edit": q(
            "SELECT true AS edited, 1 AS n, row_hash || '|Own|' || CASE WHEN source_row % 4 = 0 THEN 'rule,' ELSE '' END || 'x,y' AS \"row\" FROM (SELECT * FROM tx ORDER BY row_hash LIMIT 1) UNION ALL SELECT NULL, count(*) - 1, NULL FROM tx"
        ),
        "filter_document": q(f"SELECT month, count(*) AS kept, {total} FROM tx WHERE NOT (regexp_matches(merchant_raw, '0{{3}}[12]$') AND date >= '1996-01-01') AND coalesce(category_final, '') <> 'BUILDING' AND date NOT BETWEEN '1997-02-01' AND '1997-02-28' GROUP BY month"),
        "merchant_pattern": q(f"SELECT merchant_raw, count(*) AS n, {total} FROM tx WHERE regexp_matches(lower(merchant_raw), 'r#0+[1-9]7$') GROUP BY 1"),
        "networth_posture": f"SELECT 'networth' AS domain, CASE WHEN net_worth < 0 THEN 'negative' WHEN net_worth >= 1e12 THEN 'on_target' ELSE 'tracking' END AS status, net_worth, 1e12::DOUBLE AS target, 1e12::DOUBLE - net_worth AS gap_to_target, net_worth < 0 AS actionable FROM ({known['networth_position']})",
        "obligations_posture": f"SELECT 'obligations' AS domain, CASE WHEN count(*) > 0 THEN 'needs_confirmation' ELSE 'healthy' END AS status, count(*) AS candidates, count(*) > 0 AS actionable FROM ({known['recurring_obligations']})",
        "review_posture": q(
            f"SELECT 'review' AS domain, CASE WHEN count(*) FILTER ({_ATTENTION}) > 0 THEN 'needs_attention' ELSE 'healthy' END AS status, month, count(*) FILTER ({_ATTENTION}) AS waiting, count(*) FILTER ({_ATTENTION}) > 0 AS actionable FROM tx WHERE month = (SELECT max(month) FROM tx) GROUP BY month"
        ),
        "top_commands": "SELECT event_type AS command, count(*) AS \"count\" FROM events WHERE event_id % 9 > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
        "pivot_other_bucket": q(
            "SELECT y.year, b.bucket, coalesce(CAST(sum(abs(p.amount)) AS DOUBLE), 0) AS value FROM (SELECT DISTINCT year FROM p) y CROSS JOIN (SELECT bucket FROM top UNION ALL SELECT '_other_') b LEFT JOIN p ON p.year = y.year AND p.b = b.bucket GROUP BY 1, 2",
            "base AS (SELECT substr(date, 1, 4) AS year, coalesce(nullif(trim(minor_raw), ''), '_unknown_') AS b, amount FROM tx WHERE NOT is_transfer_bool), top AS (SELECT b AS bucket FROM base GROUP BY b ORDER BY sum(abs(amount)) DESC, b LIMIT 3), "
            "p AS (SELECT year, CASE WHEN b IN (SELECT bucket FROM top) THEN b ELSE '_other_' END AS b, amount FROM base)",
        ),
        "rule_suggestions": q(
            "SELECT merchant, transaction_count, total_amount, pattern, CASE WHEN g THEN 'payment_gateway' ELSE 'merchant' END AS merchant_kind, CASE WHEN g THEN 'payment_gateway' END AS ambiguous_reason, CASE WHEN g THEN 'skip_rule' ELSE 'create_rule' END AS default_action, NOT g AS auto_apply_eligible, "
            "CASE WHEN k = 1 THEN base ELSE base || '_' || k END AS rule_name, minor AS category, minor || ',' || major AS tags, CASE WHEN months >= 2 THEN 85 ELSE 80 END AS priority, "
            "coalesce((SELECT string_agg(memo_raw, ',' ORDER BY n DESC, memo_raw) FROM (SELECT v.memo_raw, count(*) AS n FROM u v WHERE v.m = z.merchant AND v.memo_raw IS NOT NULL GROUP BY v.memo_raw ORDER BY n DESC, v.memo_raw LIMIT 3)), '') AS sample_memos FROM z",
            "u AS (SELECT *, CASE WHEN source_row % 11 = 3 THEN 'KG-Inicis' ELSE minor_raw || ' ' || lpad(CAST(source_row % 20 AS VARCHAR), 2, '0') || ' (' || account || ')' END AS m FROM tx WHERE len(tags_list) = 0 AND NOT is_transfer_bool), "
            "c AS (SELECT m AS merchant, count(*) AS transaction_count, CAST(sum(abs(amount)) AS DOUBLE) AS total_amount, count(DISTINCT month) AS months, "
            "(SELECT minor_raw FROM u v WHERE v.m = u.m GROUP BY minor_raw ORDER BY count(*) DESC, minor_raw LIMIT 1) AS minor, (SELECT major_raw FROM u v WHERE v.m = u.m GROUP BY major_raw ORDER BY count(*) DESC, major_raw LIMIT 1) AS major, "
            "trim(regexp_replace(regexp_replace(m, '\\s*[(\\[].*[)\\]]\\s*$', ''), '[\\s#_-]*\\d+$', '')) AS pattern FROM u GROUP BY m HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 1200), "
            "d AS (SELECT * FROM c WHERE NOT contains(lower(merchant), '07') AND NOT contains(lower(pattern), '07') AND NOT contains('07', lower(pattern)) ORDER BY transaction_count DESC, merchant LIMIT 60), "
            "e AS (SELECT *, merchant = 'KG-Inicis' AS g, 'suggested_' || substr(trim(regexp_replace(lower(merchant), '[^a-z0-9가-힣]+', '_', 'g'), '_'), 1, 30) AS base FROM d), "
            "z AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY transaction_count DESC, merchant) + CASE WHEN base = 'suggested_kg_inicis' THEN 1 ELSE 0 END AS k FROM e)",
        ),
    }
    # edges in their order, one after another: taken if neither end has been
    matched = (
        f"WITH RECURSIVE {_EVENTS}, ranked AS (SELECT *, row_number() OVER (ORDER BY ratio, delta_s, least(out_at, in_at), greatest(out_at, in_at), least(out_row_hash, in_row_hash), greatest(out_row_hash, in_row_hash)) AS r FROM near), "
        "walk(r, used, hit) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), false UNION ALL "
        "SELECT e.r, CASE WHEN list_contains(used, out_row_hash) OR list_contains(used, in_row_hash) THEN used ELSE list_append(list_append(used, out_row_hash), in_row_hash) END, NOT (list_contains(used, out_row_hash) OR list_contains(used, in_row_hash)) "
        "FROM walk JOIN ranked e ON e.r = walk.r + 1), taken AS (SELECT ranked.* FROM ranked JOIN walk ON ranked.r = walk.r AND hit) "
    )
    out["transfer_pairs"] = matched + "SELECT out_row_hash, in_row_hash, 'T_' || least(substr(out_row_hash, 1, 8), substr(in_row_hash, 1, 8)) || '_' || greatest(substr(out_row_hash, 1, 8), substr(in_row_hash, 1, 8)) AS transfer_group_id, ratio, delta_s FROM taken"
    out["transfer_state"] = matched + (
        "SELECT event_type AS major_raw, count(*) AS n, count(*) FILTER (h IN (SELECT out_row_hash FROM taken UNION ALL SELECT in_row_hash FROM taken)) AS paired, count(*) AS candidates "
        "FROM (SELECT event_type, substr(sha256('e|' || event_id), 1, 16) AS h FROM events) GROUP BY 1"
    )
    return out
