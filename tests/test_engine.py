import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from helpers import ledger, rows_of
from tallyweave.adapters import transactions_source
from tallyweave.functions import normalize as N
from tallyweave.operators import filters as P
from tallyweave.operators import joins as J
from tallyweave.operators import rules as R
from tallyweave.operators import transfers as X
from tallyweave.plans import endpoint, networth, reports, signals, templates
from tallyweave.schema import LEDGER_COLUMNS, TABLES, detect_version, normalize_ledger, worst_state
from tallyweave.sources import files, sheets
from tallyweave.sources.store import AppendResult, Store
from tallyweave.streaming.ingest import ingest, ledger_stream, windowed_spend


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return row.select(expr.alias("x")).first()["x"]


# ---- schema and normalisation


def test_versions():
    assert detect_version(list(LEDGER_COLUMNS)) == (4, "active")
    v2 = [c for c in LEDGER_COLUMNS if c not in ("notes_manual", "transfer_group_id", "datetime", "is_transfer_candidate")]
    assert detect_version(v2)[1] == "compatible-legacy"
    assert detect_version(["a"])[1] == "unsupported"
    assert worst_state(["active", "unsupported", "compatible-legacy"]) == "unsupported"


def test_legacy_rows_get_defaults(spark):
    old = spark.createDataFrame([("h", "2024-01-01", "10:00", "1", "NA", '["a","b"]')], "row_hash string, date string, time string, is_transfer string, memo_raw string, tags_final string")
    r = normalize_ledger(old).first()
    assert (r.datetime, r.is_transfer_candidate, r.notes_manual, r.currency, r.memo_raw, r.tags_final, r.transfer_group_id) == ("2024-01-01T10:00", 1, "", "KRW", None, ["a", "b"], None)


@pytest.mark.parametrize("text,want", [("1,234원", 1234.0), ("(500)", -500.0), ("₩ 12", 12.0), ("3만원", 30000.0), ("1.5만", 15000.0), ("abc", None), ("", None), ("KRW 7", 7.0)])
def test_numbers(spark, text, want):
    assert one(spark, N.parse_number(F.col("t")), t=text) == want


@pytest.mark.parametrize("text,want", [("2024-01-05 ~ 2024.2.7", "2024-02-07"), ("2024년 3월 4일", "2024-03-04"), ("2024-13-01", None), ("x", None)])
def test_dates(spark, text, want):
    got = one(spark, N.parse_date(F.col("t")), t=text)
    assert (got and got.isoformat()) == want


def test_types_and_tags(spark):
    assert [one(spark, N.type_norm(F.col("t")), t=t) for t in ("지출", "출금이체", "입금", "이체", "", "?")] == ["expense", "expense", "income", "transfer", "other", "other"]
    tags = spark.createDataFrame([(["a", " b "], None, ["b", "__category__: Own ", ""])], "r array<string>, a array<string>, m array<string>")
    r = tags.select(N.merge_tags(F.col("r"), F.col("a"), F.col("m")).alias("t"), N.manual_category(F.col("m")).alias("c")).first()
    assert r.t == ["a", "b"] and r.c == "Own"


def test_row_hash_ignores_column_order_and_needs_all_fields(spark):
    h = N.row_hash(*[F.col(c) for c in "date time kind merchant amount currency account".split()])
    args = dict(date="2024-01-01", time="10:00", kind="지출", merchant=" Cafe ", amount=-12345678.0, currency="KRW", account="A")
    a = one(spark, h, **args)
    assert len(a) == 16 and a == one(spark, h, **args | {"merchant": "Cafe"}) and a != one(spark, h, **args | {"amount": -12345678.01})
    assert spark.createDataFrame([("d", None)], "date string, time string").select(N.row_hash(F.col("date"), F.col("time"), *[F.lit("x")] * 2, F.lit(1.0), F.lit("x"), F.lit("x")).alias("h")).first().h is None


def test_export_rows_are_normalised_or_rejected(spark):
    raw = spark.createDataFrame(
        [("2024-01-02", "09:05:10", "지출", "식비", "외식", "Cafe", "-1,000", "KRW", "Card", None), ("2024-01-02", None, "수입", None, None, "Pay", "-50", None, "Bank", "m"), (None, "x", "지출", None, None, "Cafe", "1", None, "C", None)],
        ", ".join(f"`{c}` string" for c in "날짜 시간 타입 대분류 소분류 내용 금액 화폐 결제수단 메모".split()),
    )
    good, bad = N.normalize_export(raw, "f")
    rows = {r.merchant_raw: r for r in good.collect()}
    assert rows["Cafe"].amount == -1000 and rows["Cafe"].time == "09:05" and rows["Pay"].amount == 50 and rows["Pay"].time == "00:00" and rows["Pay"].category_final == "미분류"
    assert [r.reason for r in bad.collect()] == ["no date"]
    report = N.validate_input(raw)
    assert report["valid"] and report["rows"] == 3


# ---- filters


def test_filter_complement_and_nulls(spark):
    tx = transactions_source(ledger(spark, dict(merchant_raw="Shop A"), dict(merchant_raw=None), dict(merchant_raw="shop b", date="2023-12-31", category_final=None), dict(category_final="여행", is_transfer=1, transfer_group_id=" "), dict(is_transfer=1, transfer_group_id="T_1")))
    f = P.ReportFilters(merchants=(P.MerchantExclusion("SHOP", since="2024-01-01"),), categories=(P.CategoryExclusion("여행"),))
    assert f.apply(tx).count() + tx.where(f.matches()).count() == tx.count() == 5
    assert f.applied(tx) == 2 and tx.where("is_transfer_bool").count() == 1
    assert P.ReportFilters.from_config({"excluded_date_ranges": [{"start": "2024-01-01", "end": "2024-12-31"}]}).apply(tx).count() == 1
    assert P.exclude_transfers(tx.drop("transfer_group_id")).count() == 3


def test_merchant_pattern(spark):
    tx = transactions_source(ledger(spark, dict(merchant_raw="CAFE 12"), dict(merchant_raw="cafe x"), dict(merchant_raw=None)))
    assert tx.where(P.merchant_matches("Cafe [0-9]+$")).count() == 1 and tx.where(P.merchant_contains("cafe")).count() == 1
    with pytest.raises(Exception):
        P.merchant_matches("(")


def test_order_by_is_allow_listed(spark):
    tx = transactions_source(ledger(spark, {}))
    assert P.order_by(tx, "amount desc, date").count() == 1
    with pytest.raises(ValueError):
        P.order_by(tx, "1; drop table x")
    with pytest.raises(ValueError):
        P.check_period("2024-1")


# ---- joins


def test_null_safe_anti_join(spark):
    a = spark.createDataFrame([(1, None), (1, "x"), (2, None)], "k int, s string")
    b = spark.createDataFrame([(1, None)], "k int, s string")
    assert rows_of(J.anti_join(a, b, ["k", "s"], True)) == [(1, "x"), (2, None)]
    assert J.anti_join(a, b, ["k", "s"]).count() == 3


def test_nearest_equals_all_pairs(spark):
    rnd = random.Random(3)
    left, right = [(f"l{k}", rnd.uniform(1, 2000)) for k in range(40)], [(f"r{k}", rnd.uniform(1, 2000)) for k in range(60)]
    left += [("l", 50.0), ("r1", 77.0), ("far", 1e9), ("none", -1.0), ("null", None)]
    right += [(f"t{k}", 50.0) for k in range(9)] + [("r1", 77.0), ("zero", 0.0), ("next", 5e8 + 1)]
    got = J.nearest_by_mean(spark.createDataFrame(left, "n string, v double"), spark.createDataFrame(right, "n string, v double"), name="n", value="v")
    want = set()
    for n, v in left:
        near = sorted((abs(v - w) / max(v, w), m) for m, w in right if v and v > 0 < w and m != n and abs(v - w) / max(v, w) < 0.5)[:3]
        want |= {(n, m, k + 1) for k, (_, m) in enumerate(near)}
    assert {(r.name, r.near, r["rank"]) for r in got.collect()} == want and ("l", "t2", 3) in want
    empty = spark.createDataFrame([], "n string, v double")
    assert J.nearest_by_mean(empty, empty, name="n", value="v").count() == 0


# ---- transfers


def greedy(rows, tolerance, window):
    edges = []
    for o, i in itertools.product(rows, rows):
        if o["amount"] < 0 < i["amount"] and o["major_raw"] == i["major_raw"]:
            size = max(-o["amount"], i["amount"])
            ratio, delta = abs(-o["amount"] - i["amount"]) / size, abs(o["at"] - i["at"])
            if ratio <= tolerance and delta <= window:
                edges.append((ratio, delta, min(o["at"], i["at"]), max(o["at"], i["at"]), *sorted((o["row_hash"], i["row_hash"])), o["row_hash"], i["row_hash"]))
    used, out = set(), set()
    for e in sorted(edges):
        if e[-1] not in used and e[-2] not in used:
            used |= {e[-1], e[-2]}
            out.add((e[-2], e[-1]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_matching_equals_sequential_greedy(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for k in range(60):
        s = rnd.randrange(1800)
        rows.append(dict(row_hash=f"{k:04d}", type_raw="이체", datetime=f"2024-01-15T10:{s // 60:02d}:{s % 60:02d}", amount=rnd.choice((-1, 1)) * float(rnd.choice((100, 101, 110, 120))), major_raw=rnd.choice("ab"), at=s))
    rnd.shuffle(rows)
    df = ledger(spark, *[{k: v for k, v in r.items() if k != "at"} for r in rows])
    pairs = X.match_pairs(X.candidate_pairs(df, 0.1, 300))
    got = {(r.out_row_hash, r.in_row_hash) for r in pairs.collect()}
    assert got == greedy(rows, 0.1, 300) and got
    state = X.apply_matches(df, pairs)
    assert state.where("is_transfer = 1 and transfer_group_id is not null").count() == 2 * len(got)
    assert state.groupBy("transfer_group_id").count().where("transfer_group_id is not null and count <> 2").isEmpty()


def test_rows_without_time_meet_by_amount_only(spark):
    """All rows of a day without times share one time bucket; the amounts must part them."""
    rnd = random.Random(5)
    sizes = [1000.0 * 1.02**k for k in range(150)]
    df = ledger(spark, *[dict(row_hash=f"{k:05d}", type_raw="이체", datetime="2024-01-15T00:00:00", amount=(-1) ** k * rnd.choice(sizes)) for k in range(1500)])
    pairs = X.candidate_pairs(df)
    joined = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "near" in joined
    met = X.candidate_pairs(df, tolerance=0.0100001)
    rows = X.candidates(df)
    step = 0.0100503
    bucket = lambda c: F.floor(F.log(F.abs(c)) / step)
    a, b = rows.where("amount < 0").select(F.explode(F.array(*[bucket("amount") + k for k in (-1, 0, 1)])).alias("n")), rows.where("amount > 0").select(bucket("amount").alias("n"))
    assert met.count() == pairs.count() > 0 and a.join(b, "n").count() <= 10 * pairs.count()


def test_a_chain_of_falling_edges_is_matched(spark):
    rows = [dict(row_hash=f"{k:04d}", type_raw="이체", datetime=f"2024-01-15T10:{k * (k + 1) // 2 // 60:02d}:{k * (k + 1) // 2 % 60:02d}", amount=(-1) ** k * 100.0, at=k * (k + 1) // 2) for k in range(24)]
    df = ledger(spark, *[{k: v for k, v in r.items() if k != "at"} for r in rows])
    got = {(r.out_row_hash, r.in_row_hash) for r in X.match_pairs(X.candidate_pairs(df, 0.01, 300)).collect()}
    want = greedy([r | {"major_raw": "식비"} for r in rows], 0.01, 300)
    assert got == want and len(got) == 12


def test_window_and_tolerance_are_inclusive(spark):
    base = dict(type_raw="이체")
    edge = ledger(spark, base | dict(row_hash="a", amount=-100.0, datetime="2024-01-01T10:00:00"), base | dict(row_hash="b", amount=99.0, datetime="2024-01-01T10:05:00"))
    assert X.candidate_pairs(edge).count() == 1
    late = ledger(spark, base | dict(row_hash="a", amount=-100.0, datetime="2024-01-01T10:00:00"), base | dict(row_hash="b", amount=99.0, datetime="2024-01-01T10:05:01"))
    assert X.candidate_pairs(late).isEmpty()
    odd = ledger(spark, base | dict(row_hash="a", datetime="?"), base | dict(row_hash="b", amount=1000.0, currency="USD"))
    assert X.detect_transfers(odd).where("is_transfer = 1").isEmpty()


# ---- rules


def test_rules(spark):
    rules = [R.Rule.from_config(c) for c in (
        {"name": "low", "match": "caf", "tags": ["c"], "category": "Low", "priority": 10},
        {"name": "high", "conditions": [{"field": "amount", "op": "between", "value": [-1000, -10]}], "tags": ["h", "c"], "priority": 90},
        {"name": "null", "conditions": [{"field": "memo_raw", "op": "not_contains", "value": "x"}], "tags": ["n"]},
        {"name": "off", "match": "caf", "tags": ["off"], "enabled": False},
    )]
    df = ledger(spark, dict(row_hash="1"), dict(row_hash="2", merchant_raw=None, amount=5.0, memo_raw="x"))
    out = {r.row_hash: r for r in R.apply_rules(df, rules).collect()}
    assert out["1"].tags_rule == ["h", "c", "n"] and out["1"].category_rule == "Low" and out["1"].confidence == 1.0
    assert out["2"].tags_rule == [] and out["2"].category_final == "외식" and out["2"].needs_review == 1
    many = [R.Rule(f"r{k}", (f"t{k}",), f"C{k}", match=f"zz{k}|caf" if k == 240 else f"zz{k}") for k in range(250)]
    big = R.apply_rules(df, many).where("row_hash = '1'").first()
    assert big.tags_rule == ["t240"] and big.category_rule == "C240"
    assert {r.row_hash for r in R.dry_run(df, rules).collect()} == {"1", "2"}
    edited = R.edit_tags(R.apply_rules(df, rules), "1", add=["x"], category="Own", note="n").first()
    assert edited.category_final == "Own" and edited.tags_final == ["h", "c", "n", "x"] and edited.notes_manual == "n"


def test_documents_are_loaded_or_refused():
    found = R.load_rules("rules:\n- {name: a, match: x, tags: [t], priority: 10}\n- {name: b, match: y, category: C, priority: 90}\n- {name: c, match: z, tags: [t], enabled: false}\n")
    assert [r.name for r in found] == ["b", "a"]
    with pytest.raises(ValueError, match="neither match nor conditions"):
        R.load_rules("rules:\n- {name: a, tags: [t]}\n")
    f = P.ReportFilters.load("excluded_merchants:\n- {pattern: x, match_type: regex, reason: r}\nexcluded_categories:\n- {name: c, reason: r}\n")
    assert len(f.rules) == 2
    for bad in ("excluded_merchants:\n- {pattern: x, match_type: like}\n", "excluded_date_ranges:\n- {start: '2024-02-01', end: '2024-01-01'}\n"):
        with pytest.raises(ValueError):
            P.ReportFilters.load(bad)
    a = networth.assumptions_from_config({"assumptions": {"default_savings_per_month": 5}, "lifecycle_events": [{"name": "x", "one_time_expense": 3, "date": "2024-01-01"}, {"name": "y", "monthly_net_expense": 1, "start": "2024-01-01"}]})
    assert a.savings_per_month == 5 and [e.kind for e in a.events] == ["expense", "monthly"]
    with pytest.raises(ValueError):
        networth.assumptions_from_config({"lifecycle_events": [{"name": "x"}]})


def test_pivot_other_bucket(spark):
    rows = [dict(account=a, amount=-x, category_final=c) for a, x, c in (("A", 5.0, "x"), ("A", 3.0, "y"), ("B", 2.0, "z"), ("B", 1.0, " "), ("B", 4.0, "x"))]
    out = templates.pivot(transactions_source(ledger(spark, *rows)), row="account", top_n_cols=2)
    assert out.columns == ["account", "x", "y", "_other_"] and [tuple(r) for r in out.collect()] == [("A", 5.0, 3.0, 0.0), ("B", 4.0, 0.0, 3.0)]


def test_rule_validation():
    bad = R.validate({"rules": [{"name": "a", "conditions": [{"field": "amout", "op": "less_then", "value": 1}], "tags": ["x"]}, {"match": "x", "priority": 200}, {"name": "b", "conditions": [{"field": "amount", "op": "between", "value": [1]}], "tags": ["x"]}]})
    text = "\n".join(bad)
    assert "did you mean amount?" in text and "did you mean less_than?" in text and "no name" in text and "200" in text and "two numbers" in text
    assert R.validate({}) == ["no list of rules"]
    said = lambda rule: "; ".join(R.validate({"rules": [{"name": "a", "tags": ["x"]} | rule]}))
    assert "did you mean is_not?" in said({"conditions": [{"field": "amount", "op": "ne", "value": 1}]}) and "unknown field 'file_id'" in said({"match": "x", "fields": ["merchant_raw", "file_id"]})
    for word, meant in R.HINTS.items():
        assert meant in R.OPERATORS and (word in R.ALIASES or f"did you mean {meant}?" in said({"conditions": [{"field": "account", "op": word, "value": "1"}]}))
    found = R.lint([R.Rule("a", match="star", category="A", priority=60), R.Rule("b", match="starbucks", category="B", priority=10), R.Rule("b", match="q")])
    assert any("twice" in x for x in found) and any("before the more specific" in x for x in found)


# ---- templates


def test_trend_ends_with_its_last_month(spark):
    tx = transactions_source(ledger(spark, *[dict(row_hash=f"{k}", date=f"{2023 + k // 12}-{k % 12 + 1:02d}-05", merchant_raw="Shop") for k in range(20)]))
    months = lambda **p: [r.month for r in templates.run_template(tx, "merchant_monthly_trend", merchant="shop", **p).collect()]
    assert months() == [f"{2023 + k // 12}-{k % 12 + 1:02d}" for k in range(19, 7, -1)]
    assert months(until="2024-01") == [f"{2023 + k // 12}-{k % 12 + 1:02d}" for k in range(12, 0, -1)] and months(since="2024-07") == ["2024-08", "2024-07"]


def test_template_parameters(spark):
    tx = transactions_source(ledger(spark, dict(date="2024-01-01"), dict(date="2024-02-01", amount=-50.0)))
    assert templates.run_template(tx, "monthly_spend", since="2024-02").count() == 1
    for bad in ({"since": "2024"}, {"nope": 1}):
        with pytest.raises(ValueError):
            templates.run_template(tx, "monthly_spend", **bad)
    with pytest.raises(ValueError):
        templates.run_template(tx, "tag_breakdown", top_n=500)
    assert templates.month_list("2023-11..2024-02") == ["2023-11", "2023-12", "2024-01", "2024-02"]


def test_rules_see_their_columns_only(spark):
    df = ledger(spark, dict(file_id="caf", merchant_raw="x"))
    assert R.apply_rules(df, [R.Rule("a", ("t",), match="caf", fields=("file_id", "merchant_raw"))]).first().tags_rule == []


def test_large_transactions_count_none(spark):
    tx = transactions_source(ledger(spark, dict(amount=-5.0), dict(row_hash="b", amount=-7.0)))
    assert [tuple(r) for r in signals.large_transactions(tx, 100).collect()] == [(None, None, None, None, 0)]
    assert [(r.row_hash, r["count"]) for r in signals.large_transactions(tx, 5, 1).collect()] == [("b", 2)]


def test_suggestions(spark):
    shop = lambda name, n, **more: [dict(row_hash=f"{name}{k}", merchant_raw=name, date=f"2024-0{1 + k % 2}-05", tags_final=[], memo_raw=f"m{k % 5}") | more for k in range(n)]
    rows = shop("Cafe 강남점", 9) + shop("Cafe! 12", 4) + shop("KG-INICIS", 6) + shop("paypal *x", 3) + shop("Known Shop", 8) + shop("Once", 1) + shop("Plain", 2, major_raw=None, minor_raw=" ")
    out = {r.merchant: r for r in signals.rule_suggestions(transactions_source(ledger(spark, *rows)), patterns=("known|zzz",), names=("suggested_plain",)).collect()}
    assert set(out) == {"Cafe 강남점", "Cafe! 12", "KG-INICIS", "paypal *x", "Plain"}
    a = out["Cafe 강남점"]
    assert (a.pattern, a.category, a.tags, a.priority, a.default_action, a.sample_memos) == ("Cafe", "외식", "외식,식비", 85, "create_rule", "m0,m1,m2")
    assert out["KG-INICIS"].default_action == out["paypal *x"].default_action == "skip_rule" and not out["paypal *x"].auto_apply_eligible
    assert out["Plain"].rule_name == "suggested_plain_2" and out["Plain"].category == out["Plain"].tags == "미분류"


def test_posture(spark):
    tx = transactions_source(ledger(spark, *[dict(row_hash=f"{m}", date=f"2024-0{m}-01", amount=-400000.0, tags_final=["a"] if m < 6 else []) for m in range(1, 7)]))
    none = tx.where("false")
    status = lambda df: df.first().status
    assert [status(signals.obligations_posture(t)) for t in (tx, none, tx.where("month < '2024-05'"))] == ["needs_confirmation", "empty", "healthy"]
    assert [status(signals.review_posture(t)) for t in (tx, none, tx.where("month < '2024-05'"))] == ["needs_attention", "empty", "healthy"]
    worth = lambda a, b: spark.createDataFrame([(a, b, a - b)], "total_assets double, total_liabilities double, net_worth double")
    assert [status(signals.networth_posture(*x)) for x in ((worth(1.0, 2.0), 5), (worth(9.0, 2.0), 5), (worth(6.0, 2.0), 5), (worth(6.0, 2.0), None), (worth(1.0, 1.0).where("false"), 5))] == ["negative", "on_target", "tracking", "healthy", "missing_data"]
    all_ = signals.review_posture(tx).select("domain", "status").unionByName(signals.networth_posture(worth(1.0, 2.0)).select("domain", "status"))
    assert [(r.priority, r.domain) for r in signals.next_actions(all_).collect()] == [(1, "networth"), (1, "review")]
    events = spark.createDataFrame([("tag",), ("tag",), (None,), ("import",)], "command string")
    assert [tuple(r) for r in signals.top_commands(events).collect()] == [("tag", 2), ("import", 1)]


def test_null_category_is_gone_and_new(spark):
    tx = transactions_source(ledger(spark, dict(date="2024-01-20", category_final=None), dict(date="2024-01-10", category_final=None)))
    out = templates.weekly_anomalies(tx)
    assert {(r.category, r.change_type) for r in out.collect()} == {(None, "gone"), (None, "new")}


def test_compare_divides_by_months_with_data(spark):
    tx = transactions_source(ledger(spark, dict(date="2024-01-01", amount=-100.0), dict(date="2024-03-01", amount=-30.0)))
    r = templates.compare(tx, ["2024-01", "2024-02"], ["2024-03"]).first()
    assert (r.baseline_monthly_avg, r.current_monthly_avg, r["diff"], r.pct_change) == (100.0, 30.0, -70.0, -70.0)


def test_empty_ledger_breaks_nothing(spark):
    tx = transactions_source(ledger(spark, {})).where("false")
    for name, params in {"monthly_spend": {}, "tag_breakdown": {}, "new_merchants": {}, "spending_comparison": {}, "weekly_anomalies": {}, "merchant_monthly_trend": {"merchant": "x"}, "pivot": {}}.items():
        templates.run_template(tx, name, **params).collect()
    assert reports.summary_stats(tx).first().transaction_count == 0
    assert signals.coverage_simulation(tx).first().expected_tagged == 0
    assert reports.savings_rate(tx).first().savings_rate_3mo is None


def test_recurring_needs_every_month(spark):
    rows = [dict(date=f"2024-0{m}-01", merchant_raw=f"Gym {m}", amount=-400000.0) for m in range(1, 7)] + [dict(date=f"2024-0{m}-01", merchant_raw="Gap", amount=-400000.0) for m in (1, 2, 3, 5, 6, 7)]
    out = signals.recurring_obligations(transactions_source(ledger(spark, *rows))).collect()
    assert [(r.label, r.months, r["range"]) for r in out] == [("Gym #", 6, 0.0)]


# ---- store


def test_append_is_idempotent_and_previewed(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = [dict(row_hash=f"{k}", date=f"2024-0{1 + k % 3}-10", source_row=k) for k in range(9)]
    batch = ledger(spark, *rows, dict(row_hash="0", date="2024-01-10", source_row=99))
    assert store.preview("transactions", batch) == AppendResult(9, 1, 3)
    assert store.append("transactions", batch) == AppendResult(9, 1, 3)
    assert store.append("transactions", batch) == AppendResult(0, 10, 0)
    assert store.count("transactions") == 9 and store.read_month("transactions", 2024, 2).count() == 3
    assert store.read_range("transactions", "2024-01-01", "2024-02-28", ["row_hash"]).count() == 6
    assert store.find("0").first().source_row == 0
    with pytest.raises(LookupError):
        store.find("missing")
    store.upsert("transactions", ledger(spark, dict(row_hash="3", date="2024-01-10", merchant_raw="New")))
    assert store.count("transactions") == 9 and store.find("3").first().merchant_raw == "New"
    store.write_month("transactions", ledger(spark, dict(row_hash="z", date="2024-03-01")), 2024, 3)
    assert store.count("transactions") == 7 and store.validate("transactions") == []
    assert store.index().where("table = 'transactions'").count() == 3
    assert store.read_partitions("transactions", "year=2024/month=*", ["row_hash"]).count() == 7
    store.register_views(P.ReportFilters(merchants=(P.MerchantExclusion("new"),)))
    assert spark.table("transactions").count() == 6 and spark.table("transactions_source").count() == 7
    assert Store(spark, f"file://{tmp_path}/none").count("balance") == 0


MONTH_TEMPLATES = {
    "monthly_spend": {"since": "2024-02"}, "tag_breakdown": {"since": "2024-02", "until": "2024-02"}, "monthly_consumption_summary": {"until": "2024-01"},
    "consumption_category_breakdown": {"month": "2024-02"}, "merchant_top_spend": {"month": "2024-02"}, "event_adjusted_spend": {"month": "2024-02"},
    "anomaly_large_txn": {"since": "2024-02", "threshold": 10000}, "card_spend_summary": {"since": "2024-02"}, "merchant_monthly_trend": {"merchant": "x", "since": "2024-02", "until": "2024-02"},
    "spend_by_weekday_hour": {"since": "2024-02"}, "compare": {"baseline_months": "2024-01", "current_months": "2024-02"}, "pivot": {"months": "2024-02..2024-02"},
}


def test_months_prune_partitions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.append("transactions", ledger(spark, *[dict(row_hash=f"{m}{k}", date=f"2024-{m:02d}-1{k}", tags_final=["a"], amount=-20000.0) for m in range(1, 5) for k in range(3)]))
    tx = store.ledger()
    plain = transactions_source(store.read("transactions"))

    def pruned(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        found = [x.split("]")[0] for x in plan.split("PartitionFilters: [")[1:]]
        return bool(found) and all("month" in x for x in found)

    for name, params in MONTH_TEMPLATES.items():
        out = templates.run_template(tx, name, **params)
        assert pruned(out), name
        assert rows_of(out) == rows_of(templates.run_template(plain, name, **params)), name
    for f in (lambda t: P.filter_range(t, "2024-02-05", "2024-03-11"), lambda t: t.where(P.in_period("2024-03")), lambda t: P.search(t, "cafe", "2024-02-11"), lambda t: signals.budget_status(t, spark.createDataFrame([("x", 1)], "category string, target long"), "2024-02")):
        assert pruned(f(tx)) and rows_of(f(tx).drop("month")) == rows_of(f(plain).drop("month"))
    store.register_views()
    assert pruned(endpoint.query(spark, "select account, sum(amount) as s from transactions where month between '2024-02' and '2024-03' group by account"))


def test_upsert_moves_rows_between_months(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.append("transactions", ledger(spark, dict(row_hash="a", date="2024-01-10"), dict(row_hash="b", date="2024-02-10"), dict(row_hash="c", date="2024-02-11")))
    store.upsert("transactions", ledger(spark, dict(row_hash="a", date="2024-03-01"), dict(row_hash="b", date="2024-03-02")))
    assert {(r.row_hash, r.date) for r in store.read("transactions").collect()} == {("a", "2024-03-01"), ("b", "2024-03-02"), ("c", "2024-02-11")}
    assert store.read_month("transactions", 2024, 1).isEmpty() and not [x for x in (tmp_path / "s").iterdir() if x.name.startswith("_staged")]


def test_null_safe_tables_and_cashflow_months(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    b = spark.createDataFrame([("2024-01-31", "asset", None, "Cash", 1.0, 4)], "snapshot_date string, side string, category string, item_name string, amount double, source_row long")
    assert store.append("balance", b).new == 1 and store.append("balance", b).new == 0
    c = spark.createDataFrame([("2024-01-31", None, "x", 1.0), ("2024-01-31", "2023-12", "x", 1.0)], "snapshot_date string, period_month string, category string, amount double")
    assert store.append("cashflow", c) == AppendResult(2, 0, 2)
    with pytest.raises(Exception, match="no month"):
        store.append("cashflow", c.withColumn("period_month", F.lit("2023-99")))
    assert set(TABLES) == {"transactions", "assets", "facts", "balance", "cashflow", "insurance", "investments", "loans"}


def test_csv_round_trip_keeps_tags(spark, tmp_path):
    df = ledger(spark, dict(tags_final=["a", 'b "q", c'], memo_raw="x,y"))
    files.write_ledger_csv(df, f"file://{tmp_path}/c")
    back = files.read_ledger_csv(spark, [f"file://{tmp_path}/c"]).first()
    assert back.tags_final == ["a", 'b "q", c'] and back.memo_raw == "x,y" and back.amount == -1000.0
    with pytest.raises(ValueError):
        spark.createDataFrame([(1,)], "x int").write.option("header", True).csv(f"file://{tmp_path}/bad")
        files.read_ledger_csv(spark, [f"file://{tmp_path}/bad"])


def test_audit_log(spark, tmp_path):
    lines = [json.dumps({"timestamp": f"2024-01-0{1 + k // 2}T0{k}:00:00", "template_name": "t", "param_fingerprint": "p", "success": k != 1, "duration": 1.0}) for k in range(4)]
    (tmp_path / "a.jsonl").write_text("\n".join([*lines, "{broken", ""]))
    path = f"file://{tmp_path}/a.jsonl"
    events = files.read_audit(spark, path)
    assert events.count() == 4 and files.skipped_lines(spark, path) == 1 and files.trim_audit(events, 2).count() == 2
    r = signals.audit_stats(events, order=("timestamp",)).first()
    assert (r.runs, r.failed, r.retry_attempts, r.recovered_retries) == (4, 1, 1, 1)


def test_files(spark, tmp_path):
    assert files.file_id("/x/2024-03-05_export.xlsx") == "240305_1" and files.file_id("/x/2024-03-05.xlsx", ["240305_1"]) == "240305_2" and len(files.file_id("/x/y")) == 8
    cols = "file_id string, original_filename string, imported_from string, archived string, archived_path string, imported_at string, source_rows string"
    h = spark.createDataFrame([("a", "n", "/p", "", "", "t", "1")], cols)
    assert files.record_import(h, spark.createDataFrame([("b", "n", "/p", "", "", "t", "2")], cols)).count() == 1
    with pytest.raises(ValueError):
        files.record_import(h, spark.createDataFrame([("a", "n", "/q", "", "", "t", "2")], cols))
    df = spark.createDataFrame([("=1+1", "a|b")], "x string, y string")
    files.write_report_csv(df, str(tmp_path / "r.csv"))
    many = spark.range(30).select("id")
    assert "only the first 5 rows" in files.markdown_table(many, 5) and "only the first 5 rows" in files.html_table(many, 5) and "only" not in files.markdown_table(many, 30)
    assert len(files.markdown_table(many, None).splitlines()) == 32 and files.find_import(h, "a")["source_rows"] == "1" and files.find_import(h, "z") is None and files.list_imports(h).count() == 1
    rows = [("2024-01", -5.0), ("<b>", 2.0)]
    assert "&lt;b&gt;" in files.bar_chart(rows, "x") and files.line_chart(rows, "x").count("<circle") == 2 and "no data" in files.line_chart([], "x") and "no data" in files.bar_chart([], "x")
    assert (tmp_path / "r.csv").read_bytes().startswith(b"\xef\xbb\xbf") and "'=1+1" in (tmp_path / "r.csv").read_text("utf-8-sig")
    assert "a\\|b" in files.markdown_table(df) and "<td>=1+1</td>" in files.html_table(df)


def raw_export(spark, *rows):
    names = "날짜 시간 타입 대분류 소분류 내용 금액 화폐 결제수단 메모".split()
    return spark.createDataFrame(list(rows), ", ".join(f"`{c}` string" for c in names))


def export_rows():
    day = lambda k: f"2024-{1 + k % 3:02d}-{28 - k % 20:02d}"
    rows = [(day(k), f"{k % 24:02d}:10", "지출", "식비", "외식", f"Cafe {k % 4}", f"-{1000 + k}", "KRW", "Card", None) for k in range(30)]
    rows += [("2024-01-31", "23:59", "이체", "이체", None, "own", "-5,000", "KRW", "A", None), ("2024-02-01", "00:01", "이체", "이체", None, "own", "5,000", "KRW", "B", None)]
    return [*rows, *rows[:3], (None, "x", "지출", None, None, "Cafe", "1", None, "C", None)]


def test_run_from_workbook_to_export(spark, tmp_path):
    from tallyweave.plans.run import export, run
    from tallyweave.sources.workbook import sheet_names, write_workbook

    rules = [R.Rule("cafe", ("coffee",), "Coffee", match="cafe 1")]
    raw = raw_export(spark, *export_rows())
    path = str(tmp_path / "2024-03-31.xlsx")
    write_workbook(raw, path, "가계부 <내역>")
    assert sheet_names(path) == ["가계부 <내역>"]
    read = sheets.read_transactions(spark, path)
    assert read.count() == raw.count() and rows_of(read.drop("source_row")) == rows_of(raw)
    store = Store(spark, f"file://{tmp_path}/s")
    first = run(store, [("f1", read)], rules)
    assert (first.new, first.duplicates, first.rejected, first.transfers) == (32, 3, 1, 1) and first.changed > 0
    state = rows_of(store.read("transactions"))
    again = run(store, [("f1", read)], rules)
    assert (again.new, again.duplicates, again.changed) == (0, 35, 0) and rows_of(store.read("transactions")) == state
    forced = run(store, [("f2", read)], rules, force=True)
    assert forced.changed == 0 and rows_of(store.read("transactions")) == state
    # the order and split of the imports do not matter
    other = Store(spark, f"file://{tmp_path}/t")
    for k in (2, 0, 1):
        run(other, [("f1", raw_export(spark, *export_rows()[k::3]))], rules)
    strip = lambda s: rows_of(s.read("transactions").drop("source_row"))
    assert strip(other) == strip(store)
    out = export(store)
    assert out.where("tags_final = 'coffee'").count() == out.where("category_final = 'Coffee'").count() > 0
    assert out.where("is_transfer = 1").count() == 2 and files.write_master(store.read("transactions"), str(tmp_path / "m.xlsx")) == 32


def test_run_reads_an_export_once(spark, tmp_path):
    from tallyweave.plans.run import run

    seen = spark.sparkContext.accumulator(0)

    def note(date):
        seen.add(1)
        return date

    store, rows = Store(spark, f"file://{tmp_path}/once"), export_rows()
    raw = raw_export(spark, *rows).withColumn("날짜", F.udf(note)("날짜"))
    assert run(store, [("f1", raw)], [R.Rule("cafe", ("coffee",), match="cafe")]).new == 32 and seen.value == len(rows)
    assert run(store, [("f1", raw)]).new == 0 and seen.value == 2 * len(rows)


def test_retag_keeps_each_row_without_hash(spark, tmp_path):
    from tallyweave.plans.run import retag

    store, rules = Store(spark, f"file://{tmp_path}/s"), [R.Rule("cafe", ("coffee",), match="cafe")]
    for k, date in enumerate(("2024-01-05", "2024-01-05", "2024-02-05")):
        store.append("transactions", ledger(spark, dict(row_hash=None, date=date, merchant_raw=f"Cafe {k}")))
    store.append("transactions", ledger(spark, dict(row_hash="h", date="2024-06-05", merchant_raw="Cafe far")))
    assert retag(store, rules, [(2024, 1)]) == (3, 0, 3) and retag(store, rules, [(2024, 1)]) == (3, 0, 0)
    assert sorted((r.merchant_raw, r.date[5:7], r.tags_rule) for r in store.read("transactions").collect()) == [*[(f"Cafe {k}", m, ["coffee"]) for k, m in enumerate(("01", "01", "02"))], ("Cafe far", "06", [])]


def test_amounts_are_read_alike_as_text_and_as_numbers(spark):
    texts = ["-1,234.50", " 5 ", "1e3", "(7)", "1만", "₩3", "x", "", None, "+2.", "1,0\n0"]
    read = lambda df: [r.amount for r in N.read_export(df, "f").orderBy("merchant_raw").collect()]
    raw = raw_export(spark, *[("2024-01-02", "09:05", "지출", None, None, f"{k:02d}", t, None, "Card", None) for k, t in enumerate(texts)])
    assert read(raw) == [-1234.5, 5, 1000, -7, 10000, 3, None, None, None, 2, 100]
    assert read(raw.withColumn("금액", F.lit(0.1).cast("float"))) == [0.10000000149011612] * len(texts)


def test_workbook_values(spark, tmp_path):
    import zipfile

    from tallyweave.sources.workbook import read_cells, write_workbook

    df = spark.createDataFrame([(1, 2.5, True, " a <b> & \x01", None)], "i int, d double, b boolean, s string, n string")
    write_workbook(df, str(tmp_path / "a.xlsx"), "S")
    assert [c[1:] for c in read_cells(str(tmp_path / "a.xlsx"))][5:] == [(2, 1, "1"), (2, 2, "2.5"), (2, 3, "TRUE"), (2, 4, " a <b> & ")]
    main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="info" r:id="a"/><sheet name="rows" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="a" Target="worksheets/1.xml"/><Relationship Id="b" Target="/xl/worksheets/2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>날짜</t></si><si><r><t>금</t></r><r><t>액</t></r></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="yyyy/mm/dd"/><numFmt numFmtId="171" formatCode="#,##0.00"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="22"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/1.xml", f'<worksheet xmlns="{main}"><sheetData/></worksheet>')
        z.writestr("xl/worksheets/2.xml", f'<worksheet xmlns="{main}"><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="AB2" t="s"><v>1</v></c></row><row r="3"><c r="A3" s="1"><v>45296</v></c><c r="AB3" s="3"><v>12.5</v></c></row><row r="4"><c r="A4" s="2"><v>45296.5</v></c></row></sheetData></worksheet>')
    got = sheets.read_transactions(spark, str(tmp_path / "b.xlsx"))
    assert rows_of(got) == rows_of(spark.createDataFrame([(3, "2024-01-05", "12.5"), (4, "2024-01-05 12:00:00", None)], "source_row long, `날짜` string, `금액` string"))


# ---- endpoint


@pytest.mark.parametrize("sql", [
    "drop table transactions", "insert into transactions values (1)", "select 1; select 2", "select reflect('java.lang.System', 'getProperty', 'user.dir')", "select * from other",
    "select * from parquet.`/tmp/x`", "set spark.x = 1", "show tables", "select input_file_name() from transactions", "with a as (select * from other) select * from a", "select (select max(x) from other) from transactions",
    "select * from range(1000000000000000)", "select sequence(1, 1000000000) from transactions", "select repeat(account, 1000000) from transactions", "select java_method('java.lang.System', 'exit') from transactions",
    "select * from (with a as (select 1) select * from a) join a", "with a as (select * from b), b as (select 1) select * from a", "select count(*) from transactions where amount > (select min(value) from other)",
    "select current_user()", "select spark_catalog.default.f(amount) from transactions", "select transform(tags_list, x -> reflect(x)) from transactions", "select sum(uuid()) over (order by version()) from transactions", "from transactions insert into x select *",
])
def test_guard_refuses(spark, sql):
    with pytest.raises(endpoint.GuardError):
        endpoint.guard(spark, sql)


@pytest.mark.parametrize("sql", [
    "select 'drop table x; reflect(' as word, count(*) from transactions", "with a as (select * from transactions), b as (select * from a) select * from a join b on a.row_hash = b.row_hash",
    "select account, sum(amount) over (partition by account order by date) from transactions where date in (select max(date) from transactions)", "select t.tag from transactions lateral view explode(tags_list) t as tag",
    "select case when amount < 0 then 'out' else 'in' end as way, count(distinct account), extract(year from to_date(date)) from transactions group by 1, 3 having count(*) > 0 order by 1 limit 3",
    "select cast(amount as string), amount between 1 and 2, account like 'C%', transform(tags_list, x -> upper(x)) from transactions union all select '1', true, false, array()",
])
def test_guard_allows_queries(spark, sql):
    transactions_source(ledger(spark, {})).createOrReplaceTempView("transactions")
    endpoint.query(spark, sql).collect()


def test_pages_by_key(spark):
    df = spark.createDataFrame([(k, None if k % 5 == 0 else float(k % 3)) for k in range(23)], "id int, x double")
    seen, after = [], None
    while rows := endpoint.page_after(df, after, 4, ("x", "id")).collect():
        seen += [tuple(r) for r in rows]
        after = rows[-1].asDict()
    assert seen == sorted(((k, None if k % 5 == 0 else float(k % 3)) for k in range(23)), key=lambda r: (r[1] is not None, r[1] or 0, r[0]))


def test_outputs(spark):
    assert endpoint.failure(endpoint.GuardError("x"), "query")["error"] == {"code": "QUERY_ERROR", "exit_code": 2, "message": "x"}
    assert endpoint.failure(LookupError("none"), "show")["error"]["exit_code"] == 4 and endpoint.failure(RuntimeError(), "x")["error"]["code"] in endpoint.ERROR_CODES
    schema = endpoint.output_schema(spark.createDataFrame([(1, [("a", 1.0)])], "n long, xs array<struct<k: string, v: double>>"))
    assert schema["items"]["properties"]["xs"]["items"]["properties"]["v"] == {"type": ["number", "null"]} and schema["items"]["required"] == ["n", "xs"]


def test_pages_cover_all_rows_once(spark):
    transactions_source(ledger(spark, *[dict(row_hash=f"{k % 7}", amount=-float(k % 3)) for k in range(23)])).createOrReplaceTempView("transactions")
    sql = "with transactions as (select row_hash, amount, 'drop' as word from transactions) select * from transactions"
    seen, at = [], 0
    while at is not None:
        p = endpoint.query_page(spark, sql, at, 5, ("amount",), max_bytes=150)
        assert p.total == 23 and p.rows
        seen += [tuple(r.values()) for r in p.rows]
        at = p.next_offset
    assert sorted(seen) == sorted((f"{k % 7}", -float(k % 3), "drop") for k in range(23))
    with pytest.raises(ValueError):
        endpoint.page(spark.range(3).toDF("x"), 0, 10_001)


def test_privacy_and_context():
    v = {"merchant_raw": "Cafe", "n": None, "path": "see /home/me/x.csv", "rows": [{"account": "A", "amount": 1}]}
    assert endpoint.redact(v, "raw") is v
    assert endpoint.redact(v) == {"merchant_raw": "[redacted]", "n": None, "path": "see [path]", "rows": [{"account": "[redacted]", "amount": 1}]}
    assert "n" not in endpoint.redact(v, "compact")
    b = endpoint.context_bundle({"a": "x" * 400, "b": "y"}, 20, ["a", "b"])
    assert b["dropped"] == ["a"] and b["tokens"] <= 20


# ---- net worth


def test_forecast_steps(spark):
    assets = spark.createDataFrame([("Fund", "financial", 1200.0)], "name string, category string, value double")
    debts = spark.createDataFrame([("Loan", 100.0, 12.0)], "name string, value double, rate double")
    a = networth.Assumptions(10, {"financial": {"base": 0.12}}, 0.0, (networth.Event("trip", "expense", 5, date="2024-02-29"), networth.Event("rent", "monthly", 1, start="2024-03-01"), networth.Event("swap", "swap", date="2024-04-29", remove="fund", add_name="House", add_value=2000.0)))
    out = networth.forecast(assets, debts, a, start="2024-01-31", years=1, scenarios=("base",)).orderBy("date").collect()
    assert [r.date for r in out[:4]] == ["2024-01-31", "2024-02-29", "2024-03-29", "2024-04-29"]
    assert (out[1].total_assets, out[1].total_liabilities, out[1].events) == (1217.0, 101.0, 1)
    savings = round(10 - 5 + 10 - 1, 2)
    assert out[2].total_assets == round(1224.12 + savings * 1.01 - 0.05 + 0.0, 2) or out[2].events == 1
    assert out[3].events == 2 and out[3].total_assets > 2000
    with pytest.raises(Exception, match="no asset"):
        networth.forecast(assets, debts, networth.Assumptions(events=(networth.Event("s", "swap", date="2024-01-31", remove="none", add_name="x"),)), start="2024-01-31", years=1, scenarios=("base",)).collect()


# ---- worksheets and streaming


def test_sheets(spark):
    cells = [(1, 1, "1. 현금흐름현황"), (3, 2, "구분"), (3, 3, "2024년 1월"), (3, 4, "2024-02"), (4, 2, "급여"), (4, 3, "1,000"), (4, 4, "2,000"), (10, 1, "4. 보험현황"), (11, 2, "금융사"), (11, 3, "보험명"), (11, 4, "총납입금"), (11, 5, "계약일자"),
             (12, 2, "A사"), (12, 3, "암보험"), (12, 4, "5만원"), (12, 5, "2020.1.2"), (13, 4, "9"), (17, 2, "late"), (17, 3, "x")]
    df = spark.createDataFrame([("s", *c) for c in cells], "sheet string, row int, col int, value string")
    assert rows_of(sheets.cashflow(df, "2024-02-29", "f").select("period_month", "category", "amount")) == [(1000.0, "급여", "2024-01"), (2000.0, "급여", "2024-02")]
    r = sheets.structured(df, "insurance", "2024-02-29", "f").collect()
    assert [(x.institution, x.policy_name, x.paid_amount, x.contract_date) for x in r] == [("A사", "암보험", 50000.0, "2020-01-02")]
    assert sheets.facts(df, "2024-02-29", "f").select("fact_id").distinct().count() == sheets.facts(df, "2024-02-29", "f").count()
    seen = sheets.inspect(df).first()
    assert (seen.rows, seen.cells, seen.anchors) == (17, len(cells), ["보험현황", "현금흐름현황"])
    assert sheets.find_sheet(df, ["s"]) == "s" and sheets.find_sheet(df, ["none"]) is None


def test_stream_appends_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    src = f"file://{tmp_path}/in"
    for k in range(2):
        ledger(spark, *[dict(row_hash=f"{n}", date="2024-01-10") for n in range(k, k + 3)]).coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):
        q = ingest(ledger_stream(spark, src), store, f"file://{tmp_path}/ckpt")
        q.awaitTermination(120)
    assert store.count("transactions") == 4
    # an older statement, and rows without a time, in later batches
    ledger(spark, dict(row_hash="old", date="2021-03-05", datetime="2021-03-05T10:00:00"), dict(row_hash="timeless", datetime=None), dict(row_hash="dateless", date=None, datetime=None)).coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):
        ingest(ledger_stream(spark, src), store, f"file://{tmp_path}/ckpt").awaitTermination(120)
        ledger(spark, dict(row_hash="old", date="2021-03-05"), dict(row_hash="dateless", date=None), dict(row_hash="0", date="2024-01-10")).coalesce(1).write.mode("append").parquet(src)
    assert store.count("transactions") == 7 and store.read_month("transactions", 2021, 3).count() == 1
    src = f"file://{tmp_path}/in2"
    for k in range(2):
        ledger(spark, *[dict(row_hash=f"{n}", date="2024-01-10") for n in range(k, k + 3)]).coalesce(1).write.mode("append").parquet(src)
    q = windowed_spend(ledger_stream(spark, src)).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("w").first().transaction_count == 6
