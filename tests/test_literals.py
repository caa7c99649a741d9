"""Operators on small literal inputs, with expectations worked out by hand."""

import datetime as dt
import math
import statistics
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import quantiles, resample, tails
from tidemark.operators import cohorts, diagnosis, experiments, funnel, gates, parse, pricing, quality, targeting
from tidemark.sources import files
from tidemark.sources.tables import with_flags
from tidemark.streaming.daily import daily_counts

GOOD = ("2019-10-01 00:00:00 UTC", "purchase", "1", "2", "a", "b", "1.20", "123", "s")


def raw(spark, **changes):
    row = dict(zip(parse.RAW_COLUMNS, GOOD, strict=True)) | changes
    return parse.parse_events(spark.createDataFrame([tuple(row[c] for c in parse.RAW_COLUMNS)], files.RAW_SCHEMA)).collect()[0]


@pytest.mark.parametrize(
    ("price", "flag"),
    [("NaN", "nonfinite"), ("-Inf", "nonfinite"), ("++NaN", "invalid"), ("+-Inf", "invalid"), ("1.20\n", "invalid"), ("", "missing"), (" \r\n", "missing"), ("12345678901234567", "precision_exceeded"), ("1.234", "scale_exceeded"), ("-1", "negative"), ("-0", "zero")],
)
def test_price_classes(spark, price, flag):
    row = raw(spark, price=price)
    raised = [f for f in ("missing", "invalid", "nonfinite", "negative", "zero", "precision_exceeded", "scale_exceeded") if row[f"price_{f}"]]
    assert raised == [flag]
    assert (row.price_decimal is None) == (flag not in ("negative", "zero"))


def test_price_text_is_kept_exactly(spark):
    assert raw(spark, price="+0001.2").price_decimal == Decimal("1.20")
    assert raw(spark, price="00000000000000000001").price_decimal == Decimal("1.00")


@pytest.mark.parametrize("time", ["2019-02-29 00:00:00 UTC", "0000-01-01 00:00:00 UTC", "2019-10-01 00:00:00 UTC\n", "2019-10-01 24:00:00 UTC", "2019-10-01T00:00:00 UTC"])
def test_times_that_are_none(spark, time):
    row = raw(spark, event_time=time)
    assert row.time_invalid and not row.time_missing and row.event_timestamp_utc is None and not row.event_eligible


def test_ids_and_types(spark):
    assert raw(spark, user_id="007").event_eligible and raw(spark, user_id="7\n").user_id_invalid
    assert raw(spark, event_type="View").event_type_unknown and raw(spark, user_id="١").user_id_invalid
    assert raw(spark, brand=None).brand_missing and raw(spark).amount_eligible


def facts(spark, rows):
    """(minute, type, user, session, product, price) from 2024-01-01."""
    start = dt.datetime(2024, 1, 1)
    made = [(k, "t", start + dt.timedelta(minutes=m), (start + dt.timedelta(minutes=m)).date(), u, s, p, kind, "a.b", "x", None if price is None else Decimal(str(price))) for k, (m, kind, u, s, p, price) in enumerate(rows)]
    schema = "event_id long, scope_id string, event_timestamp_utc timestamp_ntz, event_date_utc date, user_id string, user_session string, product_id string, event_type string, category_code string, brand string, price_decimal decimal(18,2)"
    return with_flags(spark.createDataFrame(made, schema))


@pytest.mark.parametrize(
    ("rows", "strict", "possible"),
    [
        ([(0, "view"), (1, "cart"), (2, "purchase")], "view_cart_purchase", "view_cart_purchase"),
        ([(0, "view"), (2, "purchase")], funnel.CLASSES[1], funnel.CLASSES[1]),
        ([(0, "view"), (1, "purchase"), (2, "cart")], funnel.CLASSES[1], funnel.CLASSES[1]),
        ([(0, "view"), (1, "purchase"), (2, "cart"), (3, "purchase")], "view_cart_purchase", "view_cart_purchase"),
        ([(0, "view"), (1, "cart"), (1, "purchase")], funnel.CLASSES[1], "view_cart_purchase"),
        ([(0, "view"), (0, "cart"), (5, "purchase")], funnel.CLASSES[1], "view_cart_purchase"),
        ([(0, "view"), (1440, "purchase")], funnel.CLASSES[1], funnel.CLASSES[1]),
        ([(0, "view"), (1441, "purchase")], "view_only", "view_only"),
        ([(1, "view"), (0, "cart")], "view_only", "view_only"),
        ([(0, "view"), (1, "cart")], funnel.CLASSES[2], funnel.CLASSES[2]),
    ],
)
def test_funnel_classes(spark, rows, strict, possible):
    path = funnel.paths(facts(spark, [(m, k, "1", "s", "9", 5) for m, k in rows]), "2024-02-01 00:00:00").collect()[0]
    assert (path.strict_class, path.possible_class, path.order_uncertain) == (strict, possible, strict != possible)


def test_first_view_prices(spark):
    at = lambda *prices: funnel.paths(facts(spark, [(0, "view", "1", "s", "9", p) for p in prices]), "2024-02-01 00:00:00").collect()[0]
    assert at(50).price_band == "[50,200)" and at(50, 50).first_view_price_status == "unique_valid"
    assert at(5, 6).first_view_price_status == "conflicting" and at(5, None).first_view_price_status == "invalid_or_missing" and at(-1).price_band == "unknown"


def test_cart_windows_to_the_second(spark):
    day = 1440
    rows = [(0, "cart", u, "s", "1", 1) for u in "123456"]
    rows += [(day, "purchase", "1", "s", "1", 2), (2 * day, "purchase", "2", "s", "1", 2), (2 * day + 1, "purchase", "3", "s", "1", 2), (day + 1, "purchase", "4", "s", "1", None), (0, "purchase", "5", "s", "1", 2)]
    got = {r.user_id: (r.eligibility_status, r.purchased_24h, r.amount_status) for r in cohorts.cart_recovery(facts(spark, rows), "2024-01-01 00:00:00", "2024-01-02 00:00:00").collect()}
    out = ("waiting_purchase_excluded", None, "not_applicable")
    assert got == {"1": out, "2": ("eligible", 1, "complete_observed"), "3": ("eligible", 0, "no_purchases"), "4": ("eligible", 1, "unknown"), "5": out, "6": ("eligible", 0, "no_purchases")}


def test_gates(spark):
    rows = [(0, "view", "1", "s", "1", 1), (1440, "purchase", "1", "s", "1", None), (2880, "view", "", "s", "1", 1), (4320, "view", "1", "", "1", 1)]
    got = {str(r.utc_date)[-2:]: (r.status, r.reason_codes) for r in gates.date_gates(facts(spark, rows), "2024-01-01", "2024-01-05").collect()}
    assert got["01"] == ("allowed", "[]") and got["02"] == ("count_only", '["purchase_amount_incomplete"]') and got["04"][0] == "allowed_with_warnings"
    assert got["03"] == ("blocked", '["core_user_id_missing","ineligible_events"]') and got["05"] == ("blocked", '["date_not_observed"]')
    told = gates.date_gates(facts(spark, rows), "2024-01-01", "2024-01-05")
    with pytest.raises(ValueError, match="2024-01-03"):
        gates.gated_read(facts(spark, rows), told, "count", "2024-01-01", "2024-01-04", strict=True)


def test_screening(spark):
    amount = {d: 100 for d in range(1, 32)} | {1: 80, 8: 100, 15: 120, 22: 10}
    days = spark.createDataFrame([(dt.date(2019, 10, d), 10, 5, Decimal(v), True, True) for d, v in amount.items()], "utc_date date, active_users long, buyers long, purchase_amount decimal(38,2), count_allowed boolean, amount_allowed boolean")
    calendar = days.select("utc_date")
    row = {r.utc_date.day: r for r in diagnosis.screen(days, calendar).collect()}
    assert (row[22].history_count, row[22].median_amount, row[22].mad, row[22].amount_difference, row[22].candidate) == (3, 100, 20, -90, True)
    assert row[22].score == pytest.approx(-7500 / 2471, abs=1e-6) and row[7].status == "insufficient_history" and row[29].status == "evaluated"
    assert diagnosis.select_case(diagnosis.screen(days, calendar)).collect()[0].selection == "downward_candidate"
    gone = {r.utc_date.day: r for r in diagnosis.screen(days.where("utc_date <> '2019-10-08'"), calendar).collect()}
    assert gone[22].status == "insufficient_history_with_gaps" and "missing_date:2019-10-08" in gone[22].reason and gone[8].status == "current_date_missing"


def test_basket_values(spark):
    got = {r.strategy: r.contribution for r in pricing.basket_strategies(spark.createDataFrame([("b", 40.0, 0.3, 2, 4.0)], "basket_id string, s0 double, m0 double, h int, l0 double")).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {"REFERENCE": 8, "ABSORB": 2, "PASS_HALF": 5, "PASS_FULL": 8, "ADD_SAME_CATEGORY": 4, "ADD_NEW_CATEGORY": 1}


def test_empty_inputs_keep_their_overall_row(spark):
    none = facts(spark, [(0, "view", "1", "s", "1", 1)]).where("false")
    row = quality.measures(none).collect()
    assert len(row) == 1 and row[0].period == "__all__" and row[0].events == 0 and row[0].amount == 0
    paths = funnel.paths(none, "2024-02-01 00:00:00")
    assert {r.segment for r in funnel.summary(paths).collect()} == {"all", *funnel.BANDS}


def test_tests_have_states(spark):
    counts = spark.createDataFrame([("a", 0, 10, 0, 5), ("b", 1, 10, 1, 5), ("c", 50, 50, 5, 25), ("d", 100, 100, 30, 50)], "s string, n1 long, n0 long, k1 long, k0 long")
    got = {r.s: r for r in experiments.test_proportions(counts).collect()}
    assert [got[s].status for s in "abcd"] == ["empty_group", "insufficient_n", "sparse_cells", "ok"] and got["c"].z is None
    assert got["d"].se == pytest.approx(math.sqrt(0.3 * 0.7 / 100 + 0.25 / 100))


def test_tail_values(spark):
    row = spark.range(1).select(tails.normal_two_sided(F.lit(1.959963984540054)).alias("z"), tails.chi_square_one(F.lit(3.841458820694124)).alias("x"), tails.student_two_sided(F.lit(2.228138851964939), F.lit(10.0)).alias("t")).collect()[0]
    assert row.z == pytest.approx(0.05, abs=1e-9) and row.x == pytest.approx(0.05, abs=1e-9) and row.t == pytest.approx(0.05, abs=1e-9)
    given = [(z / 7, float(df)) for z in (0, 1, 10, 17, 18, 25, 40, 80) for df in (1, 2, 7, 1000)] + [(None, 3.0)]
    rows = spark.createDataFrame(given, "z double, df double").select("*", tails.normal_two_sided("z").alias("p"), tails.student_two_sided("z", "df").alias("t")).collect()
    for r in rows:
        if r.z is None:
            assert r.p is None and r.t is None
            continue
        assert r.p == pytest.approx(math.erfc(r.z / math.sqrt(2)), rel=1e-11)
        closed = {1: lambda z: 1 - 2 / math.pi * math.atan(z), 2: lambda z: 1 - z / math.sqrt(2 + z * z)}
        if r.df in closed:
            assert r.t == pytest.approx(closed[r.df](r.z), rel=1e-9, abs=1e-13)
    big = {r.z: r.t for r in rows if r.df == 1000}
    # To first order in 1 / df the tail of Student's t is that of the normal with z (1 - (z^2 + 1) / (4 df)).
    assert all(t == pytest.approx(math.erfc(z * (1 - (z * z + 1) / 4000) / math.sqrt(2)), rel=2e-3) for z, t in big.items() if z < 3)


def test_counter_weights(spark):
    """Poisson weights of mean one and n; the same whenever and wherever they are drawn."""
    df = spark.range(4000).select("id", resample.block_hash(5, F.col("id"), F.lit("x")).alias("h"))
    u = resample.uniform(resample.digits(F.col("h"), 0))
    cols = [resample.poisson_one(resample.digits(F.col("h"), k)).alias(f"w{k}") for k in range(4)] + [resample.poisson_many(resample.normal_point(u, resample.tail(u)), F.lit(400)).alias("many")]
    rows = df.select("id", *cols).collect()
    again = {r.id: r for r in df.repartition(7).select("id", *cols).collect()}
    assert all(again[r.id] == r for r in rows)
    for k in range(4):
        w = [r[f"w{k}"] for r in rows]
        assert abs(statistics.mean(w) - 1) < 0.06 and abs(statistics.variance(w) - 1) < 0.1
        assert abs(sum(x == 0 for x in w) / len(w) - math.exp(-1)) < 0.03
    many = [r.many for r in rows]
    assert abs(statistics.mean(many) - 400) < 1.2 and abs(statistics.variance(many) / 400 - 1) < 0.1
    u = [1e-6, 0.01, 0.3, 0.5, 0.9, 0.99, 1 - 1e-6]
    points = spark.createDataFrame([(x,) for x in u], "u double").select(resample.normal_point(F.col("u"), resample.tail(F.col("u"))).alias("z")).collect()
    assert [r.z for r in points] == pytest.approx([statistics.NormalDist().inv_cdf(x) for x in u], abs=1e-7)


def test_exact_quantiles(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003 / 7).alias("v"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 4).alias("w"), F.lit(None).cast("double").alias("none"))
    ps = [0.0, 0.25, 0.5, 0.9, 1.0]
    want = df.select(*[F.percentile(c, F.array(*map(F.lit, ps))).alias(c) for c in ("v", "w")]).collect()[0]
    got = quantiles.exact_quantiles(df, ["v", "w", "none"], ps, accuracy=100)
    assert got["v"] == pytest.approx(want.v) and got["w"] == pytest.approx(want.w) and got["none"] == [None] * 5
    # Brackets narrowed again and again, until few rows are inside; two heavy values; a bracket that misses.
    for most, accuracy in ((200, 50), (3, 10), (1, 5)):
        assert quantiles.exact_quantiles(df, ["v", "w"], ps, accuracy=accuracy, most=most) == {"v": pytest.approx(want.v), "w": pytest.approx(want.w)}


def test_score_ranks_compare_fractions(spark):
    """Two scores that differ after the ninth digit are told apart, equal fractions tie."""
    n = 10**12
    rows = [(0, 2, 4, 1, 2), (1, 10, 20, 5, 10), (2, n // 2 + 1, n, n // 4 + 1, n), (3, n // 2, n, n // 4, n), (4, n // 2 + 2, n, n // 4 + 1, n), (5, 0, 0, 0, 0)]
    rates = spark.createDataFrame(rows, "group_id int, score_y1 long, score_n1 long, score_y0 long, score_n0 long")
    got = {r.group_id: (r.response_rank, r.incremental_rank) for r in targeting.score_ranks(rates).collect()}
    assert got == {0: (1, 3), 1: (1, 3), 2: (2, 2), 3: (3, 2), 4: (2, 1), 5: (4, 3)}


def test_cells_follow_the_rows():
    assert [targeting.cell_digits(n) for n in (0, 10**4, 10**6, 10**8, 10**12)] == [1, 1, 2, 4, 4]


def test_ranks_do_not_see_outcomes(spark, sample):
    from tidemark.sources.tables import experiment

    rows = targeting.split(experiment(spark, sample))
    turned = rows.withColumn("conversion", 1 - F.col("conversion"))
    assert rows.select("row_id", "split").exceptAll(turned.select("row_id", "split")).isEmpty()
    cuts = [r.cuts for r in targeting.train_cuts(rows, ["f0", "f1"]).orderBy("feature").collect()]
    assert cuts == [r.cuts for r in targeting.train_cuts(turned, ["f0", "f1"]).orderBy("feature").collect()]


def test_bootstrap_is_centred(spark, sample):
    from tidemark.plans.targeting_queries import _types

    types = _types(spark, sample).persist()
    point = {(r.policy, r.capacity): r.gain for r in targeting.coverage(types).collect()}
    mean = {(r.policy, r.capacity): (r.m, r.s) for r in targeting.joint_bootstrap(types, 60, 5).groupBy("policy", "capacity").agg(F.avg("gain").alias("m"), F.stddev("gain").alias("s")).collect()}
    assert all(abs(m - point[k]) < max(1.0, s) for k, (m, s) in mean.items())


def test_scans_and_sinks(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(",".join(parse.RAW_COLUMNS) + '\nt,view,1,2,"a\nb","x,""y""",,7,s\n')
    row = files.scan_strict_csv(spark, str(path)).collect()[0]
    assert (row.category_code, row.brand, row.price) == ("a\nb", 'x,"y"', "")
    (tmp_path / "bad.csv").write_text("x,y\n1,2\n")
    with pytest.raises(Exception, match="."):
        files.scan_strict_csv(spark, str(tmp_path / "bad.csv")).collect()
    df = spark.range(5).withColumn("d", F.array(F.col("id")))
    back = files.sink_parquet_exclusive(df, str(tmp_path / "p"))
    assert back.exceptAll(df).isEmpty()
    with pytest.raises(Exception, match="."):
        files.sink_parquet_exclusive(df, str(tmp_path / "p"))
    with pytest.raises(ValueError, match="more than 4"):
        files.bounded_fetch(df, 4)
    assert len(files.bounded_fetch(df, 5)) == len(list(files.stream_fetch(df))) == 5
    files.sink_report_csv(df, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).where("d = '[3]'").count() == 1
    assert files.scan_parquet_list(spark, [str(tmp_path / "p")], df.schema).count() == 5
    one, two = (files.scan_union_periods([df, df], ["id"], "id", a, b).count() for a, b in ((0, 2), (0, 5)))
    assert (one, two) == (4, 10)
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.txt").write_text("1")
    (tmp_path / "m" / "y.txt").write_text("1")
    assert [r.copied for r in files.content_manifest(spark, str(tmp_path / "m")).collect()] == [True]
    (tmp_path / "t.tsv").write_text("0\tabc\t1\ttrain\n")
    assert files.scan_delimited_members(spark, str(tmp_path / "t.tsv")).collect()[0].split == "train"
    (tmp_path / "j.jsonl").write_text('{"a": 1}\n')
    assert files.scan_jsonl(spark, str(tmp_path / "j.jsonl"), "a int").collect()[0].a == 1


def test_streamed_days_equal_a_batch(spark, tmp_path):
    df = facts(spark, [(m, k, "1", "s", "1", 2) for m in (0, 100, 1500, 3000) for k in ("view", "purchase")])
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = daily_counts(stream).writeStream.outputMode("complete").format("memory").queryName("days").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("days").exceptAll(daily_counts(df)).isEmpty() and spark.table("days").count() == daily_counts(df).count() == 6
