"""Hand-made frames for the decisions that tables of clean data don't reach."""

import datetime as dt
import difflib
import itertools
import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as X
from tidemark.operators import flows, fundamentals, joins, merge, portfolio, scan, screen, series, text
from tidemark import catalog
from tidemark.sources import fixtures, ingest
from tidemark.sources.keyed_table import KeyedTable
from tidemark.streaming import jobs

DAY = dt.date(2024, 1, 1)


def values(df, column="v"):
    return [r[column] for r in df.select(column).collect()]


def column(spark, rows, kind, expression):
    return values(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}").orderBy("i").select(expression.alias("v")))


def bars(spark, closes, symbol=1, spread=0.0, volume=None):
    rows = [(symbol, DAY + dt.timedelta(days=i), c, c + spread, c - spread, c, float(volume[i] if volume else 100)) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol long, date date, open double, high double, low double, close double, volume double")


def test_ratio_has_no_errors(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 1.0), (4.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(X.ratio("a", "b")).collect()] == [None, None, 2.0]
    assert [r[0] for r in df.select(X.ratio("a", "b", 9.0)).collect()] == [9.0, 9.0, 2.0]


def test_amounts_percents_dates(spark):
    assert column(spark, ["(1,428.27)", "21%", "-", "", "1,23,456.5", None, "x"], "string", X.amount("x")) == [-1428.27, None, None, None, 123456.5, None, None]
    assert column(spark, ["21%", "-", "1,000", None], "string", X.percent("x")) == [21.0, None, 1000.0, None]
    assert column(spark, ["05-Jan-2024", "2024-01-05", "5-January-2024", "05-01-2024", "junk", None], "string", X.any_date("x")) == [dt.date(2024, 1, 5)] * 4 + [None] * 2
    assert column(spark, ["Mar 2024", "Jan-24", "2024-02", "March-2024", "March 2024", "202403", "31/12/2023", "31-12-2023", "2023-12-31", "Jan-95", "x"], "string", X.period("x")) == ["2024-03", "2024-01", "2024-02", "2024-03", "2024-03", "2024-03", "2023-12", "2023-12", "2023-12", "1995-01", None]
    assert column(spark, ["Mar 2024"], "string", X.quarter_label_end("x")) == [dt.date(2024, 3, 31)]
    assert column(spark, ["Crème & Co. Ltd"], "string", X.normal_name("x")) == ["CRE ME CO LTD"]  # a mark taken off its letter counts as a space
    names = ["Straße ﬁne ½ Ⅳ", "ＡＢＣ Ltd", "Łódź", "plain-name_1", "", None, "日本"]
    norm = lambda t: re.sub(r"\s+", " ", re.sub("[^A-Z0-9]+", " ", unicodedata.normalize("NFKD", t).upper())).strip()
    assert column(spark, names, "string", X.normal_name("x")) == [None if n is None else norm(n) for n in names]
    assert column(spark, ["Tata Steel Pvt. Ltd."], "string", X.slug("x")) == ["tata-steel-pvt"]
    assert column(spark, ["A & B Co. India", "Tata Power Company Limited", "X India Ltd", "--", None], "string", X.slug("x")) == ["a-and-b-co", "tata-power", "x", "", None]
    assert column(spark, ["Tata Steel Ltd.", "!", None], "string", X.slug_candidates("x")) == [["tata-steel-ltd", "tata-steel-ltd-ltd", "tata-steel-ltd-limited", "tata-steel"], [], []]


def test_level_status_has_seven_states(spark):
    rows = [(None, 1.0, 2.0), (10.0, None, None), (10.0, 10.0, None), (10.0, 5.0, 10.0), (10.0, 9.8, None), (10.0, 5.0, 10.2), (10.0, 5.0, 20.0)]
    df = spark.createDataFrame(rows, "p double, s double, t double")
    assert [r[0] for r in df.select(portfolio.level_status("p", "s", "t")).collect()] == ["NO_PRICE", "NO_LEVELS", "STOP_HIT", "TARGET_HIT", "NEAR_STOP", "NEAR_TARGET", "OK"]


def test_pledge_boundaries(spark):
    df = spark.createDataFrame([(25.0, 50.0), (25.1, 50.0), (10.0, 40.0), (10.1, 50.0), (None, None), (0.0, 29.9), (0.0, 39.9)], "p double, h double")
    assert [r[0] for r in df.select(portfolio.pledge_flag("p", "h")).collect()] == ["AMBER", "RED", "OK", "AMBER", "OK", "RED", "AMBER"]


def test_health_ignores_nulls(spark):
    df = spark.createDataFrame([(None,) * 5 + (None,), (-1.0, None, None, None, None, False), (1.0, 1.0, -1.0, 120.0, 0.0, False), (1.0, -1.0, 1.0, 80.0, 0.0, False)], "a double, b double, c double, d double, e double, f boolean")
    assert [r[0] for r in df.select(portfolio.health(*map(F.col, "abcdef"))).collect()] == ["OK", "ACTION", "WATCH", "ACTION"]


def test_streak_ends_at_a_missing_quarter(spark):
    q = [dt.date(2023, 3, 31), dt.date(2023, 6, 30), dt.date(2023, 9, 30), dt.date(2023, 12, 31)]
    rows = [(1, q[0], 1.0), (1, q[1], 2.0), (1, q[2], 3.0), (1, q[3], 4.0), (2, q[0], 1.0), (2, q[2], 2.0), (2, q[3], 3.0), (3, q[2], 9.0), (3, q[3], 3.0), (4, q[2], 1.0)]
    df = spark.createDataFrame(rows, "ticker long, as_of date, pct double")
    assert dict(flows.streaks(df, F.lit(q[3])).collect()) == {1: 3, 2: 1, 3: 0}


def test_index_starts_at_its_base_and_clips(spark):
    m = spark.createDataFrame([(1, "A", "U")], "symbol long, index_name string, universe string")
    levels = values(series.equal_weight_index(series.aligned(bars(spark, [100.0, 50.0, 55.0]), m)).orderBy("date"), "level")
    assert math.isclose(levels[0], 1000.0) and math.isclose(levels[1], 650.0) and math.isclose(levels[2], 715.0)


def test_rs_does_not_depend_on_scale(spark):
    b = bars(spark, [10.0, 12.0, 9.0, 11.0, 13.0, 12.0, 14.0], symbol=1)
    bench = b.select("date", (F.col("close") * F.lit(0.5) + 3).alias("close"))
    one = series.rs_ratio_momentum(b, bench, 3, "symbol", "close").orderBy("date").collect()
    two = series.rs_ratio_momentum(b.withColumn("close", F.col("close") * 7), bench, 3, "symbol", "close").orderBy("date").collect()
    for a, c in zip(one, two, strict=True):
        assert (a.rs_ratio is None) == (c.rs_ratio is None) and (a.rs_ratio is None or math.isclose(a.rs_ratio, c.rs_ratio))


def test_resistance_of_three_touches(spark):
    closes = [90.0 + (10.0 if i % 20 == 10 else 4.0 * math.sin(i)) for i in range(80)] + [97.0]
    r = screen.resistance(bars(spark, closes)).collect()
    assert len(r) == 1 and r[0].touches >= 3 and abs(r[0].level - 100.0) < 5


def test_double_bottom_and_cup(spark):
    w = [100.0 - abs(i - 10) * 0 - max(0, 10 - abs(i - 12)) for i in range(25)] + [100.0 - max(0, 10 - abs(i - 12)) for i in range(25)] + [99.0]
    level = spark.createDataFrame([(1, 101.0, DAY, w[-1])], "symbol long, level double, base_start date, last_close double")
    assert screen.double_bottom(screen.base_rows(bars(spark, w), level)).collect()[0].w_pattern
    cup = [100.0 - 25 * math.sin(math.pi * i / 70) for i in range(71)] + [98.0, 97.0, 97.5, 98.0, 99.0]
    level = spark.createDataFrame([(1, 100.0, DAY, cup[-1])], "symbol long, level double, base_start date, last_close double")
    assert screen.cup_and_handle(screen.base_rows(bars(spark, cup), level)).collect()[0].cup_handle


def test_vcp_counts_contractions(spark):
    path, x = [], 100.0
    for depth in (14.0, 9.0, 5.0):
        path += [x - depth * (1 - abs(i - 8) / 8) for i in range(16)]
    path += [x] * 1 + [96.0] * 8
    level = spark.createDataFrame([(1, 101.0, DAY, path[-1])], "symbol long, level double, base_start date, last_close double")
    assert screen.vcp(screen.base_rows(bars(spark, path), level)).collect()[0].n_vcp >= 1


def test_too_short_series_have_no_level(spark):
    assert screen.resistance(bars(spark, [10.0] * 12)).count() == 0


def test_drop_reasons_and_survivors_are_the_universe(spark):
    b = bars(spark, [50.0 + i % 7 for i in range(80)], 1).unionByName(bars(spark, [10.0] * 20, 2))
    bench = b.where("symbol = 1").select("date", "close")
    assert screen.breakout_scan(b, bench).count() == 2


def test_scores_with_missing_items(spark):
    row = {c: None for c in fundamentals.ITEMS} | {"symbol": 1, "fy": 2024, "net_income": 5.0, "total_assets": 0.0}
    schema = "symbol long, fy int, " + ", ".join(f"{c} double" for c in fundamentals.ITEMS)
    df = spark.createDataFrame([tuple(row[c] for c in ("symbol", "fy", *fundamentals.ITEMS))], schema)
    m = fundamentals.row_score(df, "fun_01_beneish_m").collect()[0]
    assert math.isclose(m.m_score, -4.84 + 0.92 + 0.528 + 0.404 + 0.892 + 0.115 - 0.172 - 0.327)
    assert fundamentals.row_score(df, "fun_03_piotroski_f").collect()[0].f_score == 1  # no dilution is assumed
    for name in fundamentals.ROW_SCORES:
        assert fundamentals.row_score(df, name).count() == 1
    for name in fundamentals.SPAN_SCORES:
        assert fundamentals.span_score(df, name).count() == 1


def test_order_values(spark):
    want = {
        "Rs. 1,234.5 crore": 1234.5, "Rs 2.5 lakh crore": 250000.0, "2.5 lakh crore": None, "INR 3 billion": 300.0, "INR 3bn": 300.0, "INR 1,250 lakh": 12.5, "1,250 lakhs": 12.5, "5 crore": None,
        "stood at 4,500": 4500.0, "of about Rs 4 500 now": 4500.0, "of 450": 450.0, "of 45": None, "` 12 345 crs": 12345.0, "₹ 45 cr.": 45.0, "1,200 crores": 1200.0, "Rs 600000 crore or 700 crore": None, "Rs 600000 crore, Rs 7 lakh crore": 700000.0, "nothing": None, None: None,
    }
    assert column(spark, list(want), "string", text.order_value("x")) == list(want.values())


def test_order_mentions_name_each_value_once(spark):
    rows = [(1, "Order book stood at Rs 1,200 crore. Order inflow of Rs 300 crore; order\nbook again Rs 1,200 crore"), (2, "order inflow Rs 50 crore"), (3, None)]
    got = text.order_mentions(spark.createDataFrame(rows, "id int, text string"), "id").collect()
    assert sorted(map(tuple, got)) == [(1, "book", 1200.0), (1, "inflow", 300.0), (2, "inflow", 50.0)]


def test_sentences_and_tone(spark):
    long = "We expect strong growth. Nothing here at all worth it\n No outlook\n" + "x" * 300 + " guidance."
    assert column(spark, [long, None], "string", text.sentences("x", text.GUIDANCE)) == [["We expect strong growth."], []]
    assert column(spark, ["Revenue for FY26 rises by ten percent"], "string", text.sentences("x", ("FY",))) == [["Revenue for FY26 rises by ten percent"]] and column(spark, ["Revenue for FY26 rises by ten percent"], "string", text.sentences("x", ("FY",), strict=True)) == [[]]
    got = text.tone(spark.createDataFrame([("Strong demand, but risk and delay. We are confident; subject to law",), (None,)], "text string")).select("pos", "neg", "score", "confidence").collect()
    assert [tuple(r) for r in got] == [(3, 2, 0.2, 0.5), (0, 0, 0.0, 0.5)]  # "confident" is a positive word too


def test_ratings_by_pattern(spark):
    rows = ["CRISIL AA+ / Stable outlook", "[ICRA]A1+ and rated: BBB", "CARE A; Negative Outlook, then Positive outlook", "upgraded from X to 'BB+'", None]
    assert column(spark, rows, "string", text.ratings("x")) == [["AA+"], ["A1+", "BBB"], ["A"], ["BB+"], []]
    assert column(spark, rows, "string", text.outlook("x")) == ["Stable", None, "Positive", None, None]


def test_excerpts_keep_the_original_case(spark):
    assert column(spark, ["One GOING concern two Going  Concern"], "string", text.excerpts(F.col("x"), r"going\s+concern", 4, 2)) == [["One GOING concern t", "two Going  Concern"]]


def test_balanced_arrays(spark):
    rows = ['x "m":[1,[2,"]"],3] y [4]', 'x "m":[1', "", None, '[9] "m" none', r'{\"m\":[\"a\",\"[b\"]}', '"m":["a"] "m":["b"]']
    assert column(spark, rows, "string", text.embedded_array("x", "m")) == [["1", '[2,"]"]', "3"], None, None, None, None, ["a", "[b"], ["a"]]


def test_bars_keep_the_last_of_a_day(spark):
    rows = [(1, dt.datetime(2024, 1, 1, 9), 1.0, 1), (1, dt.datetime(2024, 1, 1, 9), 2.0, 2), (1, dt.datetime(2024, 1, 2, 9), float("nan"), 3)]
    df = spark.createDataFrame(rows, "symbol long, ts timestamp, close double, ingest_order int").select("*", *[F.lit(1.0).alias(c) for c in ("open", "high", "low", "volume")])
    assert values(ingest.normalised_bars(df).orderBy("date"), "close") == [2.0, None]


def test_upsert_twice_changes_nothing(spark):
    kept = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = merge.upsert(kept, new, ["k"])
    assert sorted(map(tuple, merge.upsert(once, new, ["k"]).collect())) == sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, merge.insert_absent(kept, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    import pathlib

    out = str(tmp_path / "t")
    files = lambda: {str(p.relative_to(out)): p.stat().st_mtime_ns for p in pathlib.Path(out, "data").rglob("*.parquet")}
    table = KeyedTable(spark, out, ["k"], buckets=16)
    each = jobs.merging(out, ["k"], buckets=16)
    batch = lambda rows: spark.createDataFrame(rows, "k int, v string, seq int")
    assert table.read() is None
    each(batch([(k, "a", k) for k in range(100)] + [(5, "b", 900), (None, "n", 1)]), 0)
    first = files()
    got = {r.k: r.v for r in table.read().collect()}
    assert got == {**dict.fromkeys(range(100), "a"), 5: "b", None: "n"}
    each(batch([(3, "c", 1000), (200, "d", 1001)]), 1)
    second = files()
    now = {r.k: r.v for r in table.read().collect()}
    assert now == {**got, 3: "c", 200: "d"}
    used = table.manifest(1)[0]
    assert sorted(used.values()).count(1) <= 2 and sum(b == 0 for b in used.values()) >= 14  # two keys, two buckets at most
    assert all(second[f] == first[f] for f in first)
    each(batch([(3, "c", 1000), (200, "d", 1001)]), 1)  # the batch runs again
    assert {r.k: r.v for r in table.read().collect()} == now and table.manifest(1)[0] == used
    assert {f: t for f, t in files().items() if "batch=0" in f} == {f: t for f, t in second.items() if "batch=0" in f}
    each(batch([]), 2)
    assert table.manifest(2)[0] == used and {r.k: r.v for r in table.read(0).collect()} == got
    each(spark.createDataFrame([(4, "e", 2000, 1.5)], "k int, v string, seq int, more double"), 3)
    later = {r.k: (r.v, r.more) for r in table.read().collect()}
    assert later == {**{k: (v, None) for k, v in now.items()}, 4: ("e", 1.5)}
    table.forget(keep=1)
    assert {r.k: (r.v, r.more) for r in table.read().collect()} == later and table.batches() == [3]
    with pytest.raises(ValueError):
        KeyedTable(spark, out, ["v"], buckets=16).read()
    with pytest.raises(ValueError):
        KeyedTable(spark, out, ["k"], buckets=8).read()


@pytest.mark.parametrize("how", ["upsert", "insert", "replace"])
def test_merges_in_batches_equal_one_merge(spark, tmp_path, how):
    rng = random.Random(3)
    keys = ["d"] if how == "replace" else ["d", "k"]
    each, kept = jobs.merging(str(tmp_path / how), keys, how, buckets=4), {}
    for number in range(4):
        rows = [(rng.randint(0, 9), rng.randint(0, 5), rng.random(), number * 100 + i) for i in range(30)]
        each(spark.createDataFrame(rows, "d int, k int, v double, seq int"), number)
        if how == "replace":
            days = {r[0] for r in rows}
            kept = {key: r for key, r in kept.items() if r[0] not in days} | {(number, i): r for i, r in enumerate(rows)}
        else:
            for r in sorted(rows, key=lambda r: -r[3] if how == "insert" else r[3]):
                if how == "upsert" or r[:2] not in kept or kept[r[:2]][3] >= number * 100:
                    kept[r[:2]] = r
    got = KeyedTable(spark, str(tmp_path / how), keys, buckets=4).read()
    assert sorted(tuple(r) for r in got.select("d", "k", "v", "seq").collect()) == sorted(kept.values())


def test_macro_files(spark, tmp_path):
    (tmp_path / "gst_gross.csv").write_text("Period,Value\n2024-01,1.5\n2024-02,x\nbad,2\n")
    assert [tuple(r) for r in ingest.macro_series(spark, f"file://{tmp_path}").collect()] == [("gst_gross", dt.date(2024, 1, 1), 1.5)]


def test_watch_names_match_both_ways(spark):
    names = spark.createDataFrame([(1, "ACME Growth Fund - Series II"), (2, "Zeta"), (3, None)], "id int, name string")
    watch = spark.createDataFrame([("Acme Growth",), ("Zeta Capital Ltd",)], "name string")
    assert dict(joins.watch_matches(names, watch).collect()) == {1: "Acme Growth", 2: "Zeta Capital Ltd"}


def test_watch_names_of_any_length(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("AB") for _ in range(rng.randint(1, 14)))
    names, watch = [word() for _ in range(80)], [word() for _ in range(60)]
    got = dict(joins.watch_matches(spark.createDataFrame(list(enumerate(names)), "id int, name string"), spark.createDataFrame([(w,) for w in watch], "name string")).collect())
    want = {i: ",".join(sorted({w for w in watch if w in n or n in w})) for i, n in enumerate(names)}
    assert got == {i: m for i, m in want.items() if m}


def test_watch_names_in_blocks_and_chunks(spark, monkeypatch):
    """Many small blocks and chunks give what one of each gives; repeated names and ids, names of signs only and an empty list are no matter."""
    rng = random.Random(8)
    word = lambda: " ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 4)))
    rows = [(i // 2, n) for i, n in enumerate([word() for _ in range(60)] * 2 + ["--", "", None])]
    watch = [word() for _ in range(25)]
    names, listed = spark.createDataFrame(rows, "id int, name string"), spark.createDataFrame([(x,) for x in [*watch, None, "?"]], "name string")
    show = lambda df: {r.id: r.matches for r in df.collect()}
    want = {}
    for i, n in rows:
        want.setdefault(i, set()).update(w for w in watch if n and (w.upper() in n.upper() or n.upper() in w.upper()))
    want = {i: ",".join(sorted(m)) for i, m in want.items() if m - {""}}
    assert show(joins.watch_matches(names, listed)) == want
    monkeypatch.setattr(joins, "CHUNK", 4)
    assert show(joins.watch_matches(names, listed, block=3)) == want
    assert show(joins.watch_matches(names, listed.limit(0))) == {} and show(joins.watch_matches(names.limit(0), listed)) == {}


def test_close_matches_equal_difflib(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 6)))
    keys = sorted({"-".join(word() for _ in range(rng.randint(1, 3))) for _ in range(150)})
    def edit(k):
        k = list(k)
        for _ in range(rng.randint(0, 3)):
            k[rng.randrange(len(k))] = rng.choice(["", "x", "ab"])
        return "".join(k)
    names = [edit(rng.choice(keys)) for _ in range(80)]
    got = {}
    for r in joins.close_matches(spark.createDataFrame(list(enumerate(names)), "id int, name string"), spark.createDataFrame([(k,) for k in keys], "key string")).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append(r.key)
    df = spark.createDataFrame(list(enumerate(names)), "id int, x string")
    for i, tried in df.select("id", X.slug_candidates("x")).collect():
        tried = [c for c in tried if c]
        direct = [c for c in tried if c in keys]
        want = direct or (difflib.get_close_matches(max(tried, key=len), keys, n=5, cutoff=0.7) if tried else [])
        assert got.get(i, []) == want, (i, names[i])


def test_segment_pairs_lose_no_similar_key(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abc-") for _ in range(n)).strip("-") or "a"
    keys = sorted({word(rng.randint(1, 22)) for _ in range(160)})
    names = [word(rng.randint(1, 22)) if rng.random() < 0.3 else "".join(rng.choice(["", c, c, c, c, "d", c + "e"]) for c in rng.choice(keys)) for _ in range(120)]
    slugs = [r[0] for r in spark.createDataFrame([(n,) for n in names], "x string").select(X.slug("x")).collect()]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for least in (0.55, 0.7, 0.9, 1.0):
        df = joins.similar_keys(spark.createDataFrame(list(enumerate(names)), "id int, name string"), spark.createDataFrame([(k,) for k in keys], "key string"), least, most=1000)
        want = {(i, k) for i, s in enumerate(slugs) for k in keys if s and 1 - distance(s, k) / max(len(s), len(k)) >= least - 1e-12}
        assert {(r.id, r.key) for r in df.collect()} == want
        assert "Cartesian" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    with pytest.raises(ValueError):
        joins.similar_keys(df, df, 0.5)


def test_event_windows_equal_brute_force(spark):
    rng = random.Random(10)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    events = [(rng.choice([*joins.EVENT_WINDOWS, "other"]), rng.randint(0, 6), day(rng.randint(-50, 150)), i) for i in range(400)] + [("announcement", 1, None, 999)]
    owned, asked = {0, 1, 2, 5}, [day(0), day(31), day(64)]
    got = joins.event_windows(spark.createDataFrame(events, "kind string, symbol int, date date, n int"), spark.createDataFrame([(s,) for s in [*owned, 1]], "symbol int"), spark.createDataFrame([(d,) for d in [*asked, day(0)]], "as_of date"))
    near = lambda kind, d, a: d and kind != "other" and (-7 <= (d - a).days <= 0 if kind == "announcement" else 0 <= (d - a).days <= 30)
    assert sorted((r.as_of, r.n) for r in got.collect()) == sorted((a, n) for kind, s, d, n in events for a in asked if s in owned and near(kind, d, a))


def test_greedy_clusters_equal_brute_force(spark):
    rng, rows, want = random.Random(6), [], []
    for portfolio_id in range(12):
        weight = {s: rng.choice([1.0, 2.0, 3.0, 4.0]) / 100 for s in range(14)}
        corr = {p: rng.random() for p in itertools.combinations(range(14), 2) if rng.random() < 0.5}
        rows += [(portfolio_id, a, b, c, weight[a], weight[b]) for (a, b), c in corr.items()]
        free, number = sorted({s for p in corr for s in p}, key=lambda s: (-weight[s], s)), 0
        while free:
            group = []
            for s in free:
                if all(tuple(sorted((s, m))) in corr for m in group):
                    group.append(s)
            free = [s for s in free if s not in group]
            if len(group) > 1:
                number += 1
                inside = [corr[tuple(sorted(p))] for p in itertools.combinations(group, 2)]
                want.append((portfolio_id, number, ",".join(map(str, group)), len(group), round(100 * sum(weight[m] for m in group), 6), round(sum(inside) / len(inside), 6)))
    edges = spark.createDataFrame(rows, "portfolio long, a long, b long, corr double, wa double, wb double")
    got = portfolio.greedy_clusters(edges).collect()
    assert sorted((*r[:4], round(r.weight, 6), round(r.avg_corr, 6)) for r in got) == sorted(want)


def walk(seed, n=300):
    rng, out, price = random.Random(seed), [], 100.0
    for i in range(n):
        price *= 1 + rng.gauss(0.0, 0.015) if i % 90 > 5 else 1.01
        out.append((price, price * (1 + rng.random() * 0.012), price * (1 - rng.random() * 0.012), float(rng.randint(50, 150))))
    return out


def brute_level(highs, days, closes, p):
    """The level of one symbol, from its definition: every pivot tries every level so far, highest first."""
    n, start = len(highs), max(0, len(highs) - p["lookback"])
    h, d = highs[start:], days[start:]
    tops = [i for i in range(len(h)) if any(k <= i < len(h) - k and h[i] == max(h[i - k : i + k + 1]) for k in (3, 8))]
    levels = []
    for v in sorted((h[i] for i in tops), reverse=True):
        for level in levels:
            if abs(v - sum(level) / len(level)) / (sum(level) / len(level)) <= p["band"]:
                level.append(v)
                break
        else:
            levels.append([v])
    rated = []
    for level in levels if n >= p["base_min_days"] + 20 else []:
        r = sum(level) / len(level)
        ages = [(d[-1] - d[i]).days for i in tops if abs(h[i] - r) / r <= p["band"]]
        young = [a for a in ages if a <= p["base_max_days"]]
        distance = (r - closes[-1]) / closes[-1]
        if len(level) < p["min_touches"] or len(ages) < p["min_touches"] or not p["near_low"] <= distance <= p["near_high"] or max(ages) < p["base_min_days"]:
            continue
        if max(ages) > p["base_max_days"] and len(young) < p["min_touches"]:
            continue
        rated.append((len(ages), max(young) if max(ages) > p["base_max_days"] else max(ages), -abs(distance), r))
    if not rated:
        return None
    best = max(rated)
    return max([c for c in rated if c[3] > best[3] * 1.02 and c[0] >= max(2, int(best[0] * 0.8)) and c[1] >= int(best[1] * 0.8)] or [best], key=lambda c: (c[3] if c is not best else 0))


def test_levels_equal_brute_force(spark):
    wide = {**screen.PARAMS, "near_low": -0.3, "near_high": 0.3}
    rows, want = [], {}
    for symbol in range(25):
        series_ = walk(symbol, 30 if symbol == 0 else 300)
        days = [DAY + dt.timedelta(days=i) for i in range(len(series_))]
        rows += [(symbol, d, c, h, low, c, v) for d, (c, h, low, v) in zip(days, series_, strict=True)]
        for name, p in (("narrow", screen.PARAMS), ("wide", wide)):
            want[name, symbol] = brute_level([x[1] for x in series_], days, [x[0] for x in series_], p)
    frame = spark.createDataFrame(rows, "symbol long, date date, open double, high double, low double, close double, volume double")
    for name, p in (("narrow", screen.PARAMS), ("wide", wide)):
        got = {r.symbol: (r.touches, r.base_days, round(-abs(r.distance), 9), round(r.level, 6)) for r in screen.resistance(frame, p).collect()}
        assert got == {s: (c[0], c[1], round(c[2], 9), round(c[3], 6)) for (n, s), c in want.items() if n == name and c}
    assert any(want.values())


def scan_by_parts(bars, bench, p):
    """The scan put together from its parts, each an operator over all symbols."""
    bars = bars.select("symbol", "date", "open", "high", "low", "close", "volume")
    newest = bars.withColumn("ma50", series.full_mean("close", 50)).withColumn("n", F.count("*").over(Window.partitionBy("symbol"))).withColumn("rn", F.row_number().over(series.from_end())).where("rn = 1").select("symbol", "n", "ma50", "close")
    res = screen.resistance(bars, p)
    base = screen.base_rows(bars, res)
    both = bars.join(bench.select("date", F.col("close").alias("bench")), "date").withColumn("q", X.ratio("close", "bench"))
    rising = series.slope_of_last(both, "q", 50).select("symbol", ((F.col("slope") > 0) & (F.col("n") >= 50)).alias("rs_rising"))
    plan = screen.risk_plan(screen.composite_score(bars, res, bench, p))
    x = newest.join(screen.not_extended(bars), "symbol").join(plan.drop("n", "ma50", "close"), "symbol", "left").join(rising, "symbol", "left")
    for more in (screen.failed_breakout(bars, res), screen.recent_test(bars, res, p), screen.base_geometry(base), screen.cup_and_handle(base), screen.vcp(base), screen.double_bottom(base, p=p)):
        x = x.join(more, "symbol", "left")
    return x


@pytest.mark.parametrize("seed", [0, 100, 200])
def test_folded_scan_equals_its_parts(spark, seed):
    wide = {**screen.PARAMS, "near_low": -0.3, "near_high": 0.3, "max_base_range": 5.0, "min_score": 1.0}
    rows = [(s, DAY + dt.timedelta(days=i), c, h, low, c, v) for s in range(24) for i, (c, h, low, v) in enumerate(walk(seed + s)[: 260 if s % 3 else 30 + 9 * s])]
    frame = spark.createDataFrame(rows, "symbol long, date date, open double, high double, low double, close double, volume double").cache()
    bench = frame.groupBy("date").agg(F.avg("close").alias("close")).where("day(date) <> 7")
    parts = {r.symbol: r for r in scan_by_parts(frame, bench, wide).collect()}
    folded = {r.symbol: r for r in screen.breakout_scan(frame, bench, wide).collect()}
    assert set(folded) == set(parts) and sum(r.level is not None for r in folded.values()) > 5
    for s, r in folded.items():
        for c in scan.SCAN_COLUMNS:
            a, b = r[c], parts[s][c]
            assert (a is None) == (b is None) and (a == b or isinstance(a, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)), (s, c, a, b)


def test_scan_scores_from_their_definition(spark):
    """Plan and the parts of the score of one symbol, worked out in plain Python, and the funnel's sums."""
    wide = {**screen.PARAMS, "near_low": -0.3, "near_high": 0.3, "max_base_range": 5.0, "min_score": 1.0}
    rows = [(s, DAY + dt.timedelta(days=i), c, h, low, c, v) for s in range(8) for i, (c, h, low, v) in enumerate(walk(s))]
    frame = spark.createDataFrame(rows, "symbol long, date date, open double, high double, low double, close double, volume double").cache()
    bench = frame.groupBy("date").agg(F.avg("close").alias("close"))
    level = {r.symbol: r for r in screen.resistance(frame, wide).collect()}
    scored = {r.symbol: r for r in screen.risk_plan(screen.composite_score(frame, screen.resistance(frame, wide), bench, wide)).collect()}
    assert scored
    for s, r in scored.items():
        mine = [x for x in rows if x[0] == s]
        base = [x for x in mine if x[1] >= level[s].base_start]
        close, low20 = mine[-1][5], min(x[4] for x in mine[-20:])
        assert math.isclose(r.stop, low20 * 0.99) and math.isclose(r.target, 2 * r.level - min(x[4] for x in base))
        if close > r.stop:
            assert math.isclose(r.rr, (r.target - close) / (close - r.stop))
        assert math.isclose(r.risk_pct, (close - r.stop) / close * 100)
        high = max(x[3] for x in mine[-252:])
        assert math.isclose(r.high52, 15 * min(1, max(0, 1 - (high - close) / high / 0.15)))
        v10, v50 = (sum(x[6] for x in mine[-n:]) / n for n in (10, 50))
        assert math.isclose(r.vdu, 5 * min(1, max(0, (1 - v10 / v50) / 0.2)), abs_tol=1e-9)
        assert math.isclose(r.proximity, 20 * max(0, 1 - abs(r.distance) / wide["near_high"]), abs_tol=1e-9)
        assert math.isclose(r.score, r.base_quality + r.vcr + r.vdu + r.proximity + r.trend + r.rs + r.high52)
    rows_found = screen.breakout_scan(frame, bench, wide).collect()
    assert len(rows_found) == 8
    funnel = {(r.kind, r.name): r.n for r in screen.scan_funnel(screen.breakout_scan(frame, bench, wide), wide).collect()}
    left = [r for r in rows_found if r.drop_reason is None]
    assert funnel["survivors", "all"] == len(left) and sum(n for (k, _), n in funnel.items() if k == "dropped") == 8 - len(left)
    assert funnel["pattern", "multi_touch"] == sum(r.touches >= 2 for r in left) and funnel["high_conviction", "all"] == sum(bool(r.high_conviction) for r in left)


def test_accounting_scores_by_hand(spark):
    """Each formula worked out in plain arithmetic on two years of one company."""
    new = dict(
        revenue=1200.0, cogs=700.0, tax=40.0, receivables=210.0, inventory=150.0, total_debt=300.0, total_assets=1500.0, net_income=110.0, operating_cf=130.0, gross_profit=500.0, operating_inc=220.0, depreciation=60.0,
        ebit=200.0, ebitda=260.0, interest_exp=25.0, sga=150.0, pretax_income=175.0, current_assets=520.0, cash=90.0, ppe_net=700.0, payables=120.0, current_liabilities=260.0, working_capital=260.0, long_term_debt=210.0,
        total_liabilities=700.0, equity=800.0, retained_earnings=350.0, intangibles=90.0, capex=-80.0, fcf=50.0, dividends_paid=-30.0, shares_outstanding=100.0, market_cap=1800.0, eps=1.1,
    )
    old = dict(
        revenue=1000.0, cogs=600.0, tax=30.0, receivables=150.0, inventory=120.0, total_debt=320.0, total_assets=1400.0, net_income=80.0, operating_cf=100.0, gross_profit=400.0, operating_inc=170.0, depreciation=55.0,
        ebit=150.0, ebitda=205.0, interest_exp=28.0, sga=120.0, pretax_income=122.0, current_assets=430.0, cash=70.0, ppe_net=680.0, payables=100.0, current_liabilities=250.0, working_capital=180.0, long_term_debt=230.0,
        total_liabilities=690.0, equity=710.0, retained_earnings=280.0, intangibles=95.0, capex=-70.0, fcf=30.0, dividends_paid=-20.0, shares_outstanding=100.0, market_cap=1500.0, eps=0.8,
    )
    df = spark.createDataFrame([(1, y, *map(d.get, fundamentals.ITEMS)) for y, d in ((2023, old), (2024, new))], "symbol long, fy int, " + ", ".join(f"{c} double" for c in fundamentals.ITEMS))
    row = lambda name: fundamentals.row_score(df, name).where("rn = 1").first().asDict()
    span = lambda name: fundamentals.span_score(df, name).first().asDict()

    def near(got, **want):
        for k, v in want.items():
            assert math.isclose(got[k], v, rel_tol=1e-9) if isinstance(v, float) else got[k] == v, (k, got[k], v)

    dsri, gmi = (210 / 1200) / (150 / 1000), (400 / 1000) / (500 / 1200)
    aqi, sgi = (1 - 1220 / 1500) / (1 - 1110 / 1400), 1.2
    depi, sgai = (55 / 735) / (60 / 760), (150 / 1200) / (120 / 1000)
    tata, lvgi = (110 - 130) / 1500, (300 / 1500) / (320 / 1400)
    near(row("fun_01_beneish_m"), m_score=-4.84 + 0.92 * dsri + 0.528 * gmi + 0.404 * aqi + 0.892 * sgi + 0.115 * depi - 0.172 * sgai + 4.679 * tata - 0.327 * lvgi)
    near(row("fun_02_altman_z"), z_score=1.2 * 260 / 1500 + 1.4 * 350 / 1500 + 3.3 * 200 / 1500 + 0.6 * 1800 / 700 + 1200 / 1500, zone="SAFE ZONE")
    near(row("fun_03_piotroski_f"), f_score=9, verdict="STRONG", score=10)
    near(row("fun_04_dupont"), net_margin=110 / 12.0, asset_turnover=0.8, equity_multiplier=1.875, roe=13.75)
    near(row("fun_05_margins"), gross_margin=500 / 12.0, operating_margin=220 / 12.0, ebitda_margin=260 / 12.0, score=7)
    near(row("fun_07_working_capital_days"), dso=210 / 1200 * 365, dio=150 / 700 * 365, dpo=120 / 700 * 365, current_ratio=2.0, dso_surge=False, stuffing=False, score=8)
    near(row("fun_08_leverage"), de=0.375, da=20.0, coverage=8.0, net_debt=210.0, net_de=0.2625, rising=False, score=9)
    near(row("fun_09_return_ratios"), roe=13.75, roa=110 / 15.0, roce=200 / 11.0, tax_rate=40 / 1.75, capex_dep=80 / 60.0)
    near(row("fun_12_forensic_checks"), negative_equity=False, intangible_ratio=6.0, payout_income=30 / 1.1, payout_fcf=60.0, cash_conversion=50 / 1.1, roic=200 * (1 - 40 / 175) / 11.0, quick_ratio=370 / 260.0)
    near(row("fun_13_montier_c"), c_score=2, verdict="MODERATE RISK", score=5)  # receivables up 17 %, inventory over cost up 7 %
    o = -1.32 - 0.407 * math.log(1500) + 6.03 * 700 / 1500 - 1.43 * 260 / 1500 + 0.0757 * 260 / 520 - 2.37 * 110 / 1500 - 1.83 * 130 / 700 - 0.521 * 30 / 190
    near(row("fun_14_ohlson_o"), o_score=o, probability=1 / (1 + math.exp(-o)), verdict="LOW RISK")
    near(row("fun_15_sustainable_growth"), payout=30 / 110.0, sgr=10.0, growth=20.0, gap=10.0)
    near(row("fun_17_springate_s"), s_score=1.03 * 260 / 1500 + 3.07 * 200 / 1500 + 0.66 * 175 / 260 + 0.4 * 0.8, verdict="HEALTHY", score=9)
    near(row("fun_25_debt_stress"), icr=10.4, icr_2x=5.2, icr_3x=260 / 75.0, icr_down_30=7.28, debt_ebitda=300 / 260.0, net_debt_equity=0.2625, short_mix=30.0)
    near(fundamentals.graham(df).first().asDict(), graham=math.sqrt(22.5 * 1.1 * 8), upside=(math.sqrt(22.5 * 1.1 * 8) / 18 - 1) * 100, earnings_yield=220 / 20.1, roic=220 * 0.75 / 11.5, peg=1800 / 110 / 37.5)
    near(span("fun_05_margin_trend"), gross_falling=False, operating_falling=False)
    near(span("fun_06_cash_flow_quality"), neg_cfo=0, neg_fcf=0, cfo_lt_ni=0, score=9)
    near(span("fun_11_growth"), revenue_cagr=20.0, profit_cagr=37.5, revenue_yoy=20.0, eps_growth=37.5)
    near(span("fun_12_loss_years"), loss_years=0, under_investing=0)
    near(span("fun_16_operating_leverage"), avg_dol=(50 / 150 * 100) / 20.0)
    near(span("fun_22_revenue_margin"), revenue_cagr=20.0, pat_cagr=37.5)
    near(span("fun_24_earnings_quality"), avg_cfo_pat=(130 / 110 + 100 / 80) / 2, avg_accrual=(-20 / 1450 + -20 / 1400) / 2)
    near(span("fun_26_dividends"), paid_years=2, avg_payout=(30 / 1.1 + 25) / 2)
    near(span("fun_31_capex_cycle"), intensity=80 / 12.0, maintenance=60.0, growth_capex=20.0, growth_capex_pct=25.0, turnover="stable")
    near(span("fun_32_tax"), avg_rate=(40 / 1.75 + 30 / 1.22) / 2, latest=40 / 1.75)
    assert span("agg_28_earnings_volatility")["cv"] is None  # fewer than three years
    scores = {r.technique: r.score for r in fundamentals.technique_scores(df).collect()}
    assert set(scores) >= {"beneish", "montier", "altman", "piotroski", "benford"} and scores["benford"] in (2.0, 5.0, 9.0)
    base = 10 * sum(fundamentals.WEIGHTS[k] * v for k, v in scores.items()) / sum(fundamentals.WEIGHTS[k] for k in scores)
    flags = [r.severity for r in fundamentals.flags(df).collect()]
    penalty = sum({"critical": 6, "major": 3, "minor": 1.5}.get(x, 0) for x in flags)
    total = fundamentals.overall(fundamentals.technique_scores(df), fundamentals.flags(df)).first()
    assert math.isclose(total.base, base) and math.isclose(total.final, max(0, min(100, base - penalty + min(10, 1.5 * flags.count("green")))))


def test_accounting_scores_where_items_are_missing(spark):
    """What the definitions say of first years, missing items, no debt, payouts above the income, and items that few statements have."""
    base = dict(revenue=1000.0, cogs=600.0, net_income=100.0, equity=500.0, total_debt=200.0, long_term_debt=150.0, ebit=120.0, ebitda=150.0, tax=25.0, pretax_income=100.0, total_assets=900.0, depreciation=40.0, capex=-30.0, interest_exp=-10.0, ppe_gross=800.0)
    years = [
        dict(base),
        {**base, "dividends_paid": -250.0, "revenue": 1300.0, "goodwill": 90.0, "current_debt": 80.0, "invested_capital": 600.0, "depreciation": 25.0, "ppe_gross": 900.0, "cash": 250.0},
        {**base, "total_debt": None, "long_term_debt": None, "interest_exp": 0.0, "capex": None, "intangibles": 45.0, "revenue": -5.0},
    ]
    df = spark.createDataFrame([(1, 2020 + i, *map(d.get, fundamentals.ITEMS)) for i, d in enumerate(years)], "symbol long, fy int, " + ", ".join(f"{c} double" for c in fundamentals.ITEMS))
    row = lambda name: {r.fy: r for r in fundamentals.row_score(df, name).collect()}
    montier = row("fun_13_montier_c")
    assert (montier[2020].c_score, montier[2020].verdict, montier[2020].score) == (None, None, None)
    assert montier[2021].c_score == 1  # 25 of 900 is less than 0.9 of 40 of 800; nothing else is known or rises
    growth = row("fun_15_sustainable_growth")[2021]
    assert math.isclose(growth.payout, 2.5) and growth.retention == 0 and growth.sgr == 0 and math.isclose(growth.gap, 30.0)
    checks = row("fun_12_forensic_checks")
    assert math.isclose(checks[2021].intangible_ratio, 10.0) and math.isclose(checks[2022].intangible_ratio, 5.0) and math.isclose(checks[2021].roic, 120 * 0.75 / 600 * 100) and math.isclose(checks[2020].roic, 120 * 0.75 / 700 * 100)
    debt = row("fun_25_debt_stress")
    assert math.isclose(debt[2020].icr, 15.0) and math.isclose(debt[2020].short_mix, 25.0) and math.isclose(debt[2021].short_mix, 40.0) and debt[2021].net_cash and not debt[2020].net_cash
    assert (debt[2022].icr, debt[2022].short_mix, debt[2022].net_debt, debt[2022].debt_ebitda) == (None, 0.0, 0.0, 0.0)
    assert row("fun_17_springate_s")[2020].verdict == "DISTRESS (bankruptcy risk)"
    span = lambda name: fundamentals.span_score(df, name).first()
    years_of_loss = span("fun_12_loss_years")
    assert years_of_loss.pairs == 2 and years_of_loss.under_investing == 1 and math.isclose(years_of_loss.capex_dep, 60 / 65)  # the year without capex counts on neither side
    spread = span("agg_28_earnings_volatility")
    assert spread.n == 3 and spread.cv == 0 and spread.margin_mean is None and spread.margin_cv is None  # one of three revenues isn't positive
    assert fundamentals.row_score(df.drop(*fundamentals.OPTIONAL), "fun_13_montier_c").where("fy = 2021").first().c_score == 0
    turn = spark.createDataFrame([(1, 2020 + i, r, 500.0, rec, 50.0, 60.0) for i, (r, rec) in enumerate(((1000.0, 100.0), (1000.0, 110.0), (1000.0, 160.0), (-1.0, 90.0)))], "symbol long, fy int, revenue double, cogs double, receivables double, inventory double, payables double")
    turn = fundamentals.span_score(turn, "fun_23_working_capital_trend").first()
    assert turn.n == 3 and turn.dso is None and math.isclose(turn.dio, 36.5) and turn.trend == "deteriorating"  # from the newest year that has a cycle


#: Six years of one company, newest first: a loss in the third, no dividend in the second and fourth, hardly any tax in the fifth.
SIX = dict(
    revenue=[1500.0, 1300.0, 900.0, 1000.0, 800.0, 700.0], gross_profit=[600.0, 500.0, 300.0, 400.0, 312.0, 280.0], ebitda=[330.0, 260.0, 60.0, 180.0, 136.0, 105.0], operating_inc=[280.0, 215.0, 20.0, 145.0, 105.0, 80.0],
    net_income=[180.0, 130.0, -40.0, 90.0, 70.0, 50.0], operating_cf=[210.0, 90.0, 30.0, 100.0, 50.0, 45.0], tax=[60.0, 45.0, 5.0, 30.0, 1.0, 15.0], pretax_income=[240.0, 175.0, -35.0, 120.0, 71.0, 65.0],
    total_assets=[1800.0, 1700.0, 1500.0, 1400.0, 1250.0, 1100.0], current_liabilities=[400.0, 380.0, 350.0, 300.0, 280.0, 250.0], cash=[150.0, 120.0, 80.0, 90.0, 70.0, 60.0], receivables=[300.0, 200.0, 180.0, 170.0, 140.0, 120.0],
    capex=[-120.0, -90.0, -60.0, -70.0, -55.0, -40.0], depreciation=[50.0, 45.0, 40.0, 35.0, 31.0, 25.0], dividends_paid=[-30.0, 0.0, -10.0, 0.0, -15.0, -10.0], fcf=[90.0, 0.0, -30.0, 30.0, -5.0, 5.0],
    total_debt=[300.0, 320.0, 350.0, 280.0, 250.0, 200.0], interest_exp=[25.0, 27.0, 30.0, 22.0, 20.0, 16.0], market_cap=[2500.0] * 6, shares_outstanding=[100.0] * 6, eps=[1.8, 1.3, -0.4, 0.9, 0.7, 0.5], equity=[800.0, 700.0, 600.0, 650.0, 600.0, 560.0],
)


def test_scores_over_six_years_by_hand(spark):
    """Windows of four and five years, a loss, missed dividends and an odd tax year, each in plain arithmetic."""
    df = spark.createDataFrame([(1, 2024 - i, *(SIX[c][i] for c in SIX)) for i in range(6)], "symbol long, fy int, " + ", ".join(f"{c} double" for c in SIX))
    for c in fundamentals.ITEMS:
        if c not in SIX:
            df = df.withColumn(c, F.lit(None).cast("double"))

    def near(got, **want):
        for k, v in want.items():
            assert math.isclose(got[k], v, rel_tol=1e-9, abs_tol=1e-12) if isinstance(v, float) else got[k] == v, (k, got[k], v)

    span = lambda name: fundamentals.span_score(df, name).first().asDict()
    mean = lambda xs: sum(xs) / len(xs)
    capital = [a - b - c for a, b, c in zip(SIX["total_assets"], SIX["current_liabilities"], SIX["cash"], strict=True)]
    rate = [0.25, 45 / 175, 0.15, 0.25, 0.15]  # 5 / -35 and 1 / 71 are raised to 15 %
    roce = [o * (1 - t) / c * 100 for o, t, c in zip(SIX["operating_inc"], rate, capital, strict=False)]
    added = [(SIX["operating_inc"][i] - SIX["operating_inc"][i + 1]) / (capital[i] - capital[i + 1]) * 100 for i in range(4)]  # four steps within five years
    # DCF: cash flows of five years end at -5, so growth is that of revenue over three years, cut at 35 %.
    tax, debt = 60 / 240, 300 / 2800
    wacc = max(0.08, 2500 / 2800 * 0.13 + debt * (25 / 300) * (1 - tax))
    got = fundamentals.capital_allocation(df).first().asDict()
    near(got, avg_roce=mean(roce), incremental_roce=mean(added), high_years=sum(r > 15 for r in roce), reinvestment=70 / 210 * 100, wacc=wacc, spread=mean(roce) - 100 * wacc)
    near(fundamentals.dcf(df).first().asDict(), cagr=1.5 ** (1 / 3) - 1, wacc=wacc, start=90.0)
    young = df.where("fy >= 2023")  # two years: growth over the one step there is
    near(fundamentals.dcf(young).first().asDict(), cagr=1500 / 1300 - 1)
    gm = [g / r * 100 for g, r in zip(SIX["gross_profit"][:5], SIX["revenue"][:5], strict=True)]
    sd = math.sqrt(mean([(g - mean(gm)) ** 2 for g in gm]))
    near(span("fun_22_revenue_margin"), n=5, revenue_cagr=(1.5 ** (1 / 3) - 1) * 100, revenue_cagr_5y=((1500 / 800) ** 0.25 - 1) * 100, pat_cagr=(2 ** (1 / 3) - 1) * 100, gm_sd=sd, pat_margin=12.0, trend="expanding")  # 22 % against 17 %
    backing, assets = [210 / 180, 90 / 130, 30 / -40, 100 / 90], SIX["total_assets"]
    accrual = [(p - c) / ((assets[i] + assets[i + 1]) / 2) for i, (p, c) in enumerate(zip(SIX["net_income"][:4], SIX["operating_cf"][:4], strict=True))]
    near(span("fun_24_earnings_quality"), avg_cfo_pat=mean(backing), avg_accrual=mean(accrual), divergence=(0.5 - 200 / 1300) * 100, capex_dep=2.4)
    near(span("fun_26_dividends"), n=5, paid_years=3, consistent=False, avg_payout=mean([30 / 180 * 100, 0.0, 0.0, 0.0, 15 / 70 * 100]))  # the loss year counts 0
    near(span("fun_31_capex_cycle"), intensity=8.0, maintenance=50.0, growth_capex=70.0, growth_capex_pct=70 / 1.2, turnover="improving")  # 0.83 against 0.64
    near(span("fun_32_tax"), avg_rate=mean([25.0, 45 / 1.75, 25.0, 100 / 71]), latest=25.0, gap=25.2 - mean([25.0, 45 / 1.75, 25.0, 100 / 71]), benefit=True)
    rates = [25.0, 45 / 1.75, 5 / -0.35, 25.0]
    near(span("fun_09_tax_outlier"), n=4, mean=mean(rates), outlier=True, outlier_year=next(2024 - i for i, r in enumerate(rates) if abs(r - mean(rates)) > 10))
    near(fundamentals.graham(df).first().asDict(), graham=math.sqrt(22.5 * 1.8 * 8), upside=(math.sqrt(22.5 * 1.8 * 8) / 25 - 1) * 100, peg=2500 / 180 / ((2 ** (1 / 3) - 1) * 100))
    # Moat: returns above 15 % in four years 2 or two 1, margins 0 to 2 by their spread, growth of 14.5 % 1, capex 2.4 x depreciation 1, backing 0.55 none.
    high = sum(r > 15 for r in roce)
    moat = (2 if high >= 4 else 1 if high >= 2 else 0) + (2 if sd < 3 else 1 if sd < 6 else 0) + 1 + 1 + 0
    near(fundamentals.moat(df).first().asDict(), moat=moat)
    bands, found = spark.createDataFrame([(1, 90.0)], "symbol long, pe_percentile double"), spark.createDataFrame([(1, True, True)], "symbol long, auditor_concern boolean, high_related_party boolean")
    implied = fundamentals.reverse_dcf(fundamentals.dcf(df)).first().implied
    assert fundamentals.risk(df, bands, found).first().risk == 0 + 2 + 1 + 1 + 1 + (1 if implied > 0.3 else 0)  # backing 0.55 is one point
    worst = df.withColumn("total_debt", F.col("ebitda") * 5).withColumn("operating_cf", F.lit(-10.0))
    top = fundamentals.risk(worst, bands, found).first()
    assert float(top.risk) >= 9 and top.kind == "HIGH RISK"
    assert fundamentals.risk(df).first().risk == 1 + (1 if implied > 0.3 else 0)


def test_quarters_by_hand(spark):
    rows = [(1, dt.date(2024, 3, 31), 90.0, 5.0, 20.0), (1, dt.date(2023, 12, 31), 120.0, 9.0, 24.0), (1, dt.date(2023, 9, 30), 100.0, 8.0, 21.0), (1, dt.date(2023, 6, 30), 80.0, -2.0, 8.0), (1, dt.date(2023, 3, 31), 75.0, 4.0, 15.0), (2, dt.date(2024, 3, 31), 10.0, 1.0, 2.0)]
    q = spark.createDataFrame(rows, "symbol long, quarter_end date, revenue double, net_income double, ebitda double")
    got = {r.symbol: r for r in fundamentals.quarter_score(q, "fun_10_quarter_drops").collect()}
    assert math.isclose(got[1].revenue_change, -25) and got[1].revenue_drop and got[1].income_drop and got[2].revenue_change is None and not got[2].revenue_drop
    m = {r.symbol: r for r in fundamentals.quarter_score(q, "win_33_momentum").collect()}
    assert math.isclose(m[1].q0, -25) and math.isclose(m[1].q1, 20) and math.isclose(m[1].revenue_yoy, 20) and math.isclose(m[1].profit_yoy, 25) and m[1].acceleration == "decelerating" and m[2].acceleration == "stable"
    years = spark.createDataFrame([(1, 2023, dt.date(2023, 12, 31)), (1, 2022, dt.date(2023, 1, 1)), (3, 2023, dt.date(2024, 1, 1))], "symbol long, fy int, known_on date")
    known = {(r.symbol, r.fy): (r.quarter_end, r.q_revenue) for r in fundamentals.newest_quarter_known(years, q).collect()}
    assert known == {(1, 2023): (dt.date(2023, 12, 31), 120.0), (1, 2022): (None, None), (3, 2023): (None, None)}


def test_promoter_flags_at_their_steps(spark):
    day = lambda n: dt.date(2024, 3 * n, 28)
    cases = {1: (24.9, 50.1), 2: (25.0, 50.0), 3: (70.0, 20.0), 4: (70.1, 0.0), 5: (None, None), 6: (50.0, 20.1)}
    before = {1: 28.0, 2: 22.5, 3: 73.0, 4: 69.0, 6: 53.5}
    rows = [(t, day(2), p, x) for t, (p, x) in cases.items()] + [(t, day(1), p, 0.0) for t, p in before.items()]
    got = {}
    for r in fundamentals.promoter_flags(spark.createDataFrame(rows, "ticker long, as_of date, promoter_pct double, pledge_pct double")).collect():
        got.setdefault(r.ticker, set()).add(r.rule)
    assert got == {1: {"low_promoter", "pledge_very_high", "promoter_sold"}, 2: {"pledge_high", "promoter_bought"}, 3: {"pledge"}, 4: {"high_promoter", "no_pledge"}, 6: {"pledge_high", "promoter_sold"}}


#: For each rule a wide row's values that raise it, and the nearest that don't, from the definition of its technique.
RULE_CASES = {
    "manipulation": ({"m_score": -1.77}, {"m_score": -1.78}), "no_manipulation": ({"m_score": -1.78}, {"m_score": -1.77}), "distress": ({"z_score": 1.80}, {"z_score": 1.81}), "grey_zone": ({"z_score": 1.81}, {"z_score": 2.99}), "safe_zone": ({"z_score": 2.99}, {"z_score": 2.98}),
    "weak_f": ({"f_score": 3}, {"f_score": 4}), "strong_f": ({"f_score": 7}, {"f_score": 6}), "gross_margin_fell": ({"mt_gross_falling": True}, {"mt_gross_falling": False}), "gross_margin_rose": ({"mt_gross_rising": True, "mt_gross_falling": False}, {"mt_gross_rising": False, "mt_gross_falling": False}),
    "operating_margin_fell": ({"mt_operating_falling": True}, {"mt_operating_falling": False}), "negative_cfo": ({"cf_neg_cfo": 2}, {"cf_neg_cfo": 1}), "positive_cfo": ({"cf_neg_cfo": 0}, {"cf_neg_cfo": 1}), "negative_fcf": ({"cf_neg_fcf": 3}, {"cf_neg_fcf": 2}), "positive_fcf": ({"cf_neg_fcf": 0}, {"cf_neg_fcf": 1}),
    "cfo_below_income": ({"cf_cfo_lt_ni": 2}, {"cf_cfo_lt_ni": 1}), "cfo_above_income": ({"cf_cfo_lt_ni": 0}, {"cf_cfo_lt_ni": 1}), "high_accrual": ({"cf_accrual": -0.11}, {"cf_accrual": 0.10}), "dso_surge": ({"dso_surge": True}, {"dso_surge": False}), "dio_surge": ({"dio_surge": True}, {"dio_surge": False}),
    "stuffing": ({"stuffing": True}, {"stuffing": False}), "illiquid": ({"current_ratio": 0.99}, {"current_ratio": 1.0}), "very_high_leverage": ({"de": 3.01}, {"de": 3.0}), "leverage": ({"de": 3.0}, {"de": 2.0}), "low_debt": ({"de": 0.49}, {"de": 0.5}), "thin_coverage": ({"coverage": 1.49}, {"coverage": 1.5}),
    "strong_coverage": ({"coverage": 5.1}, {"coverage": 5.0}), "leverage_rose": ({"de": 1.31, "total_debt_1": 1.0, "equity_1": 1.0}, {"de": 1.3, "total_debt_1": 1.0, "equity_1": 1.0}), "leverage_fell": ({"de": 0.79, "total_debt_1": 1.0, "equity_1": 1.0}, {"de": 0.8, "total_debt_1": 1.0, "equity_1": 1.0}),
    "strong_roe": ({"re_n": 2, "re_now": 15.1, "re_old": 1.0}, {"re_n": 2, "re_now": 15.0, "re_old": 1.0}), "roe_fell": ({"re_n": 2, "re_now": 7.9, "re_old": 12.1}, {"re_n": 2, "re_now": 8.0, "re_old": 12.1}), "odd_tax_rate": ({"tx_outlier": True}, {"tx_outlier": False}),
    "quarter_revenue_drop": ({"revenue_drop": True}, {"revenue_drop": False}), "quarter_income_drop": ({"income_drop": True}, {"income_drop": False}), "strong_growth": ({"gr_revenue_cagr": 15.1}, {"gr_revenue_cagr": 15.0}), "shrinking": ({"gr_revenue_cagr": -0.1}, {"gr_revenue_cagr": 0.0}),
    "strong_profit_growth": ({"gr_profit_cagr": 20.1}, {"gr_profit_cagr": 20.0}), "profit_shrinking": ({"gr_profit_cagr": -10.1}, {"gr_profit_cagr": -10.0}), "negative_equity": ({"negative_equity": True}, {"negative_equity": False}), "losses": ({"ly_loss_years": 3}, {"ly_loss_years": 2}), "some_losses": ({"ly_loss_years": 2}, {"ly_loss_years": 1}),
    "no_losses": ({"ly_loss_years": 0}, {"ly_loss_years": 1}), "very_high_intangibles": ({"intangible_ratio": 50.1}, {"intangible_ratio": 50.0}), "high_intangibles": ({"intangible_ratio": 50.0}, {"intangible_ratio": 30.0}), "low_intangibles": ({"intangible_ratio": 4.9}, {"intangible_ratio": 5.0}),
    "dividend_above_fcf": ({"payout_fcf": 100.1}, {"payout_fcf": 100.0}), "dividend_near_income": ({"payout_fcf": 100.0, "payout_income": 90.1}, {"payout_fcf": 100.1, "payout_income": 90.1}), "dividend_covered": ({"payout_fcf": 59.9, "payout_income": 90.0}, {"payout_fcf": 60.0, "payout_income": 20.0}),
    "under_investing": ({"ly_pairs": 2, "ly_under_investing": 2}, {"ly_pairs": 2, "ly_under_investing": 1}), "investing": ({"ly_pairs": 2, "ly_under_investing": 0, "ly_capex_dep": 1.51}, {"ly_pairs": 1, "ly_under_investing": 0, "ly_capex_dep": 1.51}), "strong_conversion": ({"cash_conversion": 80.1}, {"cash_conversion": 80.0}),
    "weak_conversion": ({"cash_conversion": 29.9}, {"cash_conversion": -1.0}), "strong_roic": ({"roic": 15.1}, {"roic": 15.0}), "low_roic": ({"roic": 4.9}, {"roic": 5.0}), "low_quick_ratio": ({"quick_ratio": 0.79}, {"quick_ratio": 0.8}), "strong_quick_ratio": ({"quick_ratio": 1.51}, {"quick_ratio": 1.5}),
    "digits_fail": ({"conformity": "FAIL"}, {"conformity": "PASS"}), "digits_marginal": ({"conformity": "MARGINAL"}, {"conformity": "FAIL"}), "digits_pass": ({"conformity": "PASS"}, {"conformity": "FAIL"}), "montier_high": ({"c_score": 4}, {"c_score": 3}), "montier_moderate": ({"c_score": 2}, {"c_score": 4}), "montier_low": ({"c_score": 1}, {"c_score": 2}),
    "bankruptcy_likely": ({"probability": 0.51}, {"probability": 0.5}), "bankruptcy_possible": ({"probability": 0.5}, {"probability": 0.3}), "bankruptcy_unlikely": ({"probability": 0.3}, {"probability": 0.31}), "growth_far_too_fast": ({"gap": 10.1}, {"gap": 10.0}), "growth_too_fast": ({"gap": 10.0}, {"gap": 5.0}),
    "growth_sustainable": ({"gap": 5.0, "sgr": 15.1, "growth": 0.1}, {"gap": 5.0, "sgr": 15.0, "growth": 0.1}), "volatile": ({"ev_cv": 50.1}, {"ev_cv": 50.0}), "fairly_volatile": ({"ev_cv": 50.0}, {"ev_cv": 30.0}), "stable_earnings": ({"ev_cv": 14.9}, {"ev_cv": 15.0}),
    "very_high_leverage_of_costs": ({"ol_avg_dol": 5.1}, {"ol_avg_dol": 5.0}), "high_leverage_of_costs": ({"ol_avg_dol": 5.0}, {"ol_avg_dol": 3.0}), "low_leverage_of_costs": ({"ol_avg_dol": 1.4}, {"ol_avg_dol": 1.5}), "springate_distress": ({"s_score": 0.861}, {"s_score": 0.862}), "springate_healthy": ({"s_score": 0.862}, {"s_score": 0.861}),
    "under_surveillance": ({"listed": True}, {"listed": False}), "not_under_surveillance": ({"listed": False}, {"listed": True}),
}


def test_every_rule_at_its_step(spark):
    assert set(RULE_CASES) == {n for n, _, _ in fundamentals.FLAGS} and len(fundamentals.FLAGS) + len(fundamentals.PROMOTER_RULES) + len(fundamentals.RATING_RULES) + len(fundamentals.FILING_RULES) >= 90
    kinds = {c: type(v) for case in RULE_CASES.values() for row in case for c, v in row.items()}
    sql = {bool: "boolean", str: "string", int: "long", float: "double"}
    rows = [(f"{n}/{hit}", *(case[not hit].get(c) for c in kinds)) for n, case in RULE_CASES.items() for hit in (True, False)]
    df = spark.createDataFrame([*rows, ("none", *[None] * len(kinds))], "symbol string, " + ", ".join(f"{c} {sql[k]}" for c, k in kinds.items()))
    got = {}
    for r in fundamentals.raised(df, fundamentals.FLAGS).select("symbol", "rule").collect():
        got.setdefault(r.symbol, set()).add(r.rule)
    assert "none" not in got
    for n in RULE_CASES:
        assert n in got[f"{n}/True"] and n not in got.get(f"{n}/False", set()), n
    ratings = spark.createDataFrame([(k, f"a{k}", k, k == 4, k == 9) for k in (0, 4, 5, 6, 7, 8, 9, 11)], "symbol int, agency string, rank int, negative boolean, downgraded boolean")
    assert {r.symbol: r.rule for r in fundamentals.raised(ratings, fundamentals.RATING_RULES).collect()} == {4: "rating_junk", 5: "rating_medium", 6: "rating_medium", 7: "rating_good", 8: "rating_good", 9: "rating_high", 11: "rating_high"}
    assert {(r.symbol, r.rule) for r in fundamentals.raised(ratings, fundamentals.FILING_RULES).collect()} == {(4, "negative_outlook"), (9, "downgraded")}


def test_deep_score_is_adjusted_within_ten_points(spark):
    f = spark.createDataFrame([(s, 2020 + y, *[float(100 + 7 * y + s + k) for k in range(len(fundamentals.ITEMS))]) for s in range(3) for y in range(5)], "symbol long, fy int, " + ", ".join(f"{c} double" for c in fundamentals.ITEMS))
    rows = [
        (0, 20.0, "BULLISH", "increasing", "UPGRADED", 40.0, 11, "STRONG UPTREND", None),
        (1, -20.0, "BEARISH", "decreasing", "DOWNGRADED", 10.0, 1, "DOWNTREND", None),
        (2, None, None, None, None, None, None, None, 20.0),
    ]
    adjust = spark.createDataFrame(rows, "symbol long, " + ", ".join(f"{c} {k}" for c, k in fundamentals.ADJUSTMENTS.items()))
    got = {r.symbol: r for r in fundamentals.deep(f, adjust).collect()}
    assert [got[s].bonus for s in range(3)] == [10, -10, 0]  # 13 and -12 before the clamp
    assert got[2].valuation == min(100, got[2].priced + 16) and got[0].valuation == got[0].priced
    for r in got.values():
        assert math.isclose(r.final, max(0, min(100, 0.25 * r.valuation + 2.5 * r.moat + 0.2 * r.growth + 0.15 * r.earnings + 0.15 * max(0, (10 - float(r.risk)) * 10) + r.bonus)))


def test_risk_summary_by_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    r, br = rng.normal(0.001, 0.02, 60), rng.normal(0.0005, 0.01, 60)
    close = 100 * np.cumprod(np.concatenate([[1.0], 1 + br]))
    day = lambda i: DAY + dt.timedelta(days=i)
    returns = spark.createDataFrame([(7, day(i + 1), float(x)) for i, x in enumerate(r)] + [(7, day(500), 9.0)], "portfolio long, date date, r double")  # a day without benchmark is left out
    bench = spark.createDataFrame([(day(i), float(c)) for i, c in enumerate(close)], "date date, close double")
    got = portfolio.risk_summary(returns, bench, spark.createDataFrame([(7, 1.1)], "portfolio long, beta double")).first()
    nav, annual, five = np.cumprod(1 + r), (np.prod(1 + r) ** (252 / 60) - 1) * 100, np.convolve(r, np.ones(5), "valid")
    want = dict(
        days=60, beta=1.1, annual=annual, bench_annual=(np.prod(1 + br) ** (252 / 60) - 1) * 100, volatility=r.std(ddof=1) * 252**0.5 * 100, sharpe=annual / (r.std(ddof=1) * 252**0.5 * 100), max_drawdown=(nav / np.maximum.accumulate(nav) - 1).min() * 100,
        var_1d=-np.percentile(r, 5) * 100, var_5d=-np.percentile(five, 5) * 100, var_parametric=1.645 * r.std(ddof=1) * 100, best_day=r.max() * 100, worst_day=r.min() * 100, excess=annual - (np.prod(1 + br) ** (252 / 60) - 1) * 100,
    )
    assert all(math.isclose(got[k], v, rel_tol=1e-9) for k, v in want.items()), (got, want)
    held = spark.createDataFrame([(7, 1, 30.0), (7, 2, 10.0), (7, 3, 60.0)], "portfolio long, symbol long, present double")
    assert math.isclose(portfolio.portfolio_beta(held, spark.createDataFrame([(1, 2.0), (2, 1.0), (3, None)], "symbol long, beta double")).first().beta, 1.75)


def test_signals_by_their_definition(spark):
    """Rows back, the volume's mean of 50, RS on common dates and the RSI in every label."""
    rng = random.Random(8)
    closes = [100.0]
    for _ in range(259):
        closes.append(closes[-1] * (1 + rng.uniform(-0.03, 0.031)))
    volume = [rng.randint(50, 150) for _ in closes]
    closes[-1], volume[-1] = closes[-2] * 0.99, 1000
    b = bars(spark, closes, volume=volume)
    bench = spark.createDataFrame([(DAY + dt.timedelta(days=i), 50.0 + i) for i in range(len(closes)) if i not in (100, len(closes) - 1)], "date date, close double")
    got = series.position_signals(b, bench).first()
    common = [(c, 50.0 + i) for i, c in enumerate(closes) if i not in (100, len(closes) - 1)]
    assert math.isclose(got.ret_6m, (closes[-1] / closes[-130] - 1) * 100) and math.isclose(got.ret_3m, (closes[-1] / closes[-65] - 1) * 100)
    assert math.isclose(got.rs_3m, common[-1][0] / common[-1][1] / (common[-65][0] / common[-65][1]) * 100) and got.down_volume
    assert math.isclose(got.volume_spike, 1000 / (sum(volume[-50:]) / 50)) and series.position_signals(bars(spark, closes[:29]), bench).count() == 0
    alpha = series.multi_horizon_alpha(b, bench).first()
    assert math.isclose(alpha.a21, (common[-1][0] / common[-21][0] - common[-1][1] / common[-21][1]) * 100)
    t = series.technical_structure(b).first()
    d = [y - x for x, y in zip(closes, closes[1:], strict=False)][-14:]
    up, down = sum(max(x, 0) for x in d), sum(max(-x, 0) for x in d)
    rsi, m50, m200 = 100 - 100 / (1 + up / down), sum(closes[-50:]) / 50, sum(closes[-200:]) / 200
    above, cross = closes[-1] > m200, m50 > m200
    label = "STRONG UPTREND" if above and cross and rsi > 50 else "UPTREND" if above and rsi > 40 else "DOWNTREND" if not above and not cross and rsi < 50 else "WEAK" if not above else "SIDEWAYS"
    assert math.isclose(t.rsi, rsi) and t.trend == label and t.volume_trend == "RISING (accumulation)" and series.technical_structure(bars(spark, closes[:199])).count() == 0


def test_correlation_tiles_equal_pandas(spark):
    import pandas as pd

    rng = random.Random(12)
    rows = [(s, DAY + dt.timedelta(days=i), 50 + 10 * rng.random() if s != 3 else 5.0) for s in range(9) for i in range(80) if rng.random() < 0.8]
    b = spark.createDataFrame(rows, "symbol long, date date, close double")
    pdf = pd.DataFrame(rows, columns=["symbol", "date", "close"]).sort_values(["symbol", "date"])
    pdf["r"] = pdf.groupby("symbol")["close"].pct_change()
    wide = pdf.dropna().pivot(index="date", columns="symbol", values="r")
    want, n = wide.corr(min_periods=30), wide.notna().astype(int).T @ wide.notna().astype(int)
    for tile in (3, 100):
        df = portfolio.pair_correlations(b, 30, tile=tile)
        got = {(r.a, r.b): (r.corr, r.n) for r in df.collect()}
        assert set(got) == {(x, y) for x in range(9) for y in range(x + 1, 9) if n.loc[x, y] >= 30}
        for (x, y), (corr, k) in got.items():
            assert k == n.loc[x, y] and ((corr is None or math.isnan(corr)) if 3 in (x, y) else math.isclose(corr, want.loc[x, y], rel_tol=1e-9))
    assert plan(portfolio.pair_correlations(b, 30)).count("Exchange hashpartitioning") == 2


def test_one_alert_for_each_turn(spark, tmp_path):
    """The state holds over batches, late rows change nothing, and a level hit again after it was left is a new alert."""
    levels = spark.createDataFrame([(1, 10.0, 20.0), (2, 10.0, 20.0)], "symbol long, stop double, target double")
    out, ticks, seq = str(tmp_path / "alerts"), str(tmp_path / "ticks"), itertools.count()
    minute = lambda m: dt.datetime(2024, 1, 1, 9, m)

    def send(*rows):
        spark.createDataFrame([(s, minute(m), float(p), next(seq)) for s, m, p in rows], "symbol long, ts timestamp, price double, seq long").coalesce(1).write.mode("append").parquet(ticks)
        stream = spark.readStream.schema("symbol long, ts timestamp, price double, seq long").parquet(ticks)
        jobs.level_alerts(stream, levels).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.symbol, r.ts.minute, r.status) for r in spark.read.schema("symbol long, ts timestamp, price double, status string").parquet(out).collect())

    first = send((1, 0, 15), (1, 2, 9), (1, 3, 8), (2, 1, 25), (1, 1, 15))
    assert first == [(1, 2, "STOP_HIT"), (2, 1, "TARGET_HIT")]
    second = send((1, 4, 7), (1, 1, 25), (2, 2, 15))  # still at the stop; a late target; level left
    assert second == first
    assert send((1, 5, 21), (2, 3, 26), (2, 4, 27)) == sorted([*first, (1, 5, "TARGET_HIT"), (2, 3, "TARGET_HIT")])


def test_late_ticks_are_kept_aside(spark, tmp_path):
    out = f"file://{tmp_path}/late"
    each = jobs.keep_late(out, "1 day")
    batch = lambda *days: spark.createDataFrame([(1, dt.datetime(2024, 1, d, 12), d) for d in days], "symbol long, ts timestamp, seq long")
    late = lambda: sorted(r.seq for r in spark.read.schema("symbol long, ts timestamp, seq long").parquet(out + "/late").collect())
    each(batch(1, 2), 0)
    each(batch(9, 1), 1)  # day 2 is the newest before: nothing is closed
    assert late() == []
    for _ in range(2):  # day 9 is the newest before: days up to the 7th are closed
        each(batch(3, 7, 8, 9), 2)
        assert late() == [3, 7]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_symbol_windows_share_one_exchange(spark):
    df = series.technical_structure(bars(spark, [1.0] * 5))
    assert plan(df).count("Exchange hashpartitioning") == 1


def test_scores_run_without_python(spark):
    f = spark.range(1).select(F.col("id").alias("symbol"), F.lit(2020).alias("fy"), *[F.lit(1.0).alias(c) for c in fundamentals.ITEMS])
    for df in (fundamentals.deep(f, spark.range(1).select(F.col("id").alias("symbol"), F.lit(1.0).alias("alpha"))), fundamentals.overall(fundamentals.technique_scores(f), fundamentals.flags(f))):
        assert "Python" not in plan(df) and "Pandas" not in plan(df)


def test_look_back_reaches_the_scan(spark, tmp_path):
    bars(spark, [1.0] * 5).write.parquet(f"file://{tmp_path}/b")
    df = ingest.look_back(spark.read.parquet(f"file://{tmp_path}/b"), "5d", F.lit("2024-01-05").cast("date"))
    assert "GreaterThanOrEqual(date" in plan(df)


def holdings_and_bars(spark, seed=3):
    """Nine portfolios of 14 symbols in two copies, one of them of nothing and one with a symbol of unknown value."""
    rng = random.Random(seed)
    market = [rng.gauss(0, 0.02) for _ in range(130)]
    rows, held = [], []
    for s in range(14):
        price = 50.0
        for i in range(130):
            price *= 1 + market[i] * (s % 3) + rng.gauss(0, 0.02)
            if rng.random() < 0.8:
                rows.append((s, DAY + dt.timedelta(days=i), price))
    for p in range(9):
        held += [(p, s, 0.0 if p == 7 else None if p == 8 and s == 0 else rng.random() * 100) for s in sorted(rng.sample(range(14), 1 if p == 5 else 6)) + [99]]
    b = spark.createDataFrame(rows, "symbol long, date date, close double")
    bench = b.where("date <> date'2024-02-01'").groupBy("date").agg(F.avg("close").alias("close"))
    return spark.createDataFrame(held, "portfolio long, symbol long, present double"), b, bench


def test_portfolio_returns_equal_the_join_of_positions_and_days(spark):
    h, b, _ = holdings_and_bars(spark)
    r = b.withColumn("r", F.coalesce(series.daily_return(), F.lit(0.0)))
    want = {(x.portfolio, x.date): x.r for x in portfolio.weights(h).join(r, "symbol").groupBy("portfolio", "date").agg(F.sum(F.col("weight") * F.col("r")).alias("r")).collect()}
    for block in (2, 2048):
        df = portfolio.daily_returns(h, b, block=block)
        got = {(x.portfolio, x.date): x.r for x in df.collect()}
        assert set(got) == set(want) and all((got[k] is None) if v is None else math.isclose(got[k], v, rel_tol=1e-9, abs_tol=1e-12) for k, v in want.items())
    assert "hashpartitioning(portfolio#" not in plan(df).split("FlatMapGroupsInArrow")[0]  # no portfolio's day is shuffled


def test_risk_in_one_pass_equals_the_summary_of_daily_returns(spark):
    h, b, bench = holdings_and_bars(spark)
    h = h.where("portfolio < 7")
    betas = spark.createDataFrame([(p, 1.0 + p) for p in range(5)], "portfolio long, beta double")
    want = {x.portfolio: x.asDict() for x in portfolio.risk_summary(portfolio.daily_returns(h, b).withColumn("r", F.col("r") * 0.5), bench, betas).collect()}
    df = portfolio.holdings_risk(h, b, bench, betas, 0.5, block=3)
    got = {x.portfolio: x.asDict() for x in df.collect()}
    assert set(got) == set(want) == set(range(7))
    for p, row in want.items():
        assert set(row) == set(got[p]) and all(got[p][k] == v if v is None else math.isclose(got[p][k], v, rel_tol=1e-9, abs_tol=1e-9) for k, v in row.items()), (row, got[p])


def test_strong_pairs_equal_all_correlations_joined(spark):
    h, b, _ = holdings_and_bars(spark)
    show = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in (r.portfolio, r.a, r.b, r.corr, r.wa, r.wb)) for r in df.collect())
    want = show(portfolio.held_pairs(portfolio.pair_correlations(b), h, 0.2))
    assert len(want) > 20
    for tile, most in ((5, 4), (1024, 2_000_000)):
        df = portfolio.strong_pairs(b, h, 0.2, tile=tile, most=most)
        assert show(df) == want
    assert "date" not in plan(df).split("FlatMapGroupsInArrow")[0] and "SortMergeJoin" not in plan(df).split("FlatMapGroupsInArrow")[0]  # pairs meet days in no join
    assert plan(portfolio.greedy_clusters(df)).split("FlatMapGroupsInArrow")[0].count("Exchange") == 1


def test_tiles_grow_with_the_symbols(spark):
    b = spark.range(3600).select(F.col("id").alias("symbol"), F.lit(DAY).alias("date"), F.lit(1.0).alias("close"))
    df = portfolio.pair_correlations(b)  # 300 symbols a tile, each series sent to 12 of them, not to 15
    assert "sequence(0, 11" in df._jdf.queryExecution().analyzed().toString()


def gappy_bars(spark):
    """Members that start late, miss days, have a close of nothing and days of null closes only; two indices and a symbol of both."""
    rng = random.Random(21)
    rows = [(s, DAY + dt.timedelta(days=i), 0.0 if (s, i) in ((2, 30), (4, 45)) else None if i in (20, 50) or rng.random() < 0.05 else 10 + 5 * rng.random()) for s in range(9) for i in range(s * 2, 60) if rng.random() < 0.6 or i in (30, 45)]
    b = spark.createDataFrame(rows, "symbol long, date date, close double")
    return b, spark.createDataFrame([(s, "A" if s < 5 else "B", "U") for s in range(9)] + [(3, "B", "U"), (77, "B", "U")], "symbol long, index_name string, universe string")


def test_levels_from_bars_equal_those_of_the_panel(spark):
    b, m = gappy_bars(spark)
    want = {(r.index_name, r.date): (r.ret, r.level) for r in series.equal_weight_index(series.aligned(b, m)).collect()}
    df = series.equal_weight_levels(b, m)
    got = {(r.index_name, r.date): (r.ret, r.level) for r in df.collect()}
    assert set(got) == set(want) and len(want) > 60
    for k, v in want.items():
        assert all((x is None) if y is None else math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12) for x, y in zip(got[k], v, strict=True)), (k, got[k], v)
    assert "Generate" not in plan(df)  # no row for a member and a date


def test_index_filled_both_ways_equals_a_filled_table(spark):
    import numpy as np
    import pandas as pd

    b, m = gappy_bars(spark)
    df = series.index_filled_both_ways(b, m, b.where("symbol = 0 and close is not null"))
    got = {(r.index_name, pd.Timestamp(r.date)): r.ret for r in df.collect()}
    rows = pd.DataFrame([tuple(r) for r in b.collect()], columns=["symbol", "date", "close"])
    want = {}
    for index, symbols in (("A", [0, 1, 2, 3, 4]), ("B", [3, 5, 6, 7, 8])):
        wide = rows[rows["symbol"].isin(symbols)].pivot(index="date", columns="symbol", values="close").astype(float).ffill().bfill()
        r = (wide / wide.shift() - 1).replace([np.inf, -np.inf], np.nan).fillna(0.0).mean(axis=1)
        want |= {(index, pd.Timestamp(d)): v for d, v in r.items()}
    assert set(got) == set(want) and all(math.isclose(got[k], v, rel_tol=1e-9, abs_tol=1e-12) for k, v in want.items())
    assert "Generate" not in plan(df)  # no row for a member and a date


def test_panel_of_gaps_by_hand(spark):
    b, m = gappy_bars(spark)
    close = {}
    for s, d, c in sorted(tuple(r) for r in b.select("symbol", "date", "close").collect() if r.close is not None):
        close.setdefault(s, []).append((d, c))
    want = {}
    for index, symbols in (("A", [0, 1, 2, 3, 4]), ("B", [3, 5, 6, 7, 8])):
        start = max(close[s][0][0] for s in symbols)
        for d in sorted({r.date for r in b.collect() if r.symbol in symbols and r.date >= start}):
            want |= {(index, s, d): [c for at, c in close[s] if at <= d][-1] for s in symbols}
    df = series.aligned(b, m)
    assert {(r.index_name, r.symbol, r.date): r.close for r in df.collect()} == want
    assert "Window" not in plan(df) and plan(df).index("MapInArrow") < plan(df).index("Exchange")  # the panel is not shuffled


def test_label_order_needs_no_sort_of_the_table(spark):
    from tidemark.plans import portfolio_queries

    df = portfolio_queries.QUERIES["top_05_custom_label_order"](spark, "/root/testdata/sf0.001")
    assert "rangepartitioning" not in plan(df)  # three labels would be three tasks


def test_margin_trend_gives_the_margins_of_both_ends(spark):
    from tidemark.plans import fundamental_queries

    df = fundamental_queries.QUERIES["fun_05_margin_trend"](spark, "/root/testdata/sf0.001")
    assert df.columns == ["symbol", "n", "g0", "g9", "o0", "o9", "gross_falling", "gross_rising", "operating_falling"]


def test_bars_have_one_exchange_and_parts_of_a_size(spark, monkeypatch):
    """Bars and windows by symbol over them share one exchange, whose parts grow in number with the table."""
    t = fixtures.Tables(spark, "/root/testdata/sf0.001")
    df = t.bars.withColumn("before", F.lag("close").over(series.by_symbol()))
    assert plan(df).count("Exchange hashpartitioning") == 0 and plan(df).count("REPARTITION_BY_NUM") == 1
    monkeypatch.setattr(fixtures, "TRADES_A_PART", 500)
    assert fixtures.Tables(spark, t.sf_dir).bars.rdd.getNumPartitions() == t.table("lineitem").count() // 500 + 1


def test_scan_goes_to_python_as_arrow(spark):
    """A symbol's rows and its one result row are Arrow tables, without a frame of 40 series a symbol."""
    df = screen.breakout_scan(bars(spark, [50.0 + i % 7 for i in range(80)]), spark.createDataFrame([(DAY + dt.timedelta(days=3), 2.0), (DAY + dt.timedelta(days=60), 4.0)], "date date, close double"))
    assert "FlatMapGroupsInArrow" in plan(df) and df.count() == 1


def test_score_comes_from_the_fold(spark):
    for name in ("pat_08_composite_score", "pat_09_risk_plan"):
        assert "FlatMapGroupsInArrow" in plan(catalog.queries()[name](spark, "/root/testdata/sf0.001"))


def test_review_makes_no_window_over_signals_and_bars(spark):
    b = bars(spark, [10.0, 11.0, 12.0, 9.0])
    signals = spark.createDataFrame([(1, DAY + dt.timedelta(days=1), 10.0, 11.0), (1, DAY + dt.timedelta(days=3), 10.0, 9.0)], "symbol long, scan_date date, level double, scan_close double")
    df = screen.review(signals, b)
    assert not re.search(r"windowspecdefinition\(symbol#\d+L?, scan_date", plan(df))
    assert [(r.max_high, r.days_above) for r in df.orderBy("scan_date").collect()] == [(12.0, 1), (12.0, 2)]  # no bar after the second: the last five count


def test_names_shared_by_many_companies_meet_their_best_keys_only(spark):
    companies = spark.createDataFrame([(i, "steel works") for i in range(20)], "id long, name string")
    index = spark.createDataFrame([(f"steel-works-{c}",) for c in "abcdefgh"], "key string")
    for df in (joins.close_matches(companies, index, most=2), joins.similar_keys(companies, index, most=2)):
        assert df.count() == 40 and re.search(r"windowspecdefinition\(s#\d+", plan(df))


def test_header_words_are_kept_as_bits(spark):
    rows = [(1, 0, 0, "Net Investment"), (1, 0, 1, "Equity"), (1, 1, 0, "Net"), (1, 1, 1, None), (1, 2, 0, "Equity Net"), (1, 2, 1, "investment")]
    h = spark.createDataFrame(rows, "table_id long, idx int, level int, text string")
    df = ingest.rightmost_column(h, ("net", "investment", "equity"))
    assert "collect_list" not in plan(df) and values(df, "idx") == [2]
    assert values(ingest.rightmost_column(h, ("net investment",)), "idx") == [2]  # goes on from one level to the next


def test_spread_of_portfolio_returns_comes_from_the_blocks(spark):
    """A block gives one row a date, not one a portfolio and date; unknown weights count as portfolios, not in the mean."""
    h, b, _ = holdings_and_bars(spark)
    want = {r.date: r for r in portfolio.daily_returns(h, b).groupBy("date").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.min("r").alias("low"), F.max("r").alias("high")).collect()}
    for block in (2, None):
        df = portfolio.return_spread(h, b, block=block)
        got = {r.date: r for r in df.collect()}
        assert set(got) == set(want) and len(want) > 100
        for d, r in want.items():
            assert got[d].n == r.n and all(math.isclose(got[d][c], r[c], rel_tol=1e-9, abs_tol=1e-12) for c in ("mean", "low", "high"))
    assert re.search(r"FlatMapGroupsInArrow.*total#", plan(df))


def test_holdings_move_once_to_their_portfolio(spark):
    t = fixtures.Tables(spark, "/root/testdata/sf0.001")
    text = plan(t.holdings.groupBy("portfolio").agg(F.sum("present")))
    assert text.count("REPARTITION_BY_NUM") == 1 and text.count("hashpartitioning(portfolio#") == 1
    assert "REPARTITION_BY_NUM" not in plan(t.last_close)  # found without the bars
    want = {r.symbol: r.c for r in t.bars.groupBy("symbol").agg(F.max_by("close", "date").alias("c")).collect()}
    assert {r.symbol: r.last_close for r in t.last_close.collect()} == want


def test_risk_finds_betas_of_portfolios_in_their_block(spark):
    h, b, bench = holdings_and_bars(spark)
    betas = spark.createDataFrame([(s, None if s == 4 else 0.1 * s) for s in range(12)], "symbol long, beta double")
    want = {r.portfolio: r.beta for r in portfolio.portfolio_beta(h, betas).collect()}
    df = portfolio.holdings_risk(h, b, bench, betas, 0.5, block=3)
    got = {r.portfolio: r.beta for r in df.collect()}
    assert len([v for v in want.values() if v]) > 5
    for p, beta in got.items():
        assert math.isclose(beta, want[p], rel_tol=1e-9) if want.get(p) is not None else beta is None
    assert plan(df).count("hashpartitioning(portfolio#") == 0  # positions meet no betas in a join


def test_strong_pairs_where_blocks_share_few_symbols(spark):
    """Above `whole` symbols a block's portfolios are multiplied one by one; pairs and weights stay the same, and no position is repeated for a tile."""
    h, b, _ = holdings_and_bars(spark)
    show = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in (r.portfolio, r.a, r.b, r.corr, r.wa, r.wb)) for r in df.collect())
    want = show(portfolio.held_pairs(portfolio.pair_correlations(b), h, 0.2))
    for tile, whole in ((4, 3), (1024, 3), (4, 4096)):
        df = portfolio.strong_pairs(b, h, 0.2, tile=tile, whole=whole)
        assert show(df) == want
    assert plan(df).split("Initial Plan")[0].count("Generate") == 1  # positions become rows only to ask for series


def test_clusters_are_found_where_their_pairs_are(spark):
    h, b, _ = holdings_and_bars(spark)
    show = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in (r.portfolio, r.cluster, r.members, r.size, r.weight, r.avg_corr)) for r in df.collect())
    want = show(portfolio.greedy_clusters(portfolio.strong_pairs(b, h, 0.2)))
    assert len(want) > 5 and any(r[-2] == "None" for r in want)
    for most, whole in ((4, 4096), (None, 3)):
        df = portfolio.strong_clusters(b, h, 0.2, most=most, whole=whole)
        assert show(df) == want
    assert "MapInArrow" not in plan(df) and "FlatMapGroupsInArrow" in plan(df)  # no pair is shuffled to its portfolio


def two_files(path, rows):
    """A table of two files whose rows two tasks read."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    path.mkdir()
    for name, part in zip("ab", rows, strict=True):
        pq.write_table(pa.Table.from_pylist(part), f"{path}/{name}.parquet")


def test_stakes_of_equal_orders_are_equal(spark, tmp_path):
    """Orders of a ticker that lie in two files are added up like those that lie in one: in their order, to the last bit."""
    order = lambda k, ticker, price: {"o_orderkey": k, "o_custkey": ticker, "o_totalprice": price, "o_orderdate": dt.datetime(2001, 5, k + 1)}
    two_files(tmp_path / "orders.parquet", ([order(0, 1, 0.1), order(1, 1, 0.2), order(2, 1, 0.3), order(3, 2, 0.1), order(4, 3, None)], [order(5, 2, 0.2), order(6, 2, 0.3)]))
    got = {r.ticker: r.pct for r in fixtures.Tables(spark, str(tmp_path)).stakes.collect()}
    assert got == {1: (0.1 + 0.2 + 0.3) / 100, 2: (0.1 + 0.2 + 0.3) / 100, 3: None} and 0.1 + 0.2 + 0.3 != 0.1 + (0.2 + 0.3)


def test_revenue_in_order_hangs_on_no_task(spark, tmp_path):
    trade = lambda symbol, x: {"l_orderkey": 1, "l_linenumber": 1, "l_suppkey": symbol, "l_shipdate": dt.datetime(2001, 5, 1), "l_extendedprice": x, "l_quantity": 1.0, "l_discount": 0.0, "l_tax": 0.0, "l_returnflag": "N"}
    two_files(tmp_path / "lineitem.parquet", ([trade(1, 0.1), trade(1, 0.2), trade(1, 0.3), trade(2, 0.1)], [trade(2, 0.2), trade(2, 0.3)]))
    t = fixtures.Tables(spark, str(tmp_path))
    got = {r.symbol: (r.revenue, r.total_assets, r.market_cap) for r in t.fundamentals_in_order.collect()}
    x = 0.1 + 0.2 + 0.3
    assert got == {1: (x, x * 1.5, x * 2.5), 2: (x, x * 1.5, x * 2.5)} and t.fundamentals_in_order.columns == t.fundamentals.columns
    assert "__row" in plan(catalog.queries()["fun_03_piotroski_f"](spark, "/root/testdata/sf0.001"))


def test_flags_read_revenue_in_order(spark):
    assert "__row" in plan(catalog.queries()["fun_20_flags"](spark, "/root/testdata/sf0.001"))


def test_overall_score_reads_revenue_in_order(spark):
    text = plan(catalog.queries()["fun_20_overall_score"](spark, "/root/testdata/sf0.001"))
    assert "__revenue" in text


def test_tiles_of_many_symbols_go_to_few_tasks(spark):
    """Above 49,000 symbols tiles go on growing; a chunk of them stands as columns at a time, and a tile without symbols gives no pair twice."""
    assert portfolio.MOST * portfolio.MEETINGS >= 390_000 and portfolio.CHUNK < portfolio.MOST
    _, b, _ = holdings_and_bars(spark)
    want = {(r.a, r.b): (round(r.corr, 9), r.n) for r in portfolio.pair_correlations(b).collect()}
    rows = portfolio.pair_correlations(b, tile=1).collect()  # 14 tiles by hash, some of them empty
    assert len(rows) == len(want) == 91 and {(r.a, r.b): (round(r.corr, 9), r.n) for r in rows} == want
