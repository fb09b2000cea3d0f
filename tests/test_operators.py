"""Hand-made frames: edge cases and laws of the operators."""

import datetime as dt
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from featlake.functions import arrays, texts, times
from featlake.operators import aggregates, encoders, joins, numbering, paths, project, sessions
from featlake.sources import readers, writers


def test_weekday_is_one_on_sunday_and_weekend_is_two_days(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, d),) for d in range(5, 9)], "ts timestamp")  # Friday to Monday
    got = df.select(times.weekday(F.col("ts")), times.is_weekend(F.col("ts")), times.before_weekend(F.col("ts"))).collect()
    assert [tuple(r) for r in got] == [(6, False, True), (7, True, False), (1, True, False), (2, False, False)]


def test_week_number_grows_across_years(spark):
    df = spark.createDataFrame([(dt.datetime(2023, 12, 31),), (dt.datetime(2024, 1, 1),)], "ts timestamp")
    a, b = [r[0] for r in df.select(times.week_number(F.col("ts"))).collect()]
    assert b == a + 1


def test_date_parse_forms(spark):
    forms = {"2024-03-01 10:11:12": (3, 1), "01/03/2024 9:05": (1, 3), "13/03/2024 9:05": (3, 13), "13/03/24 9:05:01": (3, 13), "25-12-17": (12, 25), "25-12-2017 7:08:09": (12, 25), "25-12-17 7:08": (12, 25), "1709287872": None, "12.5": None, "no": None}
    df = spark.createDataFrame([(s,) for s in [*forms, None]], "s string")
    got = {r.s: r.ts and (r.ts.month, r.ts.day) for r in df.select("s", times.parse_date(F.col("s")).alias("ts")).collect()}
    assert got == {**forms, None: None}


def test_holidays_compare_dates(spark):
    cal = spark.createDataFrame([("2024-01-06",), ("2024-01-06",)], "day string")
    df = spark.createDataFrame([(dt.datetime(2024, 1, 5, 23, 0),), (dt.datetime(2024, 1, 6, 1, 0),), (None,)], "ts timestamp")
    got = {r.ts and r.ts.day: (r.is_holiday, r.before_holiday) for r in times.with_holidays(df, "ts", cal).collect()}
    assert got == {5: (False, True), 6: (True, False), None: (False, False)}


def test_hostname_scheme_user_and_www_are_optional(spark):
    df = spark.createDataFrame([("https://u:p@a.b/c?d",), ("a.b/c",), ("http://www.a.b",), ("",)], "u string")
    assert [r[0] for r in df.select(texts.hostname(F.col("u"), strip_www=True)).collect()] == ["a.b", "a.b", "a.b", ""]
    assert [r[0] for r in df.select(texts.hostname(F.col("u"))).collect()] == ["a.b", "a.b", "www.a.b", ""]


def test_slug_and_gender(spark):
    df = spark.createDataFrame([("Can make  food!", "male"), ("a_b.c-d/é", "F"), ("", None)], "t string, g string")
    assert [r[0] for r in df.select(texts.slug(F.col("t"))).collect()] == ["Can-make--food", "a_b.c-dé", ""]
    assert [r[0] for r in df.select(texts.gender_code(F.col("g"))).collect()] == [1, 0, 0]


def test_guarded_division_and_chunks(spark):
    df = spark.createDataFrame([(6.0, 0, [1, 2, 3]), (6.0, 3, [])], "x double, n int, a array<int>")
    got = df.select(arrays.guarded(F.col("x"), F.col("n")).alias("g"), arrays.chunks(F.col("a"), 2).alias("c")).collect()
    assert [(r.g, [list(x) for x in r.c]) for r in got] == [(6.0, [[1, 2], [3]]), (2.0, [])]


def test_encode_decode_is_identity_and_overflow_is_reserved(spark):
    df = spark.createDataFrame([(f"v{i:02d}",) for i in range(25)] + [(None,)], "c string")
    d = encoders.fit(df, "c")
    coded = encoders.binary(df, "c", d, "code")
    back = encoders.decode(coded, "code", d, "label").collect()
    assert all(r.label == r.c for r in back if r.c and r.c < "v20")
    assert {r.code for r in back if r.c is None or r.c >= "v20"} == {"100000000"}
    with pytest.raises(ValueError):
        encoders.one_hot(df, "c", d)


def test_dictionary_keeps_known_indexes(spark):
    old = encoders.fit(spark.createDataFrame([("m",), ("z",)], "c string"), "c")
    new = {r.value: r.idx for r in encoders.extend(old, spark.createDataFrame([("a",), ("m",), ("b",)], "c string"), "c").collect()}
    assert new == {"m": 1, "z": 2, "a": 3, "b": 4}


def test_last_duplicate_wins_and_unmatched_rows_stay(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "k int, v string, o int")
    assert {(r.k, r.v) for r in joins.enrich(left, right, ["k"], ["o"]).collect()} == {(1, "b"), (2, None)}
    with pytest.raises(ValueError):
        joins.first_match(left, right, [], F.lit(True), ["k"], ["o"])


def test_sessions_of_one_visit_last_a_second(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t, 1, "a"), (2, t, 2, "a"), (2, t, 3, "b"), (2, t + dt.timedelta(days=2), 4, "b")], "u long, ts timestamp, e long, h string")
    s = {(r.user, r.run): (r.host, r.seconds) for r in sessions.sessions(sessions.ordered_events(df, "u", "ts", "e", "h")).collect()}
    assert s == {(1, 1): ("a", 1.0), (2, 1): ("a", 1.0), (2, 2): ("b", 172800.0)}


def path_sessions(spark, chains):
    """Sessions of chains (user, day, sites), a second each."""
    rows = [(u, run, d * 86_400_000_000 + run, h, 1.0 + run) for u, d, sites in chains for run, h in enumerate(sites)]
    return spark.createDataFrame(rows, "user long, run long, start long, host string, seconds double")


def test_path_levels_follow_sites(spark):
    rows = paths.nodes(path_sessions(spark, [(1, 0, "ab"), (2, 0, "a"), (3, 0, "b" + "c" * 40)]))
    tree = paths.tree(rows)
    got = {(r.site, r.depth): (r.visits, r.mean_seconds) for r in tree.collect() if r.depth < 3}
    assert got == {("a", 1): (2, 1.0), ("b", 2): (1, 2.0), ("b", 1): (1, 1.0), ("c", 2): (1, 2.0)}
    assert paths.longest(tree, rows).first().prefix == ">".join("b" + "c" * 40)
    assert paths.lin_similarity(tree, rows, tree, rows).first()[0] == pytest.approx(1.0)
    other = paths.nodes(path_sessions(spark, [(9, 1, "bccd"), (9, 2, "ab")]))
    assert tuple(paths.longest_common(tree, rows, paths.tree(other)).first()) == ("b>c>c", 3, 1, 1)
    none = paths.nodes(path_sessions(spark, [(9, 1, "z")]))
    assert paths.lin_similarity(tree, rows, paths.tree(none), none).first()[0] == 0.0


def test_numbers_and_neighbours_equal_a_walk(spark):
    import random

    rng = random.Random(3)
    drawn = [(rng.choice([1, 1, 1, 2, None]), rng.randint(0, 60)) for _ in range(200)]
    rows = [(k, t // 10, t, i) for i, (k, t) in enumerate(drawn)]
    df = spark.createDataFrame(rows, "k int, b int, t int, id int").repartition(7)
    got = sorted((r.t, r.id, r.n) for r in numbering.numbered(df, ["t", "id"], "n", 0).collect())
    assert [n for _, _, n in got] == list(range(200))
    assert numbering.at_position(df, ["t", "id"], 0.8).first().id == got[160][1]
    assert numbering.numbered(df.limit(0), ["t"], "n").count() == 0
    want = {}
    for key in (1, 2, None):
        own = sorted((t, i) for k, _, t, i in rows if k == key)
        for j, (_, i) in enumerate(own):
            want[i] = (own[j - 1][1] if j else None, own[j + 1][1] if j + 1 < len(own) else None)
    near = numbering.with_neighbours(df, ["k"], "b", ["t", "id"], {"p": F.col("id")}, {"f": F.col("id")})
    assert {r.id: (r.p, r.f) for r in near.collect()} == want


def test_a_far_page_equals_a_near_one(spark, monkeypatch):
    df = spark.createDataFrame([(i * 7 % 100, i) for i in range(100)], "x int, i int").repartition(5)
    near = project.page(df, [F.desc("x"), "i"], 40, 10).collect()
    monkeypatch.setattr(project, "NEAR_PAGE", 5)
    assert project.page(df, [F.desc("x"), "i"], 40, 10).collect() == near and len(near) == 10


def between(left, right, low, high, low_open, high_open):
    """Row of the left (with repeats) -> the least (o, r) that fits, by all pairs."""
    out = []
    for i, k, a, b in left:
        fits = [(o, r) for k2, y, o, r in right if None not in (k, y) and k2 == k]
        fits = [(o, r) for k2, y, o, r in right if None not in (k, y) and k2 == k and (not low or a is not None and (y > a if low_open else y >= a)) and (not high or b is not None and (y < b if high_open else y <= b))]
        out.append((i, *min(fits, default=(None, None))))
    return sorted(out, key=str)


@pytest.mark.parametrize(("value", "bound"), [("int", "int"), ("bigint", "double"), ("double", "bigint"), ("double", "double"), ("decimal(20,2)", "bigint"), ("string", "string"), ("date", "timestamp")])
def test_first_between_equals_all_pairs(spark, monkeypatch, value, bound):
    import random
    from decimal import Decimal

    monkeypatch.setattr(joins, "BLOCK_BITS", 2)  # several levels of blocks
    rng = random.Random(4)
    whole = [None, -(2**53) - 1, -(2**53), -4, -3, 0, 3, 4, 7, 2**53, 2**53 + 1, 2**63 - 1]
    parts = [None, -3.7, -3.0, -0.5, -0.0, 0.0, 0.5, 3.0, 6.99, float(2**53), 2.0**63, float("inf"), float("-inf")]
    draw = {
        "int": lambda: rng.choice([None, *range(-9, 10)]), "bigint": lambda: rng.choice(whole), "double": lambda: rng.choice(parts), "decimal(20,2)": lambda: rng.choice([None, Decimal("-3.70"), Decimal("0.00"), Decimal("3.00"), Decimal("3.01")]),
        "string": lambda: rng.choice([None, "", "a", "ab", "é", "z"]), "date": lambda: rng.choice([None, *[dt.date(2024, 1, d) for d in range(1, 9)]]), "timestamp": lambda: rng.choice([None, *[dt.datetime(2024, 1, d, h) for d in range(1, 9) for h in (0, 12)]]),
    }
    key = lambda: rng.choice([1, 1, 1, 2, None])
    left = [(i % 50, key(), draw[bound](), draw[bound]()) for i in range(70)]
    right = [(rng.choice([1, 1, 1, 2, 4, None]), draw[value](), rng.randint(0, 9), i) for i in range(90)]
    lf, rf = spark.createDataFrame(left, f"id int, k int, a {bound}, b {bound}").repartition(3), spark.createDataFrame(right, f"k int, y {value}, o int, r int").repartition(3)
    as_time = lambda x: dt.datetime.combine(x, dt.time()) if type(x) is dt.date else x
    plain = [(k, as_time(y), o, r) for k, y, o, r in right]
    for low, high, low_open, high_open in (("a", None, True, False), ("a", "b", False, False), ("a", "b", True, True), (None, "b", False, True)):
        got = joins.first_between(lf, rf, ["k"], "y", ["o", "r"], low, high, low_open, high_open).collect()
        assert sorted(((r.id, r.o, r.r) for r in got), key=str) == between(left, plain, low, high, low_open, high_open)


def test_first_between_needs_comparable_types_and_may_find_nothing(spark):
    left, right = spark.createDataFrame([(1, "x")], "k int, a string"), spark.createDataFrame([(1, 2, 3)], "k int, y int, o int")
    with pytest.raises(TypeError, match="string"):
        joins.first_between(left, right, ["k"], "y", ["o"], "a")
    left = spark.createDataFrame([(1, 5), (None, 1)], "k int, a int")
    assert [r.o for r in joins.first_between(left, right, ["k"], "y", ["o"], "a").collect()] == [None, None]
    assert [r.o for r in joins.first_between(left, right.limit(0), ["k"], "y", ["o"], "a").collect()] == [None, None]
    assert sorted(str(r.o) for r in joins.first_between(left, right, [], "y", ["o"], None, "a").collect()) == ["3", "None"]


def test_first_between_makes_no_pairs(spark, monkeypatch):
    """One key with 50,000 rows on either side: no stage has more than a few rows for each, and ranges are alike in size."""
    n, sizes = 50_000, {}
    keep = joins.written
    for module in (joins, numbering):
        monkeypatch.setattr(module, "written", lambda df, name: sizes.setdefault((name, len(sizes)), keep(df, name)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    left = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") % 1000 / 1e6).alias("a"), (F.col("id") % 1000 / 1e6 + 0.01).alias("b"), "id")
    right = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 7919 % n / (n * 1000.0)).alias("y"), F.col("id").alias("o"))
    try:
        got = joins.first_between(left, right, ["k"], "y", ["o"], "a", "b")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.where("o is not null").count() == got.count() == n
    for (name, _), df in sizes.items():
        assert df.count() <= (3 * n if name == "placed" or "_flag" in df.columns else n)
    placed = next(df for df in sizes.values() if "_flag" in df.columns)
    parts = [r["count"] for r in placed.groupBy("_range").count().collect()]
    assert len(parts) == 4 and max(parts) < 1.5 * 3 * n / 4
    row = got.where("id = 77").first()
    assert row.o == min(i for i in range(n) if 0.000077 <= i * 7919 % n / (n * 1000.0) <= 0.010077)


def test_shifted_target_carries_over_days(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t, 1, 1.0), (1, t + dt.timedelta(days=3), 2, None), (1, t + dt.timedelta(days=3), 3, 5.0), (2, t, 4, 2.0)]
    df = spark.createDataFrame(rows, "u int, ts timestamp, id int, v double")
    labels = lambda df, **how: {r.id: r.label for r in joins.shifted_target(df, "u", "ts", "v", "id", **how).collect()}
    assert labels(df, seconds=3600) == {1: None, 2: None, 3: None, 4: None}
    assert labels(df.where("id <> 2"), hours=1) == {1: 5.0, 3: None, 4: None}
    no_time = spark.createDataFrame([(1, None, 5, 7.0), (None, t, 6, 8.0)], df.schema)
    assert labels(df.where("id <> 2").union(no_time), hours=1) == {1: 5.0, 3: None, 4: None, 5: None, 6: None}
    assert labels(df, before=True, days=3) == {1: None, 2: 1.0, 3: 1.0, 4: None}
    assert labels(df, before=True) == {1: 1.0, 2: 5.0, 3: 5.0, 4: 2.0}, "of one time the last id"


def test_shifts_follow_the_calendar_and_keep_repeated_rows(spark):
    days = [dt.datetime(2024, 1, 31), dt.datetime(2024, 1, 31), dt.datetime(2024, 2, 28), dt.datetime(2024, 2, 29), dt.datetime(2024, 3, 1), dt.datetime(2025, 2, 28)]
    rows = [(1, d, i // 2, float(i), "x") for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "u int, ts timestamp, id int, v double, _rec string")
    after = joins.shifted_target(df, "u", "ts", "v", "id", months=1)
    assert after.columns == [*df.columns, "label"]
    assert sorted((r.v, r.label) for r in after.collect()) == [(0.0, 3.0), (1.0, 3.0), (2.0, 5.0), (3.0, 5.0), (4.0, 5.0), (5.0, None)]
    before = joins.shifted_target(df, "u", "ts", "v", "id", before=True, years=1)
    assert sorted((r.v, r.label) for r in before.collect())[-1] == (5.0, 2.0)


def test_null_keys_stay(spark):
    """A null user, a null time and a null group: no row is lost."""
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t, 1, "a"), (1, None, 2, "b"), (None, t, 3, "a"), (None, t + dt.timedelta(days=1), 4, "b"), (1, t + dt.timedelta(days=1), 5, None)]
    df = spark.createDataFrame(rows, "u int, ts timestamp, e int, h string")
    events = sessions.ordered_events(df, "u", "ts", "e", "h")
    assert {r.event: (r.prev_host, r.run) for r in sessions.walked(events).collect()} == {2: (None, 1), 1: ("b", 2), 5: ("a", 3), 3: (None, 1), 4: ("a", 2)}
    assert sessions.sessions(events).count() == 5
    assert {r.event: r.f for r in sessions.running_flag(events, F.col("host") == "a", "f").collect()} == {2: 0, 1: 1, 5: 1, 3: 1, 4: 1}
    assert sessions.session_sets(events, F.col("host") == "a").count() == 5
    assert {(r.u, r.unique_h, r.unique_e) for r in aggregates.num_unique_many(df, ["u"], ["h", "e"]).collect()} == {(1, 2, 3), (None, 2, 2)}
    assert {(r.e, r.n) for r in aggregates.two_pass(df, ["u"], {"n": F.count("*")}, {"n": F.col("n")}).collect()} == {(1, 3), (2, 3), (5, 3), (3, 2), (4, 2)}
    got = readers.preaggregated(df, F.lit(True), ["u", "h"], "e", ["e"], 10).collect()
    assert {(r.u, r.h, r.n, r.total) for r in got} == {(1, "a", 1, 1), (1, "b", 1, 2), (1, None, 1, 5), (None, "a", 1, 3), (None, "b", 1, 4)}


def test_relation_and_unique_key(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, "z"), (1, "w")], "key int, v2 string")
    assert sorted(tuple(r) for r in joins.related(a, b, "k = key").collect()) == [(1, "x", "w"), (1, "x", "z")]
    for wrong in ("k", "k = v", "none = key"):
        with pytest.raises(ValueError, match="relation"):
            joins.related(a, b, wrong)
    assert project.require_unique(a, ["k"]).count() == 2
    with pytest.raises(ValueError, match="'key': 1"):
        project.require_unique(b, ["key"])


def test_no_window_is_over_all_rows_or_a_whole_key(spark, sf):
    """One-task windows see a row per range only; windows by user are over rows of a day, or a row per day."""
    from featlake.plans import QUERIES

    for name in ("positional_sample", "group_ids", "ordinal_id"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "Sort [" not in plan and "Offset" not in plan
    for name in ("session_durations", "pairwise_diff", "time_shift_target", "prev_event"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert windows and any("day" in line.lower() for line in windows)


def test_the_sessions_zone_is_the_callers(spark, sf):
    from featlake.plans import QUERIES

    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        got = QUERIES["week_rollup"](spark, sf)
        assert spark.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
        tokyo = sorted(tuple(r) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tokyo == sorted(tuple(r) for r in QUERIES["week_rollup"](spark, sf).collect())


def test_csv_names_empty_columns_and_rare_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text("_cost;_cust;x;\n1;2;3;\n4;5;6;\n")
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["_cost", "_cust", "x"] and [t for _, t in df.dtypes] == ["bigint"] * 3
    (tmp_path / "b.csv").write_text("x;;_c2;\n" + "".join(f"{i};{'' if i else 'v'};'q{i}';\n" for i in range(5)))
    df = readers.read_csv(spark, str(tmp_path / "b.csv"))
    assert df.columns == ["x", "NoName_1", "_c2"] and [r["_c2"] for r in df.orderBy("x").collect()] == [f"q{i}" for i in range(5)]
    (tmp_path / "c.csv").write_text("n;t\n" + "".join(f"{'abc' if i == 4000 else i};2024-01-0{i % 9 + 1} 10:00:00\n" for i in range(5000)))
    for sample in (1.0, 0.001):
        df = readers.read_csv(spark, str(tmp_path / "c.csv"), sample=sample)
        assert df.where("n = 'abc'").count() == 1 and df.where("n is null").count() == 0 and dict(df.dtypes)["t"] == "timestamp"
    (tmp_path / "d.csv").write_text("1,a,9\n2,b,8\n")
    df = readers.read_csv(spark, str(tmp_path / "d.csv"), ",", header=False, names=["id", "name"])
    assert df.columns == ["id", "name", "NoName_2"] and df.count() == 2


def test_intermediate_tables_are_cleared(spark):
    from featlake.sources import scratch

    df = spark.range(10)
    outside = scratch.written(df, "outside")
    with scratch.cleared(spark):
        inside = numbering.numbered(df, ["id"], "n")
        files = inside.inputFiles()
        assert inside.count() == 10 and files
    assert outside.count() == 10
    assert not any(Path(f.removeprefix("file:").replace("///", "/")).exists() for f in files)


def test_scratch_folder_must_be_shared(spark):
    from featlake.sources import scratch

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session)


def test_upsert_update_delete(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    as_set = lambda df: {(r.k, r.v) for r in df.collect()}
    assert as_set(writers.upsert(old, new, ["k"])) == {(1, "a"), (2, "B"), (3, "C")}
    assert as_set(writers.keyed_update(old, new, ["k"], ["v"])) == {(1, "a"), (2, "B")}
    assert as_set(writers.delete_keys(old, new, ["k"])) == {(1, "a")}


@pytest.fixture
def small_splits(spark):
    """Splits of about 2000 bytes."""
    conf = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "40"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


def test_csv_records_cross_splits(spark, tmp_path, small_splits):
    """What a CSV writer wrote comes back, in whatever split a quote or line end lies; two files, one with a value over many splits."""
    import csv
    import random

    rng = random.Random(1)
    bits = ["a", "b;c", "d\ne", '"q"', '""', "\n\n", 'x"y', "1,5", "é", '; "', "\n;", "plain", "", "\r\n"]
    rows = [(i, "<" + "".join(rng.choice(bits) for _ in range(rng.randrange(6))) + ">", f"{rng.random():.6f}".replace(".", ",")) for i in range(900)]
    rows[700] = (700, "<" + '"long";\n' * 2000 + ">", "0,5")
    (tmp_path / "in").mkdir()
    for name, part in (("a", rows[:400]), ("b", rows[400:])):
        with open(tmp_path / "in" / f"{name}.csv", "w", newline="") as f:
            w = csv.writer(f, delimiter=";", lineterminator="\n" if name == "a" else "\r\n")
            w.writerow(["id", "note", "x"])
            w.writerows(part)
    df = readers.read_csv(spark, str(tmp_path / "in"))
    assert dict(df.dtypes) == {"id": "bigint", "note": "string", "x": "double"}
    assert {r.id: (r.note, r.x) for r in df.collect()} == {i: (n, float(x.replace(",", "."))) for i, n, x in rows}
    plain = readers.read_csv(spark, str(tmp_path / "in"), schema="id long, note string, x string")
    assert {(r.id, r.note, r.x) for r in plain.collect()} == set(rows)


def test_csv_keeps_all_fields_and_stray_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a;b\n1;2;3\n\n4;5" pipe;;6\n7;8\n"";"9\n')
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["a", "b", "NoName_2", "NoName_3"]
    got = [tuple(r) for r in df.collect()]
    assert got[:3] == [(1, "2", 3, None), (4, '5" pipe', None, 6), (7, "8", None, None)] and len(got) == 4
    (tmp_path / "b.csv").write_text("n,m\n1.5,x\n2,y\n")
    df = readers.read_csv(spark, str(tmp_path / "b.csv"), ",")
    assert [tuple(r) for r in df.collect()] == [(1.5, "x"), (2.0, "y")]
    (tmp_path / "empty.csv").write_text("")
    assert readers.read_csv(spark, str(tmp_path / "empty.csv")).count() == 0
    (tmp_path / "head.csv").write_text("a;b\n")
    assert readers.read_csv(spark, str(tmp_path / "head.csv")).columns == ["a", "b"]


def test_one_json_file_is_several_tasks(spark, tmp_path, small_splits):
    import json
    import random

    from featlake.sources import records

    rng = random.Random(2)

    def thing(depth=0):
        return {f"k{i}": rng.choice([1, None, "a}b", '{"', '\\"}', "[", [1, {"z": "}"}], thing(depth + 1) if depth < 2 else 3]) for i in range(rng.randrange(1, 4))}

    things = [{"id": i, "o": thing()} for i in range(600)]
    things[300]["o"] = {"long": '} { \\" ' * 3000}
    text = "".join(json.dumps(o) + rng.choice(["", "", " ", "\n"]) for o in things)
    (tmp_path / "a.json").write_text(text)
    got = {r.id: json.loads(r.o) for r in readers.read_concatenated_json(spark, str(tmp_path / "a.json"), "id long, o string").collect()}
    assert got == {o["id"]: o["o"] for o in things}
    tasks = records._pieces(spark, str(tmp_path / "a.json"), "}", {}).groupBy("block").agg(F.sum(F.length("value")).alias("n")).collect()
    assert len(tasks) > 20 and max(r.n for r in tasks) < 25_000 < len(text)


def test_json_and_csv_scans(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"name": "x", "age": 1}{"name": "y", "age": 2}')
    got = readers.read_concatenated_json(spark, str(tmp_path / "a.json"), "name string, age long").collect()
    assert {(r.name, r.age) for r in got} == {("x", 1), ("y", 2)}
    (tmp_path / "one.json").write_text('{"name": "x", "age": 1}')
    assert len(readers.read_any(spark, str(tmp_path / "one.json"), "application/json").columns) == 2
    (tmp_path / "a.csv").write_text("a.b;c\n 1 ;2.5\n3;x\n")
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["a_b", "c"] and dict(df.dtypes)["c"] == "string"
    with pytest.raises(ValueError):
        readers.read_any(spark, "x", "image/png")


def test_create_or_append_keeps_a_dataset_with_other_fields(spark, tmp_path):
    path, df, other = str(tmp_path / "t"), spark.range(10), spark.range(3).toDF("x")
    got = [writers.create_or_append(spark, x, path) for x in (df, other, df, other, other.toDF("y"))]
    assert got == [(path, False), (f"{path}-2", False), (path, True), (f"{path}-2", True), (f"{path}-3", False)]
    assert [spark.read.parquet(p).count() for p in (path, f"{path}-2", f"{path}-3")] == [20, 6, 3]


def test_repeated_keys_of_an_update(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "B", 1), (2, "C", 2), (None, "N", 1)], "k int, v string, o int")
    with pytest.raises(ValueError, match="duplicate key"):
        writers.keyed_update(old, new, ["k"], ["v"])
    as_set = lambda df: {(r.k, r.v) for r in df.collect()}
    assert as_set(writers.keyed_update(old, new, ["k"], ["v"], order=["o"])) == {(1, "a"), (2, "C"), (None, "n")}
    assert as_set(writers.upsert(old, new.where("o = 1").drop("o"), ["k"])) == {(1, "a"), (2, "B"), (None, "N")}


def test_a_change_writes_the_folders_of_its_keys_only(spark, tmp_path):
    from featlake.sources import keyed

    path = str(tmp_path / "t")
    keyed.write_keyed(spark.createDataFrame([(i, f"v{i}") for i in range(200)] + [(None, "none")], "k long, v string"), path, ["k"], 32)
    files = lambda: {f for f in spark.read.parquet(path).inputFiles()}
    rows = lambda: {(r.k, r.v) for r in keyed.read_keyed(spark, path).collect()}
    folder = lambda f: f.rpartition("/")[0]
    before = files()
    touched = keyed.change_keyed(spark, path, spark.createDataFrame([(7, "new")], "k long, v string"), "update")
    after = files()
    assert len(touched) == 1 and {folder(f) for f in before - after} == {folder(f) for f in after - before} and len({folder(f) for f in after - before}) == 1
    assert rows() == {(i, "new" if i == 7 else f"v{i}") for i in range(200)} | {(None, "none")}
    keyed.change_keyed(spark, path, spark.createDataFrame([(8, "up"), (1000, "in"), (None, "n")], "k long, v string"), "upsert")
    assert rows() == {(i, {7: "new", 8: "up"}.get(i, f"v{i}")) for i in range(200)} | {(1000, "in"), (None, "n")}
    with pytest.raises(ValueError, match="duplicate key"):
        keyed.change_keyed(spark, path, spark.createDataFrame([(7, "a"), (7, "b")], "k long, v string"), "update")
    keyed.change_keyed(spark, path, keyed.read_keyed(spark, path).where("k is not null"), "delete")
    assert rows() == {(None, "n")} and keyed.read_keyed(spark, path).columns == ["k", "v"]
    assert keyed.change_keyed(spark, path, spark.createDataFrame([], "k long, v string"), "upsert") == []


def test_reduction_in_chunks_equals_a_walk(spark, monkeypatch):
    """A hot key over many chunks; no group of chunks or states is longer than stated."""
    monkeypatch.setattr(aggregates, "CHUNK", 7)
    monkeypatch.setattr(aggregates, "FAN", 3)
    rows = [("hot" if i % 3 else f"k{i % 5}" if i % 2 else None, i * 37 % 200) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, x int").repartition(5)
    # The text of all values in order: order matters at every step, and combining is joining.
    text = lambda a, v: F.concat(a, F.lit(","), v["x"].cast("string"))
    got = aggregates.reduce_in_order(df, {"k": F.col("k")}, {"x": F.col("x")}, F.lit(""), text, lambda a, b: F.concat(a, b), {"text": lambda s: s})
    want = {k: "".join(f",{x}" for k2, x in sorted(rows, key=lambda r: r[1]) if k2 == k) for k in {k for k, _ in rows}}
    assert {r.k: r.text for r in got.collect()} == want
    assert aggregates.reduce_in_order(df.limit(0), {"k": F.col("k")}, {"x": F.col("x")}, F.lit(""), text, lambda a, b: F.concat(a, b), {"t": lambda s: s}).count() == 0


def test_states_merge_in_any_number_and_order(spark):
    import random
    import statistics

    from featlake.operators import states

    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1e9 + rng.random()]), i % 977, i) for i in range(6000)]
    df = spark.createDataFrame(rows, "k string, x double, u int, t int")
    rules = {"mean": ("mean", "x"), "std": ("std", "x"), "n": ("count", "x"), "about": ("about_distinct", "u"), "last": ("last", "t", "u"), "set": ("set", "u")}
    parts = [states.partial_states(df.where(f"t % 9 = {i}"), ["k"], rules) for i in range(9)]
    all_states = parts[0]
    for p in reversed(parts[1:]):
        all_states = all_states.union(p)
    half = states.merged_states(all_states, ["k"], rules)
    got = {r.k: r for r in states.finished_states(states.merged_states(half, ["k"], rules), ["k"], rules).collect()}
    for k in ("a", "b", None):
        own = [r for r in rows if r[0] == k]
        x = [r[1] for r in own if r[1] is not None]
        assert got[k].n == len(x) and got[k].mean == pytest.approx(statistics.mean(x)) and got[k].std == pytest.approx(statistics.pstdev(x), rel=1e-4)
        assert got[k].last == own[-1][2] and list(got[k].set) == sorted({r[2] for r in own})
        assert abs(got[k].about / len({r[2] for r in own}) - 1) < 3 * 1.04 / 2 ** (states.SKETCH_BITS / 2)
    none = states.partial_states(df.where("x is null and k = 'a'"), ["k"], {"m": ("mean", "x"), "s": ("std_sample", "x")})
    assert states.finished_states(none, ["k"], {"m": ("mean", "x"), "s": ("std_sample", "x")}).first()[1:] == (None, None)


def test_nearest_targets_equal_all_pairs(spark):
    """Around poles and the 180th meridian, in clusters and in one place; the joined cells hold few of all pairs."""
    import math
    import random

    rng = random.Random(6)
    place = lambda: rng.choice([(rng.uniform(-90, 90), rng.uniform(-180, 180)), (rng.choice([89.99, -89.99, 90.0]), rng.uniform(-180, 180)), (rng.uniform(-1, 1), rng.choice([179.999, -179.999, 180.0, -180.0])), (42.7 + rng.random() / 100, 23.3 + rng.random() / 100)])
    targets = [(i, *place()) for i in range(400)] + [(1000 + i, 10.0, 20.0) for i in range(50)] + [(2000, None, 1.0)]
    points = [(i, *place()) for i in range(150)] + [(500, 10.0, 20.0), (501, 10.0, 20.001), (502, 10.0, None), (500, 10.0, 20.0)]

    def km(a, b):
        x = math.sin(math.radians(a[0] - b[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(a[1] - b[1]) / 2) ** 2
        return 2 * project.EARTH_KM * math.asin(math.sqrt(min(1.0, x)))

    tf, pf = spark.createDataFrame(targets, "t int, lat double, lng double"), spark.createDataFrame(points, "p int, lat double, lng double")
    got = {}
    for r in project.geo_nearest(pf, tf, "lat", "lng", 4, "p", "t").collect():
        got.setdefault((r.p, r["rank"]), []).append((r.t, r.km))
    for p, *at in points:
        if None not in at:
            want = sorted((km(b, at), t) for t, *b in targets if None not in b)[:4]
            for rank, (d, _) in enumerate(want, 1):
                assert {round(x, 6) for _, x in got[p, rank]} == {round(d, 6)}
    assert [got[500, r][0][0] for r in (1, 2, 3, 4)] == [1000, 1001, 1002, 1003] and len(got[500, 1]) == 2 and (502, 1) not in got
    few = project.geo_nearest(pf.where("p < 3"), tf.limit(2), "lat", "lng", 4, "p", "t")
    assert few.groupBy("p").count().where("count = 2").count() == 3
    near = project.geo_near(tf, "lat", "lng", 0.0, 179.9995, 5, "t", within_km=500.0).collect()
    want = sorted((km(b, (0.0, 179.9995)), t) for t, *b in targets if None not in b)
    assert [r.t for r in near] == [t for d, t in want if d <= 500][:5] and any(r.lng < 0 for r in near)


def test_nearest_targets_are_not_broadcast_by_the_size_of_a_file(spark):
    """Points and what lies around their cells are multiplied behind the scan, so the size of the file says nothing of theirs."""
    points = spark.range(3000).select(F.col("id").alias("p"), (F.col("id") * 41 % 1801 / 10.0 - 90).alias("lat"), (F.col("id") * 97 % 3601 / 10.0 - 180).alias("lng"))
    targets = spark.range(900).select(F.col("id").alias("t"), (F.col("id") * 37 % 180 - 90.0).alias("lat"), (F.col("id") * 73 % 360 - 180.0).alias("lng"))
    df = project.geo_nearest(points, targets, "lat", "lng", 3, "p", "t")
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 9000


def test_csv_records_are_sorted_by_file(spark, sf, monkeypatch):
    """No task sorts all rows: the files grow in number, each with a header."""
    from featlake.plans import QUERIES, inout

    paths = []
    read = inout.R.read_csv
    monkeypatch.setattr(inout.R, "read_csv", lambda s, path: paths.append(path) or read(s, path))
    monkeypatch.setattr(inout, "CSV_ROWS", 400, raising=False)
    df = QUERIES["csv_records"](spark, sf)
    n = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert df.count() == n and df.columns == ["o_orderkey", "note", "price", "NoName_3", "NoName_4"]
    assert len(spark.read.text(paths[0]).inputFiles()) == n // 400 + 1


def test_inferred_csv_is_cut_once(spark, tmp_path):
    """What reads the result scans the columns that it needs, not the text again; blank lines between many records go."""
    from featlake.sources import readers

    lines = ["a;b", *(f"{i};x{i}" + ("\n " if i % 90 == 0 else "") for i in range(400)), '7;"p\nq"', *(f"{i};y" for i in range(400))]
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    df = readers.read_csv(spark, f"{tmp_path}/in.csv")
    assert df.dtypes == [("a", "bigint"), ("b", "string")] and all(f.endswith(".parquet") for f in df.inputFiles())
    assert sorted(map(tuple, df.collect())) == sorted([*((i, f"x{i}") for i in range(400)), (7, "p\nq"), *((i, "y") for i in range(400))])


def test_holidays_by_rule(spark):
    """Easter of both churches against another way to reckon it, and what was published for four years."""

    def easter(y, orthodox):
        if orthodox:  # full moon by the golden number, then the Sunday after, in the Julian calendar
            g = y % 19
            moon = dt.date(y, 3, 21) + dt.timedelta(days=(19 * g + 15) % 30 + (13 if y < 2100 else 14))
            return moon + dt.timedelta(days=7 - (moon.weekday() + 1) % 7)
        g, c = y % 19, y // 100
        h = (c - c // 4 - (8 * c + 13) // 25 + 19 * g + 15) % 30
        i = h - h // 28 * (1 - 29 // (h + 1) * ((21 - g) // 11))
        j = (y + y // 4 + i + 2 - c + c // 4) % 7
        month = 3 + (i - j + 40) // 44
        return dt.date(y, month, i - j + 28 - 31 * (month // 4))

    for name in ("orthodox", "western"):
        if name == "orthodox":
            years = range(1901, 2100)
        else:
            years = range(1900, 2101)
        got = times.holiday_calendar(spark, years[0], years[-1], name, {}, {}, shifted=False).collect()
        assert sorted(r.day for r in got) == [easter(y, name == "orthodox") for y in years]
    got = {r.name: r.day for r in times.holiday_calendar(spark, 2017, 2017).collect()}
    assert len(got) == 12 and got["easter"] == dt.date(2017, 4, 17) and got["saint george"] == dt.date(2017, 5, 5) and got["labour day"] == dt.date(2017, 5, 1) and got["new year"] == dt.date(2017, 1, 2)
    sundays = [r.day for r in times.holiday_calendar(spark, 2017, 2020, "orthodox", {}, {}, shifted=False).orderBy("day").collect()]
    assert sundays == [dt.date(2017, 4, 16), dt.date(2018, 4, 8), dt.date(2019, 4, 28), dt.date(2020, 4, 19)]
    assert {r.day.weekday() for r in times.holiday_calendar(spark, 1990, 2030).collect()} <= set(range(5))


def test_languages_of_rows_that_took_no_part(spark, sf):
    from featlake.operators import languages

    df = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    profiles = languages.learn_profiles(df.where("doc_id % 3 <> 0"), "text", "lang")
    rest = df.where("doc_id % 3 = 0 and lang is not null and text rlike '\\\\p{L}'")
    got = languages.text_language(rest, "text", profiles).select("lang", "language").collect()
    assert sum(r.lang == r.language for r in got) >= 0.95 * len(got) > 0
    odd = [(1, None), (2, ""), (3, "1234 !?"), (4, "привет мир как твои дела сегодня"), (5, "x" * 3_000_000), (6, "zqxj kvwq xzzq jjqk wqvx " * 20)]
    found = languages.text_language(spark.createDataFrame(odd, "language_id int, text string"), "text", profiles)
    assert found.columns == ["language_id", "text", "language", "distance"] and {r.language for r in found.collect()} == {"unknown"}
    assert languages.text_language(rest.limit(3), "text", profiles.limit(0)).select("language").distinct().collect()[0][0] == "unknown"


def test_feature_set_names(spark):
    fs = aggregates.FeatureSet([F.col("k")]).aggregate("s", F.sum("v")).feature(F.col("s") * 2).feature(F.col("s"), target="y")
    assert fs.build(spark.createDataFrame([(1, 2.0)], "k int, v double")).columns == ["k", "f_0", "y"]


def test_range_filter_reaches_the_scan(spark, sf):
    df = project.time_range(spark.read.parquet(f"{sf}/events.parquet"), "ts", "2024-01-08", "2024-01-09").select("event_id")
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in df._jdf.queryExecution().toString()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(0, 400_000), st.sampled_from("ab")), min_size=1, max_size=25))
def test_runs_equal_a_walk(spark, events):
    base = dt.datetime(2024, 1, 1)
    rows = [(u, base + dt.timedelta(seconds=t), i, h) for i, (u, t, h) in enumerate(events)]
    got = sessions.host_runs(sessions.ordered_events(spark.createDataFrame(rows, "u long, ts timestamp, e long, h string"), "u", "ts", "e", "h"))
    got = {r.event: r.run for r in got.collect()}
    for user in (1, 2):
        run, before = 0, None
        for _, _, i, h in sorted((r for r in rows if r[0] == user), key=lambda r: (r[1], r[2])):
            run += h != before
            before = h
            assert got[i] == run


def test_nodes_hold_whole_chains(spark, sf):
    from collections import Counter

    from featlake.operators import paths
    from featlake.plans.clicks import sessions

    chains = {}
    for r in sorted(sessions(spark, sf).collect(), key=lambda r: (r.user, r.run)):
        chains.setdefault((r.user, r.start // 86_400_000_000), []).append(r.host)
    assert max(map(len, chains.values())) > 4
    want = Counter(tuple(c[:i]) for c in chains.values() for i in range(1, len(c) + 1))
    tree = {r.node: r for r in paths.tree(paths.nodes(sessions(spark, sf))).collect()}

    def spelt(r):
        return (*(spelt(tree[r.parent]) if r.parent else ()), r.site)

    assert {spelt(r): r.visits for r in tree.values()} == want


def test_no_user_history_is_collected_to_be_counted(spark, sf):
    from featlake.plans import QUERIES

    for name in ("child_rows", "chunked_values"):
        assert "collect_list" not in QUERIES[name](spark, sf)._jdf.queryExecution().toString()


def test_concatenated_json_keeps_nulls_in_short_texts(spark, sf, tmp_path, monkeypatch):
    from featlake.plans import QUERIES, inout

    df = spark.read.parquet(f"{sf}/events.parquet").withColumn("event_id", F.when(F.col("event_id") % 3 > 0, F.col("event_id")))
    df = df.withColumn("props", F.when(F.rand(1) > 0.1, F.col("props")))
    df.union(df).union(df).write.parquet(f"{tmp_path}/events.parquet")
    read, texts = inout.R.read_concatenated_json, []
    monkeypatch.setattr(inout, "JSON_OBJECTS", 20, raising=False)
    monkeypatch.setattr(inout.R, "read_concatenated_json", lambda s, path, schema: texts.extend(s.read.text(path).select(F.regexp_count("value", F.lit("event_id"))).collect()) or read(s, path, schema))
    assert QUERIES["concatenated_json"](spark, str(tmp_path)).count() == 3 * df.count()
    assert max(t[0] for t in texts) < 100
