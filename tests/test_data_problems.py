import datetime as dt
import itertools
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions.kalman import local_level_innovations, smooth_local_trend
from strandline.functions.relative_rank import RelativeRankSketch
from strandline.operators.impute import Category, Number, chow_liu, fill_missing_values, mutual_information, posteriors
from strandline.operators.orphans import Reference, folded_name, orphan_cascade, orphans_at
from strandline.operators.percentiles import merge_sketches, read_percentiles, sketch_groups
from strandline.operators.regular_grid import regular_grid
from strandline.operators.spikes import Readings, implausible_readings, spike_mask, vanished_variance
from strandline.operators.trailing import TwoStackQueue, trailing_totals, two_stack_windows

NAN = float("nan")
D = dt.date
T0 = dt.datetime(2022, 1, 1)


# trailing totals -------------------------------------------------------------------------------------------------


def test_two_stack_queue_serves_any_monoid():
    rng = np.random.default_rng(0)
    x = rng.normal(size=200)
    for w in (1, 2, 7, 30):
        for combine, ufunc, identity in ((max, np.maximum, -np.inf), (lambda a, b: a + b, np.add, 0.0)):
            q, got = TwoStackQueue(combine, identity), []
            for i, v in enumerate(x):
                q.push(v)
                if i >= w:
                    q.pop()
                got.append(q.value())
            want = [ufunc.reduce(x[max(0, i - w + 1) : i + 1]) for i in range(len(x))]
            assert np.allclose(got, want) and np.allclose(two_stack_windows(x, w, ufunc, identity), want)


def test_trailing_totals_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows, k = [], 0
    for name, days in (("A ", 90), ("b", 40)):
        for i in range(days):
            if rng.random() < 0.7 or i in (0, days - 1):
                k += 1
                v = [float(rng.integers(-20, 30)), None, NAN, 999.0][rng.choice(4, p=[0.7, 0.1, 0.1, 0.1])]
                rows.append((k, D(2020, 1, 1) + dt.timedelta(days=i), v, name if rng.random() < 0.5 else name.strip().upper(), "x", 7))
    rows += rows[:9]  # repeats
    df = spark.createDataFrame(rows, "id long, day date, t double, place string, e string, n int")
    for block in (31, 512):
        out = trailing_totals(df, "place", "day", "t", (7, 30), "id", F.col("t").between(-90, 60), block_days=block).collect()
        got = {(r["place"], r["day"]): r for r in out}
        assert len(got) == len(out) == 130
        best = defaultdict(dict)
        for i, day, v, place, *_ in set(rows):
            best[place.strip().lower(), day][i] = v
        for (place, day), r in got.items():
            for w in (7, 30):
                vs = [v for b in range(w) for v in best.get((place, day - dt.timedelta(days=b)), {}).values() if v is not None and v == v and abs(v) < 60]
                assert r[f"n_{w}"] == len(vs)
                if vs:
                    assert r[f"sum_{w}"] == pytest.approx(sum(vs)) and r[f"mean_{w}"] == pytest.approx(sum(vs) / len(vs)) and r[f"max_{w}"] == max(vs)
                else:
                    assert r[f"sum_{w}"] is None and r[f"mean_{w}"] is None


def test_trailing_totals_edges(spark):
    schema = "id long, day date, t double, place string"
    assert trailing_totals(spark.createDataFrame([], schema), "place", "day", "t", record_id="id").count() == 0
    df = spark.createDataFrame([(1, None, 3.0, "a"), (None, D(2020, 1, 1), 4.0, None), (2, D(2023, 1, 1), 5.0, None)], schema)
    rows = trailing_totals(df, "place", "day", "t", record_id="id").collect()
    assert len(rows) == (D(2023, 1, 1) - D(2020, 1, 1)).days + 1 and {r["place"] for r in rows} == {None}
    with pytest.raises(ValueError):
        trailing_totals(df, "place", "day", "t", (600,))


# filling ---------------------------------------------------------------------------------------------------------


def test_chow_liu_posteriors_against_enumeration():
    rng = np.random.default_rng(2)
    n = 4000
    a = rng.integers(0, 3, n)
    b = np.where(rng.random(n) < 0.8, a, rng.integers(0, 3, n))
    c = np.where(rng.random(n) < 0.7, b % 2, rng.integers(0, 2, n))
    data, sizes = np.stack([a, b, c], 1), [3, 3, 2]
    pairs = {(i, j): np.histogram2d(data[:, i], data[:, j], bins=[range(sizes[i] + 1), range(sizes[j] + 1)])[0] for i in range(3) for j in range(i + 1, 3)}
    tree = chow_liu(sizes, pairs)
    edges = {frozenset((v, p)) for v, p in enumerate(tree.parent) if p >= 0}
    assert edges == {frozenset((0, 1)), frozenset((1, 2))}
    assert mutual_information(pairs[0, 1]) > mutual_information(pairs[0, 2])

    def joint(x):
        p = 1.0
        for v in range(3):
            u = tree.parent[v]
            p *= tree.table[v][x[v]] if u < 0 else tree.table[v][x[u], x[v]]
        return p

    got = posteriors(tree, np.array([[0, -1, 1], [-1, -1, 0], [2, -1, -1]]), [0, 1, 2])
    for row, known in enumerate(({0: 0, 2: 1}, {2: 0}, {0: 2})):
        for v in range(3):
            want = np.zeros(sizes[v])
            for x in np.ndindex(*sizes):
                if all(x[k] == s for k, s in known.items()):
                    want[x[v]] += joint(x)
            assert np.allclose(got[v][row], want / want.sum())


FIELDS = (Number("temp_C", -60, 60), Number("humidity_pct", 0, 100), Number("pm25_ugm3", 0, 2000), Number("co2_ppm", 150, 20000), Number("pressure_hPa", 300, 1100, False), Category("site_type", ("indoor", "outdoor", "roadside", "industrial")))


def test_hidden_values_are_filled_better_than_by_the_middle(spark, data):
    df = spark.read.parquet(f"{data}/environmental_sensors_missing.parquet").dropDuplicates(["reading_id"])
    hide = (F.xxhash64("reading_id") % 10 == 0) & F.col("temp_C").between(-60, 60) & F.col("humidity_pct").between(0, 100)
    hidden = df.withColumn("temp_C", F.when(~hide, F.col("temp_C"))).withColumn("site_type", F.when(~hide, F.col("site_type")))
    out = fill_missing_values(hidden, "station_id", "timestamp", "reading_id", FIELDS).toPandas().set_index("reading_id")
    truth = df.where(hide).toPandas().set_index("reading_id")
    got = out.loc[truth.index]
    assert got.temp_C_filled.all() and got.site_type_filled.all()
    away, plain = (got.temp_C - truth.temp_C).abs().mean(), (truth.temp_C - truth.temp_C.median()).abs().mean()
    assert away < 0.4 * plain
    known = truth.site_type.isin(FIELDS[-1].known)
    assert (got.site_type[known] == truth.site_type[known]).mean() > 0.9
    assert not out[[f.name for f in FIELDS if f.target]].isna().any().any()
    kept = out.loc[~out.temp_C_filled, "temp_C"]
    assert (kept == df.toPandas().set_index("reading_id").temp_C.loc[kept.index]).all()


def test_filling_edges(spark):
    schema = "reading_id long, station_id string, timestamp timestamp, temp_C double, humidity_pct double, pm25_ugm3 double, co2_ppm double, pressure_hPa double, site_type string, day string, src int, x0 int"
    assert fill_missing_values(spark.createDataFrame([], schema), "station_id", "timestamp", "reading_id", FIELDS).count() == 0
    rows = [(1, "a", T0, 20.0, None, NAN, None, None, "?", "z", 1, 2), (1, "a", T0, 20.0, None, NAN, None, None, "?", "z", 1, 2), (2, None, T0, -999.0, None, 5.0, None, None, None, None, 1, 2), (None, "a", None, None, None, None, None, None, None, None, 1, 2)]
    out = fill_missing_values(spark.createDataFrame(rows, schema), "station_id", "timestamp", "reading_id", FIELDS).collect()
    assert len(out) == 3
    r = next(r for r in out if r["reading_id"] == 2)
    assert r["temp_C"] == 20 and r["temp_C_filled"] and r["pm25_ugm3"] == 5 and not r["pm25_ugm3_filled"]
    assert r["humidity_pct"] is None and r["humidity_pct_filled"] and r["site_type"] is None and r["site_type_filled"]


def test_fill_days_without_values_from_the_days_beside(spark):
    rng = np.random.default_rng(12)
    rows = []
    for s in ("a", "b"):
        for h in range(24 * 40):
            v = (5 if (h // 240) % 2 else 25) + rng.normal(0, 0.3)
            absent = 24 * 24 <= h < 24 * 25 or 24 * 33 <= h < 24 * 35
            rows.append((len(rows), s, T0.replace(hour=0, minute=0) + dt.timedelta(hours=h), None if absent else float(v)))
    df = spark.createDataFrame(rows, "id long, s string, at timestamp, temp double")
    out = fill_missing_values(df, "s", "at", "id", [Number("temp", -60, 60)]).where("temp_filled").collect()
    assert len(out) == 2 * 72
    assert all(abs(r["temp"] - (5 if r["id"] % 960 // 240 % 2 else 25)) < 2 for r in out)


# regular grid ----------------------------------------------------------------------------------------------------


def test_smoother_against_dense_solution():
    rng = np.random.default_rng(4)
    t = np.sort(rng.uniform(0, 100, 25))
    y = np.where(rng.random(25) < 0.3, np.nan, np.sin(t / 15))
    r, q, damping = 0.05, 0.02, 1e-3
    level, var = smooth_local_trend(t[:, None], y[:, None], np.array([r]), np.array([q]), damping)
    dt_ = np.diff(t, prepend=t[0])
    typical = np.median(dt_[dt_ > 0])
    qs = damping * q / typical**2
    spread = np.nanvar(y) + r
    # the states as one Gaussian vector, conditioned on the readings
    n = len(t)
    cov, mean = np.zeros((2 * n, 2 * n)), np.zeros(2 * n)
    p0 = np.diag([10 * spread + 1e-9, q / typical])
    first = y[~np.isnan(y)][0]
    steps, ps = [], []
    for i in range(n):
        h = dt_[i]
        steps.append(np.array([[1, h], [0, 1]]))
        noise = np.array([[q * h + qs * h**3 / 3, qs * h**2 / 2], [qs * h**2 / 2, qs * h]])
        ps.append(steps[i] @ (ps[-1] if i else p0) @ steps[i].T + noise)
    for i in range(n):
        mean[2 * i] = first
        block = ps[i]
        for j in range(i, n):
            cov[2 * i : 2 * i + 2, 2 * j : 2 * j + 2] = block
            cov[2 * j : 2 * j + 2, 2 * i : 2 * i + 2] = block.T
            if j + 1 < n:
                block = block @ steps[j + 1].T
    seen = np.flatnonzero(~np.isnan(y)) * 2
    gain = cov[:, seen] @ np.linalg.inv(cov[np.ix_(seen, seen)] + r * np.eye(len(seen)))
    want = mean + gain @ (y[seen // 2] - mean[seen])
    left = cov - gain @ cov[seen]
    assert np.allclose(level[:, 0], want[::2], atol=1e-6) and np.allclose(var[:, 0], np.diag(left)[::2], atol=1e-6)


def test_grid(spark):
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for s, n, gap in (("a", 400, (100, 140)), ("b", 30, (10, 12))):
        for i in range(n):
            if not gap[0] <= i < gap[1]:
                k += 1
                at = T0 + dt.timedelta(minutes=60 * i + int(rng.integers(0, 59)))
                rows.append((k, s, at, None if i % 7 == 3 else 10 + math.sin(i / 10), "q", 1))
    rows += rows[:3]
    df = spark.createDataFrame(rows, "id long, src string, ts timestamp_ntz, v double, slot string, t int").withColumnRenamed("src", "station")
    cad = spark.createDataFrame([("a", 60), ("b", None)], "station string, cadence_minutes int")
    whole = regular_grid(df, "station", "ts", ["v"], "id", cad).toPandas().sort_values(["station", "slot"], ignore_index=True)
    parts = regular_grid(df, "station", "ts", ["v"], "id", cad, block_slots=120, margin_slots=24).toPandas().sort_values(["station", "slot"], ignore_index=True)
    assert len(whole) == len(parts) == 430 and whole.missing.sum() == parts.missing.sum() == 42
    assert (whole.slot == parts.slot).all() and (whole.n_records == parts.n_records).all() and not whole.v.isna().any()
    a = whole[whole.station == "a"].reset_index(drop=True)
    inside = np.r_[5:95, 145:395]
    assert np.abs(a.v[inside] - (10 + np.sin(np.array(inside) / 10))).max() < 0.25
    assert a.v_sd[120] > 2 * a.v_sd[50] and a.v_n[3] == 0 and a.n_records[3] == 1
    assert np.abs(parts.v - whole.v).mean() < 0.1


@pytest.mark.parametrize("every", [60, 1440])
def test_grid_of_blocks_is_that_of_the_whole_series(spark, every):
    rng = np.random.default_rng(every)
    level = 50 + np.cumsum(rng.normal(0, 1, 1600))
    rows = [("s", T0 + dt.timedelta(minutes=every * i), float(v)) for i, v in enumerate(level + rng.normal(0, 1, 1600)) if i % 11 and not 600 <= i < 640]
    df = spark.createDataFrame(rows, "s string, ts timestamp, v double")
    whole, parts = (regular_grid(df, "s", "ts", ["v"], default_minutes=every, block_slots=n).toPandas().sort_values("slot", ignore_index=True) for n in (2048, 480))
    assert len(whole) == len(parts) == 1599
    assert (np.abs(parts.v - whole.v) <= 0.2 * whole.v_sd).mean() > 0.98 and (np.abs(parts.v_sd / whole.v_sd - 1) < 0.05).mean() > 0.98
    assert 0.5 < np.abs(whole.v - level[1:]).mean() < 2.0


def test_grid_edges(spark):
    schema = "station string, ts timestamp, v double"
    assert regular_grid(spark.createDataFrame([], schema), "station", "ts", ["v"]).count() == 0
    df = spark.createDataFrame([(None, T0, None), (None, T0 + dt.timedelta(days=40), NAN), ("x", None, 1.0)], schema)
    out = regular_grid(df, "station", "ts", ["v"], default_minutes=1440).collect()
    assert len(out) == 41 and sum(r["missing"] for r in out) == 39 and all(r["v"] is None for r in out)


# orphans ---------------------------------------------------------------------------------------------------------


def test_folded_names(spark):
    names = [" Péljorvor ", "PELJORVOR", "péljorvor", "San  \t Stoyth ", "san stoyth", "　", None, "STRASSE", "straße"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(folded_name(F.col("n"))).collect()]
    assert got == ["peljorvor"] * 3 + ["san stoyth"] * 2 + [None, None, "strasse", "strasse"]


def test_orphans_at(spark):
    parents = spark.createDataFrame([("a", D(2020, 1, 10), D(2020, 3, 1)), ("a", D(2020, 6, 1), None), ("a", D(2020, 6, 1), None), ("b", None, None), (None, None, None)], "k string, o date, c date")
    days = ["2020-01-09", "2020-01-10", "2020-02-29", "2020-03-01", "2020-05-31", "2020-06-01", "2031-01-01"]
    kids = [(i, "a", D.fromisoformat(x)) for i, x in enumerate(days)] + [(10, "b", D(1990, 1, 1)), (11, "z", D(2020, 1, 1)), (12, None, D(2020, 1, 1)), (13, "a", None), (14, "z", None), (0, "a", D.fromisoformat(days[0]))]
    df = spark.createDataFrame(kids, "id int, k string, at date").withColumn("_m", F.lit(1))
    got = sorted({r["id"] for r in orphans_at(df, ["k"], "at", parents, "o", "c").collect()})
    assert got == [0, 3, 4, 11, 14]
    assert orphans_at(df.limit(0), ["k"], "at", parents, "o", "c").count() == 0
    assert sorted({r["id"] for r in orphans_at(df, ["k"], "at", parents.limit(0), "o", "c").collect()}) == [0, 1, 2, 3, 4, 5, 6, 10, 11, 13, 14]


def test_cascade(spark):
    t = {
        "a": spark.createDataFrame([(1,), (2,)], "a int"),
        "b": spark.createDataFrame([(10, 1), (11, 9), (12, 2), (13, None), (12, 2)], "b int, a int"),
        "c": spark.createDataFrame([(100, 10, None), (101, 11, None), (102, 12, 101), (103, 13, 104), (104, 99, None), (105, 10, 105)], "c int, b int, up int"),
    }
    refs = [Reference("b", ("a",), "a", ("a",)), Reference("c", ("b",), "b", ("b",)), Reference("c", ("up",), "c", ("c",))]
    found = orphan_cascade(t, {"a": "a", "b": "b", "c": "c"}, refs, {"a": t["a"].where("a = 2")})
    kinds = {n: {int(r["id"]): r["kind"] for r in df.collect()} for n, df in found.items()}
    assert kinds["a"] == {2: "deleted"} and kinds["b"] == {11: "direct", 12: "inherited"}
    assert kinds["c"] == {101: "inherited", 102: "inherited", 103: "inherited", 104: "direct"}


# percentiles -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("high", [True, False])
def test_sketch_errors_stay_within_what_it_says(high):
    rng = np.random.default_rng(6)
    x = np.round(rng.lognormal(4, 0.6, 300_000), 1)
    s = RelativeRankSketch(high=high)
    for part in np.array_split(x, 23):
        other = RelativeRankSketch(high=high)
        other.update(part)
        s.merge(RelativeRankSketch.from_bytes(other.to_bytes()))
    assert s.n == len(x) and sum(map(len, s.levels)) < 8000
    q = np.array([0.0, 0.001, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999, 1.0])
    v, xs = s.quantiles(q), np.sort(x)
    lo, hi = np.searchsorted(xs, v, "left") / len(x), np.searchsorted(xs, v, "right") / len(x)
    assert (np.maximum(np.maximum(lo - q, q - hi), 0) <= s.rank_error(v) + 1 / len(x)).all()
    tail = s.rank_error(v[-3:-1] if high else v[1:3])
    assert (tail <= 0.05 * np.array([0.01, 0.001] if high else [0.001, 0.01]) + 2e-5).all()  # relative to the rank from the protected end


def test_errors_of_many_equal_parts_cancel():
    rng = np.random.default_rng(12)
    q = np.array([0.05, 0.25, 0.5, 0.75])
    off = []
    for trial in range(6):
        whole, xs = RelativeRankSketch(seed=trial), []
        for _ in range(1000):
            part = RelativeRankSketch()
            x = rng.normal(0, 1, 500)
            part.update(x)
            whole.merge(part)
            xs.append(x)
        xs = np.sort(np.concatenate(xs))
        v = whole.quantiles(q)
        assert (np.abs(np.searchsorted(xs, v, "right") / len(xs) - q) <= whole.rank_error(v)).all()
        at = xs[(q * len(xs)).astype(int)]
        kept, upto = whole._weighted()
        told = np.append(0, upto)[np.searchsorted(kept, at, "right")]
        off.append((told - np.searchsorted(xs, at, "right")) / len(xs) / whole.rank_error(at))
    off = np.array(off)  # shares of the bound
    assert np.abs(off).max() <= 1 and np.abs(off.mean()) < 0.15 and np.abs(off.mean(axis=0)).max() < 0.3
    a, b = RelativeRankSketch(), RelativeRankSketch()
    a.update(x), b.update(x)
    assert a.to_bytes() == b.to_bytes() and RelativeRankSketch(seed=1).number != a.number


def test_percentiles_of_groups_and_merged_days(spark):
    rng = np.random.default_rng(7)
    rows = [(i, None if i % 50 == 0 else "hot" if i % 3 else "b", i % 5, [float(v), None, NAN][0 if i % 11 else 1 + i % 2]) for i, v in enumerate(rng.normal(50, 10, 6000))]
    df = spark.createDataFrame(rows + rows[:200], "id long, g string, day int, v double").withColumn("_x", F.lit(0)).withColumn("sketch", F.lit(1))
    direct = read_percentiles(sketch_groups(df, ["g"], "v", "id"), ["g"], [0.1, 0.5, 0.99]).collect()
    merged = read_percentiles(merge_sketches(sketch_groups(df, ["g", "day"], "v", "id"), ["g"]), ["g"], [0.1, 0.5, 0.99]).collect()
    for out in (direct, merged):
        assert len(out) == 9
        for r in out:
            xs = np.sort([v for _, g, _, v in rows if g == r["g"] and v is not None and v == v])
            assert r["n"] == len(xs)
            lo, hi = np.searchsorted(xs, r["value"], "left") / len(xs), np.searchsorted(xs, r["value"], "right") / len(xs)
            assert max(lo - r["q"], r["q"] - hi) <= r["rank_error"] + 1 / len(xs)
    assert sketch_groups(df.limit(0), ["g"], "v", "id").count() == 0


# spikes ----------------------------------------------------------------------------------------------------------


def _planted(rng, n, offset):
    y = np.round(20 + 3 * np.sin(np.arange(n) / 60) + rng.normal(0, 0.3, n), 2)
    want = set()
    for i in range(40, n - 40, 97):
        y[i] += rng.choice([-1, 1]) * 4.5
        want.add(offset + i)
    for i in range(90, n - 120, 400):
        y[i : i + 15] = y[i]
        y[i + 15] += 0.05 * (y[i + 15] == y[i])
        want |= {offset + j for j in range(i, i + 15)}
    y[20] = -999.0
    return y, want | {offset + 20}


def test_planted_readings_are_found_whole_and_in_chunks(spark):
    rng = np.random.default_rng(8)
    rows, want = [], set()
    for s, n in (("hot", 3000), ("b", 300)):
        y, w = _planted(rng, n, len(rows))
        want |= w
        rows += [(len(rows) + i, s, T0 + dt.timedelta(minutes=15 * i), float(v)) for i, v in enumerate(y)]
    rows += [(10**6 + i, "b", T0 + dt.timedelta(minutes=15 * i + 7), [None, NAN][i % 2]) for i in range(20)]
    df = spark.createDataFrame(rows + rows[95:99], "id long, s string, at timestamp, v double").withColumn("c", F.lit(1)).withColumn("t", F.lit("x"))
    for chunk in (400, 16_384):
        out = implausible_readings([Readings("m", df, "s", "at", "id", "v", 0, 100)], chunk=chunk).collect()
        assert {r["record_id"] for r in out} == want and len(out) == len(want)
        assert {r["reason"] for r in out} == {"impossible", "stuck", "spike"}


def test_spikes_come_from_innovations():
    y = np.random.default_rng(11).normal(10, 0.2, 60)
    y[30:32] += 3
    z = local_level_innovations(np.stack([y, y[::-1]], axis=1), np.full(2, 0.04), np.full(2, 0.0004), 4.0)
    both = np.stack([z[:, 0], z[::-1, 1]])
    assert np.flatnonzero(spike_mask(y, both, 0.04, 4.0, 8.0)).tolist() == [30, 31]
    assert not spike_mask(y, np.zeros((2, 60)), 0.04, 4.0, 8.0).any()


@pytest.mark.parametrize("n", [0, 5, 12, 40])
def test_innovation_variance_that_vanishes(n):
    y = np.round(np.random.default_rng(n).normal(0, 1, n), 0)
    y[3:18] = 7.0
    y[20:31] = 5.0
    still = vanished_variance(np.diff(y, prepend=np.nan), 12)
    runs = np.array([len(list(g)) for v, g in itertools.groupby(y) for g in [list(g)] for _ in g])
    assert still.tolist() == (runs >= 12).tolist()


def test_stuck_run_over_a_short_chunk(spark):
    rng = np.random.default_rng(10)
    sizes = [190, 408, 3, 200]  # a burst on the second day leaves the third a chunk of its own
    rows, day = [], [d for d, n in enumerate(sizes) for _ in range(n)]
    for i, d in enumerate(day):
        rows.append((i, "s", T0.replace(hour=0, minute=0) + dt.timedelta(days=d, minutes=2 * (i - day.index(d))), float(rng.normal(10, 0.2))))
    rows = [(i, s, t, 10.5 if 593 <= i < 605 else v) for i, s, t, v in rows]
    df = spark.createDataFrame(rows, "id long, s string, at timestamp, v double")
    out = implausible_readings([Readings("m", df, "s", "at", "id", "v", 0, 100)], chunk=200).collect()
    assert {r["record_id"] for r in out} == set(range(593, 605)) and {r["reason"] for r in out} == {"stuck"}


def test_slow_rises_steps_and_short_series_are_no_spikes(spark):
    rng = np.random.default_rng(9)
    y = np.concatenate([rng.normal(10, 0.2, 200), rng.normal(18, 0.2, 200), 18 + np.arange(200) / 8 + rng.normal(0, 0.2, 200)])
    rows = [(i, "s", T0 + dt.timedelta(minutes=i), float(v)) for i, v in enumerate(y)] + [(9000 + i, "few", T0 + dt.timedelta(minutes=i), v) for i, v in enumerate([1.0, 50.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, s string, at timestamp, v double")
    assert implausible_readings([Readings("m", df, "s", "at", "id", "v", 0, 100)]).count() == 0
    assert implausible_readings([Readings("m", df.limit(0), "s", "at", "id", "v", 0, 100)]).count() == 0
