"""Queries of the general data problems over the tables of a data folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.impute import Category, Number, fill_missing_values, present
from strandline.operators.orphans import Reference, folded_name, orphan_cascade, orphan_report
from strandline.operators.percentiles import merge_sketches, read_percentiles, sketch_groups
from strandline.operators.regular_grid import regular_grid
from strandline.operators.spikes import Readings, implausible_readings
from strandline.operators.trailing import trailing_totals
from strandline.sources.tables import table


# 1 trailing totals ---------------------------------------------------------------------------------------------


def _daily_temperatures(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "climate_daily_temp").select("reading_id", "date", "temperature_celsius", "location")
    return trailing_totals(df, "location", "date", "temperature_celsius", (7, 30), record_id="reading_id", valid=F.col("temperature_celsius").between(-90, 60))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _daily_temperatures(spark, d).where("n = 0").select("location", F.date_format("date", "yyyy-MM-dd").alias("day"))


def p1_trailing_totals(spark: SparkSession, d: str) -> DataFrame:
    t = _daily_temperatures(spark, d)
    return t.select(
        "location", F.date_format("date", "yyyy-MM-dd").alias("day"), "n_records", (F.col("n") > 0).alias("observed"),
        *[F.round(F.col(f"{k}_{w}") + 1e-9, 4).alias(f"{k}_{w}") for w in (7, 30) for k in ("sum", "mean")], *[F.col(f"{k}_{w}") for w in (7, 30) for k in ("min", "max", "n")],
    )


_P1_DAYS = """
with rec as (
  select lower(trim(location)) location, date, reading_id,
         max(case when temperature_celsius between -90 and 60 and not isnan(temperature_celsius) then temperature_celsius end) v
  from climate_daily_temp where date is not null group by 1, 2, 3),
daily as (select location, date, count(*) n_records, count(v) n, sum(v) s, min(v) mn, max(v) mx from rec group by 1, 2),
span as (select location, min(date) lo, max(date) hi from daily group by 1),
grid as (select location, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) date from span),
full_days as (select g.location, g.date, coalesce(n_records, 0) n_records, coalesce(n, 0) n, s, mn, mx
              from grid g left join daily d on d.location is not distinct from g.location and d.date = g.date)
"""

P1_SQL = {
    "p1_found": _P1_DAYS + "select location, strftime(date, '%Y-%m-%d') as day from full_days where n = 0",
    "p1_trailing_totals": _P1_DAYS
    + """
select location, strftime(date, '%Y-%m-%d') as day, n_records, n > 0 as observed,
  round(sum(s) over a + 1e-9, 4) as sum_7, round(sum(s) over a / sum(n) over a + 1e-9, 4) as mean_7,
  round(sum(s) over b + 1e-9, 4) as sum_30, round(sum(s) over b / sum(n) over b + 1e-9, 4) as mean_30,
  min(mn) over a as min_7, max(mx) over a as max_7, cast(sum(n) over a as bigint) as n_7,
  min(mn) over b as min_30, max(mx) over b as max_30, cast(sum(n) over b as bigint) as n_30
from full_days
window a as (partition by location order by date rows between 6 preceding and current row),
       b as (partition by location order by date rows between 29 preceding and current row)""",
}


# 4 orphan references --------------------------------------------------------------------------------------------


def _holiday_orphans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the references and their orphans."""
    stores = table(spark, d, "stores")
    place = [stores.select(F.lit(kind).alias("kind"), folded_name(F.col(c)).alias("name"), "opened_on", "closed_on", F.col("store_nbr")) for kind, c in (("local", "city"), ("regional", "state"))]
    holidays = table(spark, d, "holidays_events").select("holiday_id", "date", folded_name(F.col("locale")).alias("kind"), folded_name(F.col("locale_name")).alias("name"))
    holidays = holidays.where(F.col("kind").isin("local", "regional"))
    found = orphan_cascade(
        {"holidays_events": holidays, "stores": place[0].unionByName(place[1])},
        {"holidays_events": "holiday_id", "stores": "store_nbr"},
        [Reference("holidays_events", ("kind", "name"), "stores", ("kind", "name"), "date", "opened_on", "closed_on")],
    )
    return holidays, found["holidays_events"]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _holiday_orphans(spark, d)[1].select(F.col("id").cast("bigint").alias("holiday_id")).distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    rows, found = _holiday_orphans(spark, d)
    return orphan_report("holidays_events", rows, found, "holiday_id", "date")


def p4_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Orphans of the order tables, with the customers of nations 3 and 7 seen as deleted, per table, month and kind."""
    t = {n: table(spark, d, n) for n in ("nation", "customer", "orders", "supplier", "part")}
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    t["lineitem"] = lines.withColumn("line_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    ids = {"nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey", "supplier": "s_suppkey", "part": "p_partkey", "lineitem": "line_id"}
    refs = [
        Reference("customer", ("c_nationkey",), "nation", ("n_nationkey",)),
        Reference("supplier", ("s_nationkey",), "nation", ("n_nationkey",)),
        Reference("orders", ("o_custkey",), "customer", ("c_custkey",)),
        Reference("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
        Reference("lineitem", ("l_partkey",), "part", ("p_partkey",)),
        Reference("lineitem", ("l_suppkey",), "supplier", ("s_suppkey",)),
    ]
    found = orphan_cascade(t, ids, refs, {"customer": t["customer"].where("c_nationkey in (3, 7)")})
    return orphan_report("orders", t["orders"], found["orders"], "o_orderkey", "o_orderdate").unionByName(orphan_report("lineitem", t["lineitem"], found["lineitem"], "line_id", "l_shipdate"))


P4_SQL = {
    "p4_cascade": """
with o as (select distinct o_orderkey, strftime(o_orderdate, '%Y-%m') as month,
             case when c_custkey is null then 'direct' when c_nationkey in (3, 7) then 'inherited' end as kind
           from orders left join customer on c_custkey = o_custkey where o_custkey is not null),
l as (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m') as month,
             case when o_orderkey is null or p_partkey is null or s_suppkey is null then 'direct' else kind_of end as kind
      from (select li.*, o2.o_orderkey, p_partkey, s_suppkey, case when o2.kind is not null then 'inherited' end as kind_of
            from lineitem li left join o o2 on o2.o_orderkey = l_orderkey left join part on p_partkey = l_partkey left join supplier on s_suppkey = l_suppkey))
select 'orders' as table_name, month, kind, count(*) as n from o where kind is not null group by 2, 3
union all
select 'lineitem', month, kind, count(*) from l where kind is not null group by 2, 3""",
    "p4_found": """
with names as (select holiday_id, date, lower(trim(regexp_replace(locale, '\\s+', ' ', 'g'))) as kind,
    strip_accents(lower(trim(regexp_replace(locale_name, '[\\s\\x{00a0}\\x{2000}-\\x{200b}\\x{202f}\\x{3000}]+', ' ', 'g')))) as name from holidays_events),
places as (select 'local' as kind, strip_accents(lower(trim(city))) as name, opened_on, closed_on from stores
  union all select 'regional', strip_accents(lower(trim(state))), opened_on, closed_on from stores)
select distinct holiday_id from names h where kind in ('local', 'regional') and name <> '' and name is not null and not exists (
  select 1 from places p where p.kind = h.kind and p.name = h.name and (p.opened_on is null or p.opened_on <= h.date) and (p.closed_on is null or h.date < p.closed_on))""",
}


# 2 filling missing values ---------------------------------------------------------------------------------------

_SITES = ("indoor", "outdoor", "roadside", "industrial")
_ENV = (
    Number("temp_C", -60, 60),
    Number("humidity_pct", 0, 100),
    Number("pm25_ugm3", 0, 2000),
    Number("co2_ppm", 150, 20000),
    Number("pressure_hPa", 300, 1100, target=False),
    Category("site_type", _SITES),
)


def p2_filled(spark: SparkSession, d: str) -> DataFrame:
    return fill_missing_values(table(spark, d, "environmental_sensors_missing"), "station_id", "timestamp", "reading_id", _ENV)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    marks = [F.when(F.col(f"{f.name}_filled"), F.lit(f.name)) for f in _ENV if f.target]
    return p2_filled(spark, d).select("reading_id", F.explode(F.array_compact(F.array(*marks))).alias("field")).distinct()


P2_SQL = {
    "p2_found": " union ".join(
        f"select reading_id, '{f.name}' as field from environmental_sensors_missing where {f.name} is null or isnan({f.name}) or {f.name} < {f.lo} or {f.name} > {f.hi}" for f in _ENV if isinstance(f, Number) and f.target
    )
    + f" union select reading_id, 'site_type' from environmental_sensors_missing where site_type is null or site_type not in {_SITES}"
}


# 3 regular grid --------------------------------------------------------------------------------------------------


def _station_grid(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "environmental_sensors_missing")
    clean = df.select("reading_id", "station_id", "timestamp", *[present(f, F.col(f.name)).alias(f.name) for f in _ENV if isinstance(f, Number)])
    return regular_grid(clean, "station_id", "timestamp", [f.name for f in _ENV if isinstance(f, Number)], "reading_id", table(spark, d, "sensor_stations"))


def _oil_grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(table(spark, d, "oil").select("series_code", "date", "dcoilwtico"), "series_code", "date", ["dcoilwtico"], default_minutes=1440)


def p3_station_grid(spark: SparkSession, d: str) -> DataFrame:
    return _station_grid(spark, d)


def p3_oil_grid(spark: SparkSession, d: str) -> DataFrame:
    return _oil_grid(spark, d)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    at = F.date_format("slot", "yyyy-MM-dd HH:mm:ss").alias("slot")
    stations = _station_grid(spark, d).where("missing").select(F.col("station_id").alias("series"), at)
    oil = _oil_grid(spark, d).where("dcoilwtico_n = 0").select(F.col("series_code").alias("series"), at)
    return stations.unionByName(oil)


def p3_station_slots(spark: SparkSession, d: str) -> DataFrame:
    """The grid of the stations: records and readings with a temperature in each period."""
    return _station_grid(spark, d).select("station_id", "slot", "n_records", "missing", F.col("temp_C_n").alias("n_temp"))


P3_SQL = {
    "p3_station_slots": """
with rec as (select distinct e.station_id, reading_id, cadence_minutes * 60 as p, timestamp, cast(floor(epoch(timestamp)) as bigint) as s,
               max(case when temp_C between -60 and 60 and not isnan(temp_C) then temp_C end) over (partition by e.station_id, reading_id, timestamp) as v
             from environmental_sensors_missing e join sensor_stations using (station_id)),
slots as (select station_id, p, s // 86400 * 86400 + (s % 86400) // p * p as slot, count(*) as n, count(v) as n_temp from rec group by 1, 2, 3),
span as (select station_id, p, min(slot) lo, max(slot) hi from slots group by 1, 2),
grid as (select station_id, unnest(generate_series(lo, hi, p)) as slot from span)
select g.station_id, make_timestamp(g.slot * 1000000) as slot, coalesce(n, 0) as n_records, n is null as missing, coalesce(n_temp, 0) as n_temp
from grid g left join slots s on s.station_id = g.station_id and s.slot = g.slot""",
    "p3_found": """
with rec as (select e.station_id, cadence_minutes * 60 as p, cast(floor(epoch(timestamp)) as bigint) as s
             from environmental_sensors_missing e join sensor_stations using (station_id)),
slots as (select distinct station_id, p, s // 86400 * 86400 + (s % 86400) // p * p as slot from rec),
span as (select station_id, p, min(slot) lo, max(slot) hi from slots group by 1, 2),
grid as (select station_id, unnest(generate_series(lo, hi, p)) as slot from span),
days as (select series_code, min(date) lo, max(date) hi from oil group by 1),
oil_grid as (select series_code, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as date from days)
select station_id as series, strftime(make_timestamp(slot * 1000000), '%Y-%m-%d %H:%M:%S') as slot from grid g
where not exists (select 1 from slots s where s.station_id = g.station_id and s.slot = g.slot)
union all
select series_code, strftime(date, '%Y-%m-%d 00:00:00') from oil_grid g
where not exists (select 1 from oil o where o.series_code = g.series_code and o.date = g.date and o.dcoilwtico is not null and not isnan(o.dcoilwtico))"""
}


# 5 percentiles --------------------------------------------------------------------------------------------------

_QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999)


def _pm25(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "climate_pm25_timeseries")


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per location, from sketches of the whole table's partitions."""
    sketches = sketch_groups(_pm25(spark, d).select("reading_id", "location", "pm25_ugm3"), ["location"], "pm25_ugm3", "reading_id")
    return read_percentiles(sketches, ["location"], _QUANTILES)


def p5_merged_days(spark: SparkSession, d: str) -> DataFrame:
    """The same from sketches of separate days, merged."""
    days = _pm25(spark, d).select("reading_id", "location", F.to_date("timestamp").alias("day"), "pm25_ugm3")
    return read_percentiles(merge_sketches(sketch_groups(days, ["location", "day"], "pm25_ugm3", "reading_id"), ["location"]), ["location"], _QUANTILES)


def p5_within_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Whether each percentile's true rank lies within its stated error."""
    got = p5_merged_days(spark, d).withColumn("location", F.coalesce("location", F.lit("")))
    rows = _pm25(spark, d).select("reading_id", F.coalesce("location", F.lit("")).alias("location"), "pm25_ugm3").where("pm25_ugm3 is not null and not isnan(pm25_ugm3)")
    rows = rows.groupBy("reading_id", "location").agg(F.max("pm25_ugm3").alias("x"))
    side = got.groupBy("location").agg(F.collect_list(F.struct("q", "value", "n", "rank_error")).alias("qs"))  # a few values for each location
    per = rows.join(side, "location").groupBy("location").agg(
        F.first("qs").alias("qs"),
        *[F.count(F.when(F.col("x") < F.col("qs")[i]["value"], 1)).alias(f"below{i}") for i in range(len(_QUANTILES))],
        *[F.count(F.when(F.col("x") <= F.col("qs")[i]["value"], 1)).alias(f"upto{i}") for i in range(len(_QUANTILES))],
    )
    each = F.array(*[F.struct(F.col("qs")[i]["q"].alias("q"), F.col("qs")[i]["n"].alias("n"), F.col(f"below{i}").alias("lo"), F.col(f"upto{i}").alias("hi"), F.col("qs")[i]["rank_error"].alias("e")) for i in range(len(_QUANTILES))])
    off = F.greatest(F.col("c.lo") / F.col("c.n") - F.col("c.q"), F.col("c.q") - F.col("c.hi") / F.col("c.n"))
    return per.select("location", F.explode(each).alias("c")).select("location", F.col("c.q").alias("q"), F.col("c.n").alias("n"), (off <= F.col("c.e") + 1 / F.col("c.n")).alias("within"))


P5_SQL = {
    "p5_within_bounds": f"""
with rec as (select distinct reading_id, coalesce(location, '') as location, pm25_ugm3 from climate_pm25_timeseries where pm25_ugm3 is not null and not isnan(pm25_ugm3))
select location, q, count(*) as n, true as within from rec, (select unnest([{', '.join(f'{q}::double' for q in _QUANTILES)}]) as q) group by 1, 2"""
}


# 6 implausible measurements -------------------------------------------------------------------------------------


def p6_flagged(spark: SparkSession, d: str) -> DataFrame:
    pm = table(spark, d, "climate_pm25_timeseries").select("reading_id", "sensor_id", "timestamp", "pm25_ugm3")
    iot = table(spark, d, "iot_sensors_multiseries").select("reading_id", "device_id", "timestamp", "sensor_01")
    return implausible_readings(
        [
            Readings("climate_pm25_timeseries", pm, "sensor_id", "timestamp", "reading_id", "pm25_ugm3", 0, 1000),
            Readings("iot_sensors_multiseries", iot, "device_id", "timestamp", "reading_id", "sensor_01", -50, 150),
        ]
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_flagged(spark, d).select("table_name", F.col("record_id").alias("reading_id")).distinct()

def p6_impossible_stuck(spark: SparkSession, d: str) -> DataFrame:
    """The readings flagged as impossible or stuck."""
    return p6_flagged(spark, d).where("reason <> 'spike'").select("table_name", F.col("record_id").alias("reading_id"), "reason").distinct()


P6_SQL = {
    "p6_impossible_stuck": """
with rec as (select distinct 'climate_pm25_timeseries' as table_name, sensor_id as src, reading_id, timestamp, pm25_ugm3 as y, 0 as lo, 1000 as hi from climate_pm25_timeseries
  union select distinct 'iot_sensors_multiseries', device_id, reading_id, timestamp, sensor_01, -50, 150 from iot_sensors_multiseries),
seen as (select *, case when y = lag(y) over w then 0 else 1 end as new from rec where y is not null and not isnan(y) window w as (partition by table_name, src order by timestamp, reading_id)),
runs as (select *, sum(new) over (partition by table_name, src order by timestamp, reading_id) as run from seen),
sized as (select *, count(*) over (partition by table_name, src, run) as n from runs)
select distinct table_name, reading_id, case when y < lo or y > hi then 'impossible' else 'stuck' end as reason from sized where y < lo or y > hi or n >= 12"""
}

P4_SQL["p4_report"] = (
    "with found as (" + P4_SQL["p4_found"] + ") select 'holidays_events' as table_name, strftime(date, '%Y-%m') as month, 'direct' as kind, count(*) as n "
    "from (select distinct holiday_id, date from holidays_events) join found using (holiday_id) group by 2"
)


QUERIES = {
    "p1_found": p1_found, "p1_trailing_totals": p1_trailing_totals, "p2_found": p2_found, "p2_filled": p2_filled,
    "p3_found": p3_found, "p3_station_grid": p3_station_grid, "p3_oil_grid": p3_oil_grid, "p3_station_slots": p3_station_slots,
    "p4_found": p4_found, "p4_report": p4_report, "p4_cascade": p4_cascade,
    "p5_percentiles": p5_percentiles, "p5_merged_days": p5_merged_days, "p5_within_bounds": p5_within_bounds,
    "p6_found": p6_found, "p6_flagged": p6_flagged, "p6_impossible_stuck": p6_impossible_stuck,
}
SQL = {**P1_SQL, **P2_SQL, **P3_SQL, **P4_SQL, **P5_SQL, **P6_SQL}
