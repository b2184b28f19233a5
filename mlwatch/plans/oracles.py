"""DuckDB SQL that states each registered query independently, over the same tables."""

from __future__ import annotations

TRIPS = """
zones as (select n_nationkey, r_name from nation join region on n_regionkey = r_regionkey
          where n_nationkey < 24),
trips as (
  select l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
         o.o_orderdate + to_hours(cast(o.o_orderkey % 24 as bigint)) as pickup_ts,
         o.o_orderdate + to_hours(cast(o.o_orderkey % 24 as bigint))
           + to_minutes(cast((l.l_partkey*7 + l.l_linenumber*13) % 200 as bigint)) as dropoff_ts,
         l.l_quantity*2.2e0 as trip_distance,
         l.l_linenumber as passenger_count,
         cast(substr(o.o_orderpriority,1,1) as int) as "RatecodeID",
         case o.o_orderstatus when 'F' then 1 when 'O' then 2 else 5 end as payment_type,
         pz.r_name as pickup_borough,
         dz.r_name as dropoff_borough,
         l.l_extendedprice/500e0 as fare_amount
  from lineitem l join orders o on o.o_orderkey = l.l_orderkey
  join customer c on c.c_custkey = o.o_custkey
  join supplier s on s.s_suppkey = l.l_suppkey
  left join zones pz on pz.n_nationkey = c.c_nationkey
  left join zones dz on dz.n_nationkey = s.s_nationkey),
featured as (
  select *, cast(datediff('second', pickup_ts, dropoff_ts) as double)/60e0 as trip_duration_minutes,
         cast(hour(pickup_ts) as int) as pickup_hour,
         cast(dayofweek(pickup_ts) + 1 as int) as pickup_day_of_week,
         cast(month(pickup_ts) as int) as pickup_month,
         cast(case when dayofweek(pickup_ts) in (0, 6) then 1 else 0 end as int) as is_weekend,
         cast(case when hour(pickup_ts) between 7 and 9 or hour(pickup_ts) between 16 and 19
              then 1 else 0 end as int) as is_rush_hour
  from trips),
sided as (
  select *, case when pickup_ts >= timestamp '1999-01-01' then 'current' else 'reference' end as side
  from featured),
shifted as (
  select * replace (
    case when l_partkey % 211 = 0 then cast('Infinity' as double)
         when side = 'current' then trip_distance*1.5e0 else trip_distance end as trip_distance,
    case when side = 'current' and l_partkey % 3 = 0 then 'ASIA' else pickup_borough end as pickup_borough)
  from sided),
dirty as (
  select * replace (
    case when l_partkey % 101 = 0 then cast('NaN' as double) else trip_distance end as trip_distance,
    case when l_partkey % 97 <> 0 then passenger_count end as passenger_count,
    case when l_partkey % 89 = 0 then 'Atlantis' else pickup_borough end as pickup_borough)
  from featured)
"""

PREPARED = """
prepared as (
  select * from featured
  where trip_distance between 0.1 and 100 and passenger_count between 1 and 6
    and trip_duration_minutes between 1 and 180 and "RatecodeID" between 1 and 6
    and payment_type between 1 and 4 and fare_amount between 2.5 and 200
    and pickup_borough is not null and dropoff_borough is not null)
"""

EVENTS = """
ev as (select *, cast(json_extract_string(props, '$.k') as int) as k from events),
preds as (
  select event_id as request_id, ts, 'm' || cast(user_id % 3 as varchar) as model_name,
         cast(user_id % 4 + 1 as int) as model_version, value as predicted_fare,
         (k + 1)*0.5e0 as latency_ms, k, props as numeric_feature_stats from ev),
requests as (
  select event_id, user_id, ts,
         case when event_type in ('purchase','signup') then 'POST' else 'GET' end as method,
         case when k % 10 = 0 then '/healthz'
              when k % 10 = 1 then '/doc/3f2504e0-4f89-11d3-9a0c-0305e82c3301/view'
              else '/api/v1/user/' || cast(user_id as varchar) || '/' || event_type end as path,
         case when event_type = 'error' then case when k % 2 = 0 then 500 else 422 end else 200 end as status,
         (k + 1)*0.005e0 as latency_seconds,
         case when k % 3 = 0 then ' 10.0.0.' || cast(k as varchar) || ' , 10.1.1.1' end as forwarded,
         case when k % 3 = 1 then '10.9.0.' || cast(k as varchar) end as peer from ev)
"""

SCORED = """
scored as (
  select 'm' || cast(l_suppkey % 3 as varchar) as model_name, l_linenumber as model_version,
         l_extendedprice/500e0 as label,
         l_extendedprice/500e0 + ((l_partkey % 21) - 10) *
           case l_linenumber when 1 then 3.0e0 when 2 then 2.95e0 when 3 then 2.0e0 when 4 then 2.1e0
                             when 5 then 1.2e0 when 6 then 0.8e0 else 0.5e0 end as prediction,
         (l_partkey % 50 + 1) * case when l_linenumber = 6 then 0.2e0 else 0.1e0 end as latency_ms
  from lineitem),
versions as (
  select model_name, model_version, sqrt(avg((label-prediction)*(label-prediction))) as rmse,
         avg(abs(label-prediction)) as mae,
         1 - sum((label-prediction)*(label-prediction))/greatest(var_pop(label)*count(*), 1e-10) as r2,
         avg(case when label > 0 then abs((label-prediction)/label) end)*100 as mape,
         avg(latency_ms) as avg_latency_ms, model_version <> 5 as validation_passed,
         timestamp '2024-01-01' + to_days(model_version) as decided_at
  from scored group by 1, 2)
"""

NUMERIC = [
    "trip_distance",
    "trip_duration_minutes",
    "passenger_count",
    "pickup_hour",
    "pickup_day_of_week",
    "is_weekend",
    "is_rush_hour",
]
CATEGORICAL = ["pickup_borough", "dropoff_borough", "RatecodeID", "payment_type"]


def _union(parts: list[str]) -> str:
    return "\n union all ".join(parts)


def _drift_ctes(
    source: str,
    numeric: list[str] = NUMERIC,
    categorical: list[str] = CATEGORICAL,
    by: str = "",
    bins: int = 20,
) -> str:
    """CTEs ``drift`` (one row per feature) and its parts; ``by`` is a key column of the source."""
    key = f"{by}, " if by else ""
    same = f"and a.{by} = b.{by}" if by else ""
    tall = [
        f"select {key}side, {i} as position, '{c}' as feature, true as is_numeric, "
        f"cast({c} as double) as v, cast(null as varchar) as category from {source}"
        for i, c in enumerate(numeric)
    ] + [
        f"select {key}side, {len(numeric) + i} as position, '{c}' as feature, false as is_numeric, "
        f"cast(null as double) as v, cast(\"{c}\" as varchar) as category from {source}"
        for i, c in enumerate(categorical)
    ]
    return f"""
tall as ({_union(tall)}),
clean as (select * replace (case when isfinite(v) then v end as v), v is not null and not isfinite(v) as odd from tall),
pairs as (
  select {key}position, feature, is_numeric, min(v) as lo, max(v) as hi,
         count(*) filter (side = 'reference') as rows_r, count(*) filter (side = 'current') as rows_c,
         count(coalesce(category, cast(v as varchar))) filter (side = 'reference') as n_r,
         count(coalesce(category, cast(v as varchar))) filter (side = 'current') as n_c,
         avg(v) filter (side = 'reference') as mean_r, avg(v) filter (side = 'current') as mean_c,
         stddev_pop(v) filter (side = 'reference') as std_r,
         stddev_pop(v) filter (side = 'current') as std_c,
         count(*) filter (side = 'reference' and odd) as odd_r,
         count(*) filter (side = 'current' and odd) as odd_c
  from clean group by {key}position, feature, is_numeric),
guessed as (
  select a.*, b.lo, (b.hi - b.lo)/{bins}e0 as step,
         case when a.v is not null and b.hi > b.lo
              then least(floor((a.v - b.lo)/nullif((b.hi - b.lo)/{bins}e0, 0)), {bins - 1}) end as g
  from clean a join pairs b on a.feature = b.feature {same}),
cells as (
  select {key}feature, side, category,
         cast(case when v < lo + g*step then g - 1
                   when g < {bins - 1} and v >= lo + (g + 1)*step then g + 1 else g end as int) as bin
  from guessed),
hist as (
  select {key}feature, bin, category, count(*) filter (side = 'reference') as c_r,
         count(*) filter (side = 'current') as c_c
  from cells where bin is not null or category is not null group by {key}feature, bin, category),
shares as (
  select a.*, greatest(coalesce(a.c_r/nullif(cast(b.n_r as double), 0), 0), 1e-6) as p,
         greatest(coalesce(a.c_c/nullif(cast(b.n_c as double), 0), 0), 1e-6) as q
  from hist a join pairs b on a.feature = b.feature {same}),
sums as (
  select {key}feature, sum((q - p)*ln(q/p)) as psi, sum(p*ln(p/q)) as kl,
         0.5*sum(p*ln(2*p/(p + q)) + q*ln(2*q/(p + q))) as js
  from shares group by {key}feature),
drift as (
  select {', '.join('a.' + c for c in ([by] if by else []) + ['position', 'feature', 'is_numeric'])},
         case when both_sides then coalesce(b.psi, 0) else 0 end as psi,
         case when is_numeric then case when both_sides then coalesce(b.kl, 0) else 0 end end as kl,
         case when is_numeric then case when both_sides then coalesce(b.js, 0) else 0 end end as js,
         mean_r, mean_c, std_r, std_c, rows_r, rows_c, n_r, n_c, odd_r, odd_c
  from (select *, case when is_numeric then n_r > 0 and n_c > 0 else rows_r > 0 and rows_c > 0 end
               as both_sides from pairs) a
  left join sums b on a.feature = b.feature {same})
"""


_DRIFT_COLUMNS = """feature, round(psi, 6) as psi, round(kl, 6) as kl_divergence, round(js, 6) as js_divergence,
  case when psi < 0.1 then 'none' when psi < 0.2 then 'low' when psi < 0.25 then 'medium' else 'high' end
    as severity,
  round(mean_r, 6) as reference_mean, round(mean_c, 6) as current_mean,
  round(std_r, 6) as reference_std, round(std_c, 6) as current_std,
  rows_r as reference_rows, rows_c as current_rows, odd_r as reference_odd, odd_c as current_odd"""


def _with(*ctes: str) -> str:
    return "with " + ",".join(c.strip().rstrip(",") for c in ctes) + "\n"



def _window_ctes(reference: str, current: str, numeric, categorical, by: list[str], ref_by: list[str]) -> str:
    """``drift`` of every current group, its reference rows repeated per group."""
    keys = ", ".join(f"g.{k}" for k in by)
    on = " and ".join(f"g.{k} = r.{k}" for k in ref_by) or "true"
    columns = ", ".join(f'r."{c}"' for c in [*numeric, *categorical])
    group = "hash_key"
    text = " || '|' || ".join(f"cast({k} as varchar)" for k in by)
    return f"""
groups as (select distinct {', '.join(by)} from {current}),
grouped as (
  select {keys}, {text.replace('cast(', 'cast(g.')} as {group}, 'reference' as side, {columns}
  from groups g join {reference} r on {on}
  union all
  select {', '.join('r.' + k for k in by)}, {text.replace('cast(', 'cast(r.')} as {group}, 'current' as side, {columns}
  from {current} r),
{_drift_ctes('grouped', numeric, categorical, by=group)}"""


PREDICTION_SOURCE = """
predicted as (
  select side, case when side = 'reference' then fare_amount else
    round(greatest(2.5e0, 3e0 + trip_distance*2.5e0 + trip_duration_minutes*0.5e0
      + case when is_rush_hour <> 0 then 2.5e0 else 0 end), 2) end as prediction
  from sided)
"""

MODEL_DAYS = """
dated as (
  select *, cast(ts as date) as day, greatest(datediff('day', date '2024-01-08', cast(ts as date)), 0) as late
  from preds),
model_days as (
  select model_name, day, predicted_fare*(1 + late/40e0) as predicted_fare, latency_ms + late*0.5e0 as latency_ms,
         k, predicted_fare*(1 + late/60e0) as prediction, model_version,
         cast((k + late*3) % 100 - (k + late*3) % 25 as int) as k_class
  from dated),
first_week as (select * from model_days where day < date '2024-01-08'),
later as (select * from model_days where day >= date '2024-01-08')
"""

WINDOW_NUMERIC = ["predicted_fare", "latency_ms", "k", "prediction"]
WINDOW_CATEGORICAL = ["model_version", "k_class"]

VERDICT = """
verdict as (
  select substr(sha256(hash_key), 1, 16) as run_id, split_part(hash_key, '|', 1) as model_name,
         cast(split_part(hash_key, '|', 2) as date) as day,
         max(rows_r) as reference_sample_count, max(rows_c) as current_sample_count,
         max(psi) filter (feature <> 'prediction') as max_psi,
         avg(psi) filter (feature <> 'prediction') as avg_psi,
         max(psi) filter (feature = 'prediction') as prediction_psi,
         coalesce(string_agg(feature, ',' order by position) filter (psi >= 0.2), '') as features_with_drift,
         cast(count(*) filter (psi >= 0.2) as int) as drift_count,
         count(*) filter (psi >= 0.2) >= 3 as drift_detected,
         max(psi) filter (feature = 'prediction') >= 0.15 as prediction_drift_detected
  from drift group by hash_key having max(rows_c) >= 100)
"""

VERDICTS = (
    EVENTS,
    MODEL_DAYS,
    _window_ctes(
        "first_week", "later", WINDOW_NUMERIC, WINDOW_CATEGORICAL, ["model_name", "day"], ["model_name"]
    ),
    VERDICT,
)

DECISIONS = """
candidates as (
  select *, row_number() over (partition by model_name order by model_version) as i from versions),
replay as (
  select model_name, i, model_version as challenger_version, rmse as challenger_rmse,
         avg_latency_ms as challenger_latency, validation_passed as own_validation, decided_at,
         cast(null as int) as champion_version, cast(null as double) as champion_rmse,
         cast(null as double) as champion_latency, true as promoted
  from candidates where i = 1
  union all
  select c.model_name, c.i, c.model_version, c.rmse, c.avg_latency_ms, c.validation_passed, c.decided_at,
         case when r.promoted then r.challenger_version else r.champion_version end,
         case when r.promoted then r.challenger_rmse else r.champion_rmse end,
         case when r.promoted then r.challenger_latency else r.champion_latency end,
         c.validation_passed
           and (case when r.promoted then r.challenger_rmse else r.champion_rmse end) - c.rmse >= 0.5
           and c.avg_latency_ms/greatest(case when r.promoted then r.challenger_latency
                                              else r.champion_latency end, 0.001) <= 1.2
  from replay r join candidates c on c.model_name = r.model_name and c.i = r.i + 1),
gated as (
  select *, champion_version is null as is_first,
         coalesce(champion_rmse - challenger_rmse, challenger_rmse) as gain,
         challenger_latency/greatest(champion_latency, 0.001) as latency_ratio from replay),
judged as (
  select *, own_validation as validation_passed, is_first or gain >= 0.5 as metric_improvement,
         is_first or latency_ratio <= 1.2 as latency_acceptable,
         substr(sha256('decision-' || model_name || '|' || cast(challenger_version as varchar)), 1, 16)
           as decision_id
  from gated),
reasoned as (
  select *, list_filter([
    case when not validation_passed and not is_first then 'Validation failed: None' end,
    case when not metric_improvement then format(
      'Insufficient rmse reduction: {:.4f} < 0.5000 required (champion={:.4f}, challenger={:.4f})',
      gain, champion_rmse, challenger_rmse) end,
    case when not latency_acceptable then format(
      'Latency regression: {:.2f}x > 1.20x max allowed', latency_ratio) end], lambda x: x is not null) as reasons
  from judged),
decisions as (
  select *, case when is_first then 'First model - auto-promoted as initial champion'
    when promoted then format('Challenger v{} outperforms champion v{}. rmse: {:.4f} vs {:.4f} (reduction: {:.4f}). Validation passed. Latency OK ({:.2f}x).',
      challenger_version, champion_version, challenger_rmse, champion_rmse, gain, latency_ratio)
    else format('Challenger v{} rejected: {}', challenger_version, array_to_string(reasons, '; ')) end
    as promotion_reason
  from reasoned)
"""


def _decided(*ctes: str) -> str:
    return "with recursive " + ",".join(c.strip().rstrip(",") for c in ctes) + "\n"


ENDPOINTS = r"""
endpoints as (
  select *, regexp_replace(regexp_replace(path,
      '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', '{id}', 'gi'),
      '/[0-9]+(/|$)', '/{id}\1', 'g') as endpoint,
    case when status >= 400 then 'http_' || cast(status as varchar) end as error_type
  from requests
  where not (path like '/healthz%' or path like '/ready%' or path like '/metrics%'))
"""

LATENCY_BOUNDS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]

_KEYS = "l_orderkey, l_linenumber"
_ALL = [
    "trip_distance", "passenger_count", "pickup_hour", "pickup_day_of_week", "pickup_month",
    "trip_duration_minutes", "is_weekend", "is_rush_hour", '"RatecodeID"', "payment_type",
    "pickup_borough", "dropoff_borough", "fare_amount",
]
_RANGES = [
    ("trip_distance", 0.1, 100), ("passenger_count", 1, 6), ("pickup_hour", 0, 23),
    ("pickup_day_of_week", 1, 7), ("pickup_month", 1, 12), ("trip_duration_minutes", 1, 180),
    ("is_weekend", 0, 1), ("is_rush_hour", 0, 1), ("RatecodeID", 1, 6), ("payment_type", 1, 4),
    ("fare_amount", 2.5, 200),
]
_REGIONS = "('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST')"
_HASH = "cast('0x' || substr(md5(cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar)), 1, 8) as bigint)"

CLEANED = "cleaned as (select * replace (case when isnan(trip_distance) then null else trip_distance end as trip_distance) from dirty)"


LATE = """
deliveries as (
  select * from (values (0, timestamp '0001-01-01', timestamp '2024-01-08'), (1, timestamp '2024-01-07', timestamp '2024-01-15'),
    (2, timestamp '2024-01-14', timestamp '2024-01-22'), (3, timestamp '2024-01-21', timestamp '9999-01-01'),
    (4, timestamp '2024-01-08', timestamp '2024-01-15')) as t(batch, since, until)),
delivered as (select * from deliveries left join requests on ts >= since and ts < until),
marks as (
  select batch, max(max(ts)) over (order by batch) as newest,
         max(max(ts)) over (order by batch rows between unbounded preceding and 1 preceding) - interval 12 hour as closed
  from delivered group by batch),
judged as (
  select delivered.*, date_trunc('hour', ts) as start, newest,
         coalesce(date_trunc('hour', ts) + interval 1 hour <= closed, false) as late
  from delivered join marks using (batch))
"""


def _validate_table(source: str = "cleaned", dropped: tuple[str, ...] = ()) -> str:
    """One row per rule over ``source``; of the ``dropped`` columns only their absence is reported."""
    parts = []

    def row(column, rule, severity, bad, found="null"):
        name = "null" if column is None else f"'{column}'"
        parts.append(
            f"""select {name} as "column", '{rule}' as rule, '{severity}' as severity, ({bad}) > 0 as failed,
            cast({bad} as bigint) as bad_rows, round(cast({found} as double), 6) as found,
            count(*) as table_rows, 13 as table_columns from {source}"""
        )

    for quoted in _ALL:
        column = quoted.strip('"')
        row(column, "missing_column", "error", str(int(column in dropped)))
        if column in dropped:
            continue
        row(column, "null_values", "error", f"count(*) filter ({quoted} is null)")
    for column, low, high in _RANGES:
        if column in dropped:
            continue
        below = f'count(*) filter ("{column}" < {low})'
        above = f'count(*) filter ("{column}" > {high})'
        row(column, "value_below_minimum", "error", below, f'case when {below} > 0 then min("{column}") end')
        row(column, "value_above_maximum", "error", above, f'case when {above} > 0 then max("{column}") end')
    for column in ("pickup_borough", "dropoff_borough"):
        row(column, "invalid_category", "error", f"count(*) filter ({column} not in {_REGIONS})")
    row(None, "low_row_count", "warning", "case when count(*) < 100 then count(*) else 0 end", "count(*)")
    return _union(parts)


def _row_problems() -> str:
    cases = []
    for quoted in _ALL[:-1]:
        cases.append(f"case when {quoted} is null then '{quoted.strip(chr(34))}:null_value' end")
    for column, low, high in _RANGES[:-1]:
        cases.append(f"case when \"{column}\" < {low} then '{column}:value_below_minimum' end")
        cases.append(f"case when \"{column}\" > {high} then '{column}:value_above_maximum' end")
    for column in ("pickup_borough", "dropoff_borough"):
        cases.append(f"case when {column} not in {_REGIONS} then '{column}:invalid_category' end")
    return (
        f"problems as (select {_KEYS}, list_sort(list_filter([{', '.join(cases)}], lambda x: x is not null)) as codes "
        "from cleaned)"
    )


def _stats_columns(source: str) -> str:
    return f"""select id, part, round(trip_distance, 6) as trip_distance,
      round(trip_duration_minutes, 6) as trip_duration_minutes, passenger_count, pickup_hour, is_weekend,
      is_rush_hour, pickup_borough, dropoff_borough, "RatecodeID", payment_type,
      pickup_day_of_week from {source}"""


def _sums(columns: list[tuple[str, str, int]]) -> str:
    return _union(
        [
            f"select '{c.strip(chr(34))}' as \"column\", round(cast(sum({e}) as double), 2) as total, '{role}' as role, {i} as position from featured"
            for i, (c, e, role) in enumerate(columns)
        ]
    )


_FEATURE_ROLES = (
    [(c, c, "numeric") for c in _ALL[:6]]
    + [(c, c, "binary") for c in _ALL[6:8]]
    + [(c, f"length(cast({c} as varchar))", "categorical") for c in _ALL[8:12]]
    + [("fare_amount", "fare_amount", "target")]
)


SQL: dict[str, str] = {
    "feature_drift": _with(TRIPS, _drift_ctes("shifted")) + f"select {_DRIFT_COLUMNS} from drift",
    "scan_union_normalise": """
      select l_linenumber, case when l_orderkey % 2 = 0 then l_returnflag end as l_returnflag, count(*) as n,
             round(sum(case when l_orderkey % 2 = 1 then trunc(l_quantity) else l_quantity end), 2) as quantity
      from lineitem group by 1, 2""",
    "csv_snapshot_roundtrip": _with(TRIPS) + f"""
      select {_KEYS}, trip_distance, passenger_count, pickup_borough, fare_amount from trips
      order by md5(cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar)),
        1 nulls first, 2 nulls first, 3 nulls first, 4 nulls first, 5 nulls first, 6 nulls first limit 1000""",
    "append_unique": _with(EVENTS) + """
      select cast(ts as date) as date, model_name, count(*) as n, count(distinct request_id) as requests,
             round(sum(predicted_fare), 2) as fares from preds group by 1, 2""",
    "table_upgrade": """
      select event_id, case when user_id % 3 <> 0 then value else 0 end as predicted_fare from events""",
    "reference_register": _with(TRIPS) + """
      select 'second' as name, 'fare' as model_name, count(*) as sample_count, 12 as feature_count,
             'references/second' as storage_path, round(avg(trip_distance), 4) as distance_mean,
             round(max(trip_distance), 4) as distance_max, round(avg(fare_amount), 4) as fare_mean,
             round(min(fare_amount), 4) as fare_min from featured""",
    "log_window_scan": _with(EVENTS) + """
      select ts, model_name, model_version, predicted_fare, numeric_feature_stats,
             timestamp '2024-01-14 12:00:00' as window_start, timestamp '2024-01-15 12:00:00' as window_end,
             count(*) over () as sample_count
      from preds where ts between timestamp '2024-01-14 12:00:00' and timestamp '2024-01-15 12:00:00'
        and model_name = 'm1'""",
    "time_features": _with(TRIPS) + f"""
      select {_KEYS}, round(trip_duration_minutes, 6) as trip_duration_minutes, pickup_hour,
             pickup_day_of_week, pickup_month, is_weekend, is_rush_hour from featured""",
    "zone_lookup": _with(TRIPS) + """
      select c_custkey, c_nationkey, r_name as zone, coalesce(r_name, 'Unknown') as zone_or_unknown
      from customer left join zones on n_nationkey = c_nationkey""",  # a key's least name, which is never ZONE
    "prepare_features": _with(TRIPS, PREPARED) + f"""
      select {_KEYS}, {', '.join(f'round({c}, 6) as {c}' if c in ('trip_distance', 'trip_duration_minutes', 'fare_amount') else c for c in _ALL)}
      from prepared""",
    "feature_target_split": _with(TRIPS) + _sums(_FEATURE_ROLES),
    "feature_bins": _with(TRIPS) + """
      select case when trip_distance <= 1 then '0-1' when trip_distance <= 3 then '1-3'
                  when trip_distance <= 5 then '3-5' when trip_distance <= 10 then '5-10' else '10+' end as distance_bin,
             case when trip_duration_minutes <= 5 then '0-5' when trip_duration_minutes <= 15 then '5-15'
                  when trip_duration_minutes <= 30 then '15-30' when trip_duration_minutes <= 60 then '30-60'
                  else '60+' end as duration_bin,
             case when pickup_hour < 6 then 'night' when pickup_hour < 10 then 'morning'
                  when pickup_hour < 16 then 'midday' when pickup_hour < 20 then 'evening' else 'night' end as hour_bin,
             count(*) as n
      from featured group by 1, 2, 3""",
    "pack_unpack_stats": _with(TRIPS, EVENTS, """
      packed as (
        select l_orderkey as id, l_linenumber as part,
               case when isnan(trip_distance) then -1 else trip_distance end as trip_distance,
               trip_duration_minutes, coalesce(passenger_count, 1) as passenger_count, pickup_hour,
               is_weekend, is_rush_hour, coalesce(pickup_borough, 'Unknown') as pickup_borough,
               coalesce(dropoff_borough, 'Unknown') as dropoff_borough, "RatecodeID", payment_type, pickup_day_of_week from dirty
        union all
        select request_id, 0, 3e0, 15e0, 1, 12, 0, 0, 'Manhattan', 'Manhattan', 1, 1, 3 from preds)""")
    + _stats_columns("packed"),
    "feature_hash": _with(TRIPS) + f"""
      select {_KEYS}, substr(sha256(
        'RatecodeID=' || coalesce(cast("RatecodeID" as varchar), 'null')
        || '|dropoff_borough=' || coalesce(dropoff_borough, 'null')
        || '|passenger_count=' || coalesce(cast(passenger_count as varchar), 'null')
        || '|payment_type=' || coalesce(cast(payment_type as varchar), 'null')
        || '|pickup_borough=' || coalesce(pickup_borough, 'null')
        || '|pickup_hour=' || coalesce(cast(pickup_hour as varchar), 'null')), 1, 16) as feature_hash,
        substr(sha256('decision-' || cast(l_orderkey as varchar) || '|' || cast(l_linenumber as varchar)), 1, 16) as run_id
      from featured""",
    "baseline_score": _with(TRIPS) + f"""
      select {_KEYS}, fare as predicted_fare, cast(round_even(fare, 0) as int) as prediction_label
      from (select *, round(greatest(2.5e0, 3e0 + trip_distance*2.5e0 + trip_duration_minutes*0.5e0
              + case when is_rush_hour <> 0 then 2.5e0 else 0 end), 2) as fare from featured)""",
    "request_normalise": _with(EVENTS, ENDPOINTS) + """
      select event_id, endpoint,
             case when forwarded <> '' then trim(split_part(forwarded, ',', 1)) else coalesce(peer, 'unknown') end as client_ip,
             error_type,
             case when status >= 500 then 'error' when status >= 400 then 'warning' else 'debug' end as log_level
      from endpoints""",
    "hash_split": _with(TRIPS, f"hashed as (select *, {_HASH} as h, count(*) over () as total from trips)") + f"""
      select case when h % 100 < 80 then 'train' else 'test' end as part, count(*) as n,
             round(sum(fare_amount), 2) as fares from hashed group by 1
      union all
      select 'capped', count(*), round(sum(fare_amount), 2) from hashed
      where total <= 5000 or h < floor((5000/cast(total as double))*4294967296)
      union all
      select 'fixed', count(*), round(sum(fare_amount), 2) from (select * from hashed order by
        md5(cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar)), {_KEYS}, fare_amount nulls first limit 100)""",
    "sample_gate": _with(EVENTS) + """
      select model_name, cast(ts as date) as day, count(*) as samples, 10 as common, 1 as skipped
      from preds group by 1, 2 having count(*) >= 100""",
    "validate_table": _with(TRIPS, CLEANED) + _validate_table(),
    "validate_rows": _with(TRIPS, CLEANED, _row_problems()) + f"""
      select {_KEYS}, cast(len(codes) as int) as error_count, array_to_string(codes, ',') as codes from problems""",
    "quarantine_counts": _with(TRIPS, CLEANED, _row_problems()) + f"""
      select split_part(code, ':', 2) as type, split_part(code, ':', 1) as feature, count(*) as failures
      from (select unnest(codes) as code from problems) group by 1, 2
      union all select 'accepted', '', count(*) from problems where len(codes) = 0
      union all select 'invalid:' || pickup_borough, 'pickup_borough', count(*) from cleaned
        where pickup_borough not in {_REGIONS} group by 1, 2
      union all select 'invalid:' || dropoff_borough, 'dropoff_borough', count(*) from cleaned
        where dropoff_borough not in {_REGIONS} group by 1, 2""",
    "validate_json": _with(EVENTS, """
      marked as (
        select *, event_id % 8 as marker, case when event_id % 8 in (2, 4) then null
                 when event_id % 8 = 3 then k + 0.5 else k end as number from ev),
      listed as (
        select event_id, list_sort(list_filter(case when marker = 7 then [':invalid_json'] else [
          case when marker = 2 or marker = 3 then 'k:type_error' end,
          case when marker = 4 then 'k:null_value' end,
          case when number > 79 then 'k:value_above_maximum' end,
          case when marker = 6 then 'value:missing_features' end,
          case when marker <> 6 and round(value, 2) < 0.5 then 'value:value_below_minimum' end,
          case when marker <> 6 and round(value, 2) > 400 then 'value:value_above_maximum' end,
          case when marker = 5 then 'note:extra_features' end,
          case when event_type not in ('click', 'view', 'purchase', 'signup') then 'event_type:invalid_category' end]
        end, lambda x: x is not null)) as codes from marked)""") + """
      select event_id, cast(len(codes) as int) as error_count, array_to_string(codes, ',') as codes from listed""",
    "profile_shape": _with(TRIPS, CLEANED) + _union(
        [
            f"select '{c.strip(chr(34))}' as \"column\", count(*) filter ({c} is null) as nulls, count(*) as rows, 13 as columns from cleaned"
            for c in _ALL
        ]
    ),
    "profile_numeric": _with(TRIPS, CLEANED) + _union(
        [
            f"select '{c}' as feature, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, "
            f"round(cast(min({c}) as double), 6) as min, round(cast(max({c}) as double), 6) as max, "
            f"round(quantile_cont(cast({c} as double), 0.5), 6) as median from cleaned"
            for c in [*_ALL[:6], "fare_amount"]
        ]
    ),
    "profile_categorical": _with(TRIPS, CLEANED, "valued as (" + _union(
        [
            f"select '{c.strip(chr(34))}' as feature, cast({c} as varchar) as value, count(*) as rows from cleaned where {c} is not null group by 2"
            for c in [*_ALL[8:12], *_ALL[6:8]]
        ]
    ) + ")") + "select feature, value, rows, count(*) over (partition by feature) as distinct_values from valued",
    "histogram_pair": _with(TRIPS, _drift_ctes("shifted", categorical=[])) + """
      select a.feature, bin, c_r as reference_n, c_c as current_n, round(c_r/cast(n_r as double), 8) as reference_share,
             round(c_c/cast(n_c as double), 8) as current_share
      from hist a join pairs b on a.feature = b.feature""",
    "psi_numeric": _with(TRIPS, _drift_ctes("shifted", categorical=[])) + """
      select feature, round(psi, 6) as psi, case when psi < 0.1 then 'none' when psi < 0.2 then 'low'
             when psi < 0.25 then 'medium' else 'high' end as severity from drift""",
    "psi_categorical": _with(TRIPS, _drift_ctes("shifted", numeric=[])) + """
      select feature, round(psi, 6) as psi, case when psi < 0.1 then 'none' when psi < 0.2 then 'low'
             when psi < 0.25 then 'medium' else 'high' end as severity from drift""",
    "kl_js": _with(TRIPS, _drift_ctes("shifted", categorical=[])) + """
      select feature, round(kl, 6) as kl_divergence, round(js, 6) as js_divergence from drift""",
    "moments_pair": _with(TRIPS, _drift_ctes("sided", categorical=[])) + """
      select feature, n_r as reference_count, n_c as current_count, round(mean_r, 6) as reference_mean,
             round(mean_c, 6) as current_mean, round(std_r, 6) as reference_std, round(std_c, 6) as current_std
      from pairs""",
    "prediction_drift": _with(TRIPS, PREDICTION_SOURCE, _drift_ctes("predicted", ["prediction"], [])) + """
      select feature, round(psi, 6) as psi, case when psi < 0.1 then 'none' when psi < 0.2 then 'low'
             when psi < 0.25 then 'medium' else 'high' end as severity, round(mean_r, 6) as reference_mean,
             round(mean_c, 6) as current_mean, round(std_r, 6) as reference_std, round(std_c, 6) as current_std
      from drift""",
    "window_drift": _with(
        TRIPS,
        "ref as (select * from shifted where side = 'reference'), cur as (select * from shifted where side = 'current')",
        _window_ctes("ref", "cur", NUMERIC, ["pickup_borough", "RatecodeID"], ["payment_type"], []),
    ) + f"select cast(hash_key as int) as payment_type, {_DRIFT_COLUMNS} from drift",
    "drift_verdict": _with(*VERDICTS) + """
      select run_id, model_name, day, reference_sample_count, current_sample_count, round(max_psi, 6) as max_psi,
             round(avg_psi, 6) as avg_psi, round(prediction_psi, 6) as prediction_psi, features_with_drift,
             drift_count, drift_detected, prediction_drift_detected from verdict""",
    "drift_alerts": _with(*VERDICTS) + """
      select substr(sha256('alert-' || run_id), 1, 16) as alert_id, run_id, cast(day as timestamp) as created_at,
             case when max_psi >= 0.25 then 'high' when max_psi >= 0.2 then 'medium' else 'low' end as severity,
             format('Drift detected in {} features: {}. Max PSI: {:.3f}, Avg PSI: {:.3f}', drift_count,
                    replace(features_with_drift, ',', ', '), max_psi, avg_psi) as message,
             features_with_drift as features_affected, false as acknowledged,
             cast(dayofyear(day) as int) as drift_metric_id
      from verdict where drift_detected""",
    "drift_summary": _with(*VERDICTS, """
      recent as (select * from verdict where day >= date '2024-01-15' and day <= date '2024-01-25'),
      newest as (select model_name, max_by(drift_detected and drift_count >= 3, day) as should_retrain
                 from verdict group by 1)""") + """
      select m.model_name, count(r.run_id) as runs, count(*) filter (r.drift_detected) as drift_detected_count,
             round(avg(r.max_psi), 6) as avg_max_psi, round(avg(r.avg_psi), 6) as avg_avg_psi,
             max_by(r.run_id, r.day) as latest_run_id, max_by(r.drift_count, r.day) as latest_drift_count,
             max_by(r.features_with_drift, r.day) as latest_features, max_by(r.current_sample_count, r.day) as latest_samples,
             coalesce(any_value(n.should_retrain), false) as should_retrain
      from (select distinct model_name from preds) m left join recent r on r.model_name = m.model_name
      left join newest n on n.model_name = m.model_name group by 1""",
    "regression_metrics": _with(TRIPS, """
      scored_trips as (select payment_type, fare_amount as y, round(greatest(2.5e0, 3e0 + trip_distance*2.5e0
        + trip_duration_minutes*0.5e0 + case when is_rush_hour <> 0 then 2.5e0 else 0 end), 2) as p from featured)""") + """
      select payment_type, count(*) as samples, round(sqrt(avg((y-p)*(y-p))), 6) as rmse, round(avg(abs(y-p)), 6) as mae,
             round(1 - sum((y-p)*(y-p))/greatest(var_pop(y)*count(*), 1e-10), 6) as r2,
             round(avg(case when y > 0 then abs((y-p)/y) end)*100, 6) as mape
      from scored_trips group by 1""",
    "latency_by_version": _with(EVENTS) + """
      select model_name, model_version, count(*) as samples, round(avg(latency_ms), 6) as avg_latency_ms,
             round(quantile_cont(latency_ms, 0.95), 6) as p95_latency_ms from preds group by 1, 2""",
    "traffic_summary": _with(EVENTS) + """
      select model_name, count(*) as total, count(*) filter (status = 200) as successes,
             count(*) filter (status <> 200) as failures,
             round(avg(predicted_fare) filter (status = 200), 6) as avg_fare,
             round(min(predicted_fare) filter (status = 200), 6) as min_fare,
             round(max(predicted_fare) filter (status = 200), 6) as max_fare,
             round(avg(latency_ms) filter (status = 200), 6) as avg_latency_ms
      from requests left join preds on request_id = event_id and event_id % 9 <> 0 group by 1""",
    "promotion_gate": _decided(SCORED, DECISIONS) + """
      select model_name, challenger_version, champion_version, validation_passed, metric_improvement,
             latency_acceptable, promoted, round(gain, 6) as primary_metric_improvement,
             round(latency_ratio, 6) as latency_ratio, cast(len(reasons) as int) as reasons, promotion_reason
      from (select * replace (case when is_first then null else latency_ratio end as latency_ratio) from decisions)""",
    "champion_challenger": _with(TRIPS, """
      pairs as (select payment_type, fare_amount as y, round(greatest(2.5e0, 3e0 + trip_distance*2.5e0
        + trip_duration_minutes*0.5e0 + case when is_rush_hour <> 0 then 2.5e0 else 0 end), 2) as a,
        fare_amount + (l_partkey % 21 - 10)*2.0e0 as b from featured)""") + """
      select payment_type, """ + ", ".join(
        f"""round(sqrt(avg((y-{c})*(y-{c}))), 6) as {r}_rmse, round(avg(abs(y-{c})), 6) as {r}_mae,
        round(1 - sum((y-{c})*(y-{c}))/greatest(var_pop(y)*count(*), 1e-10), 6) as {r}_r2,
        round(avg(case when y > 0 then abs((y-{c})/y) end)*100, 6) as {r}_mape"""
        for c, r in (("a", "champion"), ("b", "challenger"))
    ) + " from pairs group by 1",
    "production_alias": _decided(SCORED, DECISIONS) + """
      select model_name, max_by(challenger_version, decided_at) filter (promoted) as production_version,
             max(challenger_version) as latest_version from decisions group by 1""",
    "recent_decisions": _decided(SCORED, DECISIONS) + """
      select decision_id, decided_at, case when challenger_version % 2 = 0 then 'drift' else 'scheduled' end as trigger_type,
             challenger_version, promoted, round(gain, 6) as primary_metric_improvement, promotion_reason,
             case when challenger_version = 2 then 'skipped' when challenger_version = 4 then 'failed'
                  else 'completed' end as status,
             case when challenger_version = 2 then 'skipped' when challenger_version = 4 then 'failed'
                  else 'success' end as outcome,
             case when challenger_version % 2 = 0 then round(challenger_version*0.1e0, 6) end as drift_max_psi,
             case when challenger_version % 2 = 0 then challenger_version end as drift_count
      from decisions order by decided_at desc, decision_id limit 10""",
    "counter_rollup": _with(EVENTS, ENDPOINTS) + """
      select 'requests' as metric, method, endpoint, cast(status as varchar) as label, count(*) as total
      from endpoints group by all
      union all select 'errors', '', endpoint, error_type, count(*) from endpoints where error_type is not null
      group by all""",
    "latency_histogram": _with(EVENTS, ENDPOINTS) + _union(
        [
            f"""select method, endpoint, cast({b} as double) as bound, count(*) filter (latency_seconds <= {b}e0) as at_most,
            count(*) as count, round(sum(latency_seconds), 6) as sum, round(avg(latency_seconds), 6) as avg
            from endpoints group by 1, 2"""
            for b in LATENCY_BOUNDS
        ]
    ),
    "gauge_last": _with(EVENTS, """
      marked as (
        select *, max(case when k = 0 then ts end) over (partition by model_name, model_version) as set_ts from preds)""") + """
      select model_name, cast(model_version as varchar) as model_version, max_by(latency_ms, ts) as value,
             round(coalesce(max_by(latency_ms, ts) filter (k = 0), 0) + coalesce(sum(
               case when k = 0 then null when k % 2 = 0 then latency_ms else -latency_ms end)
               filter (set_ts is null or ts > set_ts), 0), 6) as replayed
      from marked group by 1, 2""",
    "stream_score_log": _with(EVENTS, """
      asked as (
        select event_id as request_id, k*1.1e0 + 0.5 as d, value/2.5e0 as m, cast(user_id % 7 + 1 as int) as p from ev),
      checked as (
        select *, list_filter([case when p > 6 then 'passenger_count' end,
                 case when d > 100 then 'trip_distance' end,
                 case when m < 1 or m > 180 then 'trip_duration_minutes' end], lambda x: x is not null) as bad
        from asked)""") + """
      select request_id, round(greatest(2.5e0, 3e0 + d*2.5e0 + m*0.5e0), 2) as predicted_fare,
             case when len(bad) = 0 then 'accepted' else array_to_string(bad, ',') end as outcome from checked""",
    "stream_window_24h": """
      with bounds as (select max(ts) - interval 1 hour as watermark, min(ts) as first_ts from events),
      starts as (select unnest(generate_series(date_trunc('hour', first_ts) - interval 23 hour,
                   date_trunc('hour', watermark), interval 1 hour)) as window_start from bounds)
      select window_start, window_start + interval 24 hour as window_end, event_type, count(*) as n,
             round(avg(value), 9) as mean, round(stddev_pop(value), 9) as std, round(min(value), 9) as lo,
             round(max(value), 9) as hi
      from starts join events on ts >= window_start and ts < window_start + interval 24 hour
      where window_start + interval 24 hour <= (select watermark from bounds)
      group by 1, 2, 3""",
    "stream_rollup": _with(EVENTS, """
      hourly as (select *, date_trunc('hour', ts) as start from requests
        where date_trunc('hour', ts) + interval 1 hour <= (select max(ts) - interval 1 hour from events))""") + _union(
        [
            f"""select start, method, cast(status as varchar) as status, cast({b} as double) as bound,
            count(*) filter (latency_seconds <= {b}e0) as at_most,
            count(*) as count, round(sum(latency_seconds), 6) as sum, round(avg(latency_seconds), 6) as avg
            from hourly group by 1, 2, 3"""
            for b in LATENCY_BOUNDS
        ]
    ),
    "stream_open_windows": _with(EVENTS, LATE) + """
      select start as window_start, start + interval 1 hour as window_end, method, cast(status as varchar) as status,
             count(*) as count, round(sum(latency_seconds), 6) as sum, count(*) filter (latency_seconds > 0.25e0) as slow,
             start + interval 1 hour <= (select max(newest) from marks) - interval 12 hour as closed
      from judged where not late and ts is not null group by 1, 3, 4""",
    "stream_late_rows": _with(EVENTS, LATE) + """
      select batch, count(ts) as rows, count(ts) filter (late) as late_rows, 0::bigint as untimed_rows, max(newest) as newest
      from judged group by batch""",
    "encode_assemble": _with(TRIPS, PREPARED) + """
      select payment_type, count(*) as rows,
             cast(max(8 + (select count(distinct "RatecodeID") + count(distinct payment_type)
               + count(distinct pickup_borough) + count(distinct dropoff_borough) + 4 from prepared)) as int) as length,
             round(avg(4 + cast(trip_distance <> 0 as int) + cast(passenger_count <> 0 as int)
               + cast(pickup_hour <> 0 as int) + cast(pickup_day_of_week <> 0 as int)
               + cast(pickup_month <> 0 as int) + cast(trip_duration_minutes <> 0 as int)
               + is_weekend + is_rush_hour), 6) as filled
      from prepared group by 1""",
    "dataset_stats": _with(TRIPS) + _union(
        [
            f"select '{c.strip(chr(34))}' as \"column\", unnest(['rows', 'nulls']) as statistic, "
            f"unnest([cast(count(*) as double), cast(count(*) filter ({c} is null) as double)]) as value from featured"
            for c in _ALL
        ]
        + [
            f"select '{c}', unnest(['mean', 'std', 'min', 'max', 'median']), unnest([round(avg({c}), 6), "
            f"round(stddev_samp({c}), 6), round(cast(min({c}) as double), 6), round(cast(max({c}) as double), 6), "
            f"round(quantile_cont(cast({c} as double), 0.5), 6)]) from featured"
            for c in [*_ALL[:6], "fare_amount"]
        ]
        + [
            f"select '{c.strip(chr(34))}', 'distinct_values', cast(count(distinct {c}) as double) from featured"
            for c in _ALL[6:12]
        ]
        + [
            f"select '{c.strip(chr(34))}', 'count of ' || cast({c} as varchar), cast(count(*) as double) from featured "
            f"where {c} is not null group by {c}"
            for c in _ALL[6:12]
        ]
    ),
    "champion_history": _decided(SCORED, DECISIONS) + """
      select model_name, decision_id, decided_at, challenger_version, promoted, champion_version as champion_held
      from decisions""",
    "prediction_latency": _with(EVENTS) + _union(
        [
            f"""select model_name, cast(model_version as varchar) as model_version, cast({b} as double) as bound,
            count(*) filter (latency_ms/1000e0 <= {b}e0) as at_most, count(*) as count,
            round(sum(latency_ms/1000e0), 6) as sum, round(avg(latency_ms/1000e0), 6) as avg
            from preds group by 1, 2"""
            for b in LATENCY_BOUNDS[:-2]
        ]
    ),
    "narrowed_quantiles": _with(EVENTS) + " union all ".join(
        f"""select model_name, '{c}' as feature, {q}e0 as probability,
             round(quantile_cont(cast({c} as double), {q}), 6) as value from preds group by 1"""
        for c in ("latency_ms", "predicted_fare") for q in (0.05, 0.5, 0.95)
    ),
    "metric_counters": _decided(*VERDICTS, SCORED, DECISIONS, TRIPS, CLEANED, _row_problems()) + """
      select 'predictions' as metric, model_name || '|' || cast(model_version as varchar) || '|'
               || cast(cast(round_even(predicted_fare, 0) as int) as varchar) as labels, count(*) as total
      from preds group by 2
      union all select 'drift_checks', model_name, count(*) from verdict group by 2
      union all select 'drift_events', 'feature|' || case when max_psi >= 0.25 then 'high'
               when max_psi >= 0.2 then 'medium' else 'low' end, count(*) from verdict where drift_detected group by 2
      union all select 'promotions', coalesce(cast(champion_version as varchar), '') || '|'
               || cast(challenger_version as varchar), count(*) from decisions where promoted group by 2
      union all select 'retraining_runs', case when challenger_version % 2 = 0 then 'drift' else 'scheduled' end || '|'
               || case when challenger_version = 2 then 'skipped' when challenger_version = 4 then 'failed' else 'success' end,
             count(*) from decisions group by 2
      union all select 'model_reloads', model_name || '|success', count(*) from decisions where promoted group by 2
      union all select 'current_model', model_name, cast(max(challenger_version) as bigint) from decisions where promoted group by 2
      union all select 'validation_failures', '/predict|' || split_part(code, ':', 2), count(*)
      from (select unnest(codes) as code from problems) group by 2""",
    "stream_drift": _with(
        EVENTS,
        """named as (select * rename (predicted_fare as prediction) from preds),
        ref as (select * from named where ts < timestamp '2024-01-08'),
        ends as (select unnest(generate_series(date_trunc('day', min(ts)) + interval 1 day, date_trunc('day', max(ts)),
                   interval 1 day)) as window_end from named),
        cur as (select named.*, window_end from named join ends on ts between window_end - interval 24 hour and window_end)""",
        _window_ctes("ref", "cur", ["latency_ms", "k", "prediction"], ["model_version"], ["model_name", "window_end"], []),
    ) + """
      select split_part(hash_key, '|', 1) as model_name, cast(split_part(hash_key, '|', 2) as timestamp) as ts,
             max(rows_r) as reference_sample_count,
             max(rows_c) as current_sample_count,
             round(max(psi) filter (feature <> 'prediction'), 6) as max_psi,
             round(avg(psi) filter (feature <> 'prediction'), 6) as avg_psi,
             round(max(psi) filter (feature = 'prediction'), 6) as prediction_psi,
             coalesce(string_agg(feature, ',' order by position) filter (psi >= 0.2), '') as features_with_drift,
             cast(count(*) as int) as features,
             cast(count(*) filter (psi >= 0.2) as int) as drift_count, count(*) filter (psi >= 0.2) >= 3 as drift_detected,
             max(psi) filter (feature = 'prediction') >= 0.15 as prediction_drift_detected
      from drift group by hash_key""",
    "monitor_log": _with(
        TRIPS,
        """ref as (select *, fare_amount as prediction from featured where pickup_ts < timestamp '1999-01-01'),
        cur as (
          select * replace (coalesce(pickup_borough, 'Unknown') as pickup_borough,
                            coalesce(dropoff_borough, 'Unknown') as dropoff_borough),
                 'm' || cast(l_suppkey % 2 as varchar) as model_name,
                 round(greatest(2.5e0, 3e0 + trip_distance*2.5e0 + trip_duration_minutes*0.5e0
                   + case when is_rush_hour <> 0 then 2.5e0 else 0 end), 2) as prediction
          from (select * from shifted where l_partkey % 211 <> 0)
          where pickup_ts between timestamp '1999-06-30' and timestamp '2000-06-30')""",
        _window_ctes("ref", "cur", [*NUMERIC, "prediction"], CATEGORICAL, ["model_name"], []),
    ) + """
      select hash_key as model_name, max(rows_r) as reference_sample_count, max(rows_c) as current_sample_count,
             round(max(psi) filter (feature <> 'prediction'), 6) as max_psi,
             round(avg(psi) filter (feature <> 'prediction'), 6) as avg_psi,
             round(max(psi) filter (feature = 'prediction'), 6) as prediction_psi,
             cast(count(*) filter (psi >= 0.2) as int) as drift_count, count(*) filter (psi >= 0.2) >= 3 as drift_detected,
             string_agg(feature || ':' || case when psi < 0.1 then 'none' when psi < 0.2 then 'low'
               when psi < 0.25 then 'medium' else 'high' end, ',' order by position) as details,
             case when count(*) filter (psi >= 0.2) >= 3 then
               case when max(psi) filter (feature <> 'prediction') >= 0.25 then 'high'
                    when max(psi) filter (feature <> 'prediction') >= 0.2 then 'medium' else 'low' end end as alert_severity,
             1 as runs
      from drift group by hash_key having max(rows_c) >= 100""",
    "train_score": _with(TRIPS, PREPARED, f"split as (select *, {_HASH} % 100 < 80 as fitting from prepared)") + """
      select 'rows of payment type ' || cast(payment_type as varchar) as fact, cast(count(*) as double) as value
      from split where not fitting group by 1
      union all select 'train rows', count(*) from split where fitting
      union all select 'test rows', count(*) from split where not fitting
      union all select 'fallback fares', round(sum(round(greatest(2.5e0, 3e0 + trip_distance*2.5e0
        + trip_duration_minutes*0.5e0 + case when is_rush_hour <> 0 then 2.5e0 else 0 end), 2)), 2)
        from split where not fitting
      union all select * from (values ('closer than the mean', 1), ('fares under the floor', 0), ('fares not in cents', 0),
        ('reloaded scores that differ', 0), ('good table passes', 1), ('broken table passes', 0),
        ('errors of the broken table', 1), ('rmse as the evaluator has it', 1))""",
    "retrain_run": """
      select * from (values
        ('calm', 'drift', 'skipped', 'skipped', 'r0', 1, 0.1e0, null::boolean, null::int, null::varchar, null::double,
         null::boolean, 1, null::boolean, false),
        ('fare', 'manual', 'failed', 'failed', null, null, null, null, 1, null, null, null, 1, true, false),
        ('fare', 'drift', 'completed', 'success', 'r1', 4, 0.4e0, true, 1,
         'First model - auto-promoted as initial champion', null, true, 1, null, true))
      as t(model_name, trigger_type, status, outcome, drift_run_id, drift_count, drift_max_psi, promoted, model_version,
           promotion_reason, latency_ratio, gain_is_rmse, like_it, names_the_column, measured)
      where (select count(*) from lineitem) > 0""",
    "retrain_champion": _with(EVENTS, """
      shadow as (select model_version, avg(l) as mean, quantile_cont(l, 0.95) as p95
        from (select model_version, latency_ms * case when model_version = 2 then 2e0 else 1e0 end as l from preds)
        group by 1),
      faced as (select * from (values (1, null::int, true, true, true, ''), (2, 1, true, false, false, 'Latency regression:'),
        (3, 1, true, true, true, ''), (4, 3, false, true, false, 'Insufficient rmse'))
        as t(challenger_version, champion_version, metric_improvement, latency_acceptable, promoted, reasons))""") + """
      select challenger_version, champion_version, 'scheduled' as trigger_type, true as validation_passed,
             metric_improvement, latency_acceptable, promoted, round(c.mean / h.mean, 6) as latency_ratio,
             round(h.mean, 6) as champion_avg_latency_ms, round(c.mean, 6) as challenger_avg_latency_ms,
             round(h.p95, 6) as champion_p95_latency_ms, round(c.p95, 6) as challenger_p95_latency_ms,
             reasons, true as gain_is_rmse
      from faced join shadow c on c.model_version = challenger_version
        left join shadow h on h.model_version = champion_version""",
    "table_checks": _with(TRIPS, SCORED, "report as (" + _validate_table("featured", ("pickup_month", "payment_type")) + ")") + """
      select 'rows written once' as fact, cast(count(*) as double) as value from featured
      union all select 'missing columns', count(*) from report where rule = 'missing_column' and failed
      union all select 'success', cast(count(*) = 0 as int) from report where failed and severity = 'error'
      union all select 'errors', count(*) from report where failed and severity = 'error'
      union all select 'warnings', count(*) from report where failed and severity = 'warning'
      union all select 'latest version', max(model_version) from versions where model_name = 'm1'
      union all select * from (values ('common features', 10), ('skipped features', 1), ('extra columns', 1), ('explicit version', 3))""",
}
