"""Queries of the methods over the driver's tables, and the same in DuckDB SQL.

Every query runs over its whole table. Floats are rounded on both sides, since
engines add in different orders.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import apply, batch_som, efcm, fcm, kmeans, merged_update, minimize, partial_update, rcm, rmcm, som, som_olp, steps, uniform
from .functions.columns import effective_units, scaling, standardized
from .operators.maps import covariance, map_quality, principal_start, unit_coordinates
from .operators.metrics import Counts, Neighborhood, Table, ami, ari, contingency, continuity, expected_information, nearest_rows, ranks, trustworthiness
from .operators.neighbors import counts_within
from .operators.search import Interval, Kernels
from .operators.seeding import seeds
from .plans.engine import Result
from .sources.points import prepared
from .sources.shared import shared_folder
from .sources.store import load, save
from .streaming.fitting import StreamedFit

Query = Callable[[SparkSession, str], DataFrame]

#: Start prototypes, off the data so that no distance ties.
EVENT_START = [[3.137, 0.211], [9.713, 2.371], [15.419, 5.137], [21.291, 11.173]]
LINE_START = [[7.131, 21.117, 2.313, 1.117], [19.317, 43.219, 7.171, 6.331], [31.213, 60.171, 4.319, 2.171], [43.117, 80.331, 8.137, 4.219]]
ACCOUNT_START = [[0.317, 3.171], [2.713, 9.317], [5.119, 14.713], [7.371, 21.219]]
GRID = (2, 2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour of the day and value of every event."""
    hour = F.hour("ts") + F.minute("ts") / 60.0 + F.second("ts") / 3600.0
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), hour.alias("x"), (F.col("value") / 20).alias("y"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four numbers of every order line."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("row_id"), F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"),
        (F.col("l_discount") * 100).alias("c"), (F.col("l_tax") * 100).alias("d"),
    )


def accounts(spark: SparkSession, sf_dir: str, name: str = "customer") -> DataFrame:
    """Balance and nation of every customer or supplier."""
    key = {"customer": "c", "supplier": "s"}[name]
    return table(spark, sf_dir, name).select(
        F.col(f"{key}_{'cust' if key == 'c' else 'supp'}key").alias("row_id"), (F.col(f"{key}_acctbal") / 1000).alias("x"), F.col(f"{key}_nationkey").cast("double").alias("y")
    )


def units(spark: SparkSession, result: Result) -> DataFrame:
    """(unit, c0, c1, ..., n_iter) of a run."""
    rows = [(i, *(round(float(v), 5) for v in c), result.n_iter) for i, c in enumerate(result.centers)]
    return spark.createDataFrame(rows, "unit int, " + ", ".join(f"c{d} double" for d in range(result.centers.shape[1])) + ", n_iter int")


def shares(result: Result, k: int) -> DataFrame:
    """(row_id, label, u0, u1, ...) of soft assignments."""
    return result.assignments.select("row_id", "label", *(F.round(F.col("membership")[c], 6).alias(f"u{c}") for c in range(k)))


# SQL of the same inputs.
EVENTS = "select event_id as id, hour(ts) + minute(ts) / 60.0 + floor(second(ts)) / 3600.0 as x0, value / 20 as x1 from events"
LINES = "select row_number() over () as id, l_quantity as x0, l_extendedprice / 1000 as x1, l_discount * 100 as x2, l_tax * 100 as x3 from lineitem"
CUSTOMERS = "select c_custkey as id, c_acctbal / 1000 as x0, cast(c_nationkey as double) as x1 from customer"
SUPPLIERS = "select s_suppkey as id, s_acctbal / 1000 as x0, cast(s_nationkey as double) as x1 from supplier"


def values(start) -> str:
    """(unit, c0, c1, ...) as SQL rows."""
    rows = ", ".join(f"({i}, {', '.join(f'cast({v!r} as double)' for v in c)})" for i, c in enumerate(start))
    return f"(values {rows}) as s(unit, {', '.join(f'c{d}' for d in range(len(start[0])))})"


def squared(width: int) -> str:
    return " + ".join(f"(x{d} - c{d}) * (x{d} - c{d})" for d in range(width))


#: Weight of a row for a unit, from d2 within the row's window; u is the membership, w its weight in the mean.
NEAREST = "case when row_number() over (partition by id order by d2, unit) = 1 then 1.0 else 0.0 end"
FUZZY = "(1 / greatest(d2, 1e-300)) / sum(1 / greatest(d2, 1e-300)) over (partition by id)"


def soft_share(tau: float) -> str:
    return f"exp((low - d2) / {tau}) / sum(exp((low - d2) / {tau})) over (partition by id)"


def rough_share(alpha: float, beta: float, p: float = 1.0) -> str:
    reach = f"{alpha} * sqrt(low) + {beta}" if p == 1 else f"power(power({alpha} * sqrt(low), {p}) + power({beta}, {p}), 1 / {p})"
    held = f"case when sqrt(d2) <= {reach} then 1.0 else 0.0 end"
    return f"{held} / sum({held}) over (partition by id)"


def trained_sql(points: str, start, share: str, steps: int, power: int = 1, x: tuple[str, str] | None = None, objective: str = "", tail: str = "") -> str:
    """Centers after a number of steps, or the objective at each step.

    ``x``: columns to add up instead of the features, and their mass. ``objective``: of
    a row, from its distances d2 and the least of them, low. ``tail``: what to select
    from the steps ``it`` and the points ``p`` instead.
    """
    width = len(start[0])
    c, xs = ", ".join(f"c{d}" for d in range(width)), ", ".join(f"x{d}" for d in range(width))
    add, mass = x or ("x{d}", "1.0")
    new = ", ".join(f"case when sum(w * {mass}) > 0 then sum(w * {add.format(d=d)}) / sum(w * {mass}) else c{d} end" for d in range(width))
    extra = ", y0, y1, z" if x else ""
    rounded = ", ".join(f"round(c{d}, 5) as c{d}" for d in range(width))
    last = f"""
select unit, {rounded}, {steps} as n_iter from it where t = {steps}"""
    if objective:
        last = f"""
select cast(t + 1 as int) as iteration, round(sum(v), 4) as objective
from (select t, id, {objective} as v
      from (select t, id, d2, min(d2) over (partition by t, id) as low
            from (select t, id, {squared(width)} as d2 from it, p where t < {steps})) group by t, id, low)
group by t"""
    last = tail or last
    return f"""
with recursive p as ({points}), it(t, unit, {c}) as (
  select 0, unit, {c} from {values(start)}
  union all
  select t + 1, unit, {new}
  from (select *, power(u, {power}) as w
        from (select *, {share} as u
              from (select *, min(d2) over (partition by id) as low
                    from (select it.*, id, {xs}{extra}, {squared(width)} as d2 from it, p where t < {steps}))))
  group by t, unit, {c}
){last}"""


def shares_sql(points: str, start, share: str) -> str:
    k, width = len(start), len(start[0])
    cells = ", ".join(f"round(max(case when unit = {c} then u end), 6) as u{c}" for c in range(k))
    return f"""
with p as ({points}), d as (select id, unit, {squared(width)} as d2 from p, {values(start)}),
u as (select id, unit, {share} as u from (select *, min(d2) over (partition by id) as low from d))
select id as row_id, cast(arg_min(unit, (-u, unit)) as int) as label, {cells} from u group by id"""


XY, FOUR = ["x", "y"], ["a", "b", "c", "d"]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query(f"""
with p as ({EVENTS}), d as (select id, unit, {squared(2)} as d2 from p, {values(EVENT_START)}),
l as (select id, arg_min(unit, (d2, unit)) as label, min(d2) as d2 from d group by id)
select cast(label as int) as label, count(*) as n, round(sum(d2), 4) as sse from l group by label""")
def apply_kmeans_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and squared error of each unit."""
    df = events(spark, sf_dir)
    found = apply.kmeans(df, EVENT_START, features=XY).assignments
    gaps = sum((F.col(n) - F.element_at(F.array(*(F.lit(c[d]) for c in EVENT_START)), F.col("label") + 1)) ** 2 for d, n in enumerate(XY))
    return found.join(df, "row_id").groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(gaps), 4).alias("sse"))


@query(f"""
with p as ({EVENTS}), d as (select id, unit, {squared(2)} as d2 from p, {values(EVENT_START)})
select id as row_id, cast(arg_min(unit, (d2, unit)) as int) as label from d group by id""")
def apply_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply.kmeans(events(spark, sf_dir), EVENT_START, features=XY).assignments


@query(shares_sql(EVENTS, EVENT_START, FUZZY))
def apply_fcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(apply.fcm(events(spark, sf_dir), EVENT_START, m=2.0, features=XY), 4)


@query(shares_sql(EVENTS, EVENT_START, soft_share(5.0)))
def apply_efcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(apply.efcm(events(spark, sf_dir), EVENT_START, tau=5.0, features=XY), 4)


@query(shares_sql(EVENTS, EVENT_START, rough_share(1.3, 0.5)))
def apply_rcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(apply.rcm(events(spark, sf_dir), EVENT_START, alpha=1.3, beta=0.5, p=1.0, features=XY), 4)


EDGES = "select a.id as i, b.id as j from p a, p b where sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1)) <= 1.05"


@query(f"""
with p as ({CUSTOMERS}), e as ({EDGES}), d as (select id, unit, {squared(2)} as d2 from p, {values(ACCOUNT_START)}),
l as (select id, arg_min(unit, (d2, unit)) as label from d group by id),
u as (select i, {", ".join(f"avg(case when label = {c} then 1.0 else 0.0 end) as u{c}" for c in range(4))} from e join l on l.id = e.j group by i)
select i as row_id, cast(list_position([u0, u1, u2, u3], greatest(u0, u1, u2, u3)) - 1 as int) as label,
  round(u0, 6) as u0, round(u1, 6) as u1, round(u2, 6) as u2, round(u3, 6) as u3 from u""")
def apply_rmcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(apply.rmcm(accounts(spark, sf_dir), ACCOUNT_START, delta=1.05, features=XY), 4)


@query(f"""
with p as ({EVENTS}), d as (select id, unit, {squared(2)} as d2 from p, {values(EVENT_START)}),
l as (select id, arg_min(unit, (d2, unit)) as label from d group by id)
select id as row_id, cast(label as int) as label, cast(label // 2 as double) as row, cast(label % 2 as double) as col from l""")
def apply_som(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = apply.som(events(spark, sf_dir), EVENT_START, GRID, features=XY).assignments
    return found.select("row_id", "label", F.col("embedding")[0].alias("row"), F.col("embedding")[1].alias("col"))


@query(ORACLE_SQL["apply_som"])
def apply_batch_som(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = apply.batch_som(events(spark, sf_dir), EVENT_START, GRID, features=XY).assignments
    return found.select("row_id", "label", F.col("embedding")[0].alias("row"), F.col("embedding")[1].alias("col"))


def olp_sql(points: str, start, lam: float, gamma: float, steps: int, still: bool) -> str:
    """Rows carry their latent position and every unit's center from step to step."""
    move = ("c0", "c1") if still else ("sum(p * x0) over (partition by unit) / sum(p) over (partition by unit)", "sum(p * x1) over (partition by unit) / sum(p) over (partition by unit)")
    return f"""
with recursive p as ({points}), it(t, id, unit, x0, x1, c0, c1, vr, vc, p) as (
  select 0, id, unit, x0, x1, c0, c1, cast(0 as double), cast(0 as double), cast(0 as double) from p, {values(start)}
  union all
  select t + 1, id, unit, x0, x1, {move[0]}, {move[1]},
    sum(p * (unit // 2)) over (partition by id), sum(p * (unit % 2)) over (partition by id), p
  from (select t, id, unit, x0, x1, c0, c1, e / sum(e) over (partition by id) as p
        from (select *, exp((min(cost) over (partition by id) - cost) / {lam}) as e
              from (select *, {squared(2)} + case when t = 0 then 0 else {gamma} * ((vr - unit // 2) * (vr - unit // 2) + (vc - unit % 2) * (vc - unit % 2)) end as cost
                    from it where t < {steps})))
)"""


@query(olp_sql(CUSTOMERS, ACCOUNT_START, 4.0, 2.0, 3, True) + f"""
select id as row_id, cast(arg_min(unit, (-p, unit)) as int) as label, {", ".join(f"round(max(case when unit = {c} then p end), 6) as u{c}" for c in range(4))}
from it where t = 3 group by id""")
def apply_som_olp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(apply.som_olp(accounts(spark, sf_dir), ACCOUNT_START, GRID, lam=4.0, gamma=2.0, tol=0.0, max_iter=3, features=XY), 4)


@query(trained_sql(LINES, LINE_START, NEAREST, 5))
def train_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, kmeans(lines(spark, sf_dir), 4, features=FOUR, init=LINE_START, max_iter=5))


@query(trained_sql(EVENTS, EVENT_START, FUZZY, 5, 2))
def train_fcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, fcm(events(spark, sf_dir), 4, features=XY, init=EVENT_START, max_iter=5, tol=0.0))


@query(trained_sql(LINES, LINE_START, soft_share(60.0), 4))
def train_efcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, efcm(lines(spark, sf_dir), 4, features=FOUR, init=LINE_START, tau=60.0, max_iter=4, tol=0.0))


@query(trained_sql(EVENTS, EVENT_START, rough_share(1.3, 0.5), 4))
def train_rcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, rcm(events(spark, sf_dir), 4, features=XY, init=EVENT_START, alpha=1.3, beta=0.5, max_iter=4))


GRAPH = f"""select q.*, y0, y1, z from ({CUSTOMERS}) q join (
  select j, sum(x0 / g) as y0, sum(x1 / g) as y1, sum(1.0 / g) as z
  from (select a.id as i, b.id as j, a.x0, a.x1, count(*) over (partition by a.id) as g from ({CUSTOMERS}) a, ({CUSTOMERS}) b
        where sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1)) <= 1.05) group by j) s on s.j = q.id"""


@query(trained_sql(GRAPH, ACCOUNT_START, NEAREST, 4, 1, ("y{d}", "z")))
def train_rmcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, rmcm(accounts(spark, sf_dir), 4, delta=1.05, features=XY, init=ACCOUNT_START, max_iter=4))


#: Width of the neighbourhood at step t of 4, from 0.5 to 0.25.
WIDTH = "(power(0.5, 1 - t / 3.0) * power(0.25, t / 3.0))"
NEAR = "exp(-0.5 * ((unit // 2 - best // 2) * (unit // 2 - best // 2) + (unit % 2 - best % 2) * (unit % 2 - best % 2)) / ({s} * {s}))"


@query(trained_sql(EVENTS, EVENT_START, NEAR.format(s=WIDTH), 4).replace(
    "min(d2) over (partition by id) as low", "first_value(unit) over (partition by id order by d2, unit) as best"))
def train_batch_som(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, batch_som(events(spark, sf_dir), GRID, features=XY, init=EVENT_START, epochs=4, sigma=0.5, sigma_end=0.25))


@query(f"""
with recursive p as (select *, row_number() over (order by id) - 1 as turn, count(*) over () as n from ({SUPPLIERS})), it(t, unit, c0, c1) as (
  select 0, unit, c0, c1 from {values(ACCOUNT_START)}
  union all
  select t + 1, unit, c0 + lr * h * (x0 - c0), c1 + lr * h * (x1 - c1)
  from (select *, {NEAR.format(s="s")} as h
        from (select it.*, x0, x1, power(0.5, 1 - turn / (n - 1)) * power(0.01, turn / (n - 1)) as lr, power(0.5, 1 - turn / (n - 1)) * power(0.25, turn / (n - 1)) as s,
                first_value(unit) over (order by {squared(2)}, unit) as best
              from it join p on p.turn = it.t))
)
select unit, round(c0, 5) as c0, round(c1, 5) as c1, 1 as n_iter from it where t = (select count(*) from supplier)""")
def train_som(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, som(accounts(spark, sf_dir, "supplier"), GRID, features=XY, init=ACCOUNT_START, epochs=1, shuffle=False, sigma=0.5, sigma_end=0.25))


@query(olp_sql(CUSTOMERS, ACCOUNT_START, 4.0, 2.0, 4, False) + "\nselect distinct unit, round(c0, 5) as c0, round(c1, 5) as c1, 4 as n_iter from it where t = 4")
def train_som_olp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, som_olp(accounts(spark, sf_dir), GRID, features=XY, init=ACCOUNT_START, lam=4.0, gamma=2.0, max_iter=4, tol=0.0))


@query(f"select cast(floor(x0) as int) as a, cast(floor(x1 / 4) as int) as b, count(*) as n from ({EVENTS}) group by all")
def label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).select(F.floor("x").cast("int").alias("hour"), F.floor(F.col("y") / 4).cast("int").alias("size"))
    return contingency(df, "hour", "size")


LABELS = "select event_type as a, user_id % 4 as b from events"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 4).alias("quarter"))


@query(f"""
with l as ({LABELS}), c as (select a, b, cast(count(*) as hugeint) as n from l group by all),
s as (select (select sum(n * n) from c) as nn, (select sum(r * r) from (select sum(n) as r from c group by a)) as aa,
  (select sum(r * r) from (select sum(n) as r from c group by b)) as bb, (select sum(n) from c) as n),
q as (select nn - n as tp, aa - nn as f1, bb - nn as f2, n * n - aa - bb + nn as tn from s)
select round(2.0 * (tp * tn - f1 * f2) / ((tp + f1) * (f1 + tn) + (tp + f2) * (f2 + tn)), 9) as ari from q""")
def adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(round(ari(_labels(spark, sf_dir), "event_type", "quarter"), 9),)], "ari double")


@query(f"""
with l as ({LABELS}), c as (select a, b, count(*) as n from l group by all), r as (select a, sum(n)::bigint as na from c group by a),
k as (select b, sum(n)::bigint as nb from c group by b), t as (select sum(n)::bigint as n from c),
mi as (select sum(c.n / t.n * (ln(c.n) + ln(t.n) - ln(na) - ln(nb))) as v from c join r using (a) join k using (b), t),
ha as (select sum(-na / t.n * ln(na / t.n)) as v from r, t), hb as (select sum(-nb / t.n * ln(nb / t.n)) as v from k, t),
e as (select sum(m / n * (ln(n) + ln(m) - ln(na) - ln(nb)) * exp(lgamma(na + 1) + lgamma(nb + 1) + lgamma(n - na + 1) + lgamma(n - nb + 1) - lgamma(n + 1)
    - lgamma(m + 1) - lgamma(na - m + 1) - lgamma(nb - m + 1) - lgamma(n - na - nb + m + 1))) as v
  from (select na, nb, n, unnest(range(greatest(1, na + nb - n), least(na, nb) + 1)) as m from r, k, t))
select average, round((mi.v - e.v) / (mean - e.v), 9) as ami
from mi, e, (select 'arithmetic' as average, (ha.v + hb.v) / 2 as mean from ha, hb union all select 'geometric', sqrt(ha.v * hb.v) from ha, hb
  union all select 'min', least(ha.v, hb.v) from ha, hb union all select 'max', greatest(ha.v, hb.v) from ha, hb)""")
def adjusted_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _labels(spark, sf_dir)
    averages = ["arithmetic", "geometric", "min", "max"]
    rows = [(a, round(v, 9)) for a, v in zip(averages, ami(df, "event_type", "quarter", average=averages), strict=True)]
    return spark.createDataFrame(rows, "average string, ami double")


def kept_sql(near: str, far: str) -> str:
    """1 less the penalty of neighbours in ``near`` by their rank in ``far``, for k of 5 and 10."""
    return f"""
with v as (select vec_id as id, list_transform(embedding, lambda x: cast(x as double)) as x from embeddings),
d as (select a.id as i, b.id as j, list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as dx,
  (a.x[1] - b.x[1]) * (a.x[1] - b.x[1]) + (a.x[2] - b.x[2]) * (a.x[2] - b.x[2]) as dy from v a join v b on a.id <> b.id),
r as (select row_number() over (partition by i order by {near}, j) as place, row_number() over (partition by i order by {far}, j) as rank from d),
n as (select count(*) as n from v)
select k, round(1 - 2.0 * sum(greatest(rank - k, 0)) / (n * k * (2 * n - 3 * k - 1)), 9) as value
from r, n, (values (5), (10)) as s(k) where place <= k group by k, n"""


def _spaces(spark: SparkSession, sf_dir: str) -> tuple[Neighborhood, Neighborhood]:
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("x"))
    return Neighborhood.of(df, "x"), Neighborhood.of(df.select("row_id", F.slice("x", 1, 2).alias("x")), "x")


@query(kept_sql("dy", "dx"))
def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = _spaces(spark, sf_dir)
    return spark.createDataFrame([(k, round(v, 9)) for k, v in zip((5, 10), trustworthiness(x, y, [5, 10]), strict=True)], "k int, value double")


@query(kept_sql("dx", "dy"))
def continued(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = _spaces(spark, sf_dir)
    return spark.createDataFrame([(k, round(v, 9)) for k, v in zip((5, 10), continuity(x, y, [5, 10]), strict=True)], "k int, value double")


@query(f"with p as ({CUSTOMERS}), e as ({EDGES}) select i as row_id, count(*) as n from e group by i")
def neighbour_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows within distance 1.05 of every row, itself included."""
    return counts_within(prepared(accounts(spark, sf_dir), XY), 1.05)


@query(f"""
with p as ({LINES}), m as (select count(*) as n, avg(x0) as a, avg(x1) as b, avg(x2) as c, avg(x3) as d from p)
select max(n) as n, round(max(a), 6) as a, round(max(b), 6) as b, round(max(c), 6) as c, round(max(d), 6) as d,
  round(sqrt(avg((x0 - a) * (x0 - a) + (x1 - b) * (x1 - b) + (x2 - c) * (x2 - c) + (x3 - d) * (x3 - d))), 6) as radius from p, m""")
def description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, mean and radius of the checked input."""
    points = prepared(lines(spark, sf_dir), FOUR)
    return spark.createDataFrame([(points.n, *(round(float(v), 6) for v in points.mean), round(points.radius, 6))], "n long, a double, b double, c double, d double, radius double")


@query(f"""
with p as ({EVENTS}) select id as row_id, round((x0 - a) / s, 6) as x, round((x1 - b) / t, 6) as y
from p, (select avg(x0) as a, stddev_pop(x0) as s, avg(x1) as b, stddev_pop(x1) as t from p)""")
def standard_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir)
    return standardized(df, scaling(df, XY)).select("row_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"""
with p as ({EVENTS}), d as (select id, unit, {squared(2)} as d2 from p, {values(EVENT_START)}),
u as (select id, {soft_share(5.0)} as u from (select *, min(d2) over (partition by id) as low from d))
select id as row_id, round(exp(sum(case when u > 0 then -u * ln(u) else 0 end)), 6) as units from u group by id""")
def effective_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = apply.efcm(events(spark, sf_dir), EVENT_START, tau=5.0, features=XY).assignments
    return found.select("row_id", F.round(effective_units("membership"), 6).alias("units"))


def objectives(spark: SparkSession, result: Result) -> DataFrame:
    """(iteration, objective) of a run."""
    return spark.createDataFrame([(i + 1, round(float(v), 4)) for i, v in enumerate(result.history)], "iteration int, objective double")


@query(trained_sql(LINES, LINE_START, NEAREST, 5, objective="low"))
def kmeans_objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objectives(spark, kmeans(lines(spark, sf_dir), 4, features=FOUR, init=LINE_START, max_iter=5))


@query(trained_sql(EVENTS, EVENT_START, FUZZY, 5, 2, objective="1 / sum(1 / d2)"))
def fcm_objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objectives(spark, fcm(events(spark, sf_dir), 4, features=XY, init=EVENT_START, max_iter=5, tol=0.0))


@query(trained_sql(EVENTS, EVENT_START, soft_share(5.0), 4, objective="low - 5.0 * ln(sum(exp((low - d2) / 5.0)))"))
def efcm_objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objectives(spark, efcm(events(spark, sf_dir), 4, features=XY, init=EVENT_START, tau=5.0, max_iter=4, tol=0.0))


@query(f"""
with p as ({LINES}), s as (select round(covar_pop(x0, x0), 6) as c00, round(covar_pop(x0, x1), 6) as c01, round(covar_pop(x0, x2), 6) as c02, round(covar_pop(x0, x3), 6) as c03,
  round(covar_pop(x1, x1), 6) as c11, round(covar_pop(x1, x2), 6) as c12, round(covar_pop(x1, x3), 6) as c13, round(covar_pop(x2, x2), 6) as c22,
  round(covar_pop(x2, x3), 6) as c23, round(covar_pop(x3, x3), 6) as c33 from p) select * from s""")
def line_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = covariance(prepared(lines(spark, sf_dir), FOUR))
    cells = [(i, j) for i in range(4) for j in range(i, 4)]
    return spark.createDataFrame([tuple(round(float(found[c]), 6) for c in cells)], ", ".join(f"c{i}{j} double" for i, j in cells))


@query(f"""
with p as ({EVENTS}), d as (select id, min({squared(2)}) as d2 from p, {values(EVENT_START)} group by id) select round(avg(d2), 6) as error from d""")
def quantization_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = prepared(events(spark, sf_dir), XY)
    return spark.createDataFrame([(round(map_quality(points, np.array(EVENT_START)), 6),)], "error double")


PAIRS = """
with v as (select vec_id as id, list_transform(embedding, lambda x: cast(x as double)) as x from embeddings),
d as (select a.id as i, b.id as j, list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as dx,
  (a.x[1] - b.x[1]) * (a.x[1] - b.x[1]) + (a.x[2] - b.x[2]) * (a.x[2] - b.x[2]) as dy from v a join v b on a.id <> b.id),
r as (select i, j, cast(row_number() over (partition by i order by dy, j) as int) as place, row_number() over (partition by i order by dx, j) as rank from d)"""


@query(PAIRS + " select i, j, place from r where place <= 5")
def nearest_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's five nearest others in its first two components."""
    return nearest_rows(_spaces(spark, sf_dir)[1], 5)


@query(PAIRS + " select i, j, cast(place as bigint) as place, rank from r where place <= 5")
def neighbour_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks in all components of the five nearest in the first two."""
    x, y = _spaces(spark, sf_dir)
    return ranks(x, nearest_rows(y, 5))


@query(f"""
with l as ({LABELS}), c as (select a, b, count(*) as n from l group by all), r as (select a, sum(n)::bigint as na from c group by a),
k as (select b, sum(n)::bigint as nb from c group by b), t as (select sum(n)::bigint as n from c)
select round((select sum(c.n / t.n * (ln(c.n) + ln(t.n) - ln(na) - ln(nb))) from c join r using (a) join k using (b), t), 9) as information,
  round((select sum(-na / t.n * ln(na / t.n)) from r, t), 9) as entropy_a, round((select sum(-nb / t.n * ln(nb / t.n)) from k, t), 9) as entropy_b,
  round((select sum(m / n * (ln(n) + ln(m) - ln(na) - ln(nb)) * exp(lgamma(na + 1) + lgamma(nb + 1) + lgamma(n - na + 1) + lgamma(n - nb + 1) - lgamma(n + 1)
    - lgamma(m + 1) - lgamma(na - m + 1) - lgamma(nb - m + 1) - lgamma(n - na - nb + m + 1)))
  from (select na, nb, n, unnest(range(greatest(1, na + nb - n), least(na, nb) + 1)) as m from r, k, t)), 9) as expected""")
def label_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual information, entropies, and the information expected by chance."""
    table_ = Table.of(_labels(spark, sf_dir), "event_type", "quarter")
    cells, rows, cols = Counts.of(table_.cells, "n"), Counts.of(table_.rows, "na"), Counts.of(table_.cols, "nb")
    information = np.log(cells.n) + (cells.logs - rows.logs - cols.logs) / cells.n
    found = (information, rows.entropy, cols.entropy, expected_information(table_, cells.n))
    return spark.createDataFrame([tuple(round(float(v), 9) for v in found)], "information double, entropy_a double, entropy_b double, expected double")


@query(trained_sql(EVENTS, EVENT_START, rough_share(1.3, 0.5, 2.0), 4))
def train_exrcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extended form of rough c-means."""
    return units(spark, rcm(events(spark, sf_dir), 4, features=XY, init=EVENT_START, alpha=1.3, beta=0.5, p=2.0, max_iter=4))


@query(shares_sql(EVENTS, EVENT_START, rough_share(1.3, 0.5, 2.0)))
def apply_exrcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(apply.rcm(events(spark, sf_dir), EVENT_START, alpha=1.3, beta=0.5, p=2.0, features=XY), 4)


#: The first step at which no center moves by more than a share of the radius of the points.
STOPPED = """, m as (select b.t, max(greatest(abs(b.c0 - a.c0), abs(b.c1 - a.c1))) as far from it a join it b on b.unit = a.unit and b.t = a.t + 1 group by b.t),
r as (select sqrt(var_pop(x0) + var_pop(x1)) as radius from p), s as (select min(m.t) as t from m, r where far <= {tol} * radius)
select unit, round(c0, 5) as c0, round(c1, 5) as c1, it.t as n_iter from it join s on s.t = it.t"""


@query(trained_sql(EVENTS, EVENT_START, FUZZY, 25, 2, tail=STOPPED.format(tol=0.02)))
def stopped_fcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centers and iterations of a run that ends at its tolerance."""
    found = fcm(events(spark, sf_dir), 4, features=XY, init=EVENT_START, tol=0.02, max_iter=None)
    return units(spark, found)


FAR_START = [*ACCOUNT_START[:3], [5000.0, -5000.0]]


@query(trained_sql(CUSTOMERS, FAR_START, NEAREST, 4))
def unreached_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit that no row is nearest to stays where it is."""
    return units(spark, kmeans(accounts(spark, sf_dir), 4, features=XY, init=FAR_START, max_iter=4))


SIX_START = [*EVENT_START, [5.713, 17.319], [12.931, 8.117]]


@query(trained_sql(EVENTS, SIX_START, NEAR.format(s="(power(1.0, 1 - t / 3.0) * power(0.5, t / 3.0))"), 4).replace(
    "min(d2) over (partition by id) as low", "first_value(unit) over (partition by id order by d2, unit) as best"))
def default_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch map of three rows and two columns, whose widths go from half its extent to a half."""
    return units(spark, batch_som(events(spark, sf_dir), (3, 2), features=XY, init=SIX_START, epochs=4))


@query(trained_sql(LINES, LINE_START, NEAREST, 3, tail="""
select t as iteration, unit, round(c0, 5) as c0, round(c1, 5) as c1, round(c2, 5) as c2, round(c3, 5) as c3 from it where t > 0"""))
def stepped_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centers of every iteration, one after the other."""
    run = steps.kmeans(lines(spark, sf_dir), 4, features=FOUR, init=LINE_START, max_iter=3)
    rows = [(progress.iteration, unit, *(round(float(v), 5) for v in c)) for progress in run for unit, c in enumerate(progress.result().centers)]
    return spark.createDataFrame(rows, "iteration int, unit int, c0 double, c1 double, c2 double, c3 double")


@query(trained_sql(f"select *, 0 as sent from ({CUSTOMERS}) union all select -id, x0, x1, 1 from ({SUPPLIERS})", ACCOUNT_START, NEAREST, 3).replace(
    "from it, p where t < 3", "from it, p where t < 3 and sent = least(t, 1)"))
def sent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One iteration on customers, then two on suppliers that are sent in."""
    run = steps.kmeans(accounts(spark, sf_dir), 4, features=XY, init=ACCOUNT_START, max_iter=3)
    next(run)
    run.send(accounts(spark, sf_dir, "supplier"))
    return units(spark, [progress.result() for progress in run][-1])


@query(olp_sql(CUSTOMERS, ACCOUNT_START, 4.0, 2.0, 12, True) + f""", m as (
  select b.t, max(abs(b.p - a.p)) as change from it a join it b on b.id = a.id and b.unit = a.unit and b.t = a.t + 1 where a.t > 0 group by b.t),
s as (select min(t) as t from m where change <= 0.05)
select id as row_id, cast(arg_min(unit, (-p, unit)) as int) as label, {", ".join(f"round(max(case when unit = {c} then p end), 6) as u{c}" for c in range(4))},
  cast(max(s.t) as int) as n_iter
from it join s on s.t = it.t group by id""")
def steady_som_olp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applied until no membership changes by more than a tolerance."""
    found = apply.som_olp(accounts(spark, sf_dir), ACCOUNT_START, GRID, lam=4.0, gamma=2.0, tol=0.05, max_iter=12, features=XY)
    return shares(found, 4).withColumn("n_iter", F.lit(found.n_iter))


@query(f"select unit, c0, c1 from ({ORACLE_SQL['train_batch_som']})")
def stored_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map that was saved and loaded."""
    found = batch_som(events(spark, sf_dir), GRID, features=XY, init=EVENT_START, epochs=4, sigma=0.5, sigma_end=0.25)
    path = f"{shared_folder(spark)}/map-{uuid.uuid4().hex}"
    save(spark, found, path, features=XY)
    rows = [(unit, *(round(float(v), 5) for v in c)) for unit, c in enumerate(load(spark, path).centers)]
    return spark.createDataFrame(rows, "unit int, c0 double, c1 double")


@query(trained_sql(EVENTS, EVENT_START, FUZZY, 2, 2))
def federated_fcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two updates from two sites, which send on their parts alone."""
    df = events(spark, sf_dir)
    centers = np.array(EVENT_START)
    for _ in range(2):
        parts = [partial_update(df.where(F.col("row_id") % 2 == site), centers, features=XY, m=2.0) for site in range(2)]
        centers, _ = merged_update(parts, centers)
    rows = [(unit, *(round(float(v), 5) for v in c), 2) for unit, c in enumerate(centers)]
    return spark.createDataFrame(rows, "unit int, c0 double, c1 double, n_iter int")


# Eigenvalues and axes of a symmetric matrix of two rows, in closed form.
@query(f"""
with p as ({EVENTS}), c as (select var_pop(x0) as a, covar_pop(x0, x1) as b, var_pop(x1) as d from p),
l as (select *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) as l1, (a + d) / 2 - sqrt((a - d) * (a - d) / 4 + b * b) as l2 from c),
v as (select *, case when a >= d then l1 - d else b end as vx, case when a >= d then b else l1 - a end as vy from l),
n as (select l1, l2, vx / sqrt(vx * vx + vy * vy) as vx, vy / sqrt(vx * vx + vy * vy) as vy from v),
w as (select l1, l2, vx * sign(vx) as ax, vy * sign(vx) as ay, -vy * sign(-vy) as bx, vx * sign(-vy) as by_ from n)
select cast(3 * r + c as int) as unit, round(2 * ((r - 1) * sqrt(l1) * ax + (c - 1) * sqrt(l2) * bx), 5) + 0.0 as x,
  round(2 * ((r - 1) * sqrt(l1) * ay + (c - 1) * sqrt(l2) * by_), 5) + 0.0 as y
from w, (select unnest(range(3)) as r), (select unnest(range(3)) as c)""")
def principal_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first prototypes of a map of three rows and columns, about the mean."""
    points = prepared(events(spark, sf_dir), XY)
    # Without the sign of a zero.
    rows = [(i, *(round(float(v), 5) + 0.0 for v in c)) for i, c in enumerate(principal_start(points, unit_coordinates((3, 3)), 2.0))]
    return spark.createDataFrame(rows, "unit int, x double, y double")


@query("select cast(i as int) as unit, true as is_row, true as lowers from range(8) as r(i)")
def seeds_are_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every seed: whether it is a row, and whether it lowers the squared distances to the seeds."""
    df = events(spark, sf_dir)
    points = prepared(df, XY)
    found = seeds(points, 8, 3) + points.mean
    totals = [map_quality(points, found[: i + 1]) for i in range(len(found))]
    lowers = [i == 0 or totals[i] < totals[i - 1] for i in range(len(totals))]
    seen = spark.createDataFrame([(i, *map(float, c), low) for i, (c, low) in enumerate(zip(found, lowers, strict=True))], "unit int, sx double, sy double, lowers boolean")
    close = (F.abs(F.col("x") - F.col("sx")) < 1e-9) & (F.abs(F.col("y") - F.col("sy")) < 1e-9)
    # Eight seeds: a table that is broadcast.
    rows = df.join(F.broadcast(seen), close).select("unit").distinct().withColumn("is_row", F.lit(True))
    return seen.join(rows, "unit", "left").select("unit", F.coalesce("is_row", F.lit(False)).alias("is_row"), "lowers")


# A kernel's mass within [0, 1], which its density is divided by, is summed up by Simpson's rule.
@query("""
with v as (select s_suppkey as t, (s_acctbal - min(s_acctbal) over ()) / (max(s_acctbal) over () - min(s_acctbal) over ()) as x, count(*) over () as n from supplier),
k as (select t, x, n from v union all select null, 0.5, max(n) from v),
g as (select t, x, n, x - lag(x, 1, 0.0) over o as below, lead(x, 1, 1.0) over o - x as above from k window o as (order by x, t nulls last)),
w as (select x, n, case when t is null then 1.0 else least(1.0, greatest(below, above, 0.03, power(n + 1, -2.0))) end as width from g),
s as (select x, width, n, sum(exp(-0.5 * power((i / 400.0 - x) / width, 2)) * case when i in (0, 400) then 1 when i % 2 = 1 then 4 else 2 end) / 1200.0 as mass
  from w, (select unnest(range(401)) as i) group by all)
select cast(j as int) as place, round(sum(exp(-0.5 * power((j / 20.0 - x) / width, 2)) / mass) / (max(n) + 1), 5) as density
from s, (select unnest(range(21)) as j) group by j""")
def parzen_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The density of trials at the suppliers' balances, at 21 places."""
    rows = table(spark, sf_dir, "supplier").orderBy("s_suppkey").select("s_acctbal").collect()
    found = np.array([r[0] for r in rows], float)
    scaled = (found - found.min()) / (found.max() - found.min())
    density = np.exp(Kernels(scaled[:, None], [Interval(0.0, 1.0)]).log_density(np.arange(21)[:, None] / 20))
    return spark.createDataFrame([(i, round(float(v), 5)) for i, v in enumerate(density)], "place int, density double")


# Random draws and searches: no SQL states them.
@query()
def seeded_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    return units(spark, kmeans(df, 10, features="embedding", id_col="vec_id", seed=1, max_iter=20)).select("unit", "n_iter", "c0", "c1")


@query()
def searched_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tau at which entropic memberships of events come nearest to two effective units."""
    df = events(spark, sf_dir).persist()

    def loss(p: dict) -> float:
        found = apply.efcm(df, EVENT_START, tau=float(np.exp(p["log_tau"])), features=XY).assignments
        return abs(found.agg(F.avg(effective_units("membership"))).head()[0] - 2.0)

    out = minimize(loss, {"log_tau": uniform(-1.0, 6.0)}, 15, seed=1).trials(spark)
    df.unpersist()
    return out


@query(trained_sql(EVENTS, EVENT_START, soft_share(5.0), 1))
def streamed_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One iteration a micro-batch over the files of the events table."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    fit = StreamedFit(lambda batch: steps.efcm(batch, 4, features=XY, init=EVENT_START, tau=5.0, max_iter=None))
    hour = F.hour("ts") + F.minute("ts") / 60.0 + F.second("ts") / 3600.0
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)
    rows = stream.select(F.col("event_id").alias("row_id"), hour.alias("x"), (F.col("value") / 20).alias("y"))
    running = rows.writeStream.foreachBatch(fit).start()
    running.processAllAvailable()
    running.stop()
    return units(spark, fit.result())


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_kmeans_summary(spark, sf_dir)
