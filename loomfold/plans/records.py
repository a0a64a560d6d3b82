"""Logs, order states, profiles, entity resolution, exports with totals, and texts in their given forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomfold.functions import columns as C
from loomfold.functions import literals as L
from loomfold.operators import profile as P
from loomfold.plans.registry import query
from loomfold.sources import artifacts as A
from loomfold.sources import evaluation_logs as E
from loomfold.sources import tables as S
from loomfold.streaming import states


# a log for each type of event: headings, metrics under repeated names, values that are none, formulas, examples
def _log_lines(events):
    k = F.col("event_id")
    number = lambda c: c.cast("string")
    metric = F.concat(F.lit("  Recall@"), number(k % 97), F.lit(": "), number(F.floor(F.col("value") * 100)), F.lit(" of all: 9\t"))
    parts = [
        (F.when(k % 50 == 0, "=== RESULTS FOR x: 1 ==="), 0),
        (F.when(k % 5 == 0, "Recall@bad: n/a").otherwise(metric), 1),
        (F.lit("[info] Recall@bad: 5"), 2),
        (F.when(k % 3 != 0, F.concat(F.lit(f" {E.FORMULA} hits : "), number(k), F.lit(" "))), 3),
        (F.when(k % 4 == 0, F.concat(F.lit(f"🧮 {E.EXAMPLE} "), number(k), F.lit(" / 9"))).otherwise(""), 4),
    ]
    said = F.explode(F.array(*[F.struct(p.alias("line"), F.lit(i).alias("i")) for p, i in parts]))
    rows = events.select(F.col("interaction_type").alias("model"), k.alias("event_id"), said.alias("said")).where("said.line is not null")
    return rows.select("model", (F.col("event_id") * 5 + F.col("said.i")).alias("place"), "said.line")


@query("JS04", f"""select log, name, arg_max(value, k) filter (k % 5 <> 0) as value, arg_max('hits : ' || k, k) filter (k % 3 <> 0) as formula, arg_max(k || ' / 9', k) filter (k % 4 = 0) as example
from (select *, last_value(case when k % 5 <> 0 then 'Recall@' || (k % 97) end ignore nulls) over (partition by log order by k) as name
  from (select interaction_type as log, event_id as k, floor(value * 100) as value from event_rows)) where name is not null group by 1, 2""")
def evaluation_logs(spark, d):
    """Metrics, formulas and examples of logs that were written as text, a folder for each type of event."""
    path = A.path(spark, "evaluation-logs")
    E.write(_log_lines(S.events(spark, d)), path)
    return E.parse(E.read_lines(spark, path))


@query("SNK13", """select coalesce(o.order_id, m.order_id) as order_id, case when o.order_id is not null then coalesce(paid, false) end as is_paid, case when o.order_id is not null then coalesce(delivered, false) end as is_delivered,
  case when o.order_id is not null then coalesce(cancelled, false) end as is_cancelled, case when o.order_id is not null then paid_at end as paid_at, case when o.order_id is not null then delivered_at end as delivered_at,
  case when o.order_id is not null then greatest(created_at, updated_at) end as updated_at, case when o.order_id is null then 'Order does not exist.' end as message
from (select o_orderkey as order_id, o_orderdate as created_at from orders) o full join (
  select case when l_linenumber = 5 then -l_orderkey else l_orderkey end as order_id, bool_or(l_returnflag = 'N') as paid, bool_or(l_returnflag = 'A') as delivered, bool_or(l_returnflag = 'R' and l_linenumber < 4) as cancelled,
  max(l_shipdate) filter (l_returnflag = 'N') as paid_at, max(l_shipdate) filter (l_returnflag = 'A') as delivered_at, max(l_shipdate) as updated_at
  from lineitem where l_returnflag in ('N', 'A') or l_linenumber < 4 group by 1) m on o.order_id = m.order_id""")
def order_moves(spark, d):
    """Orders after the moves of their lines: paid, delivered, cancelled, and others; some name no order."""
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    move = F.when(flag == "N", states.PAID).when(flag == "A", states.DELIVERED).when((flag == "R") & (line < 4), states.CANCELLED).otherwise("packed")
    order = F.when(line == 5, -F.col("l_orderkey")).otherwise(F.col("l_orderkey"))
    moves = S.table(spark, d, "lineitem").select(order.alias("order_id"), move.alias("move"), F.col("l_shipdate").alias("at"))
    orders = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("created_at"))
    return states.settled(orders, states.order_states(moves))


UPLOAD = ("product_id", "name", "usage", "year", "price", "on_sale", "note")
_EXACT = ("column", "type", "rows", "nulls", "longest", "mean", "std", "least", "most")


def _uploaded(spark, d):
    """A CSV file of products read back as text cells; `note` has no cell at all."""
    p, path = S.products(spark, d), A.path(spark, "upload")
    year = F.when(F.col("product_id").cast("bigint") % 3 != 0, F.col("year"))
    S.write_csv(p.select("product_id", "name", "usage", year.alias("year"), "price", (F.col("sale") == 0).alias("on_sale"), F.lit(None).cast("string").alias("note")), path)
    return S.read_csv(spark, path, ", ".join(f"{c} string" for c in UPLOAD))


def _profile_sql(column: str, kind: str, value: str) -> str:
    number = kind in ("integer", "number")
    figures = [f"{f}({value})::double" if number else "null::double" for f in ("avg", "stddev_samp", "min", "max")]
    figures = [f"round({f}, 3) as {n}" for f, n in zip(figures, ("mean", "std", "least", "most"))]
    # the length of a price depends on how it is printed
    longest = "null" if column == "price" else f"coalesce(max(length(cast({value} as varchar))), 0)"
    return f"select '{column}' as \"column\", '{kind}' as type, count(*) as rows, count(*) - count({value}) as nulls, {longest} as longest, {', '.join(figures)} from products"


@query("SRC13", " union all ".join(_profile_sql(*c) for c in (
    ("product_id", "integer", "cast(product_id as bigint)"), ("name", "text", "name"), ("usage", "text", "usage"), ("year", "integer", "case when cast(product_id as bigint) % 3 <> 0 then year end"),
    ("price", "number", "price"), ("on_sale", "boolean", "(sale = 0)"), ("note", "empty", "cast(null as varchar)"))))
def upload_profile(spark, d):
    """The exact columns of an uploaded file's profile."""
    rows = P.profile(_uploaded(spark, d))
    exact = rows.withColumns({c: F.round(c, 3) for c in ("mean", "std", "least", "most")}).withColumn("longest", F.when(F.col("column") != "price", F.col("longest")))
    return exact.select(*_EXACT)


@query("SRC13_sketches")
def upload_sketches(spark, d):
    """Distinct counts and quartiles of the same profile, by sketches; tested against exact ones."""
    return P.profile(_uploaded(spark, d)).select("column", "about_distinct", "about_quarters")


_WANTED = "0" * 22 + "2a"


@query("A30", f"""select kind, count(*) as n, count(*) filter (same) as matching, string_agg(k || ':' || coalesce(key, '') || ':' || same, ',' order by k) filter (place <= 5) as sample
from (select *, row_number() over (partition by kind order by k) as place from (select k, key, kind, coalesce(lower(key) = '{_WANTED}', false) as same
  from (select cast(product_id as bigint) as k, ['object_id', 'integer', 'text', 'null'][k % 4 + 1] as kind,
    case k % 4 when 0 then lpad(upper(to_hex(k - k % 8 + 2)), 24, '0') when 1 then '4' || k when 2 then 'category ' || k end as key from products))) group by 1""")
def key_kinds(spark, d):
    """The keys of products in several representations, against one that is asked for."""
    k = F.col("product_id").cast("bigint")
    hexed = F.lpad(F.hex(k - k % 8 + 2), 24, "0")
    key = F.when(k % 4 == 0, hexed).when(k % 4 == 1, F.concat(F.lit("4"), "product_id")).when(k % 4 == 2, F.concat(F.lit("category "), "product_id"))
    return P.key_diagnostics(S.products(spark, d).select(k.alias("id"), key.alias("key")), "id", "key", _WANTED)


@query("SRC19", """select k as request, asked, case when k % 4 = 0 and c % 3 <> 0 or k % 4 = 1 and c % 2 = 0 then c end as entity_id, case when k % 4 = 0 and c % 3 <> 0 or k % 4 = 1 and c % 2 = 0 then null else 'User not found' end as error
from (select o_orderkey as k, o_custkey as c, case o_orderkey % 4 when 0 then '00' || o_custkey when 1 then 'E' || lpad(upper(to_hex(o_custkey)), 23, '0') when 2 then ' ' || o_custkey end as asked from orders)""")
def resolve_users(spark, d):
    """Requests that name users by number or object id, or badly, against users that have one of them, both or none."""
    c = F.col("c_custkey")
    object_id = F.when(c % 2 == 0, F.concat(F.lit("e"), F.lpad(F.lower(F.hex(c)), 23, "0")))
    entities = S.table(spark, d, "customer").select(c.alias("entity_id"), F.when(c % 3 != 0, c).alias("number"), object_id.alias("object_id"))
    k, user = F.col("o_orderkey"), F.col("o_custkey")
    asked = F.when(k % 4 == 0, F.concat(F.lit("00"), user.cast("string"))).when(k % 4 == 1, F.concat(F.lit("E"), F.lpad(F.hex(user), 23, "0"))).when(k % 4 == 2, F.concat(F.lit(" "), user.cast("string")))
    requests = S.table(spark, d, "orders").select(k.alias("request"), asked.alias("asked"))
    return P.resolved(requests, entities, "asked")


@query("SNK04", """select *, true as success from (select 'interactions' as export, count(*) as rows from interactions union all select 'products', count(*) from products union all select 'users', count(*) from users
union all select 'all', (select count(*) from interactions) + (select count(*) from products) + (select count(*) from users))""")
def export_all(spark, d):
    """The three exports written, their rows counted in what was written, and the totals."""
    p, u, i = S.products(spark, d), S.users(spark, d), S.interactions(spark, d)
    at = {n: A.path(spark, f"all-{n}") for n in ("products", "users", "interactions")}
    S.export_products(p, at["products"])
    S.export_users(u, i, at["users"])
    rejected = S.export_interactions(i, u, at["interactions"])
    n = F.count(F.lit(1)).alias("rows")
    columns = {"products": p.columns, "users": [*u.columns, "interaction_history"], "interactions": ["user_id", "product_id", "interaction_type", "timestamp"]}
    counts = {name: S.read_csv(spark, at[name], ", ".join(f"{c} string" for c in columns[name])).agg(n) for name in at}
    wanted = {"products": p.agg(n), "users": u.agg(n), "interactions": i.agg((F.count(F.lit(1)) - rejected).alias("rows"))}
    return P.export_result(counts, wanted)


@query("S19", """select product_id, case cast(product_id as bigint) % 6 when 0 then 'http://x/' || product_id || '.jpg' when 1 then 'it''s ' || product_id when 2 then 'https://y/' || product_id when 3 then 'b' end as url from products""")
def image_urls(spark, d):
    """Image cells as they come: list literals, plain addresses, empty lists, others."""
    k, name = F.col("product_id").cast("bigint"), F.col("product_id")
    forms = [
        F.concat(F.lit("['http://x/"), name, F.lit(".jpg', 'b']")), F.concat(F.lit(" [\"it's "), name, F.lit("\", None] ")), F.concat(F.lit("  https://y/"), name),
        F.lit("[r'b',]"), F.lit("[]"), F.concat(F.lit("ftp://"), name),
    ]
    cell = F.element_at(F.array(*forms), (k % 6 + 1).cast("int"))
    return S.products(spark, d).select("product_id", C.first_image(cell, L.as_json(F.trim(cell))).alias("url"))


@query("D04", """select event_id, case event_id % 6 when 0 then date_trunc('second', ts) when 1 then ts when 2 then date_trunc('second', ts) - interval 90 minute when 3 then date_trunc('day', ts) else timestamp '2001-02-03 04:05:06' end as said from event_rows""")
def iso_times(spark, d):
    """Times with Z, with microseconds, with an offset, of a day, and texts that are none, which get the given time."""
    k = F.col("event_id")
    second = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = (
        F.when(k % 6 == 0, F.concat(second, F.lit("Z"))).when(k % 6 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).when(k % 6 == 2, F.concat(second, F.lit("+01:30")))
        .when(k % 6 == 3, F.date_format("ts", "yyyy-MM-dd")).when(k % 6 == 4, "2024-13-01T00:00:00Z")
    )
    return S.events(spark, d).select("event_id", C.iso_time(text, F.to_timestamp(F.lit("2001-02-03 04:05:06"))).alias("said"))
