"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.reshape import render, text_to_list
from workload.base import day, query, stamp, table, text


@query(
    "fn_string",
    """select c_custkey, c_name || '/' || lower(c_mktsegment) as joined, lpad('', 3, ' ') || length(c_name) as padded,
              substring(c_name, 10, 4) as part, c_mktsegment || chr(10) as line,
              regexp_replace(c_name, '0+', '.', 'g') as squeezed, trim('  ' || c_mktsegment || ' ') as trimmed,
              translate(c_mktsegment, 'AEIOU', 'aeiou') as translated,
              case when len(c_name) - len(replace(c_name, '0', '')) >= 3
                   then list_extract(list_filter(range(1, 40), lambda i: substring(c_name, i, 1) = '0'), 3) else 0 end as third_zero
       from customer""",
)
def fn_string(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.concat("c_name", F.lit("/"), F.lower("c_mktsegment")).alias("joined"),
        F.concat(F.lpad(F.lit(""), 3, " "), F.length("c_name")).alias("padded"),
        F.substring("c_name", 10, 4).alias("part"),
        F.concat("c_mktsegment", F.chr(F.lit(10))).alias("line"),
        F.regexp_replace("c_name", "0+", ".").alias("squeezed"),
        F.trim(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).alias("trimmed"),
        F.translate("c_mktsegment", "AEIOU", "aeiou").alias("translated"),
        S.nth_position("c_name", "0", 3).cast("bigint").alias("third_zero"),
    )


@query(
    "fn_list_element",
    """select p_partkey, string_split(p_size || ',' || p_partkey || ',7', ',')[2] as second,
              string_split(p_name, ' ')[3] as third from part""",
)
def fn_list_element(spark, sf):
    numbers = F.concat_ws(",", "p_size", "p_partkey", F.lit("7"))
    return table(spark, sf, "part").select(
        "p_partkey", S.list_element(numbers, 2).alias("second"), S.list_element("p_name", 3, " ").alias("third")
    )


@query("fn_list_length", "select doc_id, len(string_split(trim(text, ' '), ' ')) as n_words from documents")
def fn_list_length(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.list_length("text", " ").cast("bigint").alias("n_words"))


@query(
    "fn_array",
    """with a as (select p_partkey, p_size, string_split(p_name || ' ' || p_type, ' ') as a from part)
       select p_partkey, array_to_string(a, '/') as joined, len(a) as n, a[1] as first, array_to_string(a[2:3], '+') as rest,
              array_to_string(list_append(a, 'end'), ' ') as longer, list_contains(a, 'SMALL') as small from a""",
)
def fn_array(spark, sf):
    a = text_to_list(F.concat("p_name", F.lit(" "), "p_type"), " ")
    rows = table(spark, sf, "part").select("p_partkey", a.alias("a"))
    return rows.select(
        "p_partkey",
        F.array_join("a", "/").alias("joined"),
        F.size("a").cast("bigint").alias("n"),
        F.element_at("a", 1).alias("first"),
        F.array_join(F.slice("a", 2, 2), "+").alias("rest"),
        F.array_join(F.array_append("a", F.lit("end")), " ").alias("longer"),
        F.array_contains("a", "SMALL").alias("small"),
    )


@query(
    "fn_date_parts",
    """select event_id, year(ts)::int as y, month(ts)::int as m, day(ts)::int as d, hour(ts)::int as h, minute(ts)::int as mi,
              extract(dow from ts)::int as dow, extract(isodow from ts)::int as isodow from events""",
)
def fn_date_parts(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.year("ts").alias("y"), F.month("ts").alias("m"), F.dayofmonth("ts").alias("d"),
        F.hour("ts").alias("h"), F.minute("ts").alias("mi"),
        (F.dayofweek("ts") - 1).alias("dow"), (F.weekday("ts") + 1).alias("isodow"),
    )


@query(
    "fn_date_build",
    """select o_orderkey, strftime(make_date(year(o_orderdate), month(o_orderdate), 1), '%Y-%m-%d') as first_day,
              strftime(make_timestamp(year(o_orderdate), month(o_orderdate), day(o_orderdate), 6, 30, 0), '%Y-%m-%d %H:%M:%S') as at,
              strftime(cast(o_orderdate as date) + 10, '%Y-%m-%d') as plus,
              date_diff('day', date '1995-01-01', cast(o_orderdate as date)) as days,
              strftime(last_day(o_orderdate), '%Y-%m-%d') as last,
              cast(julian(cast(o_orderdate as date)) as bigint) as julian from orders""",
)
def fn_date_build(spark, sf):
    d = F.to_date("o_orderdate")
    y, m, dd = F.year(d), F.month(d), F.dayofmonth(d)
    julian = F.datediff(d, F.lit("1970-01-01").cast("date")) + 2440588
    return table(spark, sf, "orders").select(
        "o_orderkey",
        day(F.make_date(y, m, F.lit(1))).alias("first_day"),
        text(F.make_timestamp_ntz(y, m, dd, F.lit(6), F.lit(30), F.lit(0))).alias("at"),
        day(F.date_add(d, 10)).alias("plus"),
        F.datediff(d, F.lit("1995-01-01").cast("date")).cast("bigint").alias("days"),
        day(F.last_day(d)).alias("last"),
        julian.cast("bigint").alias("julian"),
    )


@query(
    "fn_month_reverse_day",
    """select l_orderkey, l_linenumber, l_partkey,
              date_diff('day', cast(l_shipdate as date), cast(date_trunc('month', l_shipdate) + interval 1 month as date)) as rday
       from lineitem""",
)
def fn_month_reverse_day(spark, sf):
    rday = S.month_reverse_day(F.to_date("l_shipdate")).cast("bigint").alias("rday")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", rday)


@query(
    "fn_ts_format",
    f"""select event_id, {stamp('ts')} as shown, cast(strftime(ts, '%Y%m%d%H%M%S') as bigint) as load_id,
               {stamp("strptime(strftime(ts, '%Y%m%d%H%M%S'), '%Y%m%d%H%M%S')")} as back,
               strftime(strptime(strftime(ts, '%d.%m.%Y'), '%d.%m.%Y'), '%Y-%m-%d') as day from events""",
)
def fn_ts_format(spark, sf):
    number = S.load_number("ts")
    european = F.to_date(F.date_format("ts", "dd.MM.yyyy"), "dd.MM.yyyy")
    return table(spark, sf, "events").select(
        "event_id", text("ts").alias("shown"), number.alias("load_id"), text(S.load_time(number)).alias("back"),
        day(european).alias("day"),
    )


@query(
    "fn_null",
    """select o_orderkey, coalesce(nullif(o_orderstatus, 'O'), nullif(o_orderpriority, '5-LOW'), 'none') as first_known,
              nullif(o_orderstatus, 'O') is null as missing from orders""",
)
def fn_null(spark, sf):
    a, b = F.nullif("o_orderstatus", F.lit("O")), F.nullif("o_orderpriority", F.lit("5-LOW"))
    return table(spark, sf, "orders").select(
        "o_orderkey", F.coalesce(a, b, F.lit("none")).alias("first_known"), a.isNull().alias("missing")
    )


@query(
    "fn_math",
    """select l_orderkey, l_linenumber, l_partkey, cast(pow(2, l_linenumber) as bigint) as power, l_linenumber * 3 - 1 as lin,
              (((cast(year(l_shipdate) as bigint) * 100 + month(l_shipdate)) * 100 + day(l_shipdate)) * 100 + 7) * 100 + l_linenumber as packed
       from lineitem""",
)
def fn_math(spark, sf):
    n, d = F.col("l_linenumber"), F.col("l_shipdate")
    packed = S.pack_date(F.year(d), F.month(d), F.dayofmonth(d), F.lit(7), n)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.pow(F.lit(2), n).cast("bigint").alias("power"),
        (n * 3 - 1).alias("lin"), packed.alias("packed"),
    )


@query(
    "fn_cast",
    """select o_orderkey, cast(o_orderkey as varchar) as shown, cast(left(o_orderpriority, 1) as int) as grade,
              try_cast(o_orderpriority as int) as bad, cast(cast(o_orderdate as date) as varchar) as day from orders""",
)
def fn_cast(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderkey").cast("string").alias("shown"),
        F.left("o_orderpriority", F.lit(1)).cast("int").alias("grade"),
        F.col("o_orderpriority").try_cast("int").alias("bad"),
        F.to_date("o_orderdate").cast("string").alias("day"),
    )


@query(
    "fn_interval",
    f"""select event_id, {stamp('ts + to_minutes(user_id)')} as later, {stamp("ts - interval 90 minute")} as earlier from events""",
)
def fn_interval(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", text(S.shift_minutes("ts", "user_id")).alias("later"),
        text(S.shift_minutes("ts", F.lit(-90))).alias("earlier"),
    )


@query(
    "fn_unescape",
    r"""select doc_id, md5(regexp_replace(replace(replace(text, ' ', '\ '), 'e', '\\e') || '\', '\\(.?)', '\1', 'gs')) as digest
        from documents""",
)
def fn_unescape(spark, sf):
    escaped = F.replace(F.replace("text", F.lit(" "), F.lit("\\ ")), F.lit("e"), F.lit("\\\\e"))
    value = S.unescape(F.concat(escaped, F.lit("\\")))
    return table(spark, sf, "documents").select("doc_id", F.md5(value).alias("digest"))


@query(
    "fn_quote",
    """select doc_id, md5('"' || replace(text, '"', '\\"') || '"') as digest from documents""",
)
def fn_quote(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(S.quote("text")).alias("digest"))


@query(
    "fn_head_tail",
    """with l as (select p_partkey, [string_split(p_name, ' '), [p_brand], [p_type, p_brand]] as l from part)
       select p_partkey, array_to_string(l[1], ' ') as head, len(l[2:]) as n_tail, array_to_string(flatten(l[2:]), ' ') as tail from l""",
)
def fn_head_tail(spark, sf):
    lists = F.array(F.split("p_name", " "), F.array("p_brand"), F.array("p_type", "p_brand"))
    rows = table(spark, sf, "part").select("p_partkey", lists.alias("l"))
    return rows.select(
        "p_partkey", F.array_join(S.head("l"), " ").alias("head"), F.size(S.tail("l")).cast("bigint").alias("n_tail"),
        F.array_join(F.flatten(S.tail("l")), " ").alias("tail"),
    )


@query(
    "fn_zip_to_map",
    "select p_partkey, p_brand as b, p_type as t, 2 as n from part",
)
def fn_zip_to_map(spark, sf):
    m = S.zip_to_map(F.array(F.lit("b"), F.lit("t")), F.array("p_brand", "p_type"))
    rows = table(spark, sf, "part").select("p_partkey", m.alias("m"))
    return rows.select("p_partkey", F.col("m")["b"].alias("b"), F.col("m")["t"].alias("t"), F.size("m").alias("n"))


@query(
    "fn_map_merge",
    """select p_partkey, p_brand as a, case when p_size > 25 then p_type else p_name end as b,
              case when p_size > 25 then p_name end as c from part""",
)
def fn_map_merge(spark, sf):
    base = F.create_map(F.lit("a"), "p_brand", F.lit("b"), "p_name")
    over = F.when(F.col("p_size") > 25, F.create_map(F.lit("b"), "p_type", F.lit("c"), "p_name")).otherwise(
        F.create_map().cast("map<string,string>")
    )
    rows = table(spark, sf, "part").select("p_partkey", S.map_merge(over, base).alias("m"))
    return rows.select("p_partkey", *[F.col("m")[k].alias(k) for k in "abc"])


@query(
    "fn_render",
    """select p_partkey, 'aaa' || p_brand || p_type || '123' || '-' || p_brand as shown from part""",
)
def fn_render(spark, sf):
    x = S.join_list(F.array(F.array("p_brand"), F.array("p_type")))
    features = F.create_map(F.lit("x"), x, F.lit("y"), F.lit("${x}"), F.lit("b"), F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", render("aaa${x}123${none}-${b}", features).alias("shown"))


@query("fn_join_list", "select p_partkey, replace(p_name, ' ', '') || p_brand as joined from part")
def fn_join_list(spark, sf):
    lists = F.array(F.split("p_name", " "), F.array("p_brand"))
    return table(spark, sf, "part").select("p_partkey", S.join_list(lists).alias("joined"))
