"""Hierarchies: parts as a heap-shaped call tree, lists, series and templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import hierarchy as T
from tidemark.operators import reshape as R
from tidemark.operators.contraction import Monoid, contract
from workload.base import day, query, table, text

# Part k > 0 hangs below part (k - 1) div 2 at position (k - 1) % 2.  Parts with children
# are sequences or parallels by their type, the others are atoms.
TREE_CTE = """
  tree as (
    select p_partkey as id, case when p_partkey > 0 then (p_partkey - 1) // 2 end as parent_id,
           case when p_partkey > 0 then (p_partkey - 1) % 2 else 0 end as position,
           case when 2 * p_partkey + 1 > (select max(p_partkey) from part) then 2
                when p_type in ('ECONOMY', 'SMALL') then 0 else 1 end as kind,
           p_brand, p_type, p_name from part)"""


def part_tree(spark, sf):
    part = table(spark, sf, "part").withColumns(
        {
            "id": F.col("p_partkey"),
            "parent_id": F.expr("case when p_partkey > 0 then (p_partkey - 1) div 2 end"),
            "position": F.expr("case when p_partkey > 0 then cast((p_partkey - 1) % 2 as int) else 0 end"),
        }
    )
    inner = part.where("parent_id is not null").select(F.col("parent_id").alias("has")).distinct()
    kind = F.when(F.col("has").isNull(), T.ATOM).when(F.col("p_type").isin("ECONOMY", "SMALL"), T.SEQUENCE).otherwise(T.PARALLEL)
    joined = part.join(inner, F.col("id") == F.col("has"), "left").withColumn("kind", kind)
    return joined.select("id", "parent_id", "position", "kind", "p_brand", "p_type", "p_name")


def listed(c):
    return F.array_join(F.col(c).cast("array<string>"), ",")


@query(
    "split_ordered",
    """select p_partkey, generate_subscripts(string_split(p_name, ' '), 1)::int as order_num, unnest(string_split(p_name, ' ')) as word
       from part where p_name is not null and p_name <> ''""",
)
def split_ordered(spark, sf):
    return R.split_ordered(table(spark, sf, "part"), ["p_partkey"], "p_name", " ", "word")


PATHS_CTE = f"""{TREE_CTE},
  paths as (
    select id, cast(position as varchar) as path, 0 as depth from tree where parent_id is null
    union all
    select t.id, paths.path || ',' || t.position, depth + 1 from paths join tree t on t.parent_id = paths.id)"""


@query("tree_paths", f"with recursive {PATHS_CTE} select id, path, depth from paths")
def tree_paths(spark, sf):
    paths = T.tree_paths(part_tree(spark, sf), "id", "parent_id", "position")
    return paths.select("id", listed("path").alias("path"), "depth")


@query(
    "sort_path",
    f"""with recursive {TREE_CTE}, paths as (
        select id, [position] as path from tree where parent_id is null
        union all select t.id, list_append(paths.path, t.position) from paths join tree t on t.parent_id = paths.id)
    select id, row_number() over (order by path) as place from paths""",
)
def sort_path(spark, sf):
    from tidemark.plans.history import dense_keys

    paths = T.tree_paths(part_tree(spark, sf), "id", "parent_id", "position")
    return dense_keys(paths, ["path"], "place").select("id", "place").orderBy("place")


@query(
    "materialised_path_parent",
    f"""with recursive {PATHS_CTE}
    select id, case when contains(path, ',') then regexp_replace(path, ',[0-9]+$', '') else '' end as parent_path,
           cast(regexp_extract(path, '[0-9]+$') as int) as position from paths""",
)
def materialised_path_parent(spark, sf):
    paths = T.tree_paths(part_tree(spark, sf), "id", "parent_id", "position")
    return R.path_parent(paths, "path").select("id", listed("parent_path").alias("parent_path"), "position")


@query(
    "tree_flatten",
    f"""with recursive {TREE_CTE}, x as (
      select id, parent_id, position, kind, [position] as path, true as stays from tree where parent_id is null
      union all
      select t.id, case when x.stays then x.id else x.parent_id end, t.position, t.kind,
             list_append(x.path, t.position), t.kind <> x.kind
      from x join tree t on t.parent_id = x.id)
    select id, parent_id, row_number() over (partition by parent_id order by path) - 1 as position, kind from x where stays""",
)
def tree_flatten(spark, sf):
    return T.tree_flatten(part_tree(spark, sf), "id", "parent_id", "position", "kind")


# Conditions: parts dealt to 21 forests, of which a third have no call; in each a tree with long chains.
CONDITIONS_CTE = """
  nodes as (
    select p_partkey % 7 as task_id, nullif(p_partkey % 3, 0) as call_id, p_partkey // 21 as id,
           case when p_partkey >= 21 then greatest(p_partkey // 21 - 1 - p_size % 3, 0) end as parent_id, p_partkey // 21 as position,
           case when p_type in ('ECONOMY', 'SMALL', 'STANDARD') then 0 else 1 end as kind, p_brand from part)"""


@query(
    "flatten_conditions",
    f"""with recursive {CONDITIONS_CTE}, x as (
      select task_id, call_id, id, parent_id, kind, p_brand, [position] as path, true as stays from nodes where parent_id is null
      union all
      select t.task_id, t.call_id, t.id, case when x.stays then x.id else x.parent_id end, t.kind, t.p_brand,
             list_append(x.path, t.position), t.kind <> x.kind
      from x join nodes t on t.task_id = x.task_id and t.call_id is not distinct from x.call_id and t.parent_id = x.id)
    select task_id, call_id, id, parent_id, row_number() over (partition by task_id, call_id, parent_id order by path) - 1 as position, kind, p_brand
    from x where stays""",
)
def flatten_conditions(spark, sf):
    part = table(spark, sf, "part")
    nodes = part.selectExpr(
        "p_partkey % 7 as task_id", "nullif(p_partkey % 3, 0) as call_id", "p_partkey div 21 as id",
        "case when p_partkey >= 21 then greatest(p_partkey div 21 - 1 - p_size % 3, 0) end as parent_id", "p_partkey div 21 as position",
        "case when p_type in ('ECONOMY', 'SMALL', 'STANDARD') then 0 else 1 end as kind", "p_brand")
    return T.flatten_conditions(nodes)


# Precedence, found by climbing from each leaf one step at a time.
EDGES_CTE = f"""{TREE_CTE},
  climb as (
    select id as leaf, id, parent_id, position, true as first, true as last from tree where kind = 2
    union all
    select c.leaf, p.id, p.parent_id, p.position,
           c.first and (p.kind <> 0 or c.position = 0),
           c.last and (p.kind <> 0 or c.position = s.top)
    from climb c join tree p on p.id = c.parent_id
    join (select parent_id, max(position) as top from tree group by parent_id) s on s.parent_id = p.id
    where c.first or c.last),
  edges as (
    select 'node ' || c.leaf as src, 'gate ' || p.id || '.' || (c.position + 1) as dst
    from climb c join tree p on p.id = c.parent_id join tree n on n.parent_id = p.id and n.position = c.position + 1
    where c.last and p.kind = 0
    union all
    select 'gate ' || p.id || '.' || c.position, 'node ' || c.leaf
    from climb c join tree p on p.id = c.parent_id where c.first and p.kind = 0 and c.position > 0)"""


@query("dependency_edges", f"with recursive {EDGES_CTE} select src, dst from edges")
def dependency_edges(spark, sf):
    return T.dependency_edges(part_tree(spark, sf), "id", "parent_id", "position", "kind")


@query(
    "downstream_set",
    f"""with recursive {EDGES_CTE},
    first as (select 'node ' || id as n from tree where kind = 2 and p_brand = (select min(p_brand) from part)),
    reach as (select dst as n from edges where src in (select n from first)
              union select e.dst from reach r join edges e on e.src = r.n)
    select cast(n[6:] as bigint) as id from reach where n like 'node %'""",
)
def downstream_set(spark, sf):
    tree = part_tree(spark, sf)
    brand = tree.agg(F.min("p_brand").alias("p_brand"))
    starts = tree.where(F.col("kind") == T.ATOM).join(brand, "p_brand", "left_semi")
    return T.downstream_set(tree, starts, "id", "parent_id", "position", "kind")


@query(
    "ancestors",
    f"""with recursive {TREE_CTE}, up as (
      select id, parent_id as ancestor, 1 as distance from tree where parent_id is not null
      union all select up.id, t.parent_id, distance + 1 from up join tree t on t.id = up.ancestor where t.parent_id is not null)
    select * from up""",
)
def ancestors(spark, sf):
    return T.ancestors(part_tree(spark, sf), "id", "parent_id").select("id", "ancestor", "distance")


@query(
    "descendants",
    f"""with recursive {TREE_CTE}, down as (
      select id, 1 as distance from tree where parent_id = 1
      union all select t.id, distance + 1 from down join tree t on t.parent_id = down.id)
    select * from down""",
)
def descendants(spark, sf):
    return T.descendants(part_tree(spark, sf), "id", "parent_id", 1)


@query(
    "descendants_of_each",
    f"""with recursive {TREE_CTE}, down as (
      select p.id as start, t.id from tree t join tree p on p.id = t.parent_id where p.p_type = 'ECONOMY'
      union all select d.start, t.id from down d join tree t on t.parent_id = d.id)
    select start, id from down""",
)
def descendants_of_each(spark, sf):
    tree = part_tree(spark, sf)
    return T.descendants_of_each(tree, tree.where("p_type = 'ECONOMY'"), "id", "parent_id", "position")


@query(
    "downstream_of_each",
    f"""with recursive {EDGES_CTE},
    first as (select id as start, 'node ' || id as n from tree where kind = 2 and p_brand in (select distinct p_brand from part order by 1 limit 3)),
    reach as (select start, dst as n from edges join first on n = src
              union select r.start, e.dst from reach r join edges e on e.src = r.n)
    select start, cast(n[6:] as bigint) as id from reach where n like 'node %'""",
)
def downstream_of_each(spark, sf):
    tree = part_tree(spark, sf)
    brands = tree.select("p_brand").distinct().orderBy("p_brand").limit(3)
    starts = tree.where(F.col("kind") == T.ATOM).join(brands, "p_brand", "left_semi")
    return T.downstream_of_each(tree, starts, "id", "parent_id", "position", "kind")


@query(
    "successors",
    """with recursive e as (select distinct o_custkey as a, (o_custkey * 7 + o_orderkey) % (select count(*) from customer) as b from orders),
    r as (select b as node from e where a = (select min(a) from e) union select e.b from r join e on e.a = r.node)
    select node from r where node <> (select min(a) from e)""",
)
def successors(spark, sf):
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer").count()
    edges = orders.select(F.col("o_custkey").alias("a"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % customers).alias("b")).distinct()
    starts = edges.agg(F.min("a").alias("node"))
    return T.reachable(edges, starts, "a", "b").select("node")


@query(
    "predecessors",
    """with recursive e as (select distinct o_custkey as a, (o_custkey * 7 + o_orderkey) % (select count(*) from customer) as b from orders),
    r as (select a as node from e where b = (select max(b) from e) union select e.a from r join e on e.b = r.node)
    select node from r where node <> (select max(b) from e)""",
)
def predecessors(spark, sf):
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer").count()
    edges = orders.select(F.col("o_custkey").alias("a"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % customers).alias("b")).distinct()
    return T.predecessors(edges, edges.agg(F.max("b").alias("node")), "a", "b").select("node")


@query(
    "tree_two_level",
    f"""with recursive {TREE_CTE},
    nodes as (select * from (values (0, 1, null, 0, 0, null), (0, 2, 1, 0, 2, 0), (0, 3, 1, 1, 2, 1),
                                    (1, 1, null, 0, 1, null), (1, 2, 1, 0, 2, 0), (1, 3, 1, 1, 2, 1))
              as v(task, id, parent_id, position, kind, call)),
    inst as (select id, parent_id, position as call, kind as task, p_brand, string_split(p_name, ' ') as ident from tree),
    x as (
      select i.id as inst, n.id as node, [n.position] as path, n.kind, n.call, i.task from inst i join nodes n on n.task = i.task
      where i.parent_id is null and n.parent_id is null
      union all
      select t.inst, t.node, list_append(x.path, t.position), t.kind, t.call, t.task from x join (
        select i.id as inst, i.parent_id as inst_up, i.call as inst_call, i.task, n.id as node, n.parent_id as node_up,
               n.position, n.kind, n.call from inst i join nodes n on n.task = i.task) t
      on t.inst_up = x.inst and t.node_up is null and t.inst_call = x.call
         or t.inst = x.inst and t.node_up = x.node)
    select array_to_string(path, ',') as path,
           repeat(' ', 2 * len(path)) || case when x.kind = 2 then 'Task ' || i.p_brand || ' ' || array_to_string(i.ident, ' ')
                else case x.kind when 0 then 'sequence' else 'parallel' end end as node
    from x left join inst i on i.parent_id = x.inst and i.call = x.call
    union all select '', 'main'""",
)
def tree_two_level(spark, sf):
    tree = part_tree(spark, sf)
    instances = tree.select(
        "id", "parent_id", F.col("position").alias("call_id"), F.col("id").alias("name_id"), F.col("kind").alias("task_id"),
        F.concat(F.array("p_brand"), F.split("p_name", " ")).alias("identifier"),
    ).drop("name_id")
    rows = [(k, n, up, pos, kind, call) for k in (T.SEQUENCE, T.PARALLEL)
            for n, up, pos, kind, call in ((1, None, 0, k, None), (2, 1, 0, T.ATOM, 0), (3, 1, 1, T.ATOM, 1))]
    nodes = spark.createDataFrame(rows, "task_id int, id bigint, parent_id bigint, position int, kind int, call_id int")
    names = spark.createDataFrame([(k, "Task") for k in (0, 1, 2)], "task_id int, name string")
    out = T.tree_two_level(instances, nodes, names, "main", {0: "sequence", 1: "parallel"})
    return out.select(listed("path").alias("path"), "node")


@query(
    "bottom_up_fold",
    f"""with recursive {TREE_CTE}, leaf as (
      select id, parent_id, kind, length(p_name) as v from tree),
    up as (select id as leaf, id, v from leaf where kind = 2
           union all select up.leaf, l.parent_id, up.v from up join leaf l on l.id = up.id where l.parent_id is not null)
    select id, sum(v)::bigint as total from up group by id""",
)
def bottom_up_fold(spark, sf):
    tree = part_tree(spark, sf)
    value = F.when(F.col("kind") == T.ATOM, F.length("p_name").cast("bigint"))
    nodes = tree.select("id", "parent_id", value.alias("total"))
    return contract(nodes, "id", "parent_id", "total", Monoid("sum")).select("id", "total")


@query(
    "inherit_attributes",
    f"""with recursive {TREE_CTE}, x as (
      select id, p_brand as brand, p_type as kind, p_type || '/' || p_brand as label, p_brand as trail
      from tree where parent_id is null
      union all
      select t.id, t.p_brand, case when t.p_type < 'N' then t.p_type else x.kind end,
             case when t.p_type < 'N' then t.p_type else x.kind end || '/' || t.p_brand,
             case when length(x.trail) < 20 then x.trail || '>' || t.p_brand else t.p_brand end
      from x join tree t on t.parent_id = x.id)
    select id, brand, kind, label from x""",
)
def inherit_attributes(spark, sf):
    tree = part_tree(spark, sf)
    own_kind = F.col("p_type") < "N"
    own_kind = own_kind | F.col("parent_id").isNull()
    nodes = tree.select(
        "id", "parent_id",
        F.create_map(F.lit("brand"), "p_brand").alias("identifiers"),
        F.when(own_kind, F.create_map(F.lit("kind"), "p_type")).alias("call"),
        F.create_map(F.lit("label"), F.lit("${kind}/${brand}")).alias("task"),
    )
    out = T.inherit_attributes(nodes, "id", "parent_id", ["identifiers", "call", "task"], "features")
    return out.select("id", *[F.col("features")[k].alias(k) for k in ("brand", "kind", "label")])


@query(
    "fan_out_list",
    """with l as (select p_partkey, string_split(p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_size, ' ') as l from part),
    g as (select p_partkey, l, unnest(range(0, (len(l) + 2) // 3)) as i from l)
    select p_partkey, (i + 1)::int as iteration, l[3 * i + 1] as first, l[3 * i + 2] as second, l[3 * i + 3] as third from g""",
)
def fan_out_list(spark, sf):
    words = F.split(F.concat_ws(" ", "p_name", "p_brand", "p_type", "p_size"), " ")
    lists = table(spark, sf, "part").select("p_partkey", words.alias("l"))
    return R.fan_out_list(lists, ["p_partkey"], "l", ["first", "second", "third"])


@query(
    "number_series",
    "select p_partkey, unnest(range(0, p_size + 1)) as n from part",
)
def number_series(spark, sf):
    return R.number_series(table(spark, sf, "part"), ["p_partkey"], "p_size", "n")


@query(
    "date_series",
    """select c_custkey, s::int as seq, strftime(a - to_days(cast(s as integer)), '%Y-%m-%d') as d
       from (select o_custkey as c_custkey, min(o_orderdate) as a from orders group by 1), range(0, 10) r(s)""",
)
def date_series(spark, sf):
    first = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("a"))
    return R.date_series(first, ["c_custkey"], "a", 10, -1, "d").withColumn("d", day("d"))


@query(
    "minute_series",
    """with l as (select user_id, date_trunc('minute', max(ts)) as a from events group by user_id)
    select user_id, cast(s as integer) as seq, strftime(a + to_minutes(s), '%Y-%m-%d %H:%M:%S') as t from l, range(0, 121) r(s)""",
)
def minute_series(spark, sf):
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("a"))
    return R.minute_series(last, ["user_id"], "a", 120, "t").select("user_id", "seq", text("t").alias("t"))


@query(
    "nth_minute",
    """with l as (select user_id, date_trunc('minute', max(ts)) as a from events group by user_id),
    m as (select user_id, a + to_minutes(s) as t from l, range(0, 121) r(s)),
    f as (select user_id, t, row_number() over (partition by user_id order by t) as nth from m where minute(t) in (0, 15, 45))
    select user_id, strftime(t, '%Y-%m-%d %H:%M:%S') as third_match from f where nth = 3""",
)
def nth_minute(spark, sf):
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("a"))
    third = R.nth_minute(last, "a", 120, 3, lambda t: F.minute(t).isin(0, 15, 45), "t")
    return third.select("user_id", text("t").alias("third_match"))


TEMPLATE = "load ${nation} of ${region}${missing} for ${nation}}; cost ${ x"


@query(
    "render_template",
    """select c_custkey, 'load ' || n_name || ' of ' || r_name || ' for ' || n_name || '}; cost ' as statement
       from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey""",
)
def render_template(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    joined = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    joined = joined.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    features = F.create_map(F.lit("nation"), "n_name", F.lit("region"), "r_name")
    rendered = R.render_template(joined.withColumn("features", features), TEMPLATE, "features", "statement")
    return rendered.select("c_custkey", "statement")
