"""The given tables as the engine's inputs: entities, references, messages, receipts.

Each input is SQL text with the tables in braces, so that Spark and the oracle
build the same rows; everything after this point is built twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storynet.functions.shared import saved, ship_package, shuffles_freed

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "conversations")
MISSING = 1_000_000_000


def eid(kind: str, letter: str, key: str) -> str:
    """An id of the shape type_0L + 24 digits."""
    return f"'{kind}_0{letter}' || lpad(cast({key} as string), 24, '0')"


LOCATION, REGION = (lambda k: eid("location", "N", k)), (lambda k: eid("location", "R", k))
CHARACTER, ORGANIZATION = (lambda k: eid("character", "C", k)), (lambda k: eid("organization", "S", k))
ITEM, EVENT = (lambda k: eid("item", "P", k)), (lambda k: eid("event", "E", k))
MEMORY, RELATION = (lambda k: eid("memory", "M", k)), (lambda k: eid("character_relation", "K", k))
CONCEPT, SKILL = (lambda k: eid("concept", "T", k)), (lambda k: eid("skill", "B", k))

#: Lines numbered within their order, since (l_orderkey, l_linenumber) repeats.
LINES = """
select l_orderkey, l_partkey, l_suppkey, l_returnflag, l_quantity,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
    l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as seq
from {lineitem}"""
MEMORIES = f"""
select {MEMORY("l_orderkey * 100 + seq")} as id, l_orderkey, seq, o_custkey, l_quantity
from {{lines}} l join {{orders}} o on o.o_orderkey = l.l_orderkey where l_returnflag = 'R'"""
PAIRS = """
select c_custkey as a, b from (
  select c_custkey, lead(c_custkey) over (partition by c_nationkey order by c_custkey) as b from {customer}) p where b is not null"""

ENTITIES = f"""
select {LOCATION("n_nationkey")} as id, 'location' as type, n_name as name, 'nation' as description from {{nation}}
union all select {REGION("r_regionkey")}, 'location', r_name, 'region' from {{region}}
union all select {CHARACTER("c_custkey")}, 'character', c_name, c_mktsegment from {{customer}}
union all select {ORGANIZATION("s_suppkey")}, 'organization', s_name, 'supplier' from {{supplier}}
union all select {ITEM("p_partkey")}, 'item', p_name, p_type from {{part}}
union all select {CONCEPT("dense_rank() over (order by p_type)")}, 'concept', p_type, 'part type' from (select distinct p_type from {{part}}) t
union all select {SKILL("dense_rank() over (order by p_brand)")}, 'skill', p_brand, 'brand' from (select distinct p_brand from {{part}}) t
union all select {EVENT("o_orderkey")}, 'event', 'order ' || cast(o_orderkey as string), o_orderstatus from {{orders}}
union all select id, 'memory', 'memory ' || cast(l_orderkey as string), 'returned' from {{memories}} m
union all select {RELATION("a")}, 'character_relation', 'pair ' || cast(a as string), 'neighbours' from ({PAIRS}) p"""

_PART = f"""
select p_partkey, p_size, p_type, p_brand, p_partkey % 3 as k, cast(floor(p_partkey / 3) as bigint) as j,
  (select max(p_partkey) from {{part}}) as top from {{part}}"""
#: src_id, src_type, component, ord, role, num, tgt_id, tgt_type; targets that do not exist or have another type are injected by key.
REFS = f"""
select {CHARACTER("c_custkey")} as src_id, 'character' as src_type, 'current_location_reference' as component, cast(0 as bigint) as ord,
  'present' as role, cast(0 as bigint) as num,
  {LOCATION(f"c_nationkey + case when c_custkey % 97 = 0 then {MISSING} else 0 end")} as tgt_id, 'location' as tgt_type from {{customer}}
union all select {LOCATION("n_nationkey")}, 'location', 'parent_location_reference', 0, null, 0, {REGION("n_regionkey")}, 'location' from {{nation}}
union all select {ORGANIZATION("s_suppkey")}, 'organization', 'parent_organization_reference', 0, null, 0,
  {ORGANIZATION("case when s_suppkey % 10 <> 0 then s_suppkey - 1 else s_suppkey + 4 end")}, 'organization' from {{supplier}}
  where s_suppkey % 10 <> 0 or cast(floor(s_suppkey / 10) as bigint) % 3 = 0
union all select {ITEM("p_partkey")}, 'item', 'current_placement_reference', 0,
  case k when 0 then case p_partkey % 9 when 0 then 'carried' when 3 then 'equipped' else 'worn' end
    when 1 then 'contained' else case when p_partkey % 2 = 0 then 'placed' else 'stored' end end, 0,
  case k when 0 then {CHARACTER("p_partkey % 100")}
    when 1 then {ITEM("case when j % 10 <> 0 then p_partkey - 3 when cast(floor(j / 10) as bigint) % 5 = 2 and p_partkey + 9 <= top then p_partkey + 9 else p_partkey - 1 end")}
    else {LOCATION("p_partkey % 25")} end,
  case k when 0 then 'character' when 1 then 'item' else 'location' end from ({_PART}) p
union all select {ITEM("p_partkey")}, 'item', 'related_concept_reference', 0, null, 0, {CONCEPT("r")}, 'concept'
  from {{part}} p join (select p_type, dense_rank() over (order by p_type) as r from (select distinct p_type from {{part}}) t) d on d.p_type = p.p_type
union all select {CHARACTER("c_custkey")}, 'character', 'skill_reference', 0, null, 0, {SKILL("c_custkey % 25 + 1")}, 'skill' from {{customer}}
union all select {EVENT("o_orderkey")}, 'event', 'event_related_entity_reference', 0, null, 0, {CHARACTER("o_custkey")}, 'character' from {{orders}}
union all select {EVENT("l_orderkey")}, 'event', 'event_related_entity_reference', seq, null, 0,
  {ITEM(f"l_partkey + case when l_partkey % 97 = 0 then {MISSING} else 0 end")},
  case when l_partkey % 89 = 0 then 'concept' else 'item' end from {{lines}} l
union all select {EVENT("l_orderkey")}, 'event', 'event_location_reference', seq, null,
  case when l_orderkey % 79 = 0 and seq > 1 then seq - 1 else seq end, {LOCATION("s_nationkey")}, 'location'
  from {{lines}} l join {{supplier}} s on s.s_suppkey = l.l_suppkey
union all select id, 'memory', 'memory_owner_reference', 0, null, 0, {CHARACTER("o_custkey")}, 'character' from {{memories}} m
union all select id, 'memory', 'source_event_reference', 0, null, 0, {EVENT("l_orderkey")}, 'event' from {{memories}} m
union all select id, 'memory', 'relation_context_reference', 0,
  case l_orderkey % 3 when 0 then 'important' when 1 then 'current_basis' else 'formation_basis' end, seq % 3, {RELATION("o_custkey")}, 'character_relation'
  from {{memories}} m join ({PAIRS}) p on p.a = m.o_custkey
union all select {CHARACTER("o_custkey + case when l_orderkey % 83 = 0 then 1 else 0 end")}, 'character', 'memory_reference', l_orderkey * 100 + seq,
  null, 0, id, 'memory' from {{memories}} m where l_quantity >= 45
union all select {RELATION("a")}, 'character_relation', 'relation_endpoint_reference', 0, null, 0, {CHARACTER("a")}, 'character' from ({PAIRS}) p
union all select {RELATION("a")}, 'character_relation', 'relation_endpoint_reference', 1, null, 0, {CHARACTER("b")}, 'character' from ({PAIRS}) p"""

CONTAINERS = f"select {ITEM('p_partkey')} as id from {{part}} where p_size % 2 = 0"
MESSAGES = """
select cast(conv_id as string) as chat_id, turn as floor, role, coalesce(text, '') as content, 'floor-' || cast(turn as string) as source_id
from {conversations}"""
#: Receipts cover two turns each; every seventh interval of a chat is missing.
RECEIPTS = """
select distinct cast(conv_id as string) as chat_id, cast(floor(turn / 2) as bigint) * 2 as start_floor,
  cast(floor(turn / 2) as bigint) * 2 + 1 as end_floor
from {conversations} where (cast(floor(turn / 2) as bigint) + conv_id) % 7 <> 3"""
CHAT_EVENTS = """
select cast(user_id as string) as chat_id, event_id, row_number() over (partition by user_id order by ts, event_id) as event_no,
  event_type, value from {events}"""


#: Inputs that others are made of, each built once and saved.
BUILT = {"lines": LINES, "memories": MEMORIES}


def load(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Rows of one of the inputs above, or of any SQL with the tables in braces."""
    ship_package(spark)
    return spark.sql(sql, **_inputs(spark, sf_dir, sql, {}))


def load_all(spark: SparkSession, sf_dir: str, *sqls: str) -> tuple[DataFrame, ...]:
    """Rows of several inputs; what they are made of is built once for all."""
    ship_package(spark)
    built: dict[str, DataFrame] = {}
    return tuple(spark.sql(sql, **_inputs(spark, sf_dir, sql, built)) for sql in sqls)


def _inputs(spark: SparkSession, sf_dir: str, sql: str, built: dict[str, DataFrame]) -> dict[str, DataFrame]:
    used = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in NAMES if f"{{{n}}}" in sql}
    for name, rows in BUILT.items():
        if f"{{{name}}}" in sql:
            if name not in built:
                with shuffles_freed(spark):
                    built[name] = saved(spark.sql(rows, **_inputs(spark, sf_dir, rows, built)))
            used[name] = built[name]
    return used


def oracle(sql: str) -> str:
    """The same SQL over the oracle's views."""
    names = {n: n for n in NAMES}
    for name, rows in BUILT.items():
        names[name] = f"({rows.format(**names)})"
    return sql.format(**names)
