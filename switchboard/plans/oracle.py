"""The same results in plain SQL for an independent engine, over views of the test tables."""

from __future__ import annotations

SHORT = (
    "case when contains({c}, ':') "
    "then string_split(string_split({c}, ':')[-1], '.')[-1] else {c} end"
)

METHOD_ROWS = """
method_rows as (
 select cast(p_partkey as bigint) as seq, cast(p_partkey as varchar) as method_id,
  case when p_partkey % 10 = 9 then concat('<operator>.', lower(p_type))
       when p_partkey % 10 = 8 then concat('lib.', replace(p_name, ' ', '_'))
       when p_partkey % 10 = 7 then concat('src/m', p_size, '.py:<module>')
       when p_partkey % 10 = 6 then concat('src/m', p_size, '.py:', replace(p_name, ' ', '_'))
       else concat('src/m', p_size, '.py:<module>.', p_type, '.', replace(p_name, ' ', '_'))
  end as full_name,
  case when p_partkey % 3 = 0 then '' else concat('def(', p_brand, ')') end as signature,
  case when p_partkey % 10 >= 8 then '<unknown>'
       else concat('/repo/src/m', p_size, '.py') end as file
 from part
 union all
 select case when s_suppkey % 2 = 0 then 1000000000 else -1000000000 end
   + cast(s_suppkey as bigint), cast(s_suppkey as varchar),
  concat('src/dup.py:<module>.Dup.n', s_nationkey), 'def()', '/repo/src/dup.py'
 from supplier)"""

CALLS = """
calls as (
 select cast(case when l_linenumber = 7 then l_partkey + 900000000 else l_partkey end as varchar)
   as caller_id,
  concat('src/c.py:<module>.f', l_partkey) as caller_full_name,
  '/repo/src/c.py' as caller_file,
  case l_returnflag when 'N' then '-1' when 'R' then cast(l_suppkey as varchar)
       else cast(l_orderkey as varchar) end as callee_id,
  case when l_returnflag = 'R' then 'stale.py:<module>.ignored'
       when l_returnflag = 'A' then concat('dyn/d', l_linenumber, '.py:<module>.go')
       when l_linestatus = 'O' then '<unknownFullName>'
       when l_linenumber = 1 then ''
       else concat('ext.e', l_linenumber) end as callee_full_name,
  case when l_returnflag = 'N' then '<unknown>' else '/repo/src/e.py' end as callee_file,
  '/repo/src/c.py' as callsite_file,
  cast(l_linenumber as varchar) as callsite_line
 from lineitem)"""

METHODS = """
methods as (
 select method_id, full_name, signature, file from (
  select *, row_number() over (partition by method_id order by seq desc) rn from method_rows) t
 where rn = 1)"""

NAMES = f"""
names as (
 select {SHORT.format(c="full_name")} as fn, method_id, min(seq) as seq
 from method_rows group by all)"""

REQUESTS = """
requests as (
 select replace(p_name, ' ', '_') as function from part
 union select lower(n_name) from nation
 union select concat('n', n_nationkey) from nation)"""

CALLERS = """
callers as (
 select distinct n.fn, m.full_name as caller
 from names n join calls k on k.callee_id = n.method_id
 join methods m on m.method_id = k.caller_id)"""

CALLEES = """
callees as (
 select distinct n.fn,
  case when m.method_id is not null then m.full_name else k.callee_full_name end as callee
 from names n join calls k on k.caller_id = n.method_id
 left join methods m on m.method_id = k.callee_id and k.callee_id <> '-1'
 where m.method_id is not null
    or (k.callee_full_name is not null and k.callee_full_name not in ('', '<unknownFullName>')))"""

DETAILS = """
details as (
 select fn, method_id, full_name, signature, file from (
  select n.fn, m.*, row_number() over (partition by n.fn order by n.seq) rn
  from names n join methods m using (method_id)) t
 where rn = 1)"""

GRAPH = f"with {METHOD_ROWS}, {METHODS}, {NAMES}, {CALLS}"

# An updated graph counts its rows by file, and by their order within it.
BY_FILE = f"""with {METHOD_ROWS.replace("method_rows as", "read_rows as")}, method_rows as (
 select row_number() over (order by file, seq) as seq, method_id, full_name, signature, file
 from read_rows), {METHODS}, {NAMES}, {CALLS}"""

NODES = """with
meta as (select concat('/', lower(r_name)) as root from region where r_regionkey = 0),
m as (
 select p_partkey as method_id, p_brand as signature,
  concat('src/m', p_size, '.py:<module>.', replace(p_name, ' ', '_')) as full_name,
  case when p_partkey % 10 = 9 then '<unknown>'
       else concat((select root from meta), '/src/m', p_size, '.py') end as file,
  concat((select root from meta), '/src/m', p_size, '.py') as site_file
 from part),
sites as (
 select o_orderkey as call_id, o_custkey as caller_id,
  concat('ext.s', o_orderstatus) as method_full_name,
  case when o_orderpriority = '5-LOW' then null else cast(o_orderkey % 500 as int) end
   as line_number
 from orders),
first_targets as (
 select call_id, callee_id from (
  select l_orderkey as call_id, l_partkey as callee_id, row_number() over
   (partition by l_orderkey order by l_linenumber, l_partkey) rn from lineitem) t
 where rn = 1),
resolved as (
 select s.call_id, s.caller_id, mc.full_name as caller_full_name, mc.file as caller_file,
  coalesce(f.callee_id, -1) as callee_id,
  coalesce(me.full_name, s.method_full_name) as callee_full_name,
  coalesce(me.file, '<unknown>') as callee_file, mc.site_file as callsite_file,
  coalesce(s.line_number, -1) as callsite_line
 from sites s join m mc on mc.method_id = s.caller_id
 left join first_targets f on f.call_id = s.call_id
 left join m me on me.method_id = f.callee_id)"""

MERGED = (
    "r.method_id, r.full_name, r.signature, r.file, k.caller_id, k.caller_full_name, "
    "k.caller_file, k.callee_id, k.callee_full_name, k.callee_file, k.callsite_file, "
    "k.callsite_line"
)

FOLDED_PATH = """
with asked as (
 select page_id,
  case page_id % 6 when 0 then url when 1 then concat('./', url, '/')
   when 2 then concat('../../../', url) when 3 then concat(url, '/../x/./../../y')
   when 4 then concat('a//b/.././', url) else concat(url, '/..') end as rel,
  case page_id % 4 when 0 then '/srv/pages' when 1 then '' when 2 then 'crawl' else '/' end as root
 from pages),
joined as (select *, case when root = '' then rel else concat(root, '/', rel) end as p from asked),
folded as (
 select page_id, rel, p, list_reduce(
   list_transform(list_filter(string_split(p, '/'), lambda s: s not in ('', '.')), lambda s: [s]),
   lambda a, s: case when s[1] <> '..' then list_concat(a, s)
    when len(a) > 0 and a[-1] <> '..' then a[:-2]
    when starts_with(p, '/') then a else list_concat(a, s) end,
   []::varchar[]) as parts
 from joined)
select page_id, case when rel is null or rel in ('', '<unknown>') then '<unknown>'
 else concat(case when starts_with(p, '/') then '/' else '' end,
  array_to_string(parts, '/')) end as path
from folded"""


def _document(found: str, item: str, requests: str, asked: str, listed: str) -> str:
    """SQL for the lines of list documents, given ``found`` and ``requests`` relations."""
    return f"""
ends as (select fn, count(*) as n, max({item}) as last_item from {found} group by fn),
counted as (
 select r.function, coalesce(e.n, 0) as n
 from (select distinct function from {requests}) r left join ends e on e.fn = r.function)
select f.fn as function, 1 as section, f.{item} as item,
 concat('    ', to_json(f.{item})::varchar, case when f.{item} < e.last_item then ',' else '' end)
  as text
from {found} f join ends e on e.fn = f.fn where f.fn in (select function from {requests})
union all
select function, 0, '', concat('{{', chr(10), '  "{asked}": ', to_json(function)::varchar, ',',
 chr(10), '  "{listed}": [', case when n = 0 then '],' else '' end)
from counted
union all
select function, 2, '', concat(case when n = 0 then '' else concat('  ],', chr(10)) end,
 '  "count": ', n, ',', chr(10), '  "success": true', chr(10), '}}')
from counted"""


def _stats(by: str, columns: str, suffix: str = "") -> str:
    return (
        f"select {by} round(sum(l_quantity), 6) as total, round(avg(l_quantity), 6) as average, "
        f"round(stddev_pop(l_quantity), 6) as std_dev from lineitem {columns}{suffix}"
    )


NORMALIZED = (
    "case when s.lo = s.hi or s.dev = 0 then {x} else ({x} - s.mean) / s.dev end"
)


def _group_stats(value: str, by: str) -> str:
    return (
        f"select {by} as k, sum({value}) as total, avg({value}) as mean, "
        f"stddev_pop({value}) as dev, min({value}) as lo, max({value}) as hi "
        f"from lineitem group by {by}"
    )


SEARCH = """
search as (
 select distinct 'BOLT' as fn, fn as name from names
 where contains(lower(fn), lower('BOLT')))"""

ONE_CALLER = f"{GRAPH}, {CALLERS} select distinct caller from callers where fn = 'blue_bolt'"



def _answer(relations: str, found: str, item: str, asked: str, listed: str, argument: str) -> str:
    """SQL for the lines of one answer, given ``relations`` that include ``found``."""
    question = f"asked as (select '{argument}' as function), "
    document = _document(found, item, "asked", asked, listed)
    return f"select text from ({relations}, {question}{document}) lines"


SOURCE_METHODS = """
p as (
 select p_partkey as k, concat('parts/p', p_partkey, '.py') as path,
  concat(upper(left(p_type, 1)), lower(substr(p_type, 2))) as type from part),
o as (
 select o_orderkey as k, o_custkey as part, concat('orders/o', o_orderkey, '.py') as path
 from orders),
d as (select doc_id as k, concat('docs/d', doc_id, '.py') as path from documents)"""

# Customers with their opener and region; orders with their customer, where there is one.
CLASS_ROWS = """people as (
 select c_custkey as k, n_nationkey as nation,
  concat('people/c', c_custkey, '.py:<module>.Customer', c_custkey) as own,
  concat('people/c', c_custkey, '.py:<module>.open_', c_custkey) as opener,
  concat('world/r', n_regionkey, '.py:<module>.Region', n_regionkey) as top
 from customer join nation on n_nationkey = c_nationkey
), desks as (
 select o_orderkey as k, o_custkey as customer,
  concat('sales/o', o_orderkey, '.py:<module>.Desk', o_orderkey) as desk,
  own, opener, top, own is not null as known
 from orders left join people on people.k = o_custkey)"""

ORACLE_SQL = {
    "short_name": f"""with {METHOD_ROWS}, texts as (
 select full_name from method_rows union all select url from pages union all select html from pages)
select full_name, {SHORT.format(c="full_name")} as fn from texts""",
    "abs_path": FOLDED_PATH,
    "scan_methods": f"with {METHOD_ROWS}, {METHODS} select * from methods",
    "scan_calls": f"with {CALLS} select * from calls",
    "export_methods": f"""{NODES}
select cast(method_id as varchar) as method_id, full_name, signature, file from m
union all
select cast(1000000000 + doc_id as varchar),
 concat('corpus/', source, '.py:<module>.doc', doc_id), text,
 concat((select root from meta), '/corpus/', source, '.py')
from documents""",
    "export_calls": f"""{NODES}
select cast(caller_id as varchar) as caller_id, caller_full_name, caller_file,
 cast(callee_id as varchar) as callee_id, callee_full_name, callee_file, callsite_file,
 cast(callsite_line as varchar) as callsite_line
from resolved""",
    "json_roundtrip": "select doc_id, text, lang, source, n_chars from documents",
    "json_nested_roundtrip": """select event_id, event_type, value,
 cast(json_extract(props, '$.k') as bigint) as k from events""",
    "project_methods": f"{NODES} select method_id, full_name, signature, file from m",
    "resolve_calls": f"{NODES} select * from resolved",
    "method_map": f"with {METHOD_ROWS}, {METHODS} select * from methods",
    "name_index": f"with {METHOD_ROWS}, {NAMES} select * from names",
    "json_indented": "select c_custkey, c_name, c_acctbal from customer",
    "snapshot_callers_of": ONE_CALLER,
    "snapshot_callees_of": f"{GRAPH}, {CALLEES} select distinct callee from callees where fn = 'n15'",
    "updated_callers": f"{BY_FILE}, {CALLERS} select * from callers",
    "updated_callees": f"{BY_FILE}, {CALLEES} select * from callees",
    "callers_of": ONE_CALLER,
    "callees_of": f"{GRAPH}, {CALLEES} select distinct callee from callees where fn = 'n15'",
    "function_details": f"""{GRAPH}, {DETAILS}
select method_id, full_name, signature, file from details where fn = 'blue_bolt'""",
    "search_functions": f"""with {METHOD_ROWS}, {NAMES}
select distinct fn from names where contains(lower(fn), lower('BOLT'))""",
    "snapshot_search": f"""with {METHOD_ROWS}, {NAMES}
select distinct fn from names where contains(lower(fn), lower('BOLT'))""",
    "search_for": f"""with {METHOD_ROWS}, {NAMES}, words as (
 select unnest(string_split(p_name, ' ')) as word from part
), asked as (
 select upper(word) as query from words union select substr(word, 1, 1) from words
 union select substr(word, 2, 2) from words union select n_name from nation
), known as (select distinct fn from names)
select query, fn from asked join known on contains(lower(fn), lower(query))""",
    "graph_stats": f"""{GRAPH}
select (select count(*) from methods) as total_methods, (select count(*) from calls) as total_calls,
 (select count(distinct fn) from names) as unique_functions""",
    "calls_with_caller": f"""{GRAPH}
select {MERGED} from method_rows r join calls k on r.method_id = k.caller_id""",
    "calls_with_callee": f"""{GRAPH}
select {MERGED} from method_rows r join calls k on r.method_id = k.callee_id""",
    "callers_all": f"{GRAPH}, {CALLERS} select * from callers",
    "callees_all": f"{GRAPH}, {CALLEES} select * from callees",
    "details_all": f"{GRAPH}, {DETAILS} select * from details",
    "callers_for": f"""{GRAPH}, {CALLERS}, {REQUESTS}
select function, caller from requests left join callers on fn = function""",
    "callees_for": f"""{GRAPH}, {CALLEES}, {REQUESTS}
select function, callee from requests left join callees on fn = function""",
    "details_for": f"""{GRAPH}, {DETAILS}, {REQUESTS}
select function, method_id, full_name, signature, file
from requests left join details on fn = function""",
    "callers_json": f"{GRAPH}, {CALLERS}, {REQUESTS}, "
    + _document("callers", "caller", "requests", "function", "callers"),
    "callees_json": f"{GRAPH}, {CALLEES}, {REQUESTS}, "
    + _document("callees", "callee", "requests", "function", "callees"),
    "answer_callers": _answer(
        f"{GRAPH}, {CALLERS}", "callers", "caller", "function", "callers", "blue_bolt"
    ),
    "answer_callees": _answer(
        f"{GRAPH}, {CALLEES}", "callees", "callee", "function", "callees", "n15"
    ),
    "answer_search": _answer(
        f"with {METHOD_ROWS}, {NAMES}, {SEARCH}", "search", "name", "query", "results", "BOLT"
    ),
    "details_json": f"""{GRAPH}, {DETAILS}, {REQUESTS}
select function, case when method_id is null
 then concat('{{"function":', to_json(function)::varchar,
  ',"details":null,"success":false,"error":"Function not found"}}')
 else concat('{{"function":', to_json(function)::varchar, ',"details":{{"method_id":',
  to_json(method_id)::varchar, ',"full_name":', to_json(full_name)::varchar, ',"signature":',
  to_json(signature)::varchar, ',"file":', to_json(file)::varchar, '}},"success":true}}')
 end as json
from requests left join details on fn = function""",
    "search_json": f"with {METHOD_ROWS}, {NAMES}, {SEARCH}, asked as (select 'BOLT' as function), "
    + _document("search", "name", "asked", "query", "results"),
    "stats_json": f"""{GRAPH}
select concat('{{"total_methods":', (select count(*) from methods), ',"total_calls":',
 (select count(*) from calls), ',"unique_functions":', (select count(distinct fn) from names),
 ',"methods_file":"out/methods.csv","calls_file":"out/calls.csv","methods_loaded":true,',
 '"calls_loaded":true,"success":true}}') as json""",
    "stat_basic": _stats("l_returnflag,", "group by l_returnflag"),
    "stat_overall": _stats("", ""),
    "stat_requested": """select o.o_orderkey as l_orderkey,
 round(coalesce(sum(l_quantity), 0), 6) as total, round(coalesce(avg(l_quantity), 0), 6) as average,
 round(coalesce(stddev_pop(l_quantity), 0), 6) as std_dev
from orders o left join lineitem l on l.l_orderkey = o.o_orderkey group by o.o_orderkey""",
    "zscore": f"""with s as ({_group_stats("l_extendedprice", "l_suppkey")})
select l_orderkey, l_linenumber, l_suppkey, l_extendedprice,
 round({NORMALIZED.format(x="l_extendedprice")}, 6) + 0.0 as normalized
from lineitem join s on s.k = l_suppkey""",
    "zscore_overall": f"""with s as (
 select avg(l_extendedprice) as mean, stddev_pop(l_extendedprice) as dev,
  min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem)
select l_orderkey, l_linenumber, l_extendedprice,
 round({NORMALIZED.format(x="l_extendedprice")}, 6) + 0.0 as normalized
from lineitem, s""",
    "zscore_null_group": f"""with items as (
 select l_orderkey, l_linenumber, l_quantity, nullif(l_returnflag, 'N') as flag from lineitem),
s as (
 select flag as k, avg(l_quantity) as mean, stddev_pop(l_quantity) as dev,
  min(l_quantity) as lo, max(l_quantity) as hi from items group by flag)
select l_orderkey, l_linenumber, l_quantity, flag,
 round({NORMALIZED.format(x="l_quantity")}, 6) + 0.0 as normalized
from items join s on s.k is not distinct from flag""",
    "stat_integers": """select l_returnflag,
 cast(sum(l_orderkey * 1000003 + 10000000000007) as bigint) as total
from lineitem group by l_returnflag""",
    "analyze": f"""with s as ({_group_stats("l_quantity", "l_returnflag")})
select l_orderkey, l_linenumber, l_returnflag, l_quantity,
 round({NORMALIZED.format(x="l_quantity")}, 6) + 0.0 as normalized,
 round(s.total, 6) as total, round(s.mean, 6) as mean, round(s.mean, 6) as average,
 round(s.dev, 6) as std_dev
from lineitem join s on s.k = l_returnflag""",
    "compare": f"""with s as ({_group_stats("l_quantity", "l_suppkey")})
select s_suppkey as dataset1, s_suppkey + 1 as dataset2,
 round(coalesce(a.mean, 0), 6) as average1, round(coalesce(a.dev, 0), 6) as std_dev1,
 round(coalesce(b.mean, 0), 6) as average2, round(coalesce(b.dev, 0), 6) as std_dev2,
 round(abs(coalesce(a.mean, 0) - coalesce(b.mean, 0)), 6) as mean_difference
from supplier left join s a on a.k = s_suppkey left join s b on b.k = s_suppkey + 1""",
    "compare_two": """with s as (
 select avg(l_quantity) filter (where l_returnflag = 'R') as a1,
  stddev_pop(l_quantity) filter (where l_returnflag = 'R') as d1,
  avg(l_quantity) filter (where l_returnflag <> 'R') as a2,
  stddev_pop(l_quantity) filter (where l_returnflag <> 'R') as d2
 from lineitem)
select round(a1, 6) as average1, round(d1, 6) as std_dev1, round(a2, 6) as average2,
 round(d2, 6) as std_dev2, round(abs(a1 - a2), 6) as mean_difference from s""",
    "extract_methods": f"""with {SOURCE_METHODS}, defs as (
 select path, '' as q, '' as signature from p
 union all select path, concat('.', type), '' from p
 union all select path, concat('.', type, '.make_', k), concat('make_', k, '(self, amount)') from p
 union all
 select path, concat('.', type, '.check_', k), concat('check_', k, '(self, amount)') from p
 union all select path, concat('.build_', k), concat('build_', k, '(amount)') from p
 union all select path, '', '' from o
 union all select path, concat('.handle_', k), concat('handle_', k, '(amount)') from o
 union all select path, '', '' from d
 union all select path, concat('.note_', k), concat('note_', k, '()') from d)
select concat(path, ':<module>', q) as full_name, signature, concat('/corpus/', path) as file
from defs""",
    "extract_calls": f"""with {SOURCE_METHODS}, found as (
 select path, concat('.', type, '.make_', k) as caller, path as callee_path,
  concat(path, ':<module>.', type, '.check_', k) as callee, 3 as line from p
 union all select path, concat('.', type, '.check_', k), null, 'abs', 6 from p
 union all select path, concat('.build_', k), path, concat(path, ':<module>.', type), 9 from p
 union all select path, concat('.build_', k), path,
  concat(path, ':<module>.', type, '.make_', k), 9 from p
 union all select o.path, concat('.handle_', o.k), p.path,
  coalesce(concat(p.path, ':<module>.build_', p.k), 'build'), 5
  from o left join p on p.k = o.part
 union all select path, concat('.handle_', k), null, 'print', 6 from o
 union all select path, concat('.handle_', k), null, 'json.dumps', 7 from o
 union all select path, concat('.handle_', k), null, 'range', 7 from o
 union all select path, '', path, concat(path, ':<module>.handle_', k), 9 from o
 union all select path, concat('.note_', k), null, 'len', 2 from d)
select concat(path, ':<module>', caller) as caller_full_name,
 concat('/corpus/', path) as caller_file,
 callee as callee_full_name,
 case when callee_path is null then '<unknown>' else concat('/corpus/', callee_path) end
  as callee_file,
 concat('/corpus/', path) as callsite_file, line as callsite_line,
 callee_path is not null as resolved
from found""",
    "extract_errors": "select concat('docs/e', doc_id, '.py') as path from documents",
    "extract_class_calls": f"""with {CLASS_ROWS}, found as (
 select concat('world/r', r_regionkey, '.py:<module>.Region', r_regionkey, '.locate') as caller,
  concat('world/r', r_regionkey, '.py:<module>.Region', r_regionkey, '.label') as callee,
  3 as line, true as resolved from region
 union all select concat(own, '.label'), concat(top, '.locate'), 5, true from people
 union all select concat(own, '.again'), concat(top, '.label'), 8, true from people
 union all select concat(own, '.again'), 'super', 8, false from people
 union all select opener, own, 11, true from people
 union all select concat(desk, '.__init__'), coalesce(opener, 'open_one'), 5, known from desks
 union all select concat(desk, '.serve'), coalesce(concat(top, '.scale'), 'guest.scale'), 9, known
  from desks
 union all select concat(desk, '.serve'), coalesce(opener, 'open_one'), 10, known from desks
 union all select concat(desk, '.serve'), coalesce(concat(own, '.again'), 'again'), 10, known
  from desks
 union all select concat('sales/o', k, '.py:<module>'),
  coalesce(concat(top, '.locate'), concat('Customer', customer, '.locate')), 12, known from desks
 union all select concat('sales/o', k, '.py:<module>'),
  coalesce(opener, concat('open_', customer)), 14, known from desks)
select caller as caller_full_name, callee as callee_full_name, line as callsite_line, resolved
from found""",
    "class_ancestors": f"""with {CLASS_ROWS}, nations as (
 select concat('world/n', n_nationkey, '/impl.py:<module>.Nation', n_nationkey) as nation,
  n_nationkey, concat('world/r', n_regionkey, '.py:<module>.Region', n_regionkey) as top from nation)
select nation as class, nation as ancestor, 0 as position from nations
union all select nation, top, 1 from nations
union all select own, own, 0 from people
union all select p.own, n.nation, 1 from people p join nations n on n.n_nationkey = p.nation
union all select own, top, 2 from people""",
    "class_overriders": f"""with {CLASS_ROWS}
select concat(top, '.label') as overridden, concat(own, '.label') as overrider, 2 as distance
from people""",
}
