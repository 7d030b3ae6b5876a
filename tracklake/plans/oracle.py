"""SQL with the same results as the registered queries, written from the meaning of each operator.

It does not restate the DataFrame code: areas are plain inequalities on the grid, runs come from the
difference of row numbers, last-wins rules from NOT EXISTS or ordered distinct rows.
"""

from __future__ import annotations

from tracklake.plans.queries import LOOKUP_ID, SNAPSHOT_CUT

_DEG = "* (180.0::double / 2147483648.0::double)"


def _grid(number: str, a: int, b: int, origin: int) -> str:
    return f"({origin} + (({number} * {a} + user_id * {b}) % 1000) * 1000)"


_RECORDS = f"""records as (
  select user_id as track_id, rn - 1 as seq, event_type, ts,
    (case when event_type <> 'error' then {_grid("rn", 37, 101, 461900000)} end)::integer
      as position_lat,
    (case when event_type <> 'error' then {_grid("rn", 53, 211, -109400000)} end)::integer
      as position_long
  from (select *, row_number() over (partition by user_id order by ts, event_id) as rn from events))"""

_POSITIONS = f"""positions as (
  select user_id as track_id, rn - 1 as seq,
    {_grid("rn", 37, 101, 461900000)} {_DEG} as lat,
    {_grid("rn", 53, 211, -109400000)} {_DEG} as lon,
    epoch_us(ts) // 1000 as ts_ms
  from (select *, row_number() over (partition by user_id order by ts, event_id) as rn
        from events where event_type <> 'error'))"""

_NODES = f"""nodes as (
  select p_partkey as id, p_partkey * 7919 % 1000 as x, p_partkey * 104729 % 100 * 10 as y,
    (461900000 + (p_partkey * 7919 % 1000) * 1000) {_DEG} as lat,
    (-109400000 + (p_partkey * 104729 % 100) * 10000) {_DEG} as lon
  from part)"""

_WAY_NODES = """way_nodes as (
  select l_orderkey as way_id, l_linenumber::bigint * 1099511627776 + l_partkey as pos,
    l_partkey as ref
  from lineitem)"""

_DENSE_WAY_NODES = """dense_way_nodes as (
  select l_orderkey as way_id, l_partkey as ref,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) - 1 as pos
  from lineitem)"""

_CLASS = """case o_orderpriority when '1-URGENT' then 'cycleway' when '2-HIGH' then 'residential'
    when '3-MEDIUM' then 'primary' when '4-NOT SPECIFIED' then 'track' when '5-LOW' then 'steps' end"""

_WAY_TAGS = f"""way_tags as (
  select o_orderkey as way_id, 0::bigint as pos, 'surface' as k, o_orderstatus as v from orders
  union all select o_orderkey, 1, 'highway', {_CLASS} from orders
  union all select o_orderkey, 2, 'highway', 'cycleway' from orders where o_orderstatus = 'F')"""

_IN_RECT = "lat > 38.73 and lat < 38.78 and lon > -9.15 and lon < -9.10"
_IN_SMALL = "lat > 38.74 and lat < 38.76 and lon > -9.14 and lon < -9.12"
_IN_ELL = "x > 200 and x < 800 and y > 200 and y < 800 and (x < 500 or y < 500)"
_IN_TRI = "y > 100 and 2 * (x - 100) > y - 100 and 2 * (900 - x) > y - 100"


def _halo(area: str) -> str:
    return f"""{_POSITIONS},
    inside as (select track_id, seq from positions where {area}),
    near as (select track_id, seq from inside union select track_id, seq - 1 from inside
             union select track_id, seq + 1 from inside),
    halo as (select p.*, n.seq is not null as keep
             from positions p left join near n on n.track_id = p.track_id and n.seq = p.seq)"""


def _clip(area: str) -> str:
    return f"""{_halo(area)},
    islands as (select *, seq - row_number() over (partition by track_id order by seq) as island
                from halo where keep),
    runs as (select track_id, dense_rank() over (partition by track_id order by island) - 1 as run,
                    seq, lat, lon, ts_ms from islands)"""


def _ids(area: str) -> str:
    return f"""{_clip(area)},
  ids as (select *,
    seq - min(seq) over (partition by track_id, run) as pos,
    row_number() over (order by track_id, run desc, seq) - 1 as node_id,
    dense_rank() over (order by track_id desc, run) - 1 as way_id
  from runs)"""


def _export(area: str) -> str:
    return f"""with {_ids(area)}
      select 'node' as kind, node_id as id, null::bigint as pos, null::bigint as ref, lat, lon,
        null::varchar as k, null::varchar as v from ids
      union all select 'nd', way_id, pos, node_id, null, null, null, null from ids
      union all select distinct 'tag', way_id, 0, null::bigint, null::double, null::double,
        'highway', 'cycleway' from ids
      union all select 'bounds', null, 0, null, min(lat), min(lon), null, null from ids
      union all select 'bounds', null, 1, null, max(lat), max(lon), null, null from ids"""


def _ways_in(area: str) -> str:
    return f"""select way_id, pos, ref, lat, lon from way_nodes join nodes on id = ref
      where way_id in (select way_id from way_nodes join nodes on id = ref where {area}) and way_id in
        (select o_orderkey from orders where o_orderpriority = '1-URGENT' or o_orderstatus = 'F')"""


_IDS = _ids(_IN_RECT)

# The triangle in degrees: sides are x - 100 = (y - 100) / 2 and 900 - x = (y - 100) / 2.
_X = f"(lat - 461900000 {_DEG}) * (2147483648.0::double / 180000.0::double)"
_Y = f"(lon + 109400000 {_DEG}) * (2147483648.0::double / 180000.0::double)"
_POS_IN_TRI = (
    f"round({_Y}) > 100 and 2 * (round({_X}) - 100) > round({_Y}) - 100 "
    f"and 2 * (900 - round({_X})) > round({_Y}) - 100"
)

_HASHED = "blobs as (select doc_id as id, upper(md5(text)) as hash, text, lang, source from documents)"
_URGENT = "select o_orderkey from orders where o_orderpriority = '1-URGENT'"
_TOUCHING = f"""touching as (
  select o_orderkey as way_id from orders
  where (o_orderpriority = '1-URGENT' or o_orderstatus = 'F')
    and exists (select 1 from lineitem join nodes on id = l_partkey
                where l_orderkey = o_orderkey and {_IN_ELL}))"""
_VALUES = "select user_id, event_id, event_type, value from events"
_LAST_VALUES = f"""{_VALUES} e where not exists
  (select 1 from events l where l.user_id = e.user_id and l.event_id > e.event_id)"""
_MESSAGES = """messages as (
  select event_id as order_no, case event_type when 'signup' then 'added' when 'purchase' then 'removed'
    else event_type end as kind, user_id as key, props as payload from events)"""
_CHANGES = f"{_MESSAGES}, changes as (select * from messages where kind in ('added', 'removed'))"


def _members(where: str = "true") -> str:
    return f"""select a.key, a.order_no from changes a where a.kind = 'added' and ({where})
      and not exists (select 1 from changes l where l.key = a.key and l.order_no > a.order_no
                      and ({where.replace("a.", "l.")}))"""


_FRESHNESS = """with log as (
    select user_id % 10 as artifact_id, event_id as order_no, event_type,
      cast(event_id % 3 as varchar) as hash
    from events),
  answers as (
    select r.artifact_id, r.order_no, r.hash,
      (select max(g.order_no) from log g where g.artifact_id = r.artifact_id
         and g.event_type = 'view' and g.order_no < r.order_no) as generated,
      (select max(c.order_no) from log c where c.artifact_id = r.artifact_id
         and c.event_type = 'signup' and c.order_no < r.order_no) as changed
    from log r where r.event_type = 'click')
  select a.artifact_id, a.order_no, a.hash,
    coalesce(generated > coalesce(changed, -1)
             and a.hash = cast(generated % 3 as varchar), false) as up_to_date
  from answers a"""

_CORNERS = """corners as (
  select p_partkey::varchar as polygon_id, n, p_size,
    (p_partkey * 7919 % 1000) + [0, p_size, p_size * 1.5::double, p_size, 0][n] as lat,
    (p_partkey * 104729 % 1000) + [0, 0, p_size, p_size * 2, p_size][n] as lon
  from part, range(1, 6) t(n))"""
_EDGES = f"""with {_CORNERS}
  select b.polygon_id, b.n - 1 as pos, a.lat::double as lat1, a.lon::double as lon1,
    b.lat::double as lat2, b.lon::double as lon2
  from corners b join corners a
    on a.polygon_id = b.polygon_id and a.n = case when b.n = 1 then 5 else b.n - 1 end"""

_ELEMENTS = """select 'node' as type, id, lat, lon from nodes
  union all select 'way', o_orderkey, null, null from orders"""
_CLASS_GROUP = """case when v in ('primary', 'steps') then 'never' when v in ('track', 'residential')
  then 'link' when v = 'cycleway' then 'must' end"""
_INGESTED = "select upper(md5(text)) as hash, min(doc_id) as doc_id from documents group by text"

ORACLE: dict[str, str] = {
    # scans, sources, sinks
    "scan_track_files": """select ['', '_', '.'][doc_id % 3 + 1] || 'track ' || doc_id as name,
        strlen(coalesce(text, '')) as length, upper(md5(coalesce(text, ''))) as hash from documents
      union all
      select distinct '_empty-' || coalesce(lang, ''), 0, upper(md5('')) from documents""",
    "decode_tracks": """select track_id, row_number() over (partition by track_id order by i) - 1 as seq,
        lines[i] as line
      from (select doc_id as track_id, string_split(text, chr(10)) as lines,
              unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)""",
    "read_records": f"with {_RECORDS} select track_id, seq, position_lat, position_long, ts from records",
    "read_osm_xml": f"""with {_NODES}, {_DENSE_WAY_NODES}, {_WAY_TAGS}
      select 'node' as type, id, lat, lon, null::bigint as pos, null::bigint as ref,
        null::varchar as k, null::varchar as v from nodes
      union all select 'nd', way_id, null, null, pos, ref, null, null from dense_way_nodes
      union all select 'tag', way_id, null, null, pos, null, k, v from way_tags
      union all select 'way', unnest([o_orderkey, -1 - o_orderkey]), null, null, null, null, null, null from orders""",
    "write_osm_xml": f"with {_IDS} select way_id, pos, node_id as ref, lat, lon from ids",
    "read_osm_json": f"""with {_NODES}, {_DENSE_WAY_NODES}
      select 'node' as type, id, lat, lon, null::bigint as pos, null::bigint as ref from nodes
      union all select 'nd', way_id + ((pos // 65536) * 1099511627776), null, null, pos % 65536, ref
        from dense_way_nodes""",
    "scan_tracks": "select doc_id as id, upper(md5(text)) as hash from documents",
    "blob_lookup": f"select text as data from documents where doc_id = {LOOKUP_ID}",
    "append_tracks": f"""with {_HASHED}
      select id, hash from blobs where lang = 'en'
      union all
      select (select max(id) from blobs where lang = 'en') + row_number() over (order by id), hash
      from blobs where lang <> 'en'""",
    "delete_tracks": f"with {_HASHED} select id, hash from blobs where source <> 'src7'",
    "upsert_latest": f"""with numbered as ({_VALUES}), last as (
        select *, row_number() over (partition by user_id, event_type = 'purchase' order by event_id desc) as rn
        from numbered)
      select user_id, event_id, event_type, value from last l
      where rn = 1 and (event_type = 'purchase' or not exists
        (select 1 from events e where e.user_id = l.user_id and e.event_type = 'purchase'))""",
    "save_snapshot": f"with {_HASHED} select id, hash from blobs",
    "save_polygons": _EDGES,
    "export_osm": _export(_IN_RECT),
    "encode_message": f"""with {_MESSAGES}
      select '{{"order_no":' || order_no || ',"kind":"' || kind || '","key":' || key || '}}' as text
      from messages""",
    "decode_message": f"with {_MESSAGES} select order_no, kind, key, payload from messages",
    # projections, filters, predicates
    "valid_positions": f"""with {_RECORDS} select track_id, seq, position_lat, position_long
      from records where event_type <> 'error'""",
    "semi_to_deg": f"""with {_RECORDS}
      select track_id, seq, position_lat {_DEG} as lat, position_long {_DEG} as lon
      from records where event_type <> 'error'""",
    "to_positions": f"""with {_RECORDS}
      select track_id, row_number() over (partition by track_id order by seq) - 1 as seq,
        position_lat {_DEG} as lat, position_long {_DEG} as lon, epoch_us(ts) // 1000 as ts_ms
      from records where position_lat is not null""",
    "close_ring": _EDGES,
    "point_in_polygon": f"""with {_NODES}
      select id, {_IN_RECT} as in_rect, {_IN_ELL} as in_ell, {_IN_TRI} as in_tri from nodes""",
    "is_cycleway": "select o_orderkey as way_id from orders where o_orderpriority = '1-URGENT'",
    "tag_values": f"select distinct {_CLASS} as v from orders union select 'cycleway' as v",
    "way_subset": f"""with {_NODES}, {_WAY_NODES}, {_WAY_TAGS}
      select 'way' as type, o_orderkey as id, null::double as lat, null::double as lon,
        null::bigint as pos, null::bigint as ref, null::varchar as k, null::varchar as v from ({_URGENT})
      union all select 'node', id, lat, lon, null, null, null, null from nodes
        where id in (select l_partkey from lineitem where l_orderkey in ({_URGENT}))
      union all select 'nd', way_id, null, null, pos, ref, null, null from way_nodes
        where way_id in (select o_orderkey from ({_URGENT}))
      union all select 'tag', way_id, null, null, pos, null, k, v from way_tags
        where way_id in (select o_orderkey from ({_URGENT}))""",
    "to_polyline": f"with {_POSITIONS} select track_id, seq, lat, lon from positions",
    "flatten_runs": f"with {_IDS} select way_id, pos, lat, lon from ids",
    "polygon_text": f"""with {_CORNERS} select polygon_id,
        string_agg(lat::double::varchar || ' ' || lon::double::varchar, ' ' order by n) as text
      from corners group by polygon_id""",
    "union_elements": f"with {_NODES} {_ELEMENTS}",
    "split_elements": """select 'node' as type, count(*) as n, sum(p_partkey)::bigint as ids from part
      union all select 'way', count(*), sum(o_orderkey)::bigint from orders""",
    "drop_heartbeats": """select event_type as kind, event_id, user_id from events
      where event_type <> 'view'""",
    "highway_class": f"with {_WAY_TAGS} select way_id, pos, v, {_CLASS_GROUP} as class from way_tags",
    "rewrite_by_kind": """select event_type as kind, event_id,
      case when event_type = 'signup' then 'x' else props end as props from events""",
    # joins
    "resolve_ways": f"""with {_NODES}, {_WAY_NODES}
      select way_id, pos, ref, lat, lon from way_nodes join nodes on id = ref""",
    "referenced_nodes": f"""with {_NODES} select id, lat, lon from nodes where exists
      (select 1 from lineitem join orders on o_orderkey = l_orderkey
       where l_partkey = id and o_orderpriority = '1-URGENT')""",
    "ways_touching": f"with {_NODES}, {_TOUCHING} select way_id from touching",
    "ways_with_nodes": f"""with {_NODES}, {_WAY_NODES}, {_TOUCHING}
      select 'way' as type, way_id as id, pos, ref, null::double as lat, null::double as lon
        from way_nodes where way_id in (select way_id from touching)
      union all select 'node', id, null, null, lat, lon from nodes where id in
        (select ref from way_nodes where way_id in (select way_id from touching))""",
    "ways_in_polygon": f"""with {_NODES}, {_WAY_NODES},
      tri as (select distinct way_id from way_nodes join nodes on id = ref where {_IN_TRI})
      select way_id, pos, ref, lat, lon from way_nodes join nodes on id = ref
      where way_id in (select way_id from tri) and way_id in
        (select o_orderkey from orders where o_orderpriority = '1-URGENT' or o_orderstatus = 'F')""",
    "offer_hashes": """select doc_id as id, upper(md5(text)) as hash,
        case when text in (select text from documents where lang = 'en')
          then 'confirm' else 'accept' end as answer
      from documents""",
    "new_files": """select max(doc_id) as id, upper(md5(text)) as hash from documents
      where text not in (select text from documents where lang = 'en') group by text""",
    "accepted_uploads": """select max(doc_id) as id, upper(md5(text)) as hash from documents
      group by text having count(*) filter (where lang = 'en') = 0""",
    "points_in_polygons": f"""with {_NODES}
      select id, 'rect' as polygon_id from nodes where {_IN_RECT}
      union all select id, 'ell' from nodes where {_IN_ELL}
      union all select id, 'tri' from nodes where {_IN_TRI}""",
    "points_in_many_polygons": f"""with {_NODES}, boxes as (
        select s_suppkey::varchar as polygon_id, s_suppkey * 613 % 1000 as cx,
          s_suppkey * 389 % 1000 as cy, s_nationkey * s_nationkey * 0.5::double + 1 as half,
          s_nationkey < 12 as is_box
        from supplier)
      select id, polygon_id from nodes join boxes
        on x > cx - half and x < cx + half and y > cy - half and y < cy + half
        and (is_box or abs(x - cx) + abs(y - cy) < half)""",
    "points_in_large_polygons": """with points as (
        select p_partkey as id, p_partkey * 7919 % 1000 as x, (p_partkey * 104729 % 2000) / 2.0::double as y from part),
      rings as (select s_suppkey::varchar as polygon_id, s_suppkey * 7919 % 1000 as cx, s_suppkey * 104729 % 500 as cy from supplier),
      placed as (select id, polygon_id, x - cx as x, y - cy as y, floor(y - cy)::bigint as t from points join rings
        on y > cy and y < cy + 499 and abs(x - cx) < 61)
      select id, polygon_id from placed
      where x < 40 + (case when y > t then 10 else t % 2 * 20 end)
        and x > -40 - (case when y = t then t % 3 * 10 else [5, 15, 10][t % 3 + 1] end)""",
    # aggregations
    "bounds": f"""with {_POSITIONS}
      select track_id, min(lat) as minlat, min(lon) as minlon, max(lat) as maxlat, max(lon) as maxlon
      from positions group by grouping sets ((track_id), ())""",
    "last_by_key": _LAST_VALUES,
    "distinct_refs": f"select distinct l_partkey as ref from lineitem where l_orderkey in ({_URGENT})",
    "collect_path": f"""with {_NODES}, {_DENSE_WAY_NODES}
      select way_id, pos, lat, lon from dense_way_nodes join nodes on id = ref""",
    "known_hashes": "select upper(md5(text)) as hash from (select distinct text from documents)",
    "track_start": f"""with {_POSITIONS} select track_id, arg_min(ts_ms, seq) as start_ms
      from positions group by track_id""",
    "reassemble_chunks": """select conv_id as message_id, string_agg(text, '' order by turn) as text
      from conversations group by conv_id""",
    "fingerprint": """select ((coalesce(sum(('0x' || substr(md5(text), 1, 8))::hugeint // 4), 0) * 1073741824
        + coalesce(sum(('0x' || substr(md5(text), 9, 8))::hugeint // 4), 0)) % 1152921504606846976)::bigint
        as fingerprint, count(*) as n from documents""",
    # windows
    "halo_keep": f"with {_halo(_IN_RECT)} select track_id, seq, keep from halo",
    "segment_runs": f"with {_clip(_IN_RECT)} select track_id, run, seq from runs",
    "clip_tracks": f"with {_clip(_IN_RECT)} select track_id, run, seq, lat, lon, ts_ms from runs",
    "clip_tracks_selective": f"""with {_clip(_POS_IN_TRI)}
      select track_id, run, seq, lat, lon, ts_ms from runs""",
    "run_order": f"""with {_clip(_IN_RECT)}
      select track_id, run, n, row_number() over (order by track_id, run desc) - 1 as run_rank
      from (select track_id, run, count(*) as n from runs group by track_id, run)""",
    "sequential_ids": f"with {_IDS} select track_id, run, seq, pos, node_id, way_id from ids",
    # sets
    "set_add": "select distinct upper(md5(text)) as hash from documents",
    "set_remove": "select doc_id as id from documents where source <> 'src7'",
    "removal_messages": """select 'removed' as kind, doc_id as key from documents
      where source = 'src7'""",
    # scalar functions
    "md5_upper": "select page_id, upper(md5(html)) as hash from pages",
    "ms_to_ts": f"""with {_POSITIONS} select track_id, make_timestamp(arg_min(ts_ms, seq) * 1000) as start
      from positions group by track_id""",
    "json_field": "select event_id, json_extract_string(props, '$.k')::bigint as k from events",
    "url_encode": """select doc_id, replace(replace(replace(url_encode(text),
      '%20', '+'), '%2A', '*'), '~', '%7E') as encoded from documents""",
    # changes and streams
    "track_set": f"with {_CHANGES} {_members()}",
    "snapshot_then_changes": f"""with {_CHANGES}
      select {SNAPSHOT_CUT}::bigint as order_no, 'added' as kind, key
      from ({_members(f"a.order_no <= {SNAPSHOT_CUT}")})
      union all select order_no, kind, key from changes where order_no > {SNAPSHOT_CUT}""",
    "latest_value": _LAST_VALUES,
    "artifact_freshness": _FRESHNESS,
    "stream_ingest": _INGESTED,
    "stream_track_set": f"with {_CHANGES} {_members()}",
    "stream_latest_value": _LAST_VALUES,
    "stream_freshness": _FRESHNESS,
}
ORACLE["ways_in_polygon_last"] = ORACLE["ways_in_polygon"]
ORACLE["resolve_ways_mapped"] = f"""with {_NODES}, {_WAY_NODES}
  select way_id, pos, 'n/' || ref as node, way_id * 2 + 1 as way from way_nodes join nodes on id = ref"""
ORACLE["area_result"] = f"""with {_NODES}, {_WAY_NODES}
  select 'north' as area_id, * from ({_ways_in(_IN_TRI)}) union all select 'south', * from ({_ways_in(_IN_ELL)})"""
ORACLE["gated_export"] = f"""select 1::bigint as asked, 'north' as area_id, * from ({_export(_IN_RECT)})
  union all select 1, 'south', * from ({_export(_IN_SMALL)})
  union all select 3, 'north', * from ({_export(_IN_SMALL)})"""
