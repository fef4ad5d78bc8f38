"""DuckDB SQL that states each query's expected result straight from the tables."""

from __future__ import annotations

from weftgraph.functions import architecture
from weftgraph.operators import scan, tour
from weftgraph.sources import corpus

CLEAN, KNOTTED, TANGLED = corpus.CLEAN, corpus.KNOTTED, corpus.TANGLED


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


PARTS = f"""
parts0 as (select p_brand project_id, p_partkey p, cast(regexp_extract(p_brand, '(\\d+)', 1) as int) bn,
    p_size, list_extract({_list(corpus.FOLDERS)}, cast(p_partkey % 13 as int) + 1) folder,
    list_extract({_list(corpus.SUFFIXES)}, cast(p_partkey % 4 as int) + 1) suffix from part),
parts as (select *, bn % 2 = 1 is_py,
    case when bn % 2 = 1 then 'app/' || folder || '/m' || p || '.py'
         else 'src/' || folder || '/m' || p || suffix end path from parts0)"""


def _edges(ranges: int, name: str = "edges") -> str:
    return f"""
{name}_l as (select project_id, p a0, lead(p) over (partition by l_orderkey, project_id order by l_linenumber, p, l_quantity) b0
    from lineitem join parts on l_partkey = p),
{name}_u as (select *, a0 * {ranges} // (select count(*) from part) < b0 * {ranges} // (select count(*) from part) up
    from {name}_l where a0 <> b0),
{name}_o as (select distinct project_id, case when up then b0 else a0 end a, case when up then a0 else b0 end b from {name}_u),
{name} as (select o.project_id, a, b, x.path source, y.path target
    from {name}_o o join parts x on x.p = a join parts y on y.p = b)"""


def _nodes(edges: str = "edges", name: str = "nodes") -> str:
    return f"""
{name} as (select project_id, path node_id, string_split(path, '/')[-1] "name",
    case when is_py then 'python' else 'javascript' end as "language",
    cast(p_size * 10 + coalesce(n, 0) + cast(p % 3 = 0 as int) + cast(p % 17 = 0 as int) + 1 as int) lines_of_code, p
    from parts left join (select a, count(*) n from {edges} group by a) on a = p)"""


def _reach(edges: str = "edges", name: str = "walk") -> str:
    """Transitive closure; (s, t) with at least one step."""
    return f"""
{name} as (select project_id, source s, target t from {edges}
    union select w.project_id, w.s, e.target from {name} w join {edges} e on e.project_id = w.project_id and e.source = w.t)"""


def _scc(walk: str = "walk", name: str = "scc") -> str:
    return f"""
{name} as (select a.project_id, a.s node_id, min(a.t) component_id from {walk} a
    join {walk} b on a.project_id = b.project_id and a.s = b.t and a.t = b.s group by all)"""


def _with(*ctes: str) -> str:
    return "with recursive " + ",".join((PARTS, *ctes)) + "\n"


def _category(path: str) -> str:
    name = f"string_split(lower({path}), '/')[-1]"
    test = (
        f"regexp_matches(lower({path}), '(^|/)(tests|__tests__)/') or contains({name}, '.test.') or contains({name}, '.spec.') "
        f"or ({name} like '%.py' and ({name} like 'test\\_%' escape '\\' or {name} like '%\\_test.py' escape '\\'))"
    )
    whens = [f"when {test} then 'Test'"]
    whens += [f"when {name} = '{k}' then '{v}'" for k, v in architecture.FILE_NAMES.items()]
    whens += [
        f"when list_contains(string_split(lower({path}), '/'), '{k}') then '{v}'" for k, v in architecture.FOLDERS
    ]
    return "case " + " ".join(whens) + " else 'Unknown' end"


def _wide(ranges: int) -> tuple[str, ...]:
    """CTEs up to ``wide``: the per-file table."""
    return (
        _edges(ranges), _nodes(), _reach(), _scc(),
        """deg as (select n.project_id, n.node_id, n.lines_of_code,
    cast(coalesce(i, 0) as int) in_degree, cast(coalesce(o, 0) as int) out_degree from nodes n
    left join (select project_id, target node_id, count(*) i from edges group by all) using (project_id, node_id)
    left join (select project_id, source node_id, count(*) o from edges group by all) using (project_id, node_id))""",
        f"""base as (select d.*, (in_degree + out_degree) * (1.0::double / (n - 1)) degree_centrality,
    s.node_id is not null in_cycle, {_category('d.node_id')} category
    from deg d join (select project_id, count(*) n from nodes group by all) using (project_id)
    left join scc s using (project_id, node_id))""",
        """pts as (select *, least(40, in_degree * 2) p1,
    least(20, cast(round_even(degree_centrality * 20 * 2, 0) as int)) p2,
    least(20, cast(round_even(lines_of_code / 500.0::double * 20, 0) as int)) p3,
    case when in_cycle then 20 else 0 end p4 from base)""",
        """wide as (select *, cast(least(100, p1 + p2 + p3 + p4) as int) score,
    case when least(100, p1 + p2 + p3 + p4) <= 30 then 'Low' when least(100, p1 + p2 + p3 + p4) <= 60 then 'Medium'
         when least(100, p1 + p2 + p3 + p4) <= 80 then 'High' else 'Critical' end as "level",
    array_to_string(list_filter([
        case when in_degree > 0 then in_degree || ' files depend on this module' end,
        case when p2 >= 10 then 'High centrality in the dependency graph' end,
        case when lines_of_code >= 200 then lines_of_code || ' lines of code' end,
        case when in_cycle then 'Part of a circular dependency' end], lambda x: x is not null), '; ') reasons from pts)""",
    )


def _cycles(ranges: int, suffix: str = "", limit_len: int = 100) -> tuple[str, ...]:
    """CTEs up to ``listed{suffix}``: elementary cycles by path growth from the smallest node."""
    s = suffix
    return (
        _edges(ranges, f"edges{s}"), _reach(f"edges{s}", f"walk{s}"), _scc(f"walk{s}", f"scc{s}"),
        f"""inr{s} as (select e.project_id, e.source, e.target from edges{s} e
    join scc{s} x on x.project_id = e.project_id and x.node_id = e.source
    join scc{s} y on y.project_id = e.project_id and y.node_id = e.target and x.component_id = y.component_id)""",
        f"""grow{s} as (select distinct project_id, source st, [source] path, source last_, false closed from inr{s}
    union all select g.project_id, g.st, case when e.target = g.st then g.path else list_append(g.path, e.target) end,
        e.target, e.target = g.st
    from grow{s} g join inr{s} e on e.project_id = g.project_id and e.source = g.last_
    where not g.closed and len(g.path) <= {limit_len}
      and (e.target = g.st or (e.target > g.st and not list_contains(g.path, e.target))))""",
        f"""found{s} as (select project_id, cast(len(path) as int) len, path from grow{s} where closed)""",
        f"""listed{s} as (select project_id, 'cycle-' || (rn - 1) cycle_id, len, list_append(path, path[1]) chain from (
    select *, row_number() over (partition by project_id order by len, path) rn from found{s}) where rn <= 200)""",
    )


ORACLES: dict[str, str] = {}


def _add(name: str, sql: str) -> None:
    ORACLES[name] = sql


# --- scan --------------------------------------------------------------------
_MESSY = """messy as (select p_brand project_id, case p_partkey % 9
    when 0 then 'node_modules/pkg/m' || p_partkey || '.js' when 1 then 'src/.hidden/m' || p_partkey || '.ts'
    when 2 then 'src/build/m' || p_partkey || '.py' when 3 then 'src/m' || p_partkey || '.JS'
    when 4 then 'src/m' || p_partkey || '.d.ts' when 5 then 'docs/m' || p_partkey || '.md'
    when 6 then 'src/__tests__/_m' || p_partkey || '.py' when 7 then '.m' || p_partkey || '.js'
    else 'src/p' || p_partkey || '/.js' end path,
  case when p_partkey % 9 in (0, 1, 2) then 'ignored_dir' when p_partkey % 9 in (3, 5, 8) then 'extension'
    when p_partkey % 11 = 0 then 'symlink' when p_size * 60000 > 2097152 then 'oversized' else 'kept' end scan_status
  from part)"""
_add("scan_status", f"with {_MESSY} select * from messy")
_add("scan_status_counts", f"with {_MESSY} select project_id, scan_status, count(*) files from messy group by all")
_add("project_ceiling", f"""with {_MESSY} select project_id, count(*) kept_files,
    case when count(*) > (select floor(avg(n)) from (select count(*) n from messy where scan_status = 'kept' group by project_id))
      then 'rejected' else 'admitted' end status from messy where scan_status = 'kept' group by all""")
_add("node_ids", "select p_brand project_id, p_partkey p, 'src/m' || p_partkey || '.js' node_id from part")
_add("config_files", """select p_brand project_id, 'pkg' || p_partkey || '/' ||
    list_extract(['tsconfig.json', 'TSConfig.App.json', 'jsconfig.json', 'vite.config.mts'], cast(p_partkey % 7 as int) + 1) path
    from part where p_partkey % 7 < 4 and p_partkey % 5 <> 0""")
_add("repo_addresses", """select c_custkey,
    case c_custkey % 12 when 0 then 'owner' || c_custkey when 1 then 'o' || c_custkey when 2 then 'o' when 11 then 'o' || c_custkey end as owner,
    case c_custkey % 12 when 0 then 'repo.js' when 1 then 'my_repo' when 2 then 'r' || c_custkey when 11 then 'r' end repo,
    case when c_custkey % 12 = 2 then 'release/v1.2.3' end as ref, c_custkey % 12 in (0, 1, 2, 11) as valid from customer""")
_MANIFEST = """m as (select event_type archive, event_id seq, (event_id * 7919) % 2300000 size,
    event_id % 2999 = 1500 and event_type = 'error' unsafe,
    case when event_id % 2999 = 1500 and event_type = 'error' then 'top/../../m' || event_id || '.py'
      when event_id % 6 = 0 then 'top/src/m' || event_id || '.py' when event_id % 6 = 1 then 'top/node_modules/m' || event_id || '.js'
      when event_id % 6 = 2 then 'top/docs/m' || event_id || '.md' when event_id % 6 = 3 then 'top/pkg' || event_id || '/tsconfig.json'
      when event_id % 6 = 4 then 'top/.github/m' || event_id || '.py' else 'top/m' || event_id || '.tsx' end "name" from events),
r as (select *, sum(1) over w entries, sum(size) over w unpacked from m window w as (partition by archive order by seq)),
t as (select *, (event_id_ok and size <= 2097152) take from (select *,
    seq % 13 <> 0 and not unsafe and seq % 6 in (0, 3, 5) event_id_ok from r)),
k as (select *, sum(cast(take as int)) over (partition by archive order by seq) taken from t),
g as (select floor(avg(e) * 1.005) me, floor(avg(u) * 1.005) mu, floor(avg(t) * 1.005) mt from (
    select max(entries) e, max(unpacked) u, max(taken) t from k group by archive)),
f as (select archive, seq, case when unsafe then 'unsafe_path' when entries > (select me from g) or unpacked > (select mu from g) then 'too_large'
    when take and taken > (select mt from g) then 'too_many_files' end reason from k),
rej as (select archive, arg_min(reason, seq + case when reason = 'too_many_files' then 1000000000000 else 0 end) reason,
    arg_min(seq, seq + case when reason = 'too_many_files' then 1000000000000 else 0 end) seq from f where reason is not null group by archive)"""
_add("manifest_rejected", f"with {_MANIFEST} select archive, reason, seq from rej")
_add("manifest_wanted", f"""with {_MANIFEST} select archive, seq, "name" from k where take and archive not in (select archive from rej)""")
_add("manifest_running", f"with {_MANIFEST} select archive, seq, cast(entries as bigint) entries, cast(unpacked as bigint) unpacked from r")

# --- extraction and resolution -----------------------------------------------
_add("loc_by_file", _with(_edges(CLEAN), _nodes()) + "select project_id, node_id path, lines_of_code from nodes")
_IMPORTS = """
recs as (
    select project_id, path, is_py, 0 part_no, 0::bigint b, case when is_py then 'json' else 'react' end specifier,
        0 as "level", 'import' as "type", case when is_py then 'json' else 'default' end symbols, false nested
        from parts where p % 3 = 0
    union all select e.project_id, e.source, x.is_py, 1, e.b,
        case when x.is_py then case (e.a + e.b) % 5 when 0 then 'app.' || y.folder || '.m' || e.b when 1 then y.folder || '.m' || e.b
            when 2 then 'app.' || y.folder || '.m' || e.b when 3 then y.folder || '.m' || e.b else y.folder || '.m' || e.b end
          else '../' || y.folder || '/m' || e.b || case when (e.a + e.b) % 5 = 1 then y.suffix else '' end end,
        case when x.is_py and (e.a + e.b) % 5 in (1, 4) then 2 else 0 end,
        case when x.is_py then 'import' else list_extract(['import', 're-export', 'require', 're-export', 'import'], cast((e.a + e.b) % 5 as int) + 1) end,
        case when x.is_py then case (e.a + e.b) % 5 when 2 then 'app.' || y.folder || '.m' || e.b when 3 then '*' else 's' || e.b end
          else list_extract(['s' || e.b, 's' || e.b, 's' || e.b, '*', ''], cast((e.a + e.b) % 5 as int) + 1) end,
        x.is_py and (e.a + e.b) % 5 = 4
        from edges e join parts x on x.p = e.a join parts y on y.p = e.b
    union all select project_id, path, is_py, 2, 0, case when is_py then 'missing' || p else './missing' || p end,
        case when is_py then 1 else 0 end, 'import', case when is_py then 'x' else 'default' end, false from parts where p % 17 = 0),
imports as (select *, cast(row_number() over (partition by path order by nested, part_no, b) - 1 as int) ordinal,
    case when is_py then 'python' else 'javascript' end as "language" from recs)"""
_add("import_records", _with(_edges(CLEAN), _IMPORTS) + """select project_id, path, ordinal, "language", specifier,
    cast("level" as int) as "level", "type", symbols from imports""")
_add("language_split", _with(_edges(CLEAN), _IMPORTS) + """select p.project_id, case when is_py then 'python' else 'javascript' end as "language",
    count(*) files, cast(sum(coalesce(n, 0)) as bigint) imports from parts p
    left join (select path, count(*) n from recs group by path) using (path) group by all""")
_add("parse_errors", _with() + """select project_id, path file, 'parse failed: SyntaxError' as error from parts where p % 17 = 0""")
_add("top_dependents", _with(_edges(CLEAN)) + """select project_id, rank, node_id, in_degree from (
    select project_id, target node_id, cast(count(*) as int) in_degree,
    cast(row_number() over (partition by project_id order by count(*) desc, target) as int) rank from edges group by project_id, target) where rank <= 5""")
_PLAIN_EDGES = """select project_id, source, target, 'import' as "type", 's' || b symbols from edges"""
for _name, _thr in (("edges_clean", CLEAN), ("edges_tangled", TANGLED), ("edges_aliased", CLEAN),
                    ("snapshot_read", KNOTTED), ("node_link_roundtrip", CLEAN)):
    _add(_name, _with(_edges(_thr)) + _PLAIN_EDGES)
_add("edges_varied", _with(_edges(CLEAN), _IMPORTS) + """select r.project_id, e.source, e.target, r."type", r.symbols
    from edges e join recs r on r.path = e.source and r.b = e.b and r.part_no = 1""")
_add("import_targets", """with c as (select p_brand project_id, p_partkey % 12 k, 'm' || p_partkey m, 'pk' || p_partkey pk,
      cast(p_partkey // 12 % 5 + 1 as varchar) v from part)
  select project_id, case when k = 1 then 'near/' when k in (3, 4) then 'web/in/' when k = 8 then 'v/' when k = 9 then pk || '/' else 'src/' end
      || case k when 9 then 'm.py' when 10 then m || '.py' else m || '.ts' end path,
    case when k in (0, 1) then '@lib/' || m || 't' when k = 2 then '@lib/x/' || m || 't' when k in (3, 4) then '@/' || m || 't'
      when k = 5 then '@gone/' || m || 't' when k = 6 then '@mod/' || m || 't' when k = 7 then '../../' || m || 't'
      when k = 8 then 'a' || v || '/' || m || 't' when k = 9 then 'zz' when k = 10 then 'x' else 'libs/' || m || 't' end specifier,
    case when k in (0, 11) then 'libs/' || m || 't.ts' when k = 1 then 'near/own/' || m || 't.ts' when k = 2 then 'xlibs/' || m || 't.ts'
      when k = 3 then 'web/src/' || m || 't.ts' when k = 8 then 'v/v' || v || '/' || m || 't.ts' when k = 9 then pk || '/__init__.py' end target,
    case when k in (4, 5, 7, 10) then 'unresolved' when k = 6 then 'external' else 'local' end kind from c""")
_add("alias_rules", _with() + """select * from (
    select distinct project_id, '' as dir, cast(1 as int) rule_rank, case when bn % 3 = 2 then 'vite' else 'paths' end as mode,
      case when bn % 3 = 2 then '@' else '@/' end as prefix, '' as suffix, bn % 3 <> 2 as wildcard,
      case when bn % 3 = 2 then 'src' else 'src/*' end as targets, true as is_local from parts where not is_py
    union all select distinct project_id, '', 2, 'base', '', '', true, '', true from parts where not is_py and bn % 3 = 0)""")
_add("edges_merged", """with w as (select p_brand project_id, 'o' || l_orderkey || '.js' source, 'm' || (l_partkey % 3) || '.js' target,
    l_orderkey * 1000 + l_linenumber * 100 + l_quantity ord, case l_returnflag when 'A' then 'import' when 'N' then 'require' else 're-export' end ty,
    ['s' || l_linenumber, 's' || (l_suppkey % 4), 's' || (l_suppkey % 4)] sy from lineitem join part on l_partkey = p_partkey)
  select project_id, source, target, arg_min(ty, (ord, ty)) as "type",
    array_to_string(list_reduce(list(sy order by ord, ty, sy), lambda acc, e: list_concat(acc, list_filter(e, lambda s: not list_contains(acc, s)))), ',') symbols
  from w group by all""")
_add("external_counts", _with() + """select project_id, case when is_py then 'json' else 'react' end specifier, count(*) n
    from parts where p % 3 = 0 group by all""")
_add("unresolved_list", _with() + """select project_id, path file, case when is_py then 'missing' || p else './missing' || p end specifier,
    'import' as "type" from parts where p % 17 = 0""")
_add("cross_language", "select cast(0 as bigint) violations")
_add("node_set", _with(_edges(CLEAN), _nodes()) + 'select project_id, node_id, "name", "language", lines_of_code from nodes')

# --- metrics -----------------------------------------------------------------
_add("degree_metrics", _with(*_wide(TANGLED)) + """select project_id, node_id, in_degree, out_degree,
    round(degree_centrality, 6) degree_centrality from wide""")
_BETWEEN = (
    """step as (select project_id, source s, target t, 1 d from edges
    union select w.project_id, w.s, e.target, w.d + 1 from step w join edges e on e.project_id = w.project_id and e.source = w.t where w.d < 60)""",
    "dist as (select project_id, s, t, min(d) d from step where s <> t group by all)",
    """trail as (select project_id, source s, target t, 1 d from edges where source <> target
    union all select w.project_id, w.s, e.target, w.d + 1 from trail w join edges e on e.project_id = w.project_id and e.source = w.t
    join dist x on x.project_id = w.project_id and x.s = w.s and x.t = e.target and x.d = w.d + 1)""",
    "sig as (select project_id, s, t, d, count(*)::double n from trail group by all)",
    """bc as (select a.project_id, a.t node_id, sum(a.n * b.n / c.n) raw from sig a
    join sig b on b.project_id = a.project_id and b.s = a.t
    join sig c on c.project_id = a.project_id and c.s = a.s and c.t = b.t and c.d = a.d + b.d group by all)""",
)
_add("betweenness", _with(_edges(CLEAN), _nodes(), *_BETWEEN) + """select n.project_id, n.node_id, round(coalesce(raw, 0) / ((k - 1) * (k - 2)), 6) betweenness from nodes n
    join (select project_id, count(*) k from nodes group by all) using (project_id) left join bc using (project_id, node_id)""")
_add("betweenness_skipped", "select 'ALL' project_id, count(*) files, cast(case when count(*) > 100 then 0 else count(*) end as bigint) with_value from part")
_add("dependency_depth", _with(
    _edges(CLEAN), _nodes(), _reach(), _scc(),
    """comp as (select n.project_id, n.node_id, coalesce(component_id, n.node_id) c from nodes n left join scc using (project_id, node_id))""",
    """cedges as (select distinct e.project_id, x.c cs, y.c ct from edges e join comp x on x.project_id = e.project_id and x.node_id = e.source
    join comp y on y.project_id = e.project_id and y.node_id = e.target where x.c <> y.c)""",
    """lp as (select project_id, cs c, 1 k from cedges union select l.project_id, e.cs, l.k + 1 from lp l join cedges e on e.project_id = l.project_id and e.ct = l.c)""",
) + """select c.project_id, c.node_id, cast(coalesce(max(k), 0) as int) as depth from comp c left join lp using (project_id, c) group by c.project_id, c.node_id""")
_WCC = (
    "und as (select project_id, source s, target t from edges union select project_id, target, source from edges)",
    """wc as (select project_id, node_id s, node_id t from nodes union
    select w.project_id, w.s, u.t from wc w join und u on u.project_id = w.project_id and u.s = w.t)""",
    "labels as (select project_id, s node_id, min(t) component from wc group by all)",
)
# A closure would list every pair of a large component, so the label is spread instead.
_add("weak_components", _with(_edges(CLEAN), _nodes(), *_WCC) + "select project_id, node_id, component from labels")
_add("graph_totals", _with(_edges(KNOTTED), _nodes(), *_WCC) + """select project_id, n file_count, coalesce(m, 0) edge_count,
    component_count, largest_component, cast(printf('%.2f', (coalesce(m, 0) / n)::double) as double) avg_dependencies,
    round(coalesce(m, 0) / n, 6)::double avg_raw, n > 1500 betweenness_skipped
    from (select project_id, count(*) n from nodes group by all) left join (select project_id, count(*) m from edges group by all) using (project_id)
    join (select project_id, count(*) component_count, max(k) largest_component from
        (select project_id, component, count(*) k from labels group by all) group by all) using (project_id)""")
_add("node_table", _with(*_wide(CLEAN)) + """select project_id, node_id, lines_of_code, in_degree, out_degree,
    round(degree_centrality, 6) degree_centrality, in_cycle, category, score, "level", reasons from wide""")

# --- cycles and reach --------------------------------------------------------
_add("scc_members", _with(_edges(KNOTTED), _reach(), _scc()) + "select project_id, component_id, node_id from scc")
_add("scc_sizes", _with(_edges(TANGLED), _reach(), _scc()) + "select project_id, component_id, count(*) size from scc group by all")
_add("nodes_in_cycles", _with(_edges(TANGLED), _reach()) + "select distinct project_id, s node_id from walk where s = t")
_CHAIN = """select project_id, cycle_id, len, array_to_string(chain, ' > ') as "chain" from listed"""
_add("cycles_clean", _with(*_cycles(CLEAN)) + _CHAIN)
_add("cycles_capped", _with(*_cycles(KNOTTED)) + _CHAIN)
_add("cycle_truncation", _with(*_cycles(KNOTTED)) + """select project_id, cast(least(count(*), 200) as bigint) listed, count(*) > 200 truncated from found group by project_id""")
_add("nodes_in_listed_cycles", _with(*_cycles(CLEAN)) + "select distinct project_id, unnest(chain) node_id from listed")
_add("components_of_cycles", _with(_edges(CLEAN), _reach(), _scc()) + "select project_id, component_id, node_id from scc")
_add("impact_counts", _with(_edges(CLEAN), _nodes(), _reach()) + """, hit as (select distinct w.project_id, w.t file, w.s f,
    e.source is not null direct from walk w left join edges e on e.project_id = w.project_id and e.source = w.s and e.target = w.t where w.s <> w.t)
    select n.project_id, n.node_id file, coalesce(count_if(direct), 0) direct, coalesce(count_if(not direct), 0) indirect, count(f) total
    from nodes n left join hit on hit.project_id = n.project_id and hit.file = n.node_id group by n.project_id, n.node_id""")
_add("impact_files", _with(_edges(CLEAN), _reach()) + """select w.project_id, w.t file, w.s affected, e.source is not null is_direct
    from walk w left join edges e on e.project_id = w.project_id and e.source = w.s and e.target = w.t where w.s <> w.t""")
_add("change_impact", _with(_edges(CLEAN), _nodes(), """spread as (select project_id, node_id node, 0 d from nodes where p % 10 = 0
    union select s.project_id, e.source, s.d + 1 from spread s join edges e on e.project_id = s.project_id and e.target = s.node where s.d < 60)""")
    + """select project_id, node affected, cast(min(d) as int) distance from spread group by all having min(d) > 0""")
_add("file_dependencies", _with(_edges(CLEAN)) + "select project_id, source file, target dependency from edges")
_add("file_dependents", _with(_edges(CLEAN)) + "select project_id, target file, source dependent from edges")
_HOP = ("und as (select project_id, source s, target t from edges union select project_id, target, source from edges)",)
_add("khop2", _with(_edges(CLEAN), _nodes(), *_HOP) + """select project_id, node_id as root, node_id as node from nodes
    union select project_id, s, t from und
    union select a.project_id, a.s, b.t from und a join und b on a.project_id = b.project_id and a.t = b.s""")
_add("khop_clamped", _with(_edges(CLEAN), _nodes(), *_HOP, """hop as (select project_id, node_id as root, node_id as node from nodes
    union select project_id, s, t from und
    union select a.project_id, a.s, b.t from und a join und b on a.project_id = b.project_id and a.t = b.s
    union select a.project_id, a.s, c.t from und a join und b on a.project_id = b.project_id and a.t = b.s join und c on c.project_id = b.project_id and b.t = c.s)""")
    + "select project_id, root, count(*) reached from hop group by all")
_add("focus_start", _with(*_wide(CLEAN)) + """select project_id, node_id from (select project_id, node_id, row_number() over (
    partition by project_id order by category = 'Test', not (in_degree = 0 and out_degree > 0),
    case when in_degree = 0 and out_degree > 0 then -out_degree else 0 end, -(in_degree + out_degree), node_id) rn from wide) where rn = 1""")
_add("induced_subgraph", _with(_edges(TANGLED), _nodes()) + """select e.project_id, source, target from edges e
    join nodes a on a.project_id = e.project_id and a.node_id = source join nodes b on b.project_id = e.project_id and b.node_id = target
    where a.lines_of_code >= 200 and b.lines_of_code >= 200""")
_add("cycle_edges", _with(_edges(KNOTTED), _reach(), _scc()) + """select e.project_id, source, target,
    source in (select node_id from scc) and target in (select node_id from scc) in_cycle from edges e""")
_add("feedback_edges", _with(_edges(KNOTTED), _reach(), _scc(), """ie as (select e.project_id, e.source, e.target, x.component_id c from edges e
    join scc x on x.project_id = e.project_id and x.node_id = e.source
    join scc y on y.project_id = e.project_id and y.node_id = e.target and x.component_id = y.component_id)""",
    """bfs as (select distinct project_id, component_id c, component_id node, 0 d from scc
    union select b.project_id, b.c, i.target, b.d + 1 from bfs b join ie i on i.project_id = b.project_id and i.c = b.c and i.source = b.node where b.d < 60)""",
    "pos as (select project_id, node, min(d) d from bfs group by all)") + """select e.project_id, e.source, e.target,
    coalesce((s.d > t.d or (s.d = t.d and e.source > e.target)) and i.source is not null, false) is_feedback from edges e
    left join ie i on i.project_id = e.project_id and i.source = e.source and i.target = e.target
    left join pos s on s.project_id = e.project_id and s.node = e.source left join pos t on t.project_id = e.project_id and t.node = e.target""")
_add("isolated_files", _with(_edges(CLEAN), _nodes()) + """select project_id, node_id,
    node_id not in (select source from edges union select target from edges) isolated from nodes""")

# --- scoring and listings ----------------------------------------------------
_add("architecture_histogram", _with() + f"select project_id, {_category('path')} category, count(*) files from parts group by all")
_add("architecture_of_messy", f"with {_MESSY} select project_id, path, {_category('path')} category from messy")
_add("risk_scores", _with(*_wide(TANGLED)) + 'select project_id, node_id, score, "level", reasons from wide')
_add("risk_levels", _with(*_wide(TANGLED)) + 'select project_id, "level", count(*) files from wide group by all')
_add("high_risk_gate", _with(*_wide(TANGLED)) + "select project_id, node_id, score from wide where score >= 50")
_add("project_summary", _with(*_wide(CLEAN), *_cycles(CLEAN, "c")) + """, counts as (
    select project_id, count(*) file_count, count_if("level" in ('High', 'Critical')) high_risk_count from wide group by all)
    select c.project_id, file_count, high_risk_count, coalesce(m, 0) edge_count, coalesce(k, 0) cycle_count,
      coalesce(x, 0) external_count, coalesce(u, 0) unresolved_count, cast(printf('%.2f', (coalesce(m, 0) / file_count)::double) as double) avg_dependencies
    from counts c left join (select project_id, count(*) m from edges group by all) using (project_id)
    left join (select project_id, count(*) k from listedc group by all) using (project_id)
    left join (select project_id, 1 x from parts where p % 3 = 0 group by all) using (project_id)
    left join (select project_id, count(*) u from parts where p % 17 = 0 group by all) using (project_id)""")
_add("facet_values", _with() + f"""select distinct project_id, 'category' facet, {_category('path')} as "value" from parts
    union select distinct project_id, 'folder', case when is_py then 'app/' else 'src/' end || folder from parts""")
_add("facet_filter", _with(*_wide(TANGLED)) + """select project_id, node_id from wide where category in ('Service', 'Util', 'Model')
    and "level" <> 'Low' and node_id like 'src/%'""")
_add("file_search", _with() + "select project_id, path node_id from parts where contains(lower(path), 'utils/m1')")
_add("folder_tree", _with() + """, t as (select project_id, '' parent, case when is_py then 'app' else 'src' end as "name",
      case when is_py then 'app' else 'src' end path, false is_file, 1 as depth, count(*) files from parts group by all
    union all select project_id, case when is_py then 'app' else 'src' end, folder, case when is_py then 'app/' else 'src/' end || folder, false, 2, count(*) from parts group by all
    union all select project_id, case when is_py then 'app/' else 'src/' end || folder, string_split(path, '/')[-1], path, true, 3, 1 from parts)
    select project_id, parent, "name", path, is_file, cast(depth as int) as depth, files from t""")
_add("imports_panel", _with(_edges(CLEAN)) + """select project_id, source file, 'imports' direction, target other, 'import' as "type", 's' || b symbols from edges
    union all select project_id, target, 'imported_by', source, 'import', 's' || b from edges""")

# --- snapshots, gate, text ---------------------------------------------------
_add("snapshot_evolution", _with(_edges(CLEAN), _nodes()) + """select project_id, node_id,
    case when "language" = 'python' then 0 else lines_of_code end lines_of_code, "language" <> 'python' truncated from nodes""")
_add("baseline_roundtrip", _with(*_wide(CLEAN), *_cycles(CLEAN, "c")) + """, tot as (select project_id, count(*) n from nodes group by all)
    select project_id, 'totals' kind, null::varchar id, n file_count, coalesce(m, 0) edge_count, coalesce(k, 0) > 200 truncated, null::int score, null::varchar members
      from tot left join (select project_id, count(*) m from edges group by all) using (project_id)
      left join (select project_id, count(*) k from foundc group by all) using (project_id)
    union all select project_id, 'cycle', cycle_id, null, null, null, null, array_to_string(chain, ' > ') from listedc
    union all select project_id, 'component', component_id, null, null, null, null, node_id from scc
    union all select project_id, 'risk', node_id, null, null, null, score, null from wide""")
_add("node_link_rows", _with(_edges(CLEAN), _nodes()) + """select project_id, 'node' kind,
    cast(to_json({'id': node_id, 'name': "name", 'language': "language", 'linesOfCode': lines_of_code}) as varchar) as json from nodes
    union all select project_id, 'link', cast(to_json({'source': source, 'target': target, 'type': 'import', 'symbols': ['s' || b]}) as varchar) from edges""")
_KEYS = """keys{0} as (select distinct project_id, array_to_string(list_sort(list_distinct(chain[:-2])), ' > ') members from listed{0})"""
_add("new_cycles", _with(*_cycles(KNOTTED), *_cycles(CLEAN, "c"), _KEYS.format(""), _KEYS.format("c"))
     + "select project_id, members from keys except select project_id, members from keysc")
_NEW_COMP = """newc as (select project_id, component_id, count(*) size from scc left join sccc using (project_id, node_id) group by all)"""
_NEWC = """newc as (select s.project_id, s.component_id, count(*) size from scc s left join sccc o on o.project_id = s.project_id and o.node_id = s.node_id
    group by s.project_id, s.component_id having count(o.component_id) < count(*) or min(o.component_id) <> max(o.component_id))"""
_add("new_components", _with(_edges(KNOTTED), _reach(), _scc(), _edges(CLEAN, "edgesc"), _reach("edgesc", "walkc"), _scc("walkc", "sccc"), _NEWC)
     + "select project_id, component_id, size from newc")
_GATE = (
    *_wide(KNOTTED), *[c for c in _cycles(KNOTTED)[3:]], *_cycles(CLEAN, "c"), _KEYS.format(""), _KEYS.format("c"), _NEWC,
    "trunc as (select project_id from found group by all having count(*) > 200)",
    """tangles as (select project_id, members from (select project_id, members from keys except select project_id, members from keysc)
        where project_id not in (select project_id from trunc)
    union all select n.project_id, string_agg(s.node_id, ' > ' order by s.node_id) from newc n join scc s using (project_id, component_id)
        where n.project_id in (select project_id from trunc) group by n.project_id, n.component_id)""",
    """ver as (select p.project_id, coalesce(c, 0) new_cycles, coalesce(h, 0) high_risk_files, coalesce(c, 0) = 0 and coalesce(h, 0) = 0 passed
    from (select distinct project_id from parts) p left join (select project_id, count(*) c from tangles group by all) using (project_id)
    left join (select project_id, count(*) h from wide where score >= 50 group by all) using (project_id))""",
    """tot as (select n.project_id, n.n file_count, coalesce(m, 0) edge_count, least(coalesce(k, 0), 200) cycle_count, coalesce(k, 0) > 200 truncated
    from (select project_id, count(*) n from nodes group by all) n left join (select project_id, count(*) m from edges group by all) using (project_id)
    left join (select project_id, count(*) k from found group by all) using (project_id))""",
)
_add("verdict", _with(*_GATE) + "select project_id, new_cycles, high_risk_files, passed from ver")
_LABEL = "cycle_count || case when truncated then '+' else '' end"
_add("report_text", _with(*_GATE) + f"""select project_id, 0 as "section", 0 sort_score, 'Analysis: ' || file_count || ' files, ' || edge_count || ' dependencies, ' || {_LABEL} || ' circular dependencies' line from tot
    union all select project_id, 1, 0, case when new_cycles > 0 then 'NEW circular dependencies introduced (' || new_cycles || '):' else 'No new circular dependencies.' end from ver
    union all select project_id, 2, 0, '  - ' || replace(members, ' > ', ' <-> ') from tangles
    union all select project_id, 3, 0, case when high_risk_files > 0 then 'Files at or above risk threshold 50:' else 'No files at or above risk threshold 50.' end from ver
    union all select project_id, 4, -score, '  - ' || node_id || ': ' || score || '/100' from wide where score >= 50
    union all select project_id, 5, 0, case when passed then 'PASSED' else 'FAILED' end from ver""")
_add("report_markdown", _with(*_GATE) + f"""select project_id, 0 as "section", 0 sort_score, '**' || file_count || ' files &middot; ' || edge_count || ' dependencies &middot; ' || {_LABEL} || ' circular dependencies**' line from tot
    union all select project_id, 1, 0, case when new_cycles > 0 then '#### New circular dependency introduced (' || new_cycles || ')' else 'No new circular dependencies.' end from ver
    union all select project_id, 2, 0, '- `' || replace(members, ' > ', '` &harr; `') || '`' from tangles
    union all select project_id, 3, 0, case when high_risk_files > 0 then '#### Files at or above risk threshold (50)' else 'No files at or above risk threshold 50.' end from ver
    union all select project_id, 4, -1001, '| File | Risk |' from ver where high_risk_files > 0
    union all select project_id, 4, -1000, '|---|---|' from ver where high_risk_files > 0
    union all select project_id, 4, -score, '| `' || node_id || '` | ' || score || ' |' from wide where score >= 50
    union all select project_id, 5, 0, '**Result: ' || case when passed then 'PASSED' else 'FAILED' end || '**' from ver""")
_add("report_json", _with(*_GATE) + """select project_id, 0 as "section", 0 sort_score, cast(to_json({'passed': passed, 'fileCount': file_count, 'edgeCount': edge_count,
      'cycleCount': cycle_count, 'cyclesTruncated': truncated, 'newCycleCount': new_cycles, 'highRiskFileCount': high_risk_files}) as varchar) line from tot join ver using (project_id)
    union all select project_id, 1, 0, cast(to_json({'newCycle': string_split(members, ' > ')}) as varchar) from tangles
    union all select project_id, 2, -score, cast(to_json({'file': node_id, 'score': score}) as varchar) from wide where score >= 50""")
_PLAIN = r"""trim(regexp_replace(regexp_replace({0}, '[\x00-\x1f\x7f-\x{{9f}}\x{{2028}}\x{{2029}}]', ' ', 'g'), '[\s\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"""
_add("clean_fields", f"""select doc_id, translate({_PLAIN.format('"text"')}, '<>', '()') cleaned from documents""")
_add("plain_text", f"select page_id, {_PLAIN.format('html')} as plain from pages")
_add("code_spans", """with m as (select page_id, repeat('`', cast(page_id % 4 as int)) || url || '|a``b' t from pages),
    k as (select *, repeat('`', case when page_id % 4 = 3 then 4 else 3 end) f, case when page_id % 4 > 0 then ' ' else '' end pad from m)
    select page_id, f || pad || t || pad || f as span, f || pad || replace(t, '|', '\\|') || pad || f as cell from k""".replace("\\\\", "\\"))

# --- history -----------------------------------------------------------------
_add("retention", """select cast(o_orderkey as varchar) snapshot_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') created_at from orders
    order by o_orderdate desc, cast(o_orderkey as varchar) desc limit 5000""")
_add("retention_cascade", """with kept as (select cast(o_orderkey as varchar) id from orders order by o_orderdate desc, cast(o_orderkey as varchar) desc limit 5000),
    dropped as (select cast(o_orderkey as varchar) id from orders except select id from kept)
    select user_id || ':' || event_type cache_key, count(*) entries from events
    where cast(event_id * 2 as varchar) not in (select id from dropped) group by all""")
_add("session_expiry", "select cast(o_orderkey as varchar) snapshot_id from orders where o_orderdate >= timestamp '1998-06-30' - interval 30 day")
_add("visibility", """select cast(o_orderkey as varchar) snapshot_id from orders where o_orderpriority not like '1%' or o_custkey = 7""")
_add("cache_upsert", """with w as (select user_id || ':' || event_type cache_key, cast(event_id * 2 as varchar) snapshot_id, ts, event_id from events),
    a as (select cache_key, arg_max(snapshot_id, event_id) snapshot_id, arg_max(ts, event_id) ts from w where event_id % 2 = 0 group by all),
    b as (select cache_key, arg_max(snapshot_id, event_id) snapshot_id, arg_max(ts, event_id) ts from w where event_id % 2 = 1 group by all),
    u as (select * from b union all select * from a where ts >= timestamp '2024-01-28 00:00:00' - interval 600 second and cache_key not in (select cache_key from b))
    select cache_key, snapshot_id, regexp_replace(cast(ts as varchar), '\\.?0+$', '') cached_at from u""".replace("regexp_replace(cast(ts as varchar), '\\.?0+$', '')", "case when cast(ts as varchar) like '%.%' then rtrim(cast(ts as varchar), '0') else cast(ts as varchar) end"))
_add("ttl_lookup", """with w as (select user_id || ':' || event_type cache_key, cast(event_id * 2 as varchar) snapshot_id, ts, event_id from events),
    c as (select cache_key, arg_max(snapshot_id, event_id) snapshot_id, arg_max(ts, event_id) ts from w group by all),
    k as (select distinct cache_key from w union select distinct user_id || ':none' from events),
    o as (select k.cache_key, case when ts is null then 'miss' when ts < timestamp '2024-01-30 23:57:30' - interval 600 second then 'expired'
        when snapshot_id not in (select cast(o_orderkey as varchar) from orders) then 'dangling' else 'hit' end outcome, snapshot_id from k left join c using (cache_key))
    select cache_key, outcome, case when outcome = 'hit' then snapshot_id end snapshot_id from o""")


def _throttle(client: str, limit: int, seconds: int) -> str:
    us = seconds * 1_000_000
    live = f"list_filter(s.acc, lambda x: h.t - x <= {us})"
    return f"""with recursive h as (select event_type bucket, {client} client, event_id hit_id, epoch_us(ts) t,
        row_number() over (partition by event_type, {client} order by ts, event_id) rn from events),
    s as (select bucket, client, hit_id, t, rn, [t] acc, true accepted, null::bigint retry_after from h where rn = 1
      union all select h.bucket, h.client, h.hit_id, h.t, h.rn,
        case when len({live}) < {limit} then list_append({live}, h.t) else {live} end, len({live}) < {limit},
        case when len({live}) >= {limit} then greatest(1, cast(ceil(({us} - (h.t - {live}[1])) / 1000000.0) as bigint)) end
      from s join h on h.bucket = s.bucket and h.client = s.client and h.rn = s.rn + 1)
    select bucket, client, hit_id, t ts_us, accepted, retry_after from s"""


_add("throttle_decisions", _throttle("cast(user_id as varchar)", 2, 259_200))
_add("throttle_by_bucket", _throttle("'all'", 12, 14_400))

# --- guided tour -------------------------------------------------------------
_NOISE = "[" + ", ".join(f"'{d}'" for d in tour.NOISE_DIRS) + "]"
_TOUR = (
    *_wide(CLEAN),
    f"""code as (select *, not (category = 'Test' or regexp_matches(node_id, '{tour.NOISE_NAMES}')
        or list_has_any(string_split(lower(node_id), '/')[:-2], {_NOISE})) strict_ from wide),
elig as (select * from code where strict_ or project_id not in (select project_id from code where strict_)),
sub as (select e.* from edges e join elig a on a.project_id = e.project_id and a.node_id = e.source
    join elig b on b.project_id = e.project_id and b.node_id = e.target),
st0 as (select g.*, coalesce(ii, 0) i, coalesce(oo, 0) o from elig g
    left join (select project_id, target node_id, count(*) ii from sub group by all) using (project_id, node_id)
    left join (select project_id, source node_id, count(*) oo from sub group by all) using (project_id, node_id)),
st as (select *, case when i = 0 and o > 0 then '{tour.ENTRY}' when o = 0 then '{tour.LEAF}'
    when o >= 3 and o > i then '{tour.HUB}' else '{tour.CORE}' end stage from st0),
conn as (select * from st where i + o > 0)""",
)
_DEPTH = (
    """comp as (select n.project_id, n.node_id, coalesce(component_id, n.node_id) c from nodes n left join scc using (project_id, node_id))""",
    """cedges as (select distinct e.project_id, x.c cs, y.c ct from edges e join comp x on x.project_id = e.project_id and x.node_id = e.source
    join comp y on y.project_id = e.project_id and y.node_id = e.target where x.c <> y.c)""",
    """lp as (select project_id, cs c, 1 k from cedges union select l.project_id, e.cs, l.k + 1 from lp l join cedges e on e.project_id = l.project_id and e.ct = l.c)""",
    "depths as (select c.project_id, c.node_id, coalesce(max(k), 0) dd from comp c left join lp using (project_id, c) group by all)",
    """pick as (select *, row_number() over (partition by project_id order by i + o desc, degree_centrality desc, node_id) rk from conn),
found_ as (select p.*, row_number() over (partition by p.project_id order by dd, rk) stop_no from pick p join depths using (project_id, node_id) where rk <= 12)""",
)
_REASONS = f"""array_to_string(list_filter([
    case when stage = '{tour.ENTRY}' then 'Nothing else in this project imports it - likely where execution starts' end,
    case when stage = '{tour.HUB}' then 'Imports ' || o || ' files - it wires them together' end,
    case when i > 1 then i || ' other files depend on this' when i = 1 then '1 other file depends on this' end,
    case when category <> 'Unknown' then 'Classified as ' || category end,
    case when in_cycle then 'Part of a circular dependency - worth understanding the tangle' end], lambda x: x is not null), '; ')"""
_add("tour_roles", _with(*_TOUR) + "select project_id, node_id, cast(i as int) i, cast(o as int) o, stage from st")
_add("foundation_tour", _with(*_TOUR, *_DEPTH) + f"select project_id, cast(stop_no as int) stop_no, node_id, stage, {_REASONS} reasons from found_")
_ENTRY = (
    """er as (select c.project_id, c.node_id as root, s.target t from conn c join sub s on s.project_id = c.project_id and s.source = c.node_id where c.i = 0
    union select e.project_id, e.root, s.target from er e join sub s on s.project_id = e.project_id and s.source = e.t)""",
    "rc as (select project_id, root, count(*) reach from er where t <> root group by all)",
)
_add("entry_reach", _with(*_TOUR, *_ENTRY) + "select project_id, root, reach from rc")
_add("trace_roots", _with(*_TOUR, *_ENTRY) + """, best as (select r.project_id, r.root, row_number() over (partition by r.project_id order by reach desc, o desc, r.root) rk
      from rc r join conn c on c.project_id = r.project_id and c.node_id = r.root)
    select project_id, coalesce(b, a) roots from (select project_id, arg_min(node_id, rk) a from (select *, row_number() over
      (partition by project_id order by i + o desc, degree_centrality desc, node_id) rk from conn) group by all)
    left join (select project_id, string_agg(root, ',' order by rk) b from best where rk <= 3 group by all) using (project_id)""")
_add("tour_notes", _with(*_TOUR) + f"""select project_id, n isolated, case when k = 0 then '{tour.NO_LINKS_NOTE}'
    when n > 0 then n || case when n = 1 then ' other file has' else ' other files have' end || ' no import connections to the rest of the project (standalone scripts, or code that talks to the rest over HTTP), so can''t be placed in this tour.' end note
    from (select project_id, count_if(i + o = 0) n, count_if(i + o > 0) k from st group by all)""")
_add("node_table_full", _with(*_wide(CLEAN), *_DEPTH[:4], *_BETWEEN) + """select w.project_id, w.node_id, lines_of_code, in_degree, out_degree,
    round(degree_centrality, 6) degree_centrality, in_cycle, category, score, "level", reasons, cast(dd as int) as depth,
    round(coalesce(raw, 0) / ((k - 1) * (k - 2)), 6) betweenness from wide w
    join (select project_id, count(*) k from nodes group by all) using (project_id)
    join depths using (project_id, node_id) left join bc using (project_id, node_id)""")
_TRACE = (
    """best as (select r.project_id, r.root, row_number() over (partition by r.project_id order by reach desc, o desc, r.root) rk
      from rc r join conn c on c.project_id = r.project_id and c.node_id = r.root)""",
    """rootset as (select project_id, coalesce(b, [a]) roots from (select project_id, arg_min(node_id, rk) a from (select *, row_number() over
      (partition by project_id order by i + o desc, degree_centrality desc, node_id) rk from conn) group by all)
      left join (select project_id, list(root order by rk) b from best where rk <= 3 group by all) using (project_id))""",
    """kids as (select project_id, cur, list({'id': id, 'leaf': leaf} order by id) kids from (
      select distinct s.project_id, s.source cur, s.target id, t.o = 0 leaf from sub s
      join st t on t.project_id = s.project_id and t.node_id = s.target where s.source <> s.target) group by all)""",
    """tourwalk as (
      select project_id, roots, -1::bigint at_, 0::bigint budget, 0::bigint used, []::struct(id varchar, parent varchar)[] queue,
        []::varchar[] visited, []::struct(id varchar, parent varchar, members varchar[])[] stops, false done from rootset
      union all
      select project_id, roots, at2, budget2, case when done2 then used else used1 + grouped::int end,
        case when done2 then [] else list_concat(rest, list_transform(list_filter(kid, lambda c: not (grouped and c.leaf)),
          lambda c: {'id': c.id, 'parent': cur})) end,
        case when done2 then visited when grouped then list_concat(seen, leaves) else seen end,
        case when done2 then stops when grouped then list_concat(stops, [{'id': cur, 'parent': par, 'members': []::varchar[]},
          {'id': leaves[1], 'parent': cur, 'members': leaves}]) else list_append(stops, {'id': cur, 'parent': par, 'members': []::varchar[]}) end,
        done2
      from (select *, len(leaves) >= 3 and used1 < budget2 and len(stops) + 1 < 12 grouped
      from (select *, list_transform(list_filter(kid, lambda c: c.leaf), lambda c: c.id) leaves
      from (select s.*, list_filter(coalesce(k.kids, []), lambda c: not list_contains(s.seen, c.id)) kid
      from (select *, list_append(visited, cur) seen
      from (select *, case when done2 then null when going then q[1].id else roots[nxt + 1] end cur, case when going then q[1].parent end par,
          case when going then budget when len(roots) - nxt = 1 then left_ else greatest(3, cast(ceil(left_ / (len(roots) - nxt)) as bigint)) end budget2,
          case when going then used else 0 end + 1 used1, case when going then at_ else nxt end at2,
          case when going then q[2:] else [] end rest
      from (select *, not going and (len(later) = 0 or left_ <= 0) done2, later[1] nxt
      from (select *, len(q) > 0 and used < budget and left_ > 0 going,
          list_filter(range(len(roots)), lambda i: i > at_ and not list_contains(visited, roots[i + 1])) later
      from (select *, list_filter(queue, lambda x: not list_contains(visited, x.id)) q, 12 - len(stops) left_ from tourwalk where not done)))))
        s left join kids k on k.project_id = s.project_id and k.cur = s.cur))))""",
    "ended as (select * from tourwalk where done)",
    """told as (select project_id, unnest(range(1, len(stops) + 1)) stop_no, unnest(stops) s from ended
      union all select project_id, n + rk, {'id': node_id, 'parent': null, 'members': []} from (
        select c.project_id, c.node_id, len(e.stops) n, row_number() over (partition by c.project_id order by i + o desc, degree_centrality desc, c.node_id) rk
        from conn c join ended e using (project_id) where not list_contains(e.visited, c.node_id)) where n + rk <= 12)""",
)
_add("trace_tour", _with(*_TOUR, *_ENTRY, *_TRACE) + f"""select t.project_id, cast(stop_no as int) stop_no, s.id node_id,
    case when len(s.members) > 0 then len(s.members) || ' files used by ' || string_split(s.parent, '/')[-1] else s.id end "label",
    case when len(s.members) > 0 then '{tour.LEAF}' else stage end stage,
    case when len(s.members) > 0 then '{tour.LEAF_GROUP_REASON}' else array_to_string(list_filter([
      case when s.parent is not null then 'Imported by ' || string_split(s.parent, '/')[-1] end,
      case when stage = '{tour.ENTRY}' then 'Nothing else in this project imports it - likely where execution starts' end,
      case when stage = '{tour.HUB}' then 'Imports ' || o || ' files - it wires them together' end,
      case when i > 1 then i || ' other files depend on this' when i = 1 and s.parent is null then '1 other file depends on this' end,
      case when category <> 'Unknown' then 'Classified as ' || category end,
      case when in_cycle then 'Part of a circular dependency - worth understanding the tangle' end], lambda x: x is not null), '; ') end reasons,
    array_to_string(s.members, ',') members
    from told t join st on st.project_id = t.project_id and st.node_id = t.s.id""")
_add("stage_runs", _with(*_TOUR, *_DEPTH) + """, f as (select *, case when lag(stage) over w = stage then 0 else 1 end fresh from found_ window w as (partition by project_id order by stop_no))
    select project_id, cast(run_no as bigint) run_no, stage, cast(min(stop_no) as int) first_stop, cast(max(stop_no) as int) last_stop from (
      select *, sum(fresh) over (partition by project_id order by stop_no) run_no from f) group by project_id, run_no, stage""")
