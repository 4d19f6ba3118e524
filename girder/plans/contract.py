"""The contract queries over the star schema: each operator beside the SQL that states it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.config import Rules, Settings, Thresholds
from girder.functions import names
from girder.operators import churn, context, cycles, graph, insights, metrics, resolve, rules, symbols
from girder.sources import files, gitlog
from girder.sources.tables import NOW, Star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_DATA = {
    "steps": ("", """select l_orderkey, line, source, target from (select l_orderkey, l_linenumber line, l_suppkey source,
        lead(l_suppkey) over (partition by l_orderkey order by l_linenumber, l_suppkey) target from lineitem) where target is not null and source <> target"""),
    "pairs": ("steps", "select source, target, count(*) import_count from steps group by all"),
    "sg": ("pairs", "select source, target, import_count from (select *, row_number() over (partition by source order by import_count desc, target) k from pairs) where k <= 3"),
    "sgv": ("pairs", "select source, target, import_count from (select *, row_number() over (partition by source order by import_count desc, target) k from pairs) where k <= 1 + source % 12"),
    "ng": ("", """select source, target, import_count, (source + target) % 5 = 0 is_type_only, (source + target) % 7 = 0 is_deferred from (
        select *, row_number() over (partition by source order by import_count desc, target) k from (
        select c_nationkey source, s_nationkey target, count(*) import_count from lineitem join orders on l_orderkey = o_orderkey
        join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where c_nationkey <> s_nationkey group by all)) where k <= 2"""),
    "fwd": ("sg", "select source, target from sg where source < target or source % 10 = 0"),
    "nd": ("", """select s_suppkey id, r_name || '.' || n_name || '.' || case s_suppkey % 20 when 0 then 'test_' || s_suppkey when 1 then 's' || s_suppkey || '.settings'
        when 2 then 's' || s_suppkey || '.__init__' else s_name end as name
        from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""),
    "ne": ("sgv nd", "select a.name source, b.name target, import_count from sgv join nd a on a.id = source join nd b on b.id = target"),
    "st": ("", """select l_suppkey id, 1 + count(case when l_returnflag = 'R' and l_quantity >= 45 then 1 end) cc,
        count(case when l_returnflag = 'A' and l_discount >= 0.08::double and l_quantity >= 25 then 1 end) cog, count(distinct l_partkey) loc,
        count(distinct case when p_size <= 40 then l_partkey end) class_count, count(distinct case when p_size <= 10 then l_partkey end) abstract_count
        from lineitem left join part on p_partkey = l_partkey group by l_suppkey"""),
    "deg": ("sgv nd", """select id, (select count(distinct source) from sgv where target = id) ca, (select count(distinct target) from sgv where source = id) ce,
        coalesce((select sum(import_count) from sgv where source = id), 0)::bigint import_count from nd"""),
    "cl": ("sg", "select source seed, target node from sg union select cl.seed, g.target from cl join sg g on cl.node = g.source"),
    "clv": ("sgv", "select source seed, target node from sgv union select clv.seed, g.target from clv join sgv g on clv.node = g.source"),
    "d0": ("sgv", "select source s, target v, 1 k from sgv union select d0.s, g.target, k + 1 from d0 join sgv g on d0.v = g.source where k < 30"),
    "sp0": ("d0", "select s, v, min(k) dist from d0 where s <> v group by 1, 2"),
    "w0": ("sp0", "select source s, target v, 1 k from sgv union all select w0.s, g.target, w0.k + 1 from w0 join sp0 on sp0.s = w0.s and sp0.v = w0.v and sp0.dist = w0.k join sgv g on w0.v = g.source"),
    "sig": ("w0", "select sp0.s, sp0.v, sp0.dist, count(*) sig from w0 join sp0 on sp0.s = w0.s and sp0.v = w0.v and sp0.dist = w0.k group by 1, 2, 3"),
    "bet": ("sig nd", """select nd.id, round(coalesce(b, 0) / ((n - 1) * (n - 2)), 6) centrality from nd cross join (select count(*) n from nd) left join (
        select a.v, sum(a.sig * b.sig / st.sig::double) b from sig a join sig b on a.v = b.s join sig st on st.s = a.s and st.v = b.v and a.dist + b.dist = st.dist
        where a.s <> b.v group by 1) on v = nd.id"""),
    "m0": ("nd st deg bet", """select nd.id, name, id % 10 = 0 is_package, case when id % 37 = 0 then true else false end parse_error, ['python', 'javascript', 'typescript'][id % 3 + 1] as language,
        loc, cc, cog, class_count, abstract_count, ca, ce, import_count, centrality,
        case when ca + ce > 0 then ce::double / (ca + ce)::double else 0.0::double end instability,
        case when class_count > 0 then abstract_count::double / class_count::double else 0.0::double end abstractness,
        case when string_split(name, '.')[-1] like 'test\\_%' escape '\\' or string_split(name, '.')[-1] = 'conftest' then 'test'
             when string_split(name, '.')[-1] = '__init__' or id % 10 = 0 then 'init'
             when string_split(name, '.')[-1] in ('config', 'settings', 'constants', 'defaults') then 'config' else 'source' end as role
        from nd join st using (id) join deg using (id) join bet using (id)"""),
    "m1": ("m0", """select *, abs(abstractness + instability - 1.0::double) distance, cume_dist() over (order by centrality) crank, cume_dist() over (order by ca) arank from m0"""),
    "m2": ("m1", """select *, case when string_split(name, '.')[-1] = '__init__' and ce >= 3 then 'hub-by-design'
        when crank >= 0.9 then case when ca > ce then 'core' else 'orchestrator' end when arank >= 0.9 and ca > ce then 'core' else '' end arch_role from m1"""),
    "thr": ("m0", """select greatest(quantile_cont(cc, 0.95), 30.0::double) cc_critical, greatest(quantile_cont(cc, 0.9), 15.0::double) cc_high, greatest(quantile_cont(cc, 0.8), 8.0::double) cc_elevated,
        greatest(quantile_cont(cc, 0.6), 4.0::double) cc_moderate, greatest(quantile_cont(cog, 0.95), 30.0::double) cog_critical, greatest(quantile_cont(cog, 0.9), 15.0::double) cog_high,
        greatest(quantile_cont(cog, 0.8), 10.0::double) cog_elevated, greatest(quantile_cont(cog, 0.6), 6.0::double) cog_moderate from m0 where role = 'source'"""),
    "m3": ("m2 thr", """select m2.*, case role when 'test' then 3.0::double when 'init' then 1.5::double when 'config' then 1.5::double else 1.0::double end f,
        arch_role = 'hub-by-design' or role = 'init' as skip, thr.* from m2 cross join thr"""),
    "m4": ("m3", """select *, case when parse_error then 'unknown' when cc >= cc_critical * f or cog >= cog_critical * f then 'critical'
        when not skip and instability > 0.8::double and ce > 8 then 'critical' when cc >= cc_high * f or cog >= cog_high * f then 'high'
        when not skip and ca = 0 and ce > 8 then 'high' when cc >= cc_elevated * f or cog >= cog_elevated * f then 'elevated'
        when not skip and instability > 0.8::double * 0.875::double and ce > 8 * 0.625::double then 'elevated'
        when cc >= cc_moderate * f or cog >= cog_moderate * f then 'moderate' else 'healthy' end raw_health from m3"""),
    "mm": ("m4", """select *, case when role = 'test' and (case when arch_role = 'core' and raw_health in ('critical', 'high') then 'elevated' else raw_health end) in ('critical', 'high') then 'moderate'
        when arch_role = 'core' and raw_health in ('critical', 'high') then 'elevated' else raw_health end health from m4"""),
    "cyc4": ("sgv", """select [a.source, a.target] c from sgv a join sgv b on a.target = b.source and b.target = a.source where a.source < a.target
        union all select [a.source, a.target, b.target] from sgv a join sgv b on a.target = b.source join sgv c on b.target = c.source and c.target = a.source
        where a.source < a.target and a.source < b.target and a.target <> b.target
        union all select [a.source, a.target, b.target, c.target] from sgv a join sgv b on a.target = b.source join sgv c on b.target = c.source join sgv d on c.target = d.source and d.target = a.source
        where a.source < a.target and a.source < b.target and a.source < c.target and a.target <> b.target and a.target <> c.target and b.target <> c.target"""),
    "part4": ("cyc4", "select id, count(*) cycle_count, max(n) largest_cycle from (select unnest(c) id, len(c) n from cyc4) group by id"),
    "me": ("mm part4 clv", """select mm.*, ca direct, coalesce(tr, 0) transitive, coalesce(cycle_count, 0) cycle_count, coalesce(largest_cycle, 0) largest_cycle,
        round(instability, 3) i3, round(distance, 3) d3, round(abstractness, 3) a3 from mm left join part4 using (id)
        left join (select node id, count(*) tr from clv group by 1) using (id)"""),
    "cyp": ("ng", """select [source, target] path from ng where source <> target and target > source
        union all select list_append(path, target) from cyp join ng on path[-1] = source where target > path[1] and not list_contains(path, target) and len(path) < 10"""),
    "cy": ("cyp", "select distinct list_append(path, path[1]) path, len(path) length from cyp join ng on path[-1] = source and path[1] = target"),
    "cye": ("cy", "select path, length, unnest(range(1, length + 1)) pos, path[unnest(range(1, length + 1))] source, path[unnest(range(1, length + 1)) + 1] target from cy"),
    "sev": ("cy ng", """select path, length, coalesce(outside, 0) outside, case when coalesce(outside, 0) > 10 or length > 5 then 'critical' when coalesce(outside, 0) > 5 or length > 3 then 'high'
        when coalesce(outside, 0) > 2 then 'medium' else 'low' end severity from cy left join (
        select path, count(*) outside from (select path, unnest(path[1:length]) m from cy) join ng on target = m where not list_contains(path, source) group by 1) using (path)"""),
    "knd": ("cye ng", """select path, case when bool_and(is_type_only) then 'type_only' when bool_and(is_deferred) then 'deferred' else 'runtime' end kind
        from cye join ng using (source, target) group by 1"""),
    "brk": ("cye ng", """select path, arg_min([source, target], score * 1000 + pos) e from (select path, pos, source, target,
        import_count * case when (select count(distinct x.source) from ng x where x.target = cye.target) > 1 then 0.5 else 1.0 end score from cye join ng using (source, target)) group by 1"""),
    "fl": ("", "select doc_id ord, source || '/' || lang || '/' || case when doc_id % 50 = 0 then '__init__' else 'd' || doc_id end || '.py' rel_path, text content from documents"),
    "sy": ("", "select p_partkey % (select count(*) from supplier) as module, p_partkey as name, case when p_size % 3 = 0 then 'function' else 'class' end kind, string_split(p_name, ' ') decorators, p_size complexity from part where p_size > 25"),
    "rf": ("", """select l_suppkey source, l_partkey % (select count(*) from supplier) target, l_partkey as name from lineitem
        where l_returnflag = 'R' and l_quantity >= 46 and l_suppkey <> l_partkey % (select count(*) from supplier)"""),
    "rr": ("rf sy", "select source, target, rf.name, kind from rf left join sy on sy.module = target and sy.name = rf.name"),
    "us": ("rr", "select target as module, name, kind, count(*) usage from rr where kind is not null group by all"),
    "ch": ("", f"""select user_id as path, count(*) commits, sum(event_id % 50 + event_id % 7)::bigint as lines, count(distinct event_type) authors, strftime(min(ts), '%Y-%m-%d') first_seen,
        strftime(max(ts), '%Y-%m-%d') last_changed, greatest(0, floor((epoch(timestamp '{NOW}') - floor(epoch(max(ts)))) / 86400))::bigint as days from events group by 1"""),
    "cat": ("ch", """select *, case when commits = 0 then 'frozen' when commits >= 10 or days <= 7 and commits >= 5 then 'hot' when commits >= 3 and days <= 30 then 'warm' else 'cold' end category from ch"""),
    "ec0": ("nd st deg sgv clv", """select id, floor(loc * case id % 3 when 0 then 2.3::double when 1 then 2.0::double else 2.1::double end)::bigint own, ca files,
        coalesce((select count(*) from clv where node = id), 0) cascade from nd join st using (id) join deg using (id)"""),
    "ec": ("ec0", "select a.*, a.own + coalesce((select sum(b.own) from (select distinct source from sgv where target = a.id) join ec0 b on b.id = source), 0)::bigint tokens from ec0 a"),
}
_RECURSIVE = {"cl", "clv", "d0", "w0", "cyp"}


def with_data(data: str, body: str) -> str:
    """``body`` below the common tables it needs."""
    found: list[str] = []

    def add(name: str) -> None:
        if name not in found:
            for n in _DATA[name][0].split():
                add(n)
            found.append(name)

    for n in data.split():
        add(n)
    if not found:
        return body
    head = "with recursive " if _RECURSIVE & set(found) else "with "
    if body.startswith("with "):
        body = ", " + body.removeprefix("with ")
    return head + ",\n".join(f"{n} as ({_DATA[n][1]})" for n in found) + "\n" + body


def query(name: str, data: str | None = None, body: str = "") -> Callable:
    """Register a query over :class:`Star`, with its SQL."""

    def keep(run: Callable[[Star], DataFrame]) -> Callable[[Star], DataFrame]:
        QUERIES[name] = lambda spark, folder: run(Star(spark, folder))
        if data is not None:
            SQL[name] = with_data(data, body)
        return run

    return keep


def _joined(c: str):
    return F.array_join(F.col(c).cast("array<string>"), ",")


# --- scans ---------------------------------------------------------------------------------

_ID = r"'proj.' || replace(regexp_replace(regexp_replace(rel_path, '\.py$', ''), '(^|/)__init__$', ''), '/', '.')"
_LOC = r"len(list_filter(regexp_split_to_array(content, '\r\n|\r|\n'), lambda x: regexp_matches(x, '^\s*[^\s#]')))"


@query("scan_modules", "fl", rf"""select id, case when contains(id, '.') then regexp_replace(id, '\.[^.]*$', '') else '' end package, rel_path, rel_path like '%\_\_init\_\_.py' escape '\' is_package,
    {_LOC}::int loc, 'python' as language, ord from (select *, {_ID} id from fl) where not regexp_matches(id, '^proj\.src3\.') qualify row_number() over (partition by id order by ord desc, rel_path desc) = 1""")  # fmt: skip
def scan_modules(s: Star) -> DataFrame:
    return files.scan_modules(s.files, "proj", Settings(exclude_patterns=("proj.src3.*",)))


@query("glob_filter", "nd", r"select id, name from nd where regexp_full_match(name, 'EUROPE\..*|.*\.test_.|.*\.NATION_[12][^0-4]\..*')")
def glob_filter(s: Star) -> DataFrame:
    return s.nodes.where(names.any_glob(F.col("name"), ["EUROPE.*", "*.test_?", "*.NATION_[12][!0-4].*"]))


@query("path_to_module", "fl", rf"select ord, rel_path, {_ID} id, rel_path like '%\_\_init\_\_.py' escape '\' is_package from fl")
def path_to_module(s: Star) -> DataFrame:
    p = F.col("rel_path")
    return s.files.select("ord", "rel_path", names.python_module(p, "proj").alias("id"), names.is_init(p).alias("is_package"))


@query("count_loc", "fl", f"select ord, {_LOC} loc from fl")
def count_loc(s: Star) -> DataFrame:
    return s.files.select("ord", names.python_loc(F.coalesce("content", F.lit(""))).alias("loc"))


def _log_lines(s: Star) -> DataFrame:
    """Events as the lines of sixteen commit logs; every eleventh header has a bar too many."""
    e = s.table("events").withColumn("log", F.col("event_id") % 16)
    author = F.when(F.expr("event_id % 11 = 0"), F.concat("event_type", F.lit("|x"))).otherwise(F.col("event_type"))
    head = F.concat_ws("|", F.col("event_id").cast("string"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), author)
    user = F.col("user_id").cast("string")
    path = F.when(F.expr("event_id % 5 = 0"), F.concat(F.lit("{old => new}/u"), user)).when(F.expr("event_id % 5 = 1"), F.concat(F.lit("x => u"), user)).otherwise(F.concat(F.lit("u"), user))
    added = F.when(F.expr("event_id % 13 = 0"), F.lit("-")).otherwise((F.col("event_id") % 50).cast("string"))
    file = F.concat_ws("\t", added, (F.col("event_id") % 7).cast("string"), path)
    both = F.explode(F.array(F.struct((F.col("event_id") * 2).alias("line_no"), head.alias("line")), F.struct((F.col("event_id") * 2 + 1).alias("line_no"), file.alias("line"))))
    return e.select("log", both.alias("x")).select("log", "x.line_no", "x.line")


@query("git_log_parse", "", """with h as (select event_id, event_id % 16 log, user_id, case when event_id % 11 <> 0 then event_id::varchar || '|' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '|' || event_type end head from events),
    c as (select *, last_value(head ignore nulls) over (partition by log order by event_id rows between unbounded preceding and current row) h2 from h)
    select log, string_split(h2, '|')[1] hash, string_split(h2, '|')[3] author, replace(string_split(h2, '|')[2], 'T', ' ') author_date,
    case when event_id % 13 = 0 then 0 else event_id % 50 end::int added, (event_id % 7)::int removed, case when event_id % 5 = 0 then 'new/u' else 'u' end || user_id as path from c""")  # fmt: skip
def git_log_parse(s: Star) -> DataFrame:
    return gitlog.parse_log(_log_lines(s), "log").withColumn("author_date", F.date_format("author_date", "yyyy-MM-dd HH:mm:ss"))


@query("rename_target", "", """select event_id, case event_id % 3 when 0 then 'a/' || event_type || '/f' || user_id || '.py' when 1 then 'new' || user_id || '.py' else 'plain/f' || user_id || '.py' end path from events""")
def rename_target(s: Star) -> DataFrame:
    u, t = F.col("user_id").cast("string"), F.col("event_type")
    given = (
        F.when(F.expr("event_id % 6 = 0"), F.concat(F.lit("a/{old => "), t, F.lit("}/f"), u, F.lit(".py")))
        .when(F.expr("event_id % 6 = 3"), F.concat(F.lit("a/{ => "), t, F.lit("}//f"), u, F.lit(".py")))
        .when(F.expr("event_id % 3 = 1"), F.concat(F.lit("old"), u, F.lit(".py => new"), u, F.lit(".py")))
        .otherwise(F.concat(F.lit("plain/f"), u, F.lit(".py")))
    )
    return s.table("events").select("event_id", names.rename_target(given).alias("path"))


@query("content_hash", "fl", "select rel_path, ord, md5(content) hash from fl")
def content_hash(s: Star) -> DataFrame:
    f = s.files
    return f.select("rel_path", "ord", F.md5(F.col("content").cast("binary")).alias("hash"))


@query("changed_files", "fl", """select ord::varchar rel_path, case when ord % 7 = 0 then 'added' when ord % 7 = 1 then 'removed' else 'modified' end change from fl where ord % 7 in (0, 1) or ord % 7 = 2 and content <> ''""")
def changed_files(s: Star) -> DataFrame:
    f = s.files.withColumn("rel_path", F.col("ord").cast("string"))
    new = f.where("ord % 7 <> 1").withColumn("content", F.expr("case when ord % 7 = 2 then concat(content, content) else content end"))
    return files.changed(files.hashes(f.where("ord % 7 <> 0")), files.hashes(new))


# --- resolution ----------------------------------------------------------------------------


@query("resolve_relative_import", "nd", """select id, name, level, case when keep > 0 then case when part = '' then base else base || '.' || part end end resolved from (
    select *, array_to_string(string_split(name, '.')[1:greatest(keep, 0)], '.') base from (select id, name, id % 4 + 1 as level, case when id % 3 = 0 then '' else 'x.y' end part,
    len(string_split(name, '.')) - case when id % 10 = 0 then 0 else 1 end - (id % 4) keep from nd))""")  # fmt: skip
def resolve_relative_import(s: Star) -> DataFrame:
    part = F.when(F.expr("id % 3 = 0"), F.lit("")).otherwise("x.y")
    made = names.relative_base(F.col("name"), F.expr("id % 10 = 0"), F.col("level").cast("int"), part)
    return s.nodes.withColumn("level", F.expr("id % 4 + 1")).select("id", "name", "level", made.alias("resolved"))


_RAWS = "select id, case id % 3 when 0 then name || '.Thing.other' when 1 then name else 'nowhere.' || name end raw from nd"


@query("normalize_import", "nd", f"""with known as (select case when id % 4 = 0 then 'proj.' || name else name end as name from nd where id % 5 <> 0 union select 'proj.' || regexp_replace(name, '\\.[^.]*$', '') from nd),
    raws as (select distinct raw from ({_RAWS})), parts as (select raw, string_split(raw, '.') p from raws),
    cut as (select raw, len(p) - k place, array_to_string(p[1:k], '.') c from (select *, unnest(range(1, len(p))) k from parts)),
    cand as (select raw, 0 place, raw c from raws union all select raw, 1, 'proj.' || raw from raws union all select raw, 1 + place, c from cut union all select raw, 1000 + place, 'proj.' || c from cut)
    select raw, arg_min(c, place) filter (c in (select name from known)) resolved from cand group by raw""")  # fmt: skip
def normalize_import(s: Star) -> DataFrame:
    n = s.nodes
    known = n.where("id % 5 <> 0").select(F.expr("case when id % 4 = 0 then concat('proj.', name) else name end").alias("id"))
    known = known.union(n.select(F.concat(F.lit("proj."), graph.package_of("name"))))
    raws = n.select(F.expr("case id % 3 when 0 then concat(name, '.Thing.other') when 1 then name else concat('nowhere.', name) end").alias("raw"))
    return resolve.absolute_imports(raws, known, "proj")


@query("resolve_specifier", "", """with p as (select doc_id, 'src' || doc_id % 20 || '/f' || doc_id || case doc_id % 3 when 0 then '.js' when 1 then '.ts' else '/index.js' end id from documents)
    select a.id importer, case doc_id % 4 when 0 then '../src' || (doc_id + 1) % 20 || '/f' || (doc_id + 1) when 1 then './f' || (doc_id + 20) || '.ts' when 2 then '@lib/f' || (doc_id + 1) else 'react' end
    as specifier, case when doc_id % 3 = 2 and doc_id % 4 in (0, 1) then null else (select b.id from p b where b.doc_id = case a.doc_id % 4 when 0 then a.doc_id + 1 when 1 then a.doc_id + 20 when 2 then a.doc_id + 1 end
    and (a.doc_id % 4 <> 1 or b.doc_id % 3 = 1) and (a.doc_id % 4 <> 2 or b.doc_id % 20 = 3)) end resolved from p a""")  # fmt: skip
def resolve_specifier(s: Star) -> DataFrame:
    d = s.table("documents").select("doc_id")
    ext = F.expr("case doc_id % 3 when 0 then '.js' when 1 then '.ts' else '/index.js' end")
    paths = d.select(F.expr("concat('src', doc_id % 20, '/f', doc_id)").alias("stem"), ext.alias("e"), "doc_id").select("doc_id", F.concat("stem", "e").alias("id"), names.extension(F.concat("stem", "e")).alias("ext"))
    spec = F.expr("case doc_id % 4 when 0 then concat('../src', (doc_id + 1) % 20, '/f', doc_id + 1) when 1 then concat('./f', doc_id + 20, '.ts') when 2 then concat('@lib/f', doc_id + 1) else 'react' end")
    return resolve.specifiers(paths.select(F.col("id").alias("importer"), spec.alias("specifier")), paths, [("@lib/*", ["src3/*"])])


@query("match_alias", "", r"""select distinct p_name as name, p_name like 'ring%' a, p_name like '%bolt' b, p_name = 'ring bolt' c, case when p_name like 'ring%' then substr(p_name, 5) end rest from part""")
def match_alias(s: Star) -> DataFrame:
    n = F.col("p_name")
    return s.table("part").select(n.alias("name"), names.alias_matches(n, "ring*").alias("a"), names.alias_matches(n, "*bolt").alias("b"), names.alias_matches(n, "ring bolt").alias("c"), names.alias_rest(n, "ring*").alias("rest")).distinct()


_MODULES = "select id, replace(name, '.', '/') || '.py' rel_path, id ord from nd"


@query("resolve_path", "nd", """select case id % 5 when 0 then name when 1 then replace(name, '.', '/') || '.py' when 2 then '/work/tree/' || replace(name, '.', '/') || '.py'
    when 3 then replace(name, '.', '/') else '/elsewhere/x/' || replace(name, '.', '/') || '.py' end asked, case when id % 5 = 0 then null else id end id from nd
    union all select string_split(name, '.')[-1] || '.py', case when count(*) = 1 then min(id) end from nd group by 1""")  # fmt: skip
def resolve_path(s: Star) -> DataFrame:
    n = s.nodes
    path = F.concat(F.translate("name", ".", "/"), F.lit(".py"))
    modules = n.select("id", path.alias("rel_path"), F.col("id").alias("ord"))
    asked = n.select(F.when(F.expr("id % 5 = 0"), F.col("name")).when(F.expr("id % 5 = 1"), path).when(F.expr("id % 5 = 2"), F.concat(F.lit("/work/tree/"), path)).when(F.expr("id % 5 = 3"), F.translate("name", ".", "/")).otherwise(F.concat(F.lit("/elsewhere/x/"), path)).alias("asked"))
    asked = asked.union(n.select(F.concat(F.element_at(F.split("name", r"\."), -1), F.lit(".py"))))
    return resolve.modules_by_path(asked, modules.withColumn("id", F.col("id").cast("string")), "/work/tree").withColumn("id", F.col("id").cast("long"))


@query("find_modules", "nd", "select name as id from nd where contains(lower(name), 'nation_1') or contains(name, 'Supplier#000000002')")
def find_modules(s: Star) -> DataFrame:
    n = s.nodes.select(F.col("name").alias("id"))
    return resolve.find_modules(n, "nation_1").union(resolve.find_modules(n, "Supplier#000000002")).distinct()


# --- graph ---------------------------------------------------------------------------------


@query("graph_edges", "steps", """select source, target, count(*) import_count, string_agg(line::varchar, ',' order by l_orderkey, line) as lines, bool_and(line % 2 = 0) is_type_only, bool_and((source + target) % 7 = 0) is_deferred
    from steps where target in (select s_suppkey from supplier) group by all""")  # fmt: skip
def graph_edges(s: Star) -> DataFrame:
    imports = s.steps.withColumn("is_type_checking", F.expr("line % 2 = 0")).withColumn("is_deferred", F.expr("(source + target) % 7 = 0"))
    made = graph.build_edges(imports, s.nodes, ["l_orderkey"])
    return made.withColumn("lines", _joined("lines"))


@query("graph_export_edges", "sgv", "select source, target, import_count from sgv")
def graph_export_edges(s: Star) -> DataFrame:
    return s.edges.select("source", "target", "import_count")


@query("graph_export_nodes", "sgv nd", """select id, name, coalesce((select string_agg(target::varchar, ',' order by target) from sgv where source = id), '') dependencies,
    coalesce((select string_agg(source::varchar, ',' order by source) from sgv where target = id), '') dependents from nd""")  # fmt: skip
def graph_export_nodes(s: Star) -> DataFrame:
    e = s.edges
    out = e.groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_set("target")).alias("dependencies"))
    into = e.groupBy(F.col("target").alias("id")).agg(F.array_sort(F.collect_set("source")).alias("dependents"))
    return s.nodes.join(out, "id", "left").join(into, "id", "left").select("id", "name", F.coalesce(_joined("dependencies"), F.lit("")).alias("dependencies"), F.coalesce(_joined("dependents"), F.lit("")).alias("dependents"))


@query("impact_analysis", "sg cl nd", """select id, (select count(distinct source) from sg where target = id) direct,
    (select count(*) from cl where node = id and seed <> id and seed not in (select source from sg where target = id)) transitive_only, (select count(*) from cl where node = id) total from nd""")  # fmt: skip
def impact_analysis(s: Star) -> DataFrame:
    far = graph.reach(s.even_edges)
    near = s.even_edges.select(F.col("source").alias("seed"), F.col("target").alias("node"), F.lit(True).alias("near"))
    counted = far.join(near, ["seed", "node"], "left").groupBy(F.col("node").alias("id")).agg(
        F.count_if("near").alias("direct"), F.count_if(F.col("near").isNull() & (F.col("seed") != F.col("node"))).alias("transitive_only"), F.count(F.lit(1)).alias("total")
    )
    return s.nodes.select("id").join(counted, "id", "left").fillna(0)


@query("viz_nodes", "deg nd", "select nd.id, string_split(name, '.')[2] as group_name, least(30, greatest(6, 6 + 2 * (ca + ce))) radius from nd join deg using (id)")
def viz_nodes(s: Star) -> DataFrame:
    d = graph.degrees(s.nodes, s.edges)
    size = F.least(F.lit(30), F.greatest(F.lit(6), 6 + 2 * (F.col("ca") + F.col("ce"))))
    return s.nodes.join(d, "id").select("id", F.get(F.split("name", r"\."), F.lit(1)).alias("group_name"), size.alias("radius"))


@query("viz_links", "ne", "select source, target, import_count as weight from ne")
def viz_links(s: Star) -> DataFrame:
    return s.named_edges.select("source", "target", F.col("import_count").alias("weight"))


@query("direct_dependencies", "sgv", "select distinct target id from sgv where source = 5")
def direct_dependencies(s: Star) -> DataFrame:
    return graph.dependencies(s.edges, 5)


@query("direct_dependents", "sgv", "select distinct source id from sgv where target = 5")
def direct_dependents(s: Star) -> DataFrame:
    return graph.dependents(s.edges, 5)


def _seed(s: Star, node: int) -> DataFrame:
    return s.spark.createDataFrame([(node,)], "seed long")


@query("transitive_dependencies", "cl", "select node id from cl where seed = 5")
def transitive_dependencies(s: Star) -> DataFrame:
    return graph.reach(s.even_edges, _seed(s, 5)).select(F.col("node").alias("id"))


@query("transitive_dependents", "cl", "select seed id from cl where node = 5")
def transitive_dependents(s: Star) -> DataFrame:
    return graph.reach(graph.reverse(s.even_edges), _seed(s, 5)).select(F.col("node").alias("id"))


@query("transitive_closure", "cl", "select seed, node from cl")
def transitive_closure(s: Star) -> DataFrame:
    return graph.reach(s.even_edges).select("seed", "node")


@query("transitive_impact", "cl nd", "select id, (select count(*) from cl where node = id) impact from nd")
def transitive_impact(s: Star) -> DataFrame:
    n = graph.reach(s.even_edges).groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("impact"))
    return s.nodes.select("id").join(n, "id", "left").fillna(0)


_PATHS = "p as (select [n_nationkey] path, n_nationkey::bigint as last from nation union all select list_append(path, target), target from p join ng on last = source where not list_contains(path, target) and len(path) < 12)"


@query("shortest_path", "ng", "")
def shortest_path(s: Star) -> DataFrame:
    n = s.table("nation").select(F.col("n_nationkey").alias("source"))
    pairs = n.crossJoin(n.select(F.col("source").alias("target")))  # 25 by 25
    return graph.shortest_paths(s.nation_edges, pairs).withColumn("path", F.array_join(F.transform("path", lambda x: F.lpad(x.cast("string"), 2, "0")), ">"))


SQL["shortest_path"] = with_data("ng", "").replace("with ng", "with recursive ng", 1) + f""", {_PATHS}
select source, target, min(path) as path from (select path[1] source, last as target, array_to_string(list_transform(path, lambda x: lpad(x::varchar, 2, '0')), '>') path, len(path) n, min(len(path)) over (partition by path[1], last) as fewest from p)
where n = fewest group by 1, 2"""


@query("shortest_path_lengths", "sg", "")
def shortest_path_lengths(s: Star) -> DataFrame:
    return graph.reach(s.even_edges).where("seed <> node")


SQL["shortest_path_lengths"] = with_data("sg", "").replace("with steps", "with recursive steps", 1) + """, d as (select source seed, target node, 1 k from sg union select d.seed, g.target, k + 1 from d join sg g on d.node = g.source where k < 40)
select seed, node, min(k)::bigint steps from d where seed <> node group by 1, 2"""


@query("neighborhood_k", "sg", """, both_ways as (select source a, target b from sg union select target, source from sg), one as (select b from both_ways where a = 5)
    select 5::bigint id union select b from one union select w.b from one join both_ways w on one.b = w.a""")
def neighborhood_k(s: Star) -> DataFrame:
    return graph.neighborhood(s.even_edges, 5, 2)


@query("betweenness", "ng", "")
def betweenness(s: Star) -> DataFrame:
    n = s.table("nation").select(F.col("n_nationkey").alias("id"))
    return graph.betweenness(n, s.nation_edges).withColumn("centrality", F.round("centrality", 9))


SQL["betweenness"] = with_data("ng", "").replace("with ng", "with recursive ng", 1) + """, d(s, v, k) as (select source, target, 1 from ng union select d.s, g.target, k + 1 from d join ng g on d.v = g.source where k < 25),
sp as (select s, v, min(k) dist from d where s <> v group by 1, 2),
w(s, v, k) as (select source, target, 1 from ng union all select w.s, g.target, w.k + 1 from w join sp on sp.s = w.s and sp.v = w.v and sp.dist = w.k join ng g on w.v = g.source),
x as (select sp.s, sp.v, sp.dist, count(*) sig from w join sp on sp.s = w.s and sp.v = w.v and sp.dist = w.k group by 1, 2, 3)
select n_nationkey id, round(coalesce(b, 0) / (24 * 23), 9) centrality from nation left join (select a.v, sum(a.sig * b.sig / st.sig::double) b from x a join x b on a.v = b.s
join x st on st.s = a.s and st.v = b.v and a.dist + b.dist = st.dist where a.s <> b.v group by 1) on v = n_nationkey"""


@query("graph_collapse", "ne", """select a source, b target, sum(import_count)::bigint import_count from (select array_to_string(string_split(source, '.')[1:2], '.') a, array_to_string(string_split(target, '.')[1:2], '.') b, import_count from ne)
    where a <> b group by all""")  # fmt: skip
def graph_collapse(s: Star) -> DataFrame:
    return graph.collapse(s.nodes.withColumn("ord", F.col("id")), s.named_edges, 1)[1].select("source", "target", "import_count")


@query("graph_collapse_nodes", "nd st", """select name, id, loc from (select array_to_string(string_split(name, '.')[1:2], '.') as name, id, loc from nd join st using (id)) qualify row_number() over (partition by name order by id) = 1""")
def graph_collapse_nodes(s: Star) -> DataFrame:
    return graph.collapse(s.modules.select("name", "id", "loc", F.col("id").alias("ord")), s.named_edges, 1)[0].drop("ord")


@query("graph_filter", "ne", "select source, target, import_count from ne where source like 'A%' and target like 'A%' and source not like '%Supplier%1' and target not like '%Supplier%1'")
def graph_filter(s: Star) -> DataFrame:
    def kept(c: str):
        return names.any_glob(F.col(c), ["A*"]) & ~names.any_glob(F.col(c), ["*Supplier*1"])

    return s.named_edges.where(kept("source") & kept("target")).select("source", "target", "import_count")


@query("topological_levels", "fwd nd", "")
def topological_levels(s: Star) -> DataFrame:
    return graph.topological_levels(s.nodes, s.forward_edges)


SQL["topological_levels"] = with_data("fwd nd", "").replace("with steps", "with recursive steps", 1) + """, c as (select source a, target b from fwd union select c.a, f.target from c join fwd f on c.b = f.source),
bad as (select a id from c where a = b union select b from c where a in (select a from c where a = b)), good as (select id from nd where id not in (select id from bad)),
e as (select source, target from fwd where source in (select id from good) and target in (select id from good)),
l as (select id, 0 as level from good where id not in (select target from fwd) union select e.target, level + 1 from l join e on l.id = e.source)
select id, max(level)::bigint as level from l group by 1"""


@query("package_edges", "ne", r"select distinct regexp_replace(source, '\.[^.]*$', '') source, regexp_replace(target, '\.[^.]*$', '') target from ne where regexp_replace(source, '\.[^.]*$', '') <> regexp_replace(target, '\.[^.]*$', '')")
def package_edges(s: Star) -> DataFrame:
    return graph.package_edges(s.named_edges)


@query("top_hubs", "deg", "select id, ca, ce from (select * from deg order by ca desc, id limit 15) where ca > 0")
def top_hubs(s: Star) -> DataFrame:
    return graph.top_hubs(s.nodes, s.edges)


@query("graph_summary", "ne deg", r"""select (select count(*) from deg) as modules, (select count(*) from ne) as edges, (select max(ca) from deg) as most_importers,
    (select count(distinct regexp_replace(source, '\.[^.]*$', '')) from ne where regexp_replace(source, '\.[^.]*$', '') <> regexp_replace(target, '\.[^.]*$', '')) as packages""")  # fmt: skip
def graph_summary(s: Star) -> DataFrame:
    p = graph.package_edges(s.named_edges).agg(F.count_distinct("source").alias("packages"))
    d = graph.degrees(s.nodes, s.edges).agg(F.count(F.lit(1)).alias("modules"), F.max("ca").alias("most_importers"))
    return d.crossJoin(s.edges.agg(F.count(F.lit(1)).alias("edges"))).crossJoin(p)


@query("set_union_impact", "cl", "select seed id from cl where node = 5 union select seed from cl where node = 7")
def set_union_impact(s: Star) -> DataFrame:
    back = graph.reverse(s.even_edges)
    return graph.reach(back, _seed(s, 5)).select(F.col("node").alias("id")).union(graph.reach(back, _seed(s, 7)).select("node")).distinct()


@query("set_intersect_dependents", "sgv", "select source id from sgv where target = 5 intersect select source from sgv where target = 7")
def set_intersect_dependents(s: Star) -> DataFrame:
    return graph.dependents(s.edges, 5).intersect(graph.dependents(s.edges, 7))


@query("set_difference_impact", "cl sg", "select seed id from cl where node = 5 except select source from sg where target = 5")
def set_difference_impact(s: Star) -> DataFrame:
    return graph.reach(graph.reverse(s.even_edges), _seed(s, 5)).select(F.col("node").alias("id")).subtract(graph.dependents(s.even_edges, 5))


# --- cycles --------------------------------------------------------------------------------


@query("scc", "cl", "select a.seed id, least(min(a.node), a.seed) scc from cl a join cl b on a.seed = b.node and a.node = b.seed where a.seed <> a.node group by a.seed")
def scc(s: Star) -> DataFrame:
    return graph.strong_components(s.even_edges)


_PATH = "array_to_string(path, '>')"


def _cycles(s: Star) -> tuple[DataFrame, DataFrame]:
    return cycles.elementary_cycles(s.nation_edges), s.nation_edges


def _text(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


@query("cycles", "cy", f"select {_PATH} as path, length::int as length from cy")
def cycles_(s: Star) -> DataFrame:
    return _text(_cycles(s)[0].select("path", "length"))


@query("cycle_severity", "sev", f"select {_PATH} as path, length::int as length, outside, severity from sev")
def cycle_severity(s: Star) -> DataFrame:
    return _text(cycles.severity(*_cycles(s)))


@query("cycle_break", "brk", f"select {_PATH} as path, e[1] source, e[2] target from brk")
def cycle_break(s: Star) -> DataFrame:
    return _text(cycles.breaks(*_cycles(s)))


@query("cycle_kind", "knd", f"select {_PATH} as path, kind from knd")
def cycle_kind(s: Star) -> DataFrame:
    return _text(cycles.kinds(*_cycles(s)))


@query("cycle_participation", "cye", "select source id, count(*) cycles from cye group by 1")
def cycle_participation(s: Star) -> DataFrame:
    return cycles.participation(_cycles(s)[0])


@query("cycle_edges", "cye ng", "select source, target, (source, target) in (select (source, target) from cye) is_cycle_member from ng")
def cycle_edges(s: Star) -> DataFrame:
    return cycles.cycle_edges(*_cycles(s))


@query("cycle_summary", "sev knd", """select kind, severity, count(*) cycles, max(length)::int longest from sev join knd using (path) group by all""")
def cycle_summary(s: Star) -> DataFrame:
    return cycles.report(*_cycles(s)).groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("cycles"), F.max("length").alias("longest"))


# --- metrics -------------------------------------------------------------------------------


def _metrics(s: Star) -> DataFrame:
    c = graph.betweenness(s.nodes, s.edges).withColumn("centrality", F.round("centrality", 6))
    return metrics.module_metrics(s.modules, s.edges, c)


@query("module_role", "m0", "select id, role from m0")
def module_role(s: Star) -> DataFrame:
    return s.modules.select("id", metrics.module_role(F.col("name"), F.col("is_package")).alias("role"))


@query("arch_role", "m2", "select id, arch_role from m2")
def arch_role(s: Star) -> DataFrame:
    return _metrics(s).select("id", "arch_role")


@query("percentile_rank", "deg", "select id, ca, cume_dist() over (order by ca) as rank from deg")
def percentile_rank(s: Star) -> DataFrame:
    return graph.degrees(s.nodes, s.edges).select("id", "ca", metrics.percentile_rank("ca").alias("rank"))


@query("adaptive_thresholds", "thr", "select * from thr")
def adaptive_thresholds(s: Star) -> DataFrame:
    roles = s.modules.withColumn("role", metrics.module_role(F.col("name"), F.col("is_package")))
    return metrics.adaptive_thresholds(roles, Thresholds())


@query("module_health", "mm", "select id, raw_health, health from mm")
def module_health(s: Star) -> DataFrame:
    return _metrics(s).select("id", "raw_health", "health")


_MM = "id, name, ca, ce, import_count, loc, cc, cog, instability, abstractness, distance, centrality, role, arch_role, raw_health, health, language"


@query("module_metrics", "mm", f"select {_MM} from mm")
def module_metrics(s: Star) -> DataFrame:
    return _metrics(s).select(*_MM.split(", "))


@query("project_metrics", "mm sgv", """select count(*) as modules, sum(loc)::bigint loc, round(avg(round(instability, 3)), 9) avg_instability, max(round(instability, 3)) max_instability,
    count(*) filter (health = 'unknown') as unknown, count(*) filter (health = 'critical') critical, count(*) filter (health = 'high') high, count(*) filter (health = 'elevated') elevated,
    count(*) filter (health = 'moderate') moderate, count(*) filter (health = 'healthy') healthy, (select count(*) from sgv) as edges, round((select count(*) from sgv) / (count(*) * (count(*) - 1)), 4) density from mm""")  # fmt: skip
def project_metrics(s: Star) -> DataFrame:
    return metrics.project_metrics(_metrics(s), s.edges).withColumn("avg_instability", F.round("avg_instability", 9))


def _impact(s: Star) -> DataFrame:
    return graph.reach(s.edges).groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("cascade"))


def _cascade(measured: DataFrame) -> DataFrame:
    return measured.where("transitive > 0").select("id", F.col("transitive").alias("cascade"))


@query("edit_cost", "ec", "select id, files, cascade, tokens, case when files >= 10 then 'high' when files >= 5 then 'medium' else 'low' end risk from ec")
def edit_cost(s: Star) -> DataFrame:
    return metrics.edit_cost(s.modules, s.edges, _impact(s))


@query("edit_cost_churn", "ec cat", """select id, files, cascade, tokens, case when category is null then 'low' when category = 'hot' and files >= 5 then 'high' when category in ('hot', 'warm') or files >= 3 then 'medium'
    else 'low' end risk from ec left join cat on path = id""")  # fmt: skip
def edit_cost_churn(s: Star) -> DataFrame:
    return metrics.edit_cost(s.modules, s.edges, _impact(s), _churned(s).select(F.col("path").alias("id"), "category"))


@query("metrics_top_k", "mm", "select id, ca, ce, cc from mm order by ca desc, id limit 20")
def metrics_top_k(s: Star) -> DataFrame:
    return metrics.sort_metrics(_metrics(s), "ca", 20).select("id", "ca", "ce", "cc")


@query("metrics_by_health", "mm", """select id, health, cc from mm order by case health when 'unknown' then -1 when 'critical' then 0 when 'high' then 1 when 'elevated' then 2 when 'moderate' then 3 else 4 end, cc desc, id limit 25""")
def metrics_by_health(s: Star) -> DataFrame:
    return metrics.sort_metrics(_metrics(s), "health", 25).select("id", "health", "cc")


@query("function_complexity_topk", "sy", "select module, name, complexity from sy where kind = 'function' order by complexity desc, module, name limit 30")
def function_complexity_topk(s: Star) -> DataFrame:
    return metrics.functions_by_complexity(s.symbols).select("module", "name", "complexity")


# --- insights ------------------------------------------------------------------------------


def _short_cycles(s: Star) -> DataFrame:
    """All cycles of two to four modules, listed once."""
    return s.once("short-cycles", lambda: cycles.elementary_cycles(s.edges, longest=4, cap=1 << 30))


def _measured(s: Star) -> DataFrame:
    return s.once("measured", lambda: context.measures(_metrics(s), graph.reach(s.edges), context.cycles_of(_short_cycles(s))))


_CASES = (
    ("parse_error", "parse_failed", "'critical'", "loc"),
    ("i3 >= 0.8 and ce > 3", "high_instability", "case when i3 < 0.95 then 'warning' else 'critical' end", "i3"),
    ("i3 <= 0.2 and ca > 3", "highly_stable", "'info'", "i3"),
    ("ce >= 8", "high_efferent", "'warning'", "ce"),
    ("ca >= 8", "high_afferent", "'warning'", "ca"),
    ("ca = 0 and ce = 0", "isolated", "'info'", "0"),
    ("cc >= 50", "extreme_cyclomatic", "'critical'", "cc"),
    ("cc >= 20 and cc < 50", "high_cyclomatic", "'warning'", "cc"),
    ("cog >= 50", "extreme_cognitive", "'critical'", "cog"),
    ("cog >= 25 and cog < 50", "high_cognitive", "'warning'", "cog"),
    ("loc >= 500", "very_large_module", "'warning'", "loc"),
    ("loc >= 300 and loc < 500", "large_module", "'info'", "loc"),
    ("direct >= 10", "critical_blast_radius", "'critical'", "direct"),
    ("direct >= 5 and direct < 10", "high_blast_radius", "'warning'", "direct"),
    ("transitive > direct + 3", "wide_transitive_reach", "'info'", "transitive"),
    ("cycle_count > 0", "in_cycle", "case when largest_cycle >= 4 then 'critical' else 'warning' end", "cycle_count"),
    ("ce >= 6", "high_fan_out", "'info'", "ce"),
    ("class_count > 0 and d3 >= 0.5 and a3 <= 0.2 and i3 <= 0.3 and arch_role in ('core', 'hub-by-design')", "core_module", "'info'", "d3"),
    ("class_count > 0 and d3 >= 0.5 and a3 <= 0.2 and i3 <= 0.3 and arch_role not in ('core', 'hub-by-design')", "zone_of_pain", "'warning'", "d3"),
    ("class_count > 0 and d3 >= 0.5 and a3 >= 0.8 and i3 >= 0.7", "zone_of_uselessness", "'warning'", "d3"),
    ("class_count > 0 and d3 <= 0.2", "well_balanced", "'info'", "d3"),
)
_DATA["ins"] = ("me", "select id, seq, code, severity, value, row_number() over (partition by id order by case severity when 'critical' then 2 when 'warning' then 1 else 0 end desc, seq)::int place from (" + " union all ".join(
    f"select id, {i} seq, '{code}' code, {severity} severity, ({value})::double as value from me where {test}" for i, (test, code, severity, value) in enumerate(_CASES)) + ")")


@query("insights", "ins", "select id, place, code, severity, value from ins")
def insights_(s: Star) -> DataFrame:
    return insights.insights(_measured(s)).select("id", "place", "code", "severity", "value")


@query("insights_core_rewrite", "ins", "select id, code, severity, row_number() over (partition by id order by case severity when 'critical' then 2 when 'warning' then 1 else 0 end desc, place)::int place from (" + """
    select id, place, case when n is null then code else n end code, case when n is null then severity else 'info' end severity from (
    select *, row_number() over (partition by id, coalesce(n, '=' || code) order by place) k from (select *, case code when 'extreme_cyclomatic' then 'core_high_cc' when 'high_cyclomatic' then 'core_high_cc'
    when 'extreme_cognitive' then 'core_high_cog' when 'high_cognitive' then 'core_high_cog' when 'critical_blast_radius' then 'core_wide_reach' when 'high_blast_radius' then 'core_wide_reach' end n from ins)
    where code <> 'high_afferent') where n is null or k = 1)""")  # fmt: skip
def insights_core_rewrite(s: Star) -> DataFrame:
    return insights.rewrite_for_core(insights.insights(_measured(s))).select("id", "place", "code", "severity")


@query("insights_min_severity", "ins", "select id, code from ins where place <= 3 and code in (" + ", ".join(f"'{c}'" for c, v in insights.SEVERITY.items() if v != "info") + ")")
def insights_min_severity(s: Star) -> DataFrame:
    return insights.at_least(insights.insights(_measured(s)), "warning").select("id", "code")


_RISK = """case when cycle_count > 0 then 'tangled' when ca >= 5 and (cc >= 20 or cog >= 25) then 'hub' when (cc >= 20 or cog >= 25) and i3 >= 0.8 then 'fragile'
    when i3 >= 0.8 and ce >= 5 then 'volatile' when direct >= 3 and transitive >= direct * 2 then 'amplifier' end"""


@query("risk", "me", f"select id, {_RISK} risk from me")
def risk(s: Star) -> DataFrame:
    return _measured(s).select("id", insights.risk().alias("risk"))


# --- rules ---------------------------------------------------------------------------------

_LAYERS = ("AFRICA", "ASIA", "EUROPE")
_LAYER = "case when {0} like 'AFRICA.%' then 0 when {0} like 'ASIA.%' then 1 when {0} like 'EUROPE.%' then 2 else -1 end"
_FORBIDDEN = (("AMERICA", ("*.NATION_2*", "EUROPE")), ("ASIA", ("AFRICA.NATION_0", "AFRICA")))
_PROTECTED = ((("EUROPE", "MIDDLE EAST.*"), ("EUROPE", "ASIA.*")),)
_ALLOW = (("AFRICA", "*.test_*"),)
_INDEPENDENT = (("AFRICA.NATION_0", "EUROPE", "AFRICA.NATION_5"),)


@query("pattern_match", "nd", "select id, name like 'AFRICA.%' a, regexp_full_match(name, '.*\\.test_.') b, name = 'none' c from nd")
def pattern_match(s: Star) -> DataFrame:
    n = F.col("name")
    return s.nodes.select("id", names.module_matches(n, "AFRICA").alias("a"), names.module_matches(n, "*.test_?").alias("b"), names.module_matches(n, "none").alias("c"))


@query("layer_index", "nd", f"select id, {_LAYER.format('name')} as layer from nd")
def layer_index(s: Star) -> DataFrame:
    return s.nodes.select("id", rules.layer_index(F.col("name"), _LAYERS).alias("layer"))


_R_LAYERS = f"""select 2 rule_ord, 'layers' rule_type, source, target, a || ' -> ' || b as rule from (select distinct source, target, {_LAYER.format('source')} a, {_LAYER.format('target')} b from ne)
    where a >= 0 and b >= 0 and a < b and not (source like 'AFRICA.%' and target like '%.test\\_%' escape '\\')"""
_R_FORBIDDEN = """select 0 rule_ord, 'forbidden' rule_type, source, target, case when target like '%.NATION\\_2%' escape '\\' then 'AMERICA -> *.NATION_2*' else 'AMERICA -> EUROPE' end as rule from ne
    where source like 'AMERICA.%' and (target like '%.NATION\\_2%' escape '\\' or target like 'EUROPE.%')
    union all select 0, 'forbidden', source, target, case when target like 'AFRICA.NATION\\_0.%' escape '\\' then 'ASIA -> AFRICA.NATION_0' else 'ASIA -> AFRICA' end from ne where source like 'ASIA.%' and target like 'AFRICA.%'"""
_R_PROTECTED = """select 1 rule_ord, 'protected' rule_type, source, target, 'EUROPE' as rule from ne where target like 'EUROPE.%' and source not like 'EUROPE.%' and source not like 'ASIA.%'
    union all select 1, 'protected', source, target, 'MIDDLE EAST.*' from ne where target like 'MIDDLE EAST.%' and source not like 'EUROPE.%' and source not like 'ASIA.%'"""
_DATA["nc"] = ("clv nd", "select a.name source, b.name target from clv join nd a on a.id = seed join nd b on b.id = node")
_R_INDEPENDENT = "select 3 rule_ord, 'independence' rule_type, source, target, case " + " ".join(
    f"when source like '{x}.%' and target like '{y}.%' then '{x} | {y}'" for i, a in enumerate(_INDEPENDENT[0]) for b in _INDEPENDENT[0][i + 1 :] for x, y in ((a, b), (b, a))
) + " end as rule from nc where rule is not null"
_R_SIBLINGS = """select 4 rule_ord, 'acyclic_siblings' rule_type, s source, t target, 'EUROPE' as rule from sib where exists (from sibc where a = t and b = s)"""
_DATA["sib"] = ("ne", """select distinct s, t from (select 'EUROPE.' || string_split(source, '.')[2] s, 'EUROPE.' || string_split(target, '.')[2] t from ne where source like 'EUROPE.%' and target like 'EUROPE.%') where s <> t""")
_DATA["sibc"] = ("sib", "select s a, t b from sib union select sibc.a, sib.t from sibc join sib on sibc.b = sib.s")
_RECURSIVE.add("sibc")


def _shown(df: DataFrame) -> DataFrame:
    return df.drop("severity")


@query("rule_layers", "ne", _R_LAYERS)
def rule_layers(s: Star) -> DataFrame:
    return _shown(rules.layers(s.named_edges, _LAYERS, _ALLOW))


@query("rule_forbidden", "ne", _R_FORBIDDEN)
def rule_forbidden(s: Star) -> DataFrame:
    return _shown(rules.forbidden(s.named_edges, _FORBIDDEN))


@query("rule_protected", "ne", _R_PROTECTED)
def rule_protected(s: Star) -> DataFrame:
    return _shown(rules.protected(s.named_edges, _PROTECTED))


@query("rule_independence", "nc", _R_INDEPENDENT)
def rule_independence(s: Star) -> DataFrame:
    return _shown(rules.independence(s.named_edges, _INDEPENDENT))


@query("rule_acyclic_siblings", "sibc", _R_SIBLINGS)
def rule_acyclic_siblings(s: Star) -> DataFrame:
    return _shown(rules.acyclic_siblings(s.named_edges, ("EUROPE",)))


@query("rule_violations", "ne nc sibc", " union all ".join(f"select rule_ord, rule_type, source, target, rule from ({q})" for q in (_R_FORBIDDEN, _R_PROTECTED, _R_LAYERS, _R_INDEPENDENT, _R_SIBLINGS)))
def rule_violations(s: Star) -> DataFrame:
    return _shown(rules.check(s.named_edges, Rules(layers=_LAYERS, allow=_ALLOW, forbidden=_FORBIDDEN, protected=_PROTECTED, independence=_INDEPENDENT, acyclic_siblings=("EUROPE",))))


# --- symbols -------------------------------------------------------------------------------

_PATTERNS = ("ring", "bolt")


def _references(s: Star) -> DataFrame:
    return symbols.resolve_references(s.references, s.symbols)


@query("symbol_stats", "sy", "select module as module, count(*) filter (kind = 'class') as classes, count(*) filter (kind = 'function') as functions, count(*) total, max(complexity)::int most_complex from sy group by module")
def symbol_stats(s: Star) -> DataFrame:
    return symbols.registry(s.symbols).groupBy("module").agg(F.count_if(F.col("kind") == "class").alias("classes"), F.count_if(F.col("kind") == "function").alias("functions"), F.count(F.lit(1)).alias("total"), F.max("complexity").alias("most_complex"))


@query("symbol_lookup", "sy", "select module, name, kind from sy where name = (select min(name) from sy where module = 7)")
def symbol_lookup(s: Star) -> DataFrame:
    name = s.symbols.where("module = 7").agg(F.min("name")).first()[0]
    return symbols.lookup(s.symbols, name, 7).select("module", "name", "kind")


@query("module_symbols", "sy", "select name, kind from sy where module = 7")
def module_symbols(s: Star) -> DataFrame:
    return symbols.module_symbols(s.symbols, 7).select("name", "kind")


@query("symbol_refs", "rr", "select source, target, name, kind from rr")
def symbol_refs(s: Star) -> DataFrame:
    return _references(s).select("source", "target", "name", "kind")


@query("symbol_edges", "rr", "select source, target, name, kind, count(*) as references_ from rr where kind is not null group by all")
def symbol_edges(s: Star) -> DataFrame:
    return symbols.symbol_edges(_references(s)).withColumnRenamed("references", "references_")


@query("symbol_usage", "us", "select * from us")
def symbol_usage(s: Star) -> DataFrame:
    return symbols.usage(_references(s))


@query("symbol_hotspots", "us", "select * from us where usage >= 2")
def symbol_hotspots(s: Star) -> DataFrame:
    return symbols.hotspots(_references(s), 2)


@query("unused_symbols", "sy us", "select module, name, kind from sy where (module, name) not in (select (module, name) from us) and not list_bool_or(list_transform(decorators, lambda d: contains(d, 'ring') or contains(d, 'bolt')))")
def unused_symbols(s: Star) -> DataFrame:
    return symbols.unused(s.symbols, _references(s), _PATTERNS).select("module", "name", "kind")


@query("framework_entry", "sy", "select name, list_bool_or(list_transform(decorators, lambda d: contains(d, 'ring') or contains(d, 'bolt'))) entry from sy")
def framework_entry(s: Star) -> DataFrame:
    return s.symbols.select("name", symbols.is_framework_entry(F.col("decorators"), _PATTERNS).alias("entry"))


@query("symbol_impact", "rr", "select target as module, name, count(distinct source) importers from rr where kind is not null group by all")
def symbol_impact(s: Star) -> DataFrame:
    return symbols.impact(_references(s)).groupBy("module", "name").agg(F.count(F.lit(1)).alias("importers"))


# --- history -------------------------------------------------------------------------------


def _now():
    return F.lit(NOW).cast("timestamp")


def _churned(s: Star) -> DataFrame:
    return churn.churn(s.commit_files, _now()).withColumn("category", churn.category(F.col("commits"), F.col("days")))


@query("churn", "ch", "select * from ch")
def churn_(s: Star) -> DataFrame:
    return churn.churn(s.commit_files, _now())


@query("churn_category", "cat", "select path, category from cat")
def churn_category(s: Star) -> DataFrame:
    return _churned(s).select("path", "category")


@query("history_summary", "", f"select count(distinct event_id) commits, count(distinct user_id) files, count(distinct event_type) authors from events where ts >= timestamp '{NOW}' - interval 14 day")
def history_summary(s: Star) -> DataFrame:
    return churn.summary(churn.within(s.commit_files, _now(), 14))


@query("hotspots", "ch st", "select id, path, commits, days, cc, round(cc * commits * exp(-days / 30.0::double), 1) score from ch join st on path = id order by score desc, id limit 20")
def hotspots(s: Star) -> DataFrame:
    sized = s.modules.select(F.col("id").alias("path"), "id", "cc")
    return churn.hotspots(churn.churn(s.commit_files, _now()), sized).select("id", "path", "commits", "days", "cc", "score")


# --- contexts ------------------------------------------------------------------------------

_DATA["rel"] = ("sgv cyc4", """select id, other, row_number() over (partition by id order by kind, other)::int place from (select id, other, min(kind) kind from (
    select a.source id, a.target other, 1 kind from sgv a join sgv x on x.target = a.source join sgv y on y.source = x.source and y.target = a.target where a.source <> a.target group by all having count(distinct x.source) >= 2
    union all select a.id, b.id, 0 from (select unnest(c) id, c from cyc4) a join (select unnest(c) id, c from cyc4) b on a.c = b.c and a.id <> b.id) group by 1, 2)
    qualify place <= 8""")  # fmt: skip


@query("related_modules", "rel", "select id, other as related, place from rel")
def related_modules(s: Star) -> DataFrame:
    return context.related(s.edges, _short_cycles(s))


@query("file_context_compact", "me ins rel ec", f"""select id, loc, role, arch_role, health, cc, cog, ca, ce, round(instability, 3) instability, transitive transitive_impact, files edit_files, tokens edit_tokens,
    case when files >= 10 then 'high' when files >= 5 then 'medium' else 'low' end edit_risk, {_RISK} risk,
    coalesce((select string_agg(target::varchar, ',' order by target) from sgv where source = me.id), '') deps, coalesce((select string_agg(source::varchar, ',' order by source) from sgv where target = me.id), '') dependents,
    coalesce((select string_agg(code, ',' order by place) from ins where ins.id = me.id and place <= 3), '') insights, coalesce((select string_agg(other::varchar, ',' order by place) from rel where rel.id = me.id), '') related
    from me join (select id, files, tokens from ec) using (id)""")  # fmt: skip
def file_context_compact(s: Star) -> DataFrame:
    m = _measured(s)
    rows = context.compact(m, s.edges, insights.insights(m), metrics.edit_cost(s.modules, s.edges, _cascade(m)), context.related(s.edges, _short_cycles(s)))
    lists = ("deps", "dependents", "insights", "related")
    return rows.select(*[F.coalesce(_joined(c), F.lit("")).alias(c) if c in lists else c for c in rows.columns if c != "name"])


@query("file_context_full")
def file_context_full(s: Star) -> DataFrame:
    m = _measured(s)
    rows = context.full(m, s.edges, insights.insights(m), metrics.edit_cost(s.modules, s.edges, _cascade(m)), context.related(s.edges, _short_cycles(s)), s.symbols, report=cycles.report(_short_cycles(s), s.edges))
    return context.as_json(rows)


@query("shared_dependencies", "sgv", "select target id, count(distinct source) users from sgv where source in (1, 5, 7, 11) group by 1 having count(distinct source) >= 2")
def shared_dependencies(s: Star) -> DataFrame:
    return context.shared_dependencies(s.edges, [1, 5, 7, 11])


@query("batch_context", "clv sgv", """select id, bool_or(h = 1) is_dependency, bool_or(h = 2) is_dependent, bool_or(h = 3) is_transitive from (select target id, 1 h from sgv where source in (1, 5, 7)
    union all select source, 2 from sgv where target in (1, 5, 7) union all select seed, 3 from clv where node in (1, 5, 7)) where id not in (1, 5, 7) group by 1""")  # fmt: skip
def batch_context(s: Star) -> DataFrame:
    return context.batch(s.edges, graph.reach(s.edges), [1, 5, 7])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)



