"""Queries of the task, history, migration and index operators, each with DuckDB SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import boundaries, change, doctor, evidence, extract, graph, history, index, migration, reports, rules, search, structure, tasks
from .plans import policy
from .queries import IMPLS, RULE_SQL, context, query, spans, walk_sql
from .scratch import scratch_path


def col(text: str):
    return F.expr(text)


# -------------------------------------------------------------------- history

COMMITS = "(select 'src/m' || cast(o_custkey % 200 as varchar) || '.py' as path, 'c' || cast(o_orderkey as varchar) as sha, o_orderstatus as author, cast(o_orderdate as date) as date, o_orderpriority as summary, o_orderkey as seq, case when o_orderkey % 97 = 0 then 'src/m' || cast((o_custkey + 1) % 200 as varchar) || '.py' end as old_path from {orders})"


def commits(b):
    return b.orders.select(
        col("concat('src/m', o_custkey % 200, '.py')").alias("path"), col("concat('c', o_orderkey)").alias("sha"), F.col("o_orderstatus").alias("author"), col("cast(o_orderdate as date)").alias("date"),
        F.col("o_orderpriority").alias("summary"), F.col("o_orderkey").alias("seq"), col("case when o_orderkey % 97 = 0 then concat('src/m', (o_custkey + 1) % 200, '.py') end").alias("old_path"),
    )


NAMES = "select path, name from (with recursive m as (select distinct path as name, old_path as older from " + COMMITS + " c where old_path is not null), w as (select path, path as name from (values ('src/m7.py'), ('src/m8.py'), ('src/none.py')) v(path) union select w.path, m.older from w join m on m.name = w.name) select * from w) z"


def asked(b):
    return b.spark.createDataFrame([("src/m7.py",), ("src/m8.py",), ("src/none.py",)], "path string")


@query("select path, name, sha, author, date, summary, cast(rank as integer) as rank from (select n.path, n.name, c.sha, c.author, c.date, c.summary, row_number() over (partition by n.path order by c.seq desc, c.sha, n.name) as rank from (" + NAMES + ") n join " + COMMITS + " c on c.path = n.name) x")
def src15_file_history(b):
    return history.file_history(asked(b), commits(b))


@query("select path, arg_min(sha, seq) as first_seen, arg_max(sha, seq) as latest from " + COMMITS + " c group by path")
def src15_first_and_latest_commit(b):
    return history.ends(commits(b))


# ------------------------------------------------------------------ structure

RANGES = "(select 'src/m' || cast(l_partkey % 200 as varchar) || '.py' as path, cast(l_orderkey % 293 as int) as s, cast(l_orderkey % 293 + l_linenumber as int) as e from {lineitem})"


def ranges(b):
    return b.lineitem.select(col("concat('src/m', l_partkey % 200, '.py')").alias("path"), col("cast(l_orderkey % 293 as int)").alias("s"), col("cast(l_orderkey % 293 + l_linenumber as int)").alias("e"))


@query(f"select path, id, s, e from {IMPLS} n where exists (select 1 from (select distinct * from {RANGES} q) r where r.path = n.path and n.s <= r.e and r.s <= n.e)")
def j13_changed_symbols(b):
    return structure.intersecting(spans(b), ranges(b)).select("path", "id", "s", "e")


SECTIONS = "(select 'docs/c' || cast(c_nationkey as varchar) || '.yaml' as path, 'k' || cast(c_custkey as varchar) as key, cast(c_custkey % 400 as int) as s, cast(c_custkey % 400 + c_custkey % 41 as int) as e from {customer})"
MARKED = "(select 'docs/c' || cast(s_nationkey as varchar) || '.yaml' as path, s_suppkey as marker, cast(s_suppkey * 7 % 430 as int) as line from {supplier})"


@query(f"select m.path, m.marker, n.key, cast(row_number() over (partition by m.path, m.marker order by n.s, n.key) as integer) as position from {MARKED} m join {SECTIONS} n on n.path = m.path and m.line between n.s and n.e")
def x10_sections_of_markers(b):
    sections = b.customer.select(col("concat('docs/c', c_nationkey, '.yaml')").alias("path"), col("concat('k', c_custkey)").alias("key"), col("cast(c_custkey % 400 as int)").alias("s"), col("cast(c_custkey % 400 + c_custkey % 41 as int)").alias("e"))
    marks = b.supplier.select(col("concat('docs/c', s_nationkey, '.yaml')").alias("path"), F.col("s_suppkey").alias("marker"), col("cast(s_suppkey * 7 % 430 as int)").alias("line"))
    return structure.sections_at(marks, sections)


OWNED = "(select path, trace_id as name, s, e, case when trace_id like '%1' or trace_id like '%2' then trace_id end as traced_by from {nodes} where node_type = 'implementation')"
PARENTS = f"(select i.path, i.name, i.s, arg_min(o.traced_by, struct_pack(w := o.e - o.s, s := o.s, n := o.name)) as parent from (select path, name, s, e from {OWNED} a) i join (select path, name, s, e, coalesce(traced_by, '') as traced_by from {OWNED} c) o on o.path = i.path and o.s <= i.s and o.e >= i.e and o.name <> i.name group by i.path, i.name, i.s)"
DIRECTIVES = "(select path, s - 1 as line, case when trace_id like '%3' then '# trace:exempt reason=helper' when trace_id like '%4' then '# trace:exempt reason=' when trace_id like '%5' then '// trace:exempt reason=x' when trace_id like '%6' then '# trace:inherit impl.o' || cast(s * 100 as varchar) || ' reason=part' end as text, trace_id from {nodes} where node_type = 'implementation')"


@query(f"""with parents as {PARENTS}, d as {DIRECTIVES},
 x as (select distinct b.path, b.name, b.s from {OWNED} b join d on d.path = b.path and d.line in (b.s, b.s - 1) where d.text like '# trace:exempt reason=%helper'),
 t as (select b.path, b.name, b.s, arg_min(regexp_extract(d.text, 'inherit ([^ ]+)', 1), d.line) as target from {OWNED} b join d on d.path = b.path and d.line in (b.s, b.s - 1) where d.text like '# trace:inherit%' group by b.path, b.name, b.s),
 i as (select t.path, t.name, t.s from t join {{nodes}} n on n.trace_id = t.target and n.active and n.path = t.path join parents p on p.path = t.path and p.name = t.name and p.s = t.s where p.parent = t.target)
 select b.path, b.name, b.s, case when b.traced_by is not null then 'traced' when x.name is not null then 'exempt' when i.name is not null then 'inherited' end as account from {OWNED} b left join x on x.path = b.path and x.name = b.name and x.s = b.s left join i on i.path = b.path and i.name = b.name and i.s = b.s""")
def x14_accounted_boundaries(b):
    own = b.nodes.filter("node_type = 'implementation'")
    marked = own.select("path", F.col("trace_id").alias("name"), F.lit("function").alias("kind"), F.lit("python").alias("language"), "s", "e", col("case when trace_id like '%1' or trace_id like '%2' then trace_id end").alias("traced_by"))
    text = col("case when trace_id like '%3' then '# trace:exempt reason=helper' when trace_id like '%4' then '# trace:exempt reason=' when trace_id like '%5' then '// trace:exempt reason=x' when trace_id like '%6' then concat('# trace:inherit impl.o', s * 100, ' reason=part') end")
    lines = own.select("path", (F.col("s") - 1).alias("line"), text.alias("text"))
    return boundaries.accounted(marked, lines, b.nodes).select("path", "name", "s", "account")


@query(f"select distinct n.path, n.id as name, n.s from {IMPLS} n join (select path, id as key, s + cast(s % 4 as int) - 1 as line from {IMPLS} k where id like '%7') c on c.path = n.path and c.key = n.id and abs(c.line - n.s) <= 1")
def src19_sidecar_boundaries(b):
    marked = spans(b).select("path", F.col("id").alias("name"), "s")
    cars = spans(b).filter("id like '%7'").select("path", F.col("id").alias("key"), col("cast(s + s % 4 - 1 as int)").alias("line"))
    return boundaries.in_sidecars(marked, cars)


# ------------------------------------------------------------------ migration

FIELDS = """(select path, line, key, value from (select case when o_orderkey % 3 = 0 then 'tests/t' || cast(o_custkey % 50 as varchar) || '.py' when o_orderkey % 3 = 1 then 'src/m' || cast(o_custkey % 50 as varchar) || '.go' else 'docs/d' || cast(o_custkey % 50 as varchar) || '.md' end as path, cast(o_orderkey as int) as line,
 unnest(['work_item', 'plan', 'spec', 'commit', 'jira_ref', 'odd']) as key, unnest([case when o_orderkey % 5 = 0 then 'WORK-' || cast(o_custkey as varchar) when o_orderkey % 5 = 1 then 'not an id' end, case when o_orderkey % 7 = 0 then 'PLAN-1' end, case when o_orderkey % 4 = 0 then 'specs/a.md#REQ-' || cast(o_custkey as varchar) when o_orderkey % 4 = 1 then 'specs/a.md' end, case when o_orderkey % 6 = 0 then 'abc' end, case when o_orderkey % 10 = 9 then 'J-1' end, case when o_orderkey % 11 = 0 then '' end]) as value from {orders}) u where value is not null)"""
CLASSED = f"""(select *, case when value = '' then 'dropped' when key in ('work_item', 'plan') and value not like '% %' then 'deterministic' when key = 'spec' and value like '%#REQ-%' and path not like 'docs/%' then 'high_confidence' when key = 'commit' then 'derived' else 'requires_review' end as class from {FIELDS} f)"""
RANK = "case class when 'dropped' then 0 when 'deterministic' then 1 when 'high_confidence' then 2 when 'derived' then 3 else 4 end"
PLANNED = f"""(select path, line, case coalesce(max(case when class in ('deterministic', 'high_confidence') then {RANK} end), max({RANK})) when 0 then 'dropped' when 1 then 'deterministic' when 2 then 'high_confidence' when 3 then 'derived' else 'requires_review' end as class,
 coalesce(array_to_string(list_sort(list(distinct case when class in ('deterministic', 'high_confidence') then case key when 'work_item' then 'work ' || value when 'plan' then 'implements ' || value else case when path like 'tests/%' then 'verifies ' else 'satisfies ' end || split_part(value, '#', 2) end end)), ','), '') as edges from {CLASSED} c group by path, line)"""


def legacy(b):
    path = col("case when o_orderkey % 3 = 0 then concat('tests/t', o_custkey % 50, '.py') when o_orderkey % 3 = 1 then concat('src/m', o_custkey % 50, '.go') else concat('docs/d', o_custkey % 50, '.md') end")
    values = {
        "work_item": "case when o_orderkey % 5 = 0 then concat('WORK-', o_custkey) when o_orderkey % 5 = 1 then 'not an id' end", "plan": "case when o_orderkey % 7 = 0 then 'PLAN-1' end",
        "spec": "case when o_orderkey % 4 = 0 then concat('specs/a.md#REQ-', o_custkey) when o_orderkey % 4 = 1 then 'specs/a.md' end", "commit": "case when o_orderkey % 6 = 0 then 'abc' end", "jira_ref": "case when o_orderkey % 10 = 9 then 'J-1' end", "odd": "case when o_orderkey % 11 = 0 then '' end",
    }
    each = F.array(*[F.struct(F.lit(k).alias("key"), col(v).alias("value")) for k, v in values.items()])
    return b.orders.select(path.alias("path"), col("cast(o_orderkey as int)").alias("line"), F.explode(each).alias("x")).select("path", "line", "x.key", "x.value").filter("value is not null")


@query("select path, line, class, edges from " + PLANNED + " p")
def q18_migration_plan(b):
    return migration.plan(legacy(b)).select("path", "line", "class", F.array_join(F.array_sort(F.transform("edges", lambda e: F.concat(e["p"], F.lit(" "), e["t"]))), ",").alias("edges"))


@query("select v.class, count(p.class) as n from (values ('dropped'), ('deterministic'), ('high_confidence'), ('derived'), ('requires_review')) v(class) left join " + PLANNED + " p on p.class = v.class group by v.class")
def a09_migration_summary(b):
    return migration.summary(migration.plan(legacy(b)))


@query("select path, count_if(class = 'dropped') as dropped, count_if(class = 'deterministic') as deterministic, count_if(class = 'high_confidence') as high_confidence, count_if(class = 'derived') as derived, count_if(class = 'requires_review') as requires_review, count_if(class in ('deterministic', 'high_confidence')) as rewritten from " + PLANNED + " p group by path")
def a10_migration_files(b):
    return migration.per_file(migration.plan(legacy(b)))


# ---------------------------------------------------------------------- tasks

@query("""select conv_id, turn, case when t = '' then 'Task' when length(t) > 72 then t[1:72] || '…' else t end as title, t as intent, 'Implement: ' || case when length(t) > 200 then t[1:200] || '…' else t end as step
 from (select conv_id, turn, trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) as t from {conversations} where text is not null) x""")
def x22_bundles(b):
    rows = b.conversations.filter("text is not null").withColumn("b", tasks.bundle(F.col("text")))
    return rows.select("conv_id", "turn", "b.title", "b.intent", F.col("b.plan.steps")[0].alias("step"))


@query("select conv_id, turn, cast(case when turn % 3 = 1 then 1 else 0 end + case when turn % 4 = 2 then 1 else 0 end as integer) as n_faults from {conversations} where text is not null")
def x21_bundle_faults(b):
    made = tasks.bundle(F.col("text"))
    made = F.when(F.col("turn") % 3 == 1, made.withField("kind", F.lit("odd"))).otherwise(made)
    made = F.when(F.col("turn") % 4 == 2, made.withField("title", F.lit(" "))).otherwise(made)
    rows = b.conversations.filter("text is not null").select("conv_id", "turn", F.to_json(made).alias("bundle"))
    return tasks.with_faults(rows).select("conv_id", "turn", F.size("faults").alias("n_faults"))


@query("""select w.trace_id as work, coalesce(r.reqs, '') as requirements, p.plan from {nodes} w
 left join (select o.t as work, array_to_string(list_sort(list(distinct s.t)), ',') as reqs from {edges} o join {nodes} n on n.trace_id = o.f and n.node_type = 'implementation' join {edges} s on s.f = o.f and s.p = 'satisfies' where o.p = 'work' group by o.t) r on r.work = w.trace_id
 left join (select o.t as work, arg_min(s.t, struct_pack(f := s.f, t := s.t)) as plan from {edges} o join {edges} s on s.f = o.f and s.p = 'implements' where o.p = 'work' group by o.t) p on p.work = w.trace_id where w.active and w.node_type = 'work'""")
def j26_activation(b):
    return tasks.activation(b.edges, b.nodes).select("work", F.array_join("requirements", ",").alias("requirements"), "plan")


PENDING = "(select distinct 'src/m' || cast(o_custkey % 200 as varchar) || '.py' as path, 'Svc.f' || cast(o_orderkey % 50 as varchar) as symbol, 'impl.f' || cast(o_orderkey % 50 as varchar) as suggested from {orders})"
PRESENT = "(select distinct 'src/m' || cast(l_partkey % 200 as varchar) || '.py' as path, case when l_orderkey % 2 = 0 then 'Svc.f' else 'Other.F' end || cast(l_orderkey % 60 as varchar) as name, l_orderkey % 3 = 0 as traced from {lineitem} where l_linenumber = 1)"
CARRIED = "(select distinct 'src/m' || cast(o_custkey % 200 as varchar) || '.py' as path, 'impl.f' || cast(o_orderkey % 50 as varchar) as trace_id from {orders} where o_orderkey % 4 = 0)"


@query(f"""select q.path, q.symbol, q.suggested, case when t then 'satisfied' when t is not null or k then 'pending' else 'stale' end as state from (
 select p.*, coalesce(n.traced, a.traced) as t, exists (select 1 from {CARRIED} c where c.path = p.path and c.trace_id = p.suggested) as k from {PENDING} p
 left join (select path, name, bool_or(traced) as traced from {PRESENT} x group by path, name) n on n.path = p.path and n.name = p.symbol
 left join (select path, lower(split_part(name, '.', 2)) as slug, bool_or(traced) as traced from {PRESENT} y group by path, slug) a on a.path = p.path and a.slug = split_part(p.symbol, '.', 2)) q""")
def j25_obligations(b):
    path = lambda c: col(f"concat('src/m', {c} % 200, '.py')").alias("path")
    pending = b.orders.select(path("o_custkey"), col("concat('Svc.f', o_orderkey % 50)").alias("symbol"), col("concat('impl.f', o_orderkey % 50)").alias("suggested")).distinct()
    present = b.lineitem.filter("l_linenumber = 1").select(path("l_partkey"), col("concat(case when l_orderkey % 2 = 0 then 'Svc.f' else 'Other.F' end, l_orderkey % 60)").alias("name"), col("l_orderkey % 3 = 0").alias("traced")).distinct()
    ids = b.orders.filter("o_orderkey % 4 = 0").select(path("o_custkey"), col("concat('impl.f', o_orderkey % 50)").alias("trace_id")).distinct()
    return tasks.reconciled(pending, present, ids)


@query("select 'REQ-' || cast(c_custkey as varchar) as trace_id, case when c_custkey % 11 = 0 then false when c_custkey % 7 = 0 then true when c_custkey % 5 = 0 then false else c_custkey % 3 = 0 or c_custkey % 4 = 0 end as drifted from {customer}")
def f05_requirement_drift(b):
    id_ = col("concat('REQ-', c_custkey)").alias("trace_id")
    stored = b.customer.select(id_, col("case when c_custkey % 11 <> 0 then 'docs/r.md' end").alias("path"), F.lit("title").alias("title"), col("case when c_custkey % 5 <> 0 then 'fp' end").alias("fingerprint"))
    blocks = b.customer.filter("c_custkey % 7 <> 0").select(id_, F.lit("docs/r.md").alias("path"), col("case when c_custkey % 4 = 0 then 'other' else 'title' end").alias("title"), col("case when c_custkey % 3 = 0 then 'new' else 'fp' end").alias("fingerprint"))
    return tasks.drifted(stored, blocks)


STOP = "'the', 'a', 'an', 'and', 'or', 'for', 'with', 'to', 'it', 'this', 'that', 'of', 'in', 'on', 'is', 'are', 'was', 'be', 'make', 'add', 'fix', 'change', 'continue', 'work', 'also', 'ignore', 'using', 'use', 'so', 'then', 'now', 'but', 'not', 'what', 'when', 'how'"
TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda x: x not in (" + STOP + ")))"
WORKS = "(select 'WORK-S' || cast(s_suppkey as varchar) as id, n_name || ' ' || cast(s_suppkey % 17 as varchar) || ' can please user' as title, case when s_suppkey % 3 = 0 then 'active' when s_suppkey % 13 = 1 then 'done' end as status, 'Write summary ' || n_name as req, case when s_suppkey % 4 = 0 then 'table ' || n_name end as boundary, s_suppkey % 9 = 2 as changed, s_suppkey % 8 = 3 as recent from {supplier} join {nation} on n_nationkey = s_nationkey)"
SHARE = "len(list_intersect(p.want, {}))"


@query(f"""with p as (select conv_id || '-' || cast(turn as varchar) as prompt, {TOKENS.replace('{}', 'text')} as want, case when turn = 1 then ['s3'] else [] end as on_ from {{conversations}} where text is not null),
 w as (select *, {TOKENS.replace('{}', 'title')} as tt, {TOKENS.replace('{}', 'req')} as rt, {TOKENS.replace('{}', "coalesce(boundary, '')")} as bt, {TOKENS.replace('{}', 'id')} as it, 'REQ-' || id as rid from {WORKS} x where coalesce(status, '') <> 'done'),
 s as (select p.prompt, w.id, 2.0 * {SHARE.replace('{}', 'w.tt')} / len(p.want) + 0.5 * {SHARE.replace('{}', 'w.bt')} / len(p.want) + case when {SHARE.replace('{}', 'w.rt')} > 0 then 1.5 else 0 end + case when len(list_intersect(p.on_, list_concat(w.it, w.tt))) > 0 then 0.4 else 0 end
   + case when changed then 0.4 else 0 end + case when recent then 0.3 else 0 end + case when status = 'active' then 0.3 else 0 end as score from p, w where len(p.want) > 0),
 m as (select prompt, arg_min(id, struct_pack(s := -round(score, 9), i := id)) as id, max(round(score, 9)) as score from s where round(score, 9) > 0 group by prompt)
 select p.prompt, case when least(1.0, m.score) >= 0.55 then m.id end as work, round(least(1.0, coalesce(m.score, 0.0)), 2) as confidence, case when least(1.0, m.score) >= 0.55 then 'resume' else 'new' end as resolution from p left join m on m.prompt = p.prompt""")
def q16_resolve(b):
    prompts, work = requests(b)
    return tasks.resolved(prompts, work).select("prompt", "work", "confidence", "resolution")


def requests(b):
    """Requests, and the work items that they may resume."""
    prompts = b.conversations.filter("text is not null").select(col("concat(conv_id, '-', turn)").alias("prompt"), "text", col("case when turn = 1 then 's3' end").alias("branch"))
    work = b.supplier.join(b.nation, F.col("n_nationkey") == F.col("s_nationkey")).select(
        col("concat('WORK-S', s_suppkey)").alias("trace_id"), col("concat(n_name, ' ', s_suppkey % 17, ' can please user')").alias("title"), col("case when s_suppkey % 3 = 0 then 'active' when s_suppkey % 13 = 1 then 'done' end").alias("status"),
        col("array(struct(concat('REQ-WORK-S', s_suppkey) as id, concat('Write summary ', n_name) as title))").alias("reqs"), col("case when s_suppkey % 4 = 0 then concat('table ', n_name) end").alias("boundary"), col("s_suppkey % 9 = 2").alias("changed"), col("s_suppkey % 8 = 3").alias("recent"),
    )
    return prompts, work


def found_sql(docs, prompts, k):
    """Ranked (query, id, score, rank) of all ``prompts`` (query, text) over ``docs`` (id, text)."""
    return f"""with dw as (select id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from {docs} x), tot as (select count(*) as docs, avg(len(w)) as mean from dw),
 post as (select id, length, term, count(*) as n from (select id, len(w) as length, unnest(w) as term from dw) u group by id, length, term), df as (select term, count(*) as d from post group by term),
 q as (select query, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as term from {prompts} y where regexp_matches(text, '^[A-Za-z0-9\\s]+$')), nq as (select query, count(*) as k from q group by query),
 s as (select q.query, post.id, count(*) as m, -sum(greatest(1e-6, ln((docs - d + 0.5) / (d + 0.5))) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length / mean))) as score from q join post on post.term = q.term join df on df.term = q.term, tot group by q.query, post.id)
 select query, id, score, rank from (select s.query, id, round(score, 6) as score, cast(row_number() over (partition by s.query order by round(score, 9), id) as integer) as rank from s join nq on nq.query = s.query and nq.k = s.m) z where rank <= {k}"""


PROMPTS = "(select conv_id || '-' || cast(turn as varchar) as query, regexp_extract(text, '[A-Za-z0-9]+') || ' ' || regexp_extract(regexp_replace(text, '^[^A-Za-z0-9]*[A-Za-z0-9]+', ''), '[A-Za-z0-9]+') as text from {conversations} where text is not null)"


def two_words(b):
    """The first two words of each turn, as queries."""
    rest = F.regexp_replace("text", "^[^A-Za-z0-9]*[A-Za-z0-9]+", "")
    return b.conversations.filter("text is not null").select(col("concat(conv_id, '-', turn)").alias("query"), F.concat(F.regexp_extract("text", "[A-Za-z0-9]+", 0), F.lit(" "), F.regexp_extract(rest, "[A-Za-z0-9]+", 0)).alias("text"))


@query(found_sql("(select doc_id as id, case when doc_id % 5 = 0 then lang || ' now ' || text else text end as text from {documents} where text is not null and doc_id % 11 <> 0)", PROMPTS, 10))
def ft05_batched_search(b):
    """All queries at once over a stored index, after an update of some documents and the removal of others."""
    docs = b.documents.filter("text is not null").select(F.col("doc_id").alias("id"), "lang", "text")
    index_ = search.StoredIndex(b.spark, scratch_path(b.spark, "search"), ["text"])
    index_.update(docs)
    index_.update(docs.filter("id % 5 = 0 and id % 11 <> 0").withColumn("text", F.concat("lang", F.lit(" now "), "text")), docs.filter("id % 11 = 0").select("id"))
    return index_.best(two_words(b), 10).withColumn("score", F.round("score", 6))


HIT_DOCS = "(select id, title as text from " + WORKS + " x union all select 'REQ-' || id, req from " + WORKS + " y)"


@query(f"""with h as ({found_sql(HIT_DOCS, PROMPTS, 10)}), p as (select conv_id || '-' || cast(turn as varchar) as prompt, lower(text) as low, {TOKENS.replace('{}', 'text')} as want, case when turn = 1 then ['s3'] else [] end as on_, case when conv_id % 3 = 0 then 'WORK-S' || cast(conv_id % 7 as varchar) end as active from {{conversations}} where text is not null),
 a as (select *, {TOKENS.replace('{}', 'title')} as tt, {TOKENS.replace('{}', 'req')} as rt, {TOKENS.replace('{}', "coalesce(boundary, '')")} as bt, {TOKENS.replace('{}', 'id')} as it, 'REQ-' || id as rid from {WORKS} x), w as (select * from a where coalesce(status, '') <> 'done'),
 f as (select distinct h.query as prompt, w.id from h join w on h.id in (w.id, w.rid)),
 s as (select p.prompt, w.id, w.rid, 2.0 * {SHARE.replace('{}', 'w.tt')} / len(p.want) + 0.5 * {SHARE.replace('{}', 'w.bt')} / len(p.want) + case when {SHARE.replace('{}', 'w.rt')} > 0 then 1.5 else 0 end + case when len(list_intersect(p.on_, list_concat(w.it, w.tt))) > 0 then 0.4 else 0 end
   + case when f.id is not null then 0.6 else 0 end + case when changed then 0.4 else 0 end + case when recent then 0.3 else 0 end + case when status = 'active' then 0.3 else 0 end as score,
   concat_ws(',', case when {SHARE.replace('{}', 'w.tt')} > 0 then 'work_title' end, case when {SHARE.replace('{}', 'w.rt')} > 0 then 'requirement_title' end, case when f.id is not null then 'fts' end, case when len(list_intersect(p.on_, list_concat(w.it, w.tt))) > 0 then 'branch' end, case when {SHARE.replace('{}', 'w.bt')} > 0 then 'receipts' end, case when changed then 'changed_boundaries' end, case when recent then 'git_history' end, case when status = 'active' then 'open_work' end) as src
   from p join w on len(p.want) > 0 left join f on f.prompt = p.prompt and f.id = w.id),
 m as (select prompt, arg_min(id, k) as id, arg_min(rid, k) as rid, arg_min(src, k) as src, max(round(score, 9)) as score from (select *, struct_pack(s := -round(score, 9), i := id) as k from s) z where round(score, 9) > 0 group by prompt),
 o as (select p.*, a.rid as arid, coalesce(p.active is not null and (len(list_intersect(p.want, list_concat(a.tt, a.rt))) > 0 or list_contains(p.want, 'keep') or list_contains(p.want, 'again') or (regexp_matches(low, '\\b(this|that|it)\\b') and not regexp_matches(low, '\\b(its|itself|this_|that_)\\b'))), p.active is not null and regexp_matches(low, '\\b(this|that|it)\\b') and not regexp_matches(low, '\\b(its|itself|this_|that_)\\b')) as on_active from p left join a on a.id = p.active)
 select o.prompt, case when on_active then active when least(1.0, m.score) >= 0.55 then m.id end as work, case when on_active then 1.0 else round(least(1.0, coalesce(m.score, 0.0)), 2) end as confidence, case when on_active or least(1.0, m.score) >= 0.55 then 'resume' else 'new' end as resolution,
  case when on_active then coalesce(arid, '') when least(1.0, m.score) >= 0.55 then m.rid else '' end as requirements, case when on_active then 'active_session' else coalesce(m.src, '') end as sources from o left join m on m.prompt = o.prompt""")
def q16_resolve_session(b):
    prompts, work = requests(b)
    prompts = prompts.join(b.conversations.select(col("concat(conv_id, '-', turn)").alias("prompt"), col("case when conv_id % 3 = 0 then concat('WORK-S', conv_id % 7) end").alias("active")), "prompt")
    docs = work.select(F.col("trace_id").alias("id"), F.col("title").alias("text")).unionByName(work.select(F.concat(F.lit("REQ-"), "trace_id").alias("id"), F.col("reqs")[0]["title"].alias("text")))
    index_ = search.StoredIndex(b.spark, scratch_path(b.spark, "search"), ["text"])
    index_.update(docs)
    hits = index_.best(two_words(b), 10).select(F.col("query").alias("prompt"), F.col("id").alias("trace_id"))
    rows = tasks.resolved(prompts, work, hits)
    return rows.withColumn("requirements", F.array_join("requirements", ",")).withColumn("sources", F.array_join("sources", ","))


@query("select distinct e.t as work from {live} e join {nodes} n on n.trace_id = e.f and n.active where e.p = 'work' and n.path in (select path from {changes})")
def set07_owners_of_changed_paths(b):
    return tasks.owners(b.changes, b.nodes, b.edges)


# --------------------------------------------------------------- index, doctor

DECLARED = "(select distinct 'doc.' || cast(doc_id as varchar) as f, 'documents' as p, 'impl.o' || cast(doc_id % k as varchar) as t from {documents}, (values (500), (700)) as ks(k) where text is not null)"
OLD = "(select f, p, t, kind, status from {edges} union all select 'doc.' || cast(doc_id as varchar), 'documents', 'impl.gone', 'declared', 'active' from {documents} where text is not null)"


def previous_edges(b):
    more = b.documents.filter("text is not null").select(col("concat('doc.', doc_id)").alias("f"), F.lit("documents").alias("p"), F.lit("impl.gone").alias("t"), F.lit("declared").alias("kind"), F.lit("active").alias("status"))
    return b.edges.select("f", "p", "t", "kind", "status").unionByName(more)


@query(f"select f, p, t, kind, status from {OLD} o where kind <> 'structural' and f not in (select f from {DECLARED} d)")
def set03_kept_edges(b):
    redeclared = b.documents.filter("text is not null").select(col("concat('doc.', doc_id)").alias("trace_id"))
    return index.kept_edges(previous_edges(b), redeclared)


def whole_index(b):
    at = F.lit(None)
    nodes = b.nodes.select("trace_id", "node_type", F.lit(None).cast("string").alias("title"), "path", "s", "e", F.lit("fp").alias("fingerprint"), F.lit("symbol").alias("attachment"), F.lit("ast").alias("parser"), "status", "active")
    docs = b.documents.filter("text is not null").select(col("concat('doc.', doc_id)").alias("trace_id"), F.lit("document").alias("node_type"), F.lit("old").alias("title"), col("concat('docs/d', doc_id, '.md')").alias("path"), F.lit(1).alias("s"), F.lit(1).alias("e"), F.lit("fp").alias("fingerprint"), F.lit("file").alias("attachment"), F.lit("generic").alias("parser"), col("case when doc_id % 9 = 0 then 'stale_review_required' else 'current' end").alias("status"), F.lit(True).alias("active"))
    edges = previous_edges(b).withColumn("path", at.cast("string")).withColumn("line", at.cast("int"))
    versions = docs.filter("trace_id like '%1'").select("trace_id", "fingerprint", F.lit("0").alias("observed"))
    files = b.files.filter("text is not null").select("path", "text")
    symbols = b.spark.createDataFrame([], "path string, id string, s int, e int, hash string, parser string")
    return index.run(files, symbols, index.Index(nodes.unionByName(docs), edges, versions, b.spark.createDataFrame([], "rule string, trace_id string, path string, line int, detail string")), files.select("path"), at="1")


@query(f"""select f, p, t, kind from {OLD} o where kind <> 'structural' and f not in (select f from {DECLARED} d)
 union all select f, p, t, 'declared' from {DECLARED} d
 union all select a.trace_id, 'contains', c.trace_id, 'structural' from {{nodes}} a join {{nodes}} c on c.path = a.path and a.s < c.s and a.e > c.e where a.active and c.active""")
def q21_index_edges(b):
    return whole_index(b).edges.select("f", "p", "t", "kind")


@query("""select trace_id, status, active, false as changed from {nodes}
 union all select 'doc.' || cast(doc_id as varchar), case when doc_id % 10 = 1 then 'current' when doc_id % 9 = 0 then 'stale_review_required' else 'current' end, true, doc_id % 10 = 1 from {documents} where text is not null""")
def q21_index_nodes(b):
    return whole_index(b).nodes.select("trace_id", "status", "active", "changed")


# Files of a second run: edited (a quarter), deleted, and moved to another folder.
LAST = "(select doc_id, 'impl.d' || cast(doc_id as varchar) as id, case when doc_id % 12 = 3 then 'lib/d' else 'src/d' end || cast(doc_id as varchar) || '.py' as path, case when doc_id % 4 = 1 then doc_id % 80 else doc_id % 90 end as target from {documents} where doc_id % 12 <> 6)"
LINKS = f"(select id as f, 'work' as p, 'WORK-' || cast(doc_id % 50 as varchar) as t, path from {LAST} a union all select id, 'depends_on', 'impl.d' || cast(target as varchar), path from {LAST} c)"


def second_run(b):
    """The index after a run over all files and one over the paths that changed since."""
    spans = lambda files: extract.symbols(files.withColumn("language", F.lit("python"))).withColumn("id", F.concat_ws(":", "name", "s"))
    one = index.run(b.repo.select("path", "text"), spans(b.repo.select("path", "text")), at="1")
    n = F.col("doc_id")
    moved = b.repo.filter((n % 4 == 1) | (n % 12 == 6) | (n % 12 == 3)).select("path").unionByName(b.repo_next.filter(n % 12 == 3).select("path"))
    # Only what changed is parsed.
    fresh = b.repo_next.join(moved, "path", "left_semi").select("path", "text")
    return index.run(fresh, spans(fresh), one, moved, at="2")


@query(f"""with changed as (select 'impl.d' || cast(doc_id as varchar) as id from {{documents}} where doc_id % 4 = 1)
 select l.id as trace_id, l.path, 2 as s, 3 as e, true as active, case when exists (select 1 from {LINKS} k join changed c on c.id = k.t where k.f = l.id) then 'stale_review_required' else 'current' end as status, l.doc_id % 4 = 1 as changed from {LAST} l
 union all select 'impl.d' || cast(doc_id as varchar), 'src/d' || cast(doc_id as varchar) || '.py', 2, 3, false, 'current', false from {{documents}} where doc_id % 12 = 6""")
def q21_second_run_nodes(b):
    return second_run(b).nodes.select("trace_id", "path", "s", "e", "active", "status", "changed")


@query(f"select f, p, t, 'declared' as kind, path, 1 as line from {LINKS} k")
def q21_second_run_edges(b):
    return second_run(b).edges.select("f", "p", "t", "kind", "path", "line")


@query(f"""select 'TL002' as rule, cast(null as varchar) as trace_id, k.path, 1 as line, k.f || ' ' || k.p || ' -> ' || k.t as detail from {LINKS} k left join {LAST} l on l.id = k.t where l.id is null
 union all select case when doc_id % 10 = 3 then 'TL040' else 'TL006' end, id, path, 1, case when doc_id % 10 = 3 then 'unknown odd' else 'repeated title' end from {LAST} a where doc_id % 10 in (3, 4)""")
def q21_second_run_findings(b):
    return second_run(b).findings


@query("""select distinct * from (
 select 'TL002' as rule, 'ERROR' as severity, f as trace_id, cast(null as varchar) as path, cast(null as integer) as line, p || ' misses ' || t as detail from {live} e where t not in (select trace_id from {nodes})
 union all select 'TL002', 'ERROR', f, null, null, p || ' misses ' || f from {live} e where t in (select trace_id from {nodes}) and f not in (select trace_id from {nodes})
 union all select 'TL001', 'ERROR', d.trace_id, d.path, d.line, 'declared at ' || cast(m.n as varchar) || ' places' from (select distinct trace_id, path, s as line from {decl}) d join (select trace_id, count(*) as n from (select distinct trace_id, path, s from {decl}) x group by trace_id having count(*) > 1) m on m.trace_id = d.trace_id
 union all select 'TL110', 'INFO', trace_id, path, null, 'review' from {nodes} where active and status = 'stale_review_required'
 union all select 'TL040', 'INFO', null, path, line, 'migration ' || class from """ + PLANNED + """ p where class in ('derived', 'requires_review')) z""")
def q09_doctor(b):
    b.stored("nodes", "edges")
    return doctor.examined(b.nodes, b.edges, b.decl.select("trace_id", "path", F.col("s").alias("line")), migration=migration.plan(legacy(b)))


@query("select trace_id, cast(row_number() over (partition by trace_id order by part, key) as integer) as position, text from (select trace_id, 0 as part, '' as key, trace_id || ' (' || node_type || ') [' || upper(status) || ']' as text from {nodes} where path = 'src/m7.py' union all select distinct x.trace_id, x.part, x.p || ' ' || x.other, case x.part when 1 then '  -> ' else '  <- ' end || x.p || ' ' || x.other || ' [' || upper(n.status) || ']' from (select f as trace_id, 1 as part, p, t as other from {edges} union all select t, 2, p, f from {edges}) x join {nodes} n on n.trace_id = x.other where x.trace_id in (select trace_id from {nodes} where path = 'src/m7.py')) z")
def q03_context_text(b):
    b.stored("nodes", "edges")
    return reports.context_text(b.nodes.filter("path = 'src/m7.py'"), b.nodes, b.edges)


# -------------------------------------------------------------------- changes

@query("select trace_id, case when node_type = 'plan' then 'reviewed_needs_verification' else status end as status, case when node_type = 'plan' then 'docs/p.md' else path end as path from {nodes}")
def snk05_patched_nodes(b):
    updates = b.nodes.filter("node_type = 'plan'").select("trace_id", F.lit("reviewed_needs_verification").alias("status"), F.lit("docs/p.md").alias("path"))
    return change.patched(b.nodes.select("trace_id", "status", "path"), updates)


@query("select f, p, t, case when f in (select trace_id from {nodes} where node_type = 'test') then 'superseded' else status end as status from {edges}")
def snk05_edge_status(b):
    return change.edge_status(b.edges.select("f", "p", "t", "status"), b.nodes.filter("node_type = 'test'").select("trace_id"), "superseded")


@query("select trace_id, fingerprint, max(observed) as observed from (select trace_id, fingerprint, observed from {versions} union all select 'impl.o' || cast(o_orderkey as varchar), 'fp' || cast(o_custkey % 7 as varchar), date '2030-01-01' from {orders} where o_orderkey % 2 = 0) x group by trace_id, fingerprint")
def snk03_versions(b):
    seen = b.orders.filter("o_orderkey % 2 = 0").select(col("concat('impl.o', o_orderkey)").alias("trace_id"), col("concat('fp', o_custkey % 7)").alias("fingerprint"), col("date'2030-01-01'").alias("observed"))
    return change.recorded_versions(b.versions, seen)


@query("select '{\"trace_id\":\"' || trace_id || '\",\"node_type\":\"' || node_type || '\",\"active\":' || cast(active as varchar) || '}' as json from {nodes}".replace("'{", "'{{").replace("}'", "}}'"))
def snk07_json_rows(b):
    return reports.as_json(b.nodes.select("trace_id", "node_type", "active"))


@query("select get_key as kind, count(*) as n from (select json_extract_string(j, '$.kind') as get_key from (select '{\"kind\":\"' || kind || '\"}' as j from {edges}) x) y group by get_key".replace("'{", "'{{").replace("}'", "}}'"))
def fn_json_field(b):
    made = b.edges.select(F.to_json(F.struct("kind")).alias("j"))
    return made.select(F.get_json_object("j", "$.kind").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("select 'e_' || substr(sha256(concat_ws('|', 'n_' || substr(sha256(f), 1, 32), p, 'n_' || substr(sha256(t), 1, 32), kind, '', '')), 1, 32) as uid, f, p, t from {edges} order by uid limit 500")
def s06_edges_by_uid(b):
    from .functions.ids import edge_uid, node_uid

    uid = edge_uid(node_uid(F.col("f")), F.col("p"), node_uid(F.col("t")), F.col("kind"), F.lit(None), F.lit(None))
    return b.edges.select(uid.alias("uid"), "f", "p", "t").orderBy("uid").limit(500)


# -------------------------------------------------- impact, linked tests, scopes

PAST = "(select n.path, c.sha, row_number() over (partition by n.path order by c.seq desc, c.sha, n.name) as rank from (" + NAMES.replace("(values ('src/m7.py'), ('src/m8.py'), ('src/none.py')) v(path)", "(select distinct path from {nodes} where trace_id in ('PRD-N7', 'impl.o7', 'impl.o207')) v") + ") n join " + COMMITS + " c on c.path = n.name)"
TOUCHED = "'PRD-N7', 'impl.o7', 'impl.o207'"


def _part(name, edges, columns, where=""):
    return f"select '{name}' as part, w.trace_id, w.depth, {columns} as detail from ({walk_sql(TOUCHED, 'in', 3, edges)}) w join {{nodes}} n on n.trace_id = w.trace_id where w.depth > 0{where}"


SEM, STRUCT = " where p <> 'contains'", " where p = 'contains'"


@query(" union all ".join([_part("semantic", SEM, "n.node_type"), _part("structural", STRUCT, "n.node_type"), _part("test", SEM, "n.status", " and n.node_type = 'test'"), "select part, trace_id, min(depth), detail from (" + _part("stale", SEM, "n.status", " and n.status <> 'current'") + " union all " + _part("stale", STRUCT, "n.status", " and n.status <> 'current'") + ") z group by part, trace_id, detail", "select 'history', path, cast(rank as int), sha from " + PAST + " h where rank <= 20 and path in (select path from {nodes} where trace_id in (" + TOUCHED + "))"]))
def g03_impact_parts(b):
    """Semantic and structural dependents, tests, what is stale, and the files' last commits."""
    b.stored("nodes", "edges")
    return graph.impact_summary(b.nodes.filter(f"trace_id in ({TOUCHED})"), b.nodes, b.edges, commits(b), max_nodes=None)


@query("select distinct impl, test from (select s.f as impl, v.f as test from {edges} s join {edges} v on v.t = s.t and v.p = 'verifies' where s.p = 'satisfies' union all select t, f from {edges} where p = 'exercises') x join {nodes} i on i.trace_id = x.impl and i.node_type = 'implementation' join {nodes} t on t.trace_id = x.test")
def j23_linked_tests(b):
    return evidence.linked_tests(b.nodes, b.edges)


BITS = "(select distinct 'test.s' || cast(l_suppkey as varchar) as test, 'src/m' || cast(l_partkey % 200 as varchar) || '.py' as path, cast(k as int) as line from {lineitem}, range(32) r(k) where (cast(l_orderkey * 2654435761 % 4294967296 as bigint) >> k) & 1 = 1)"


@query(f"select b.test, n.id as impl, count(*) as hits from {BITS} b join {IMPLS} n on n.path = b.path and b.line between n.s and n.e group by b.test, n.id")
def src11_per_test_coverage(b):
    """Line sets of coverage contexts, as bits, met with implementations."""
    h = F.lpad(F.hex((F.col("l_orderkey") * 2654435761 % 4294967296).cast("long")), 8, "0")
    little = F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)])
    bits = b.lineitem.select(F.concat(F.lit("test.s"), F.col("l_suppkey").cast("string"), F.lit("|run")).alias("context"), col("concat('src/m', l_partkey % 200, '.py')").alias("path"), F.unhex(little).alias("numbits"))
    return evidence.context_edges(evidence.context_lines(bits), spans(b))


SCOPED = [RULE_SQL[r] for r in ("TL002", "TL012", "TL020")]


@query("select rule, trace_id, path, line, detail, 'ERROR' as severity, cast(null as varchar) as waiver from (" + " union ".join(SCOPED) + ") x")
def set04_both_scopes(b):
    """Findings of the change and of the whole graph, each once."""
    scope = b.nodes.join(b.changes, "path", "left_semi").select("trace_id")
    changed = context(b, scope=scope)
    return policy.both_scopes(rules.Context(b.nodes, b.edges, changed_paths=changed.changed_paths, scope=scope), rules.Context(b.nodes, b.edges), "standard", {"verifying_test": True})


@query("select rule, trace_id, path, line, detail, 'ERROR' as severity, cast(null as varchar) as waiver from (" + RULE_SQL["TL002"] + " union all " + RULE_SQL["TL012"] + ") x where path in (select path from {changes})")
def p05_findings_of_paths(b):
    found = policy.evaluate(rules.Context(b.nodes, b.edges, changed_paths=b.changes), "standard", {"verifying_test": True})
    return policy.of_kind(found, rules=("TL002", "TL012"), severities=("ERROR",), paths=b.changes)


@query("select (select count(*) from {nodes}) as nodes, (select count(*) from {nodes} where active) as active, (select count(*) from {nodes} where active and status = 'stale_review_required') as stale, (select count(*) from {edges}) as edges, (select count(*) from {edges} where p <> 'contains') as semantic, (select count(*) from {edges} e where not exists (select 1 from {nodes} n where n.trace_id = e.t)) as broken, (select count(*) from {runs}) as runs, (select count(*) from {runs} where revision is null or revision <> 'rev1') as warnings")
def a02_status_warnings(b):
    ctx = context(b, revision="rev1")
    found = policy.waived(rules.other_revision(ctx).unionByName(rules.unbound_run(ctx)), None, ctx.today)
    return reports.status(b.nodes, b.edges, b.runs, found)


# ---------------------------------------------------------------- audit bundle

SOURCES = "(select 'src/m' || cast(doc_id as varchar) || '.py' as path, coalesce(text, '') as text from {documents} union all select 'tests/t' || cast(doc_id as varchar) || '.py', coalesce(text, '') from {documents} union all select 'docs/req' || cast(doc_id as varchar) || '.md', coalesce(text, '') from {documents})"
WORK = "WORK-S3"
NEAR = f"(with own as (select f as id from {{edges}} where p = 'work' and t = '{WORK}'), one as (select id from own union select t from {{edges}} where f in (select id from own)) select id from one union select f from {{edges}} where p in ('exercises', 'verifies') and t in (select id from one))"
LISTED = f"(select * from (select section, trace_id, detail, path, s, e, row_number() over (partition by section order by near desc, trace_id, coalesce(detail, '')) as rank from (select case node_type when 'requirement' then 'requirements' when 'decision' then 'decisions' when 'implementation' then 'implementations' else 'tests' end as section, n.trace_id, case node_type when 'implementation' then c.chain when 'test' then o.outcome end as detail, path, s, e, k.id is not null as near from {{nodes}} n left join {NEAR} k on k.id = n.trace_id left join ({{chains}}) c on c.impl = n.trace_id left join (select fid, arg_max(outcome, fid) as outcome from {{results}} where false group by fid) o on o.fid = n.trace_id where active and node_type in ('requirement', 'decision', 'implementation', 'test')) z) y where rank <= 50)"


CHAINS = "select n.trace_id as impl, array_to_string(list_concat(list_concat(list_concat(case when w.work is null then [] else [w.work] end, coalesce(r.reqs, [])), [n.trace_id]), coalesce(t.tests, [])), ' > ') as chain from {nodes} n left join (select f, min(t) as work from {edges} where p = 'work' group by f) w on w.f = n.trace_id left join (select f, list_sort(list(distinct t)) as reqs from {edges} where p = 'satisfies' group by f) r on r.f = n.trace_id left join (select t, list_sort(list(distinct f)) as tests from {edges} where p = 'exercises' group by t) t on t.t = n.trace_id where n.active and n.node_type = 'implementation'"
LISTED = LISTED.replace("{chains}", CHAINS)
SHOWN = f"(select l.*, case when x.path is not null then regexp_replace(array_to_string(string_split(x.text, chr(10))[greatest(1, coalesce(l.s, 1)):least(greatest(1, coalesce(l.s, 1)) + 399, coalesce(l.e, 1000000000))], chr(10)), '^\\s+|\\s+$', '', 'g')[1:2000] end as excerpt from {LISTED} l left join {SOURCES} x on x.path = l.path)"


@query(f"""with shown as materialized {SHOWN}, first as (select e.f as trace_id, min(e.t) as impl from {{edges}} e join shown i on i.section = 'implementations' and i.trace_id = e.t join {{nodes}} n on n.trace_id = e.f and n.active and n.node_type = 'test' where e.p = 'exercises' group by e.f),
 sus as (select 0 as kind, f.trace_id, 'misleading_test ' || f.impl as detail from first f left join shown t on t.section = 'tests' and t.trace_id = f.trace_id where not contains(coalesce(t.excerpt, ''), f.impl) and not contains(coalesce(t.excerpt, ''), split_part(f.impl, '.', 2))
  union select 1, trace_id, 'drift' from {{nodes}} where active and node_type = 'implementation' and status = 'stale_review_required'
  union select 2, x.plan, 'plan_gap ' || x.expected from {{expects}} x join {{nodes}} p on p.trace_id = x.plan and p.active and p.node_type = 'plan' where not exists (select 1 from {{live}} l join {{nodes}} n on n.trace_id = l.f where l.p = 'implements' and l.f = x.expected and l.t = x.plan))
 select section, cast(rank as integer) as rank, trace_id, detail, excerpt from shown
 union all select 'suspects', cast(rank as integer), trace_id, detail, null from (select *, row_number() over (order by kind, trace_id, detail) as rank from sus) z where rank <= 50
 union all select 'unexpected', cast(rank as integer), path, null, null from (select path, row_number() over (order by path) as rank from (select distinct path from {{changes}} where path not in (select path from {{nodes}} where active)) c) v where rank <= 50""")
def q12_audit_bundle(b):
    """Sections with excerpts and suspects for one work item."""
    b.stored("nodes", "edges")
    name = lambda kind: F.concat(F.lit(kind), F.col("doc_id").cast("string"))
    text = F.coalesce("text", F.lit("")).alias("text")
    texts = b.documents.select(F.concat(name("src/m"), F.lit(".py")).alias("path"), text).unionByName(b.documents.select(F.concat(name("tests/t"), F.lit(".py")).alias("path"), text)).unionByName(b.documents.select(F.concat(name("docs/req"), F.lit(".md")).alias("path"), text))
    none = b.spark.createDataFrame([], "rule string, trace_id string, path string, detail string")
    outcomes = b.spark.createDataFrame([], "fid string, outcome string")
    return reports.audit_bundle(WORK, b.nodes, b.edges, texts, b.changes.distinct(), none, outcomes, b.expects, symbol=F.split_part(F.col("trace_id"), F.lit("."), F.lit(2)))
