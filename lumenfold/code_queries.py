"""Further registered queries: names, imports and measures of the code that stands in for a repository, and labels, views and events of texts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.catalog import CALLS, DANGER, KIND, LINES, MI, RX, SCORE, SPLIT, STRIP, SYM_SQL, query, symbols, t
from lumenfold.functions import text as fn
from lumenfold.operators import history as hi
from lumenfold.operators import indexes as ix
from lumenfold.operators import parsing
from lumenfold.operators import quality as qu
from lumenfold.operators import relations as rel
from lumenfold.operators import search as se
from lumenfold.sources import files
from lumenfold.sources.store import children, work_dir
from lumenfold.streaming import jobs

#: The same code with imports, one a supplier in a file by nation, and a native form of each part in another language.
MOD_SQL = f"""{SYM_SQL}, modules as (
  select name, kind, file_path, parent, body, start_line from symbols
  union all
  select 'import_' || s_suppkey, 'import', 'port_' || s_nationkey || case s_nationkey % 3 when 0 then '.py' when 1 then '.java' else '.rs' end, '', case s_suppkey % 3 when 0 then 'from ctypes import part_' || s_suppkey when 1 then '  use pyo3::part_' || s_suppkey || ';  ' else 'import part_' || s_suppkey end, cast(s_suppkey as int)
  from supplier
  union all
  select 'part_' || p_partkey, 'function', 'native/' || p_brand || case when p_size % 2 = 0 then '.rs' else '.cpp' end, '', 'fn part_' || p_partkey || '()', cast(p_partkey as int)
  from part)"""
LANG = "case regexp_extract(file_path, '\\.[^./]+$') when '.py' then 'python' when '.java' then 'java' when '.rs' then 'rust' when '.cpp' then 'cpp' end"
MOD_CALLS = CALLS.replace("symbols", "modules")
DEPS = "select file_path as source_file, trim(body) as import_text, start_line as line from modules where kind = 'import'"
CROSS = f"""select source_file, import_text, source_language, target_symbol, target_language, target_file
from (select *, unnest(list_distinct(regexp_extract_all(import_text, '[A-Za-z_]\\w*'))) as target_symbol
  from (select file_path as source_file, trim(body) as import_text, {LANG} as source_language, case when contains(body, 'pyo3') then 'rust' when contains(body, 'ctypes') then 'cpp' end as target_language from modules where kind = 'import')
  where target_language <> source_language)
join (select name as target_symbol, {LANG} as target_language, max(file_path) as target_file from modules where kind <> 'import' group by 1, 2) using (target_symbol, target_language)"""
#: Files of that code: the bodies by place, FILE_KEYS keys a file, so that files stay small as tables grow.
FILE_KEYS = 500
FILED_SQL = f"{SYM_SQL.replace('symbols as (', 'placed as (')}, symbols as (select * replace (replace(file_path, '.py', '_' || start_line // {FILE_KEYS} || '.py') as file_path) from placed)"
FILES_SQL = f"{FILED_SQL}, files as (select file_path, string_agg(body, chr(10) order by start_line, name) as content from symbols group by 1)"

#: The same with a file a nation and a brand, whatever its length.
WHOLE_SQL = f"{SYM_SQL}, files as (select file_path, string_agg(body, chr(10) order by start_line, name) as content from symbols group by 1)"


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def modules(spark: SparkSession, d: str) -> DataFrame:
    key, nation, part = (F.col(c).cast("string") for c in ("s_suppkey", "s_nationkey", "p_partkey"))
    pick = lambda c, a, b, e: F.when(F.col(c) % 3 == 0, a).when(F.col(c) % 3 == 1, b).otherwise(e)
    body = pick("s_suppkey", _text("from ctypes import part_", key), _text("  use pyo3::part_", key, ";  "), _text("import part_", key))
    ports = t(spark, d, "supplier").select(_text("import_", key).alias("name"), F.lit("import").alias("kind"), _text("port_", nation, pick("s_nationkey", ".py", ".java", ".rs")).alias("file_path"), F.lit("").alias("parent"), body.alias("body"), F.col("s_suppkey").cast("int").alias("start_line"))
    ext = F.when(F.col("p_size") % 2 == 0, ".rs").otherwise(".cpp")
    native = t(spark, d, "part").select(_text("part_", part).alias("name"), F.lit("function").alias("kind"), _text("native/", F.col("p_brand"), ext).alias("file_path"), F.lit("").alias("parent"), _text("fn part_", part, "()").alias("body"), F.col("p_partkey").cast("int").alias("start_line"))
    return symbols(spark, d).unionByName(ports).unionByName(native)


def filed(spark: SparkSession, d: str) -> DataFrame:
    part = F.concat(F.lit("_"), F.floor(F.col("start_line") / FILE_KEYS).cast("string"), F.lit(".py"))
    return symbols(spark, d).withColumn("file_path", F.replace(F.col("file_path"), F.lit(".py"), part))


def code_files(spark: SparkSession, d: str) -> DataFrame:
    bodies = F.transform(F.sort_array(F.collect_list(F.struct("start_line", "name", "body"))), lambda x: x["body"])
    return filed(spark, d).groupBy("file_path").agg(F.array_join(bodies, "\n").alias("content"))


def doc_files(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.col("text").alias("content"))


# ----------------------------------------------------------------- names
@query(f"{MOD_SQL} select name, file_path, start_line from modules where kind = 'function' and file_path like '%.rs'")
def symbol_find(spark, d):
    return ix.find(modules(spark, d), kind="function", parent="", language="rust").select("name", "file_path", "start_line")


@query(f"{MOD_SQL} select name, kind, file_path from modules where contains(lower(name), 'art_1')")
def symbol_search(spark, d):
    return ix.search_name(modules(spark, d), "ART_1").select("name", "kind", "file_path")


@query(f"{MOD_SQL}, m as (select *, count(*) over () as total from modules where contains(file_path, 'Brand#1') and kind = 'class') select name, file_path, total from m order by file_path, start_line, name limit 200")
def symbol_listing(spark, d):
    return ix.listing(modules(spark, d), "Brand#1", "class").select("name", "file_path", "total")


@query(f"{MOD_SQL}, k as (select *, case when kind = 'import' then name else name || ':' || start_line end as k from modules) select name, kind, file_path, start_line from k qualify row_number() over (partition by k order by file_path desc, start_line desc) = 1")
def symbol_last_of_name(spark, d):
    return qu.last_of_name(modules(spark, d)).select("name", "kind", "file_path", "start_line")


@query(f"{MOD_SQL} select {LANG} as language, count(*) as n from modules group by 1")
def language_summary(spark, d):
    return ix.language_summary(modules(spark, d))


@query(f"{MOD_SQL} select kind, count(*) as n from modules group by 1")
def kind_summary(spark, d):
    return ix.kind_summary(modules(spark, d))


@query(f"""{MOD_SQL}, m as (select *, {LANG} as language from modules)
select language, count(distinct file_path) as files, count(*) as symbols, count(*) filter (kind = 'function') as functions, count(*) filter (kind = 'class') as classes, count(*) filter (kind = 'method') as methods, count(*) filter (kind = 'import') as imports from m group by rollup (language)""")
def repository_summary(spark, d):
    return qu.repository_summary(modules(spark, d))


@query(f"""{SYM_SQL}, s as (select *, len(string_split(body, chr(10))) as n, list(name) over (partition by file_path order by start_line, name rows between unbounded preceding and unbounded following) as peers from symbols)
select name, case when kind = 'function' then 'Function `' || name || '()` defined at line ' || start_line || '.' else 'Class `' || name || '` defined at line ' || start_line || ', spanning ' || n || ' lines.' end as summary,
array_to_string(list_filter(peers[1:6], lambda x: x <> name)[1:5], ',') as related from s""")
def symbol_explanations(spark, d):
    s = symbols(spark, d).withColumns({"end_line": (F.col("start_line") + F.size(fn.lines("body")) - 1), "parameters": F.array().cast("array<string>")})
    return qu.explained(s, s, among=6).select("name", "summary", F.array_join("related", ",").alias("related"))


@query(f"""{MOD_SQL} select name, file_path || ':' || start_line || ':' || (start_line + 1) as chunk_key, kind || '.' || name as qualified,
coalesce(nullif(substr(trim(regexp_replace(case when contains(file_path, '/') then regexp_replace(regexp_extract(file_path, '[^/]*$'), '\\.[^.]*$', '') else file_path end, '[^A-Za-z0-9_]', '_', 'g'), '_'), 1, 60), ''), 'node') as node,
regexp_extract(file_path, '[^/]*$') as label, replace(file_path, '/', '--') as folder, '/a b/' || file_path as path, trim(split_part(body, chr(10), 1)) as signature, '[code] ' || kind || ' ' || name || ' (x, y)' as semantic,
'[' || start_line || '] ' || regexp_extract(file_path, '[^/]*$') || ':' || start_line || '-' || (start_line + 1) as cite, cast(greatest(1, len(body) // 4) as bigint) as tokens, sha256(name || chr(10) || body) as request from modules""")
def symbol_labels(spark, d):
    end = F.col("start_line") + 1
    return modules(spark, d).select(
        "name", fn.chunk_key("file_path", "start_line", end).alias("chunk_key"), fn.qualified_name("kind", "name").alias("qualified"), fn.node_id("file_path").alias("node"), fn.short_label("file_path").alias("label"),
        fn.model_folder("file_path").alias("folder"), fn.path_of_uri(F.concat(F.lit("file:///a%20b/"), "file_path")).alias("path"), fn.signature("body").alias("signature"),
        fn.semantic_label(F.lit("code"), "kind", "parent", "name", F.array(F.lit("x"), F.lit("y"))).alias("semantic"), fn.citation("start_line", "file_path", "start_line", end).alias("cite"), fn.token_estimate("body").alias("tokens"), fn.request_key("name", "body").alias("request"),
    )


# ----------------------------------------------------------------- imports and calls
@query(f"{MOD_SQL} {DEPS}")
def dependencies(spark, d):
    return rel.dependencies(modules(spark, d))


@query(f"{MOD_SQL}, p as ({DEPS}) select * from p where contains(import_text, 'part_1')")
def dependents(spark, d):
    return rel.dependents(rel.dependencies(modules(spark, d)), "part_1")


@query(f"{MOD_SQL} {CROSS}")
def cross_language(spark, d):
    return rel.cross_language_edges(modules(spark, d))


@query(f"{MOD_SQL}, c as ({CROSS}) {MOD_CALLS} union all select source_file || ':' || import_text, target_symbol, source_file from c")
def universal_graph(spark, d):
    m = modules(spark, d)
    return rel.universal_edges(rel.call_edges(m), rel.cross_language_edges(m))


@query(f"{MOD_SQL}, e as ({MOD_CALLS}) select *, 'caller' as side from e where callee = 'part_1' union all select *, 'callee' from e where caller like '%:supplier\\_1' escape '\\'")
def call_graph(spark, d):
    e = rel.call_edges(modules(spark, d))
    return rel.call_graph(e, "part_1").unionByName(rel.call_graph(e, "supplier_1"))


@query(f"{SYM_SQL}, e as ({CALLS}) select distinct split_part(caller, ':', 2) as name, file_path from e where callee in (select name from symbols where file_path in ('Brand#11.py', 'Brand#12.py'))")
def changed_impact(spark, d):
    s = symbols(spark, d)
    return qu.changed_impact(s.where("file_path in ('Brand#11.py', 'Brand#12.py')").select("file_path"), s, rel.call_edges(s))


@query(f"""{SYM_SQL}, old as (select name, body, file_path, false as imp from symbols union all select 'region_' || n_regionkey, 'import', 'nation_' || n_nationkey || '.py', true from nation),
new as (select name, case when p_size > 25 then body else body || '  # ' || p_type end as body, file_path, false as imp from symbols join part on name = 'part_' || p_partkey
  union all select 'customer_' || c_custkey, 'def customer_' || c_custkey || '():', 'nation_' || c_nationkey || '.py', false from customer union all select 'nation_' || n_nationkey, 'import', 'nation_' || n_nationkey || '.py', true from nation),
j as (select coalesce(o.file_path, n.file_path) as file_path, coalesce(o.name, n.name) as name, coalesce(o.imp, n.imp) as imp, o.body as ob, n.body as nb from old o full join new n on o.file_path = n.file_path and o.name = n.name and o.imp = n.imp)
select file_path, coalesce(string_agg(name, ',' order by name) filter (not imp and ob is null), '') as added, coalesce(string_agg(name, ',' order by name) filter (not imp and nb is null), '') as removed, coalesce(string_agg(name, ',' order by name) filter (not imp and ob <> nb), '') as modified,
coalesce(string_agg(case when ob is null then '+' else '-' end || name, ',' order by case when ob is null then '+' else '-' end || name) filter (imp and (ob is null or nb is null)), '') as import_changes from j group by 1""")
def change_summary(spark, d):
    """From the code to another version of it: parts of size up to 25 changed, suppliers gone, customers come."""
    of = lambda name, kind, file, body: (name.alias("name"), F.lit(kind).alias("kind"), file.alias("file_path"), body.alias("body"), F.lit(1).alias("start_line"))
    nation, file = t(spark, d, "nation"), lambda c: _text("nation_", F.col(c).cast("string"), ".py")
    load = lambda c: nation.select(*of(_text(c[2:-3] + "_", F.col(c).cast("string")), "import", file("n_nationkey"), F.lit("import")))
    s = symbols(spark, d).drop("parent")
    part = s.join(t(spark, d, "part").select(_text("part_", F.col("p_partkey").cast("string")).alias("name"), "p_size", "p_type"), "name")
    part = part.withColumn("body", F.when(F.col("p_size") > 25, F.col("body")).otherwise(_text(F.col("body"), "  # ", F.col("p_type")))).drop("p_size", "p_type")
    who = _text("customer_", F.col("c_custkey").cast("string"))
    new = part.unionByName(t(spark, d, "customer").select(*of(who, "function", file("c_nationkey"), _text("def ", who, "():")))).unionByName(load("n_nationkey"))
    found = qu.change_summary(s.unionByName(load("n_regionkey")), new)
    return found.select("file_path", *[F.array_join(c, ",").alias(c) for c in ("added", "removed", "modified", "import_changes")])


# ----------------------------------------------------------------- measures
CC = f"c as (select file_path, name, kind, 1 + sum({SCORE}) as cc from (select file_path, name, kind, unnest(string_split(body, chr(10))) as line from symbols) group by all)"
METRICS = f"""{FILES_SQL}, {CC}, l as (select file_path, unnest(string_split(content, chr(10))) as line from files),
n as (select file_path, count(*) as n_lines, count(*) filter ({KIND} = 'code') as code, count(*) filter ({KIND} = 'comment') as comment, count(*) filter ({KIND} = 'blank') as blank from l group by 1),
o as (select file_path, coalesce(avg(cc) filter (kind in ('function', 'method')), 0)::double as avg_complexity, coalesce(max(cc) filter (kind in ('function', 'method')), 0)::int as max_complexity, count(*) as symbol_count from c group by 1),
m as (select *, comment / n_lines::double as comment_ratio from n join o using (file_path))"""


@query(f"{SYM_SQL}, {CC} select name, cast(cc as int) as complexity, case when cc <= 5 then 'low' when cc <= 10 then 'moderate' when cc <= 20 then 'high' else 'very_high' end as band from c where kind = 'function' and cc >= 2")
def complex_symbols(spark, d):
    return qu.complex_symbols(symbols(spark, d), 2).select("name", "complexity", "band")


@query(f"{METRICS} select file_path, n_lines, code, comment, blank, round(avg_complexity, 6) as avg_complexity, max_complexity, symbol_count, round({MI.format(loc='code::double', cc='avg_complexity', cr='comment_ratio')}, 4) as mi from m")
def file_metrics(spark, d):
    m = qu.file_metrics(code_files(spark, d), filed(spark, d))
    return m.select("file_path", "n_lines", "code", "comment", "blank", F.round("avg_complexity", 6).alias("avg_complexity"), "max_complexity", "symbol_count", F.round("maintainability_index", 4).alias("mi"))


@query(f"""{METRICS}, p as (select count(*) as files_analyzed, cast(sum(code) as bigint) as total_loc, cast(sum(comment) as bigint) as comments, cast(sum(blank) as bigint) as blanks, avg(avg_complexity) as cc, max(max_complexity) as max_complexity, cast(sum(symbol_count) as bigint) as total_symbols from m)
select files_analyzed, total_loc, comments, blanks, round(cc, 6) as cc, max_complexity, total_symbols, round({MI.format(loc='(total_loc::double / files_analyzed)', cc='cc', cr='(comments / (total_loc + comments + blanks)::double)')}, 4) as mi from p""")
def project_metrics(spark, d):
    m = qu.project_metrics(qu.file_metrics(code_files(spark, d), filed(spark, d)))
    return m.select("files_analyzed", "total_loc", F.col("total_comment_lines").alias("comments"), F.col("total_blank_lines").alias("blanks"), F.round("avg_complexity", 6).alias("cc"), "max_complexity", "total_symbols", F.round("maintainability_index", 4).alias("mi"))


@query(f"""{WHOLE_SQL}, b as (select file_path, len(regexp_extract_all(content, '(?m)^\\s*def\\s+\\w+\\([^)]*\\)\\s*:')) as found from files),
k as (select file_path, unnest(list_transform(range(1, len(ls) - 3), lambda i: trim(array_to_string(ls[i:i + 4], chr(10)), E' \\t\\n\\r\\x0b\\x0c'))) as block from (select file_path, string_split(content, chr(10)) as ls from files) where len(ls) >= 300),
r as (select file_path, count(*) as found from (select file_path, block from k where len(block) > 60 group by 1, 2 having count(*) >= 2) group by 1)
select 'type_hints' as category, 2 as priority, file_path, cast(found as int) as found from b where found >= 2 union all select 'reduce_duplication', 4, file_path, cast(found as int) from r where found >= 2
union all select 'error_handling', 3, file_path, cast(len(regexp_extract_all(content, '\\nexcept(?: Exception)?:')) as int) from files where regexp_matches(content, '\\nexcept(?: Exception)?:')""")
def work_tasks(spark, d):
    return qu.tasks_of_parts(symbols(spark, d), ("start_line", "name"), "body")


@query(f"with l as ({LINES}), x as ({DANGER}) select cast(doc_id as varchar) as file_path, cast(line_number - 1 as int) as line, cast(len(l.line) as int) as end_col, 'warning' as severity, 'matches danger pattern ' || pattern as message from x join l using (doc_id, line_number)")
def diagnostics(spark, d):
    return qu.diagnostics(qu.unsafe_lines(doc_files(spark, d))).select("file_path", "line", "end_col", "severity", "message")


@query(f"with l as ({LINES}), x as ({DANGER}) select cast(doc_id as varchar) as file_path, cast(line_number as int) as line_number, 'Review line ' || line_number as title, 'quickfix' as kind, cast(pattern as int) as pattern from x")
def code_actions(spark, d):
    return qu.code_actions(qu.unsafe_lines(doc_files(spark, d)))


# ----------------------------------------------------------------- texts
WORDS = "(contains(lower(text), 'the')::int + contains(lower(text), 'and')::int + contains(lower(text), 'que')::int) / 3::double"


@query(f"""select doc_id, round({WORDS}, 6) as overlap, round(0.6::double * (ln(1 + n_chars) / 10) + 0.25::double * ({WORDS}) + 0.15::double * contains(lower(text), 'the and que')::int + 0.05::double * greatest(0::double, 1 - len(text) / 5000::double), 4) as rerank,
round(ln(1 + n_chars) / 10 + 0.1::double * ({WORDS}), 4) as snippet from documents where text is not null""")
def text_scores(spark, d):
    q, score = "the and que", F.log1p("n_chars") / 10
    return t(spark, d, "documents").where("text is not null").select("doc_id", F.round(fn.keyword_overlap("text", q), 6).alias("overlap"), fn.rerank_score(score, "text", q).alias("rerank"), fn.snippet_score(score, "text", q).alias("snippet"))


FULL = f"list_filter({SPLIT}, lambda line: {STRIP} <> '')"


@query(f"""select doc_id, md5(array_to_string(string_split(text, chr(10))[2:4], chr(10))) as range_md5, md5(array_to_string({FULL}[greatest(1, len({FULL}) - 2):], chr(10))) as last_md5,
md5(case when len(text) > 100 then substr(text, 1, 100) || chr(10) || '... [truncated]' else text end) as brief_md5, regexp_extract(substr(({SPLIT})[1], 1, 10), '[A-Za-z0-9_]*$') || regexp_extract(substr(({SPLIT})[1], 11), '^[A-Za-z0-9_]*') as word,
md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g'))) as embed_md5 from documents where text is not null""")
def text_views(spark, d):
    views = {"range_md5": fn.line_range("text", 2, 4), "last_md5": fn.last_lines("text", 3), "brief_md5": fn.truncated("text", 100), "embed_md5": fn.for_embedding("text")}
    word = fn.word_at(F.get(fn.lines("text"), F.lit(0)), 10)
    return t(spark, d, "documents").where("text is not null").select("doc_id", *[F.md5(v).alias(k) for k, v in views.items()], word.alias("word"))


@query(f"with s as (select doc_id, {SPLIT} as ls, cast(1 + n_chars % 7 as int) as a from documents where text is not null) select doc_id, cast(greatest(1, a - 2) as int) as first_line, md5(array_to_string(ls[greatest(1, a - 2):a + 3], chr(10))) as expanded_md5 from s")
def context_lines(spark, d):
    docs = t(spark, d, "documents").where("text is not null")
    start = (1 + F.col("n_chars") % 7).cast("int")
    spans = docs.select("doc_id", start.alias("start_line"), (start + 1).alias("end_line"))
    return se.context_lines(docs, spans, 2).select("doc_id", F.col("first_line").cast("int").alias("first_line"), F.md5("expanded").alias("expanded_md5"))


@query("select doc_id, h from (select doc_id, sha256(text) as h from documents) left join (select item_id as doc_id, sha256(text) as b from benchmark) using (doc_id) where h is distinct from b")
def changed_digests(spark, d):
    new = t(spark, d, "documents").select("doc_id", fn.content_hash("text").alias("h"))
    old = t(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), fn.content_hash("text").alias("h"))
    return rel.has_changed(new, old, "doc_id", "h")


@query("select doc_id, md5(text) as h from documents where doc_id not in (select item_id from benchmark) and doc_id not in (select page_id from pages) union all select item_id, md5(text) from benchmark")
def replaced_rows(spark, d):
    stored, fresh = t(spark, d, "documents").select("doc_id", F.md5("text").alias("h")), t(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.md5("text").alias("h"))
    return rel.replace_rows(stored, fresh, t(spark, d, "pages").select(F.col("page_id").alias("doc_id")), "doc_id")


@query(f"select '{{\"doc_id\":' || doc_id || ',\"score\":' || score || '}}' as line from ({RX}) order by score desc, doc_id limit 25")
def results_jsonl(spark, d):
    return files.results_jsonl(se.regex_search(t(spark, d, "documents"), "th[ei]", 25).select("doc_id", "score"))


@query(f"select source || '/' || doc_id || ':1-2' || '  ' || format('{{:,.4f}}', n_chars / 8::double) || '  ' || array_to_string(({SPLIT})[1:2], chr(10)) as line from documents")
def results_text(spark, d):
    rows = t(spark, d, "documents").select(F.concat_ws("/", "source", "doc_id").alias("file_path"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), (F.col("n_chars") / 8).alias("score"), F.col("text").alias("content"))
    return files.results_text(rows, 1)


@query("""with r as (select 'nation_' || s_nationkey as name, count(*) as f, cast(sum(floor(abs(s_acctbal))) as bigint) as v from supplier group by 1),
l as (select '    workspace --> repo_' || name || '["' || name || '\\n' || f || ' files, ' || v || ' vectors"]' as line from r)
select '---' || chr(10) || 'title: Workspace Repositories' || chr(10) || '---' || chr(10) || 'flowchart TD' || chr(10) || '    workspace(("Workspace"))' || chr(10) || string_agg(line, chr(10) order by line) as text from l""")
def mermaid_workspace(spark, d):
    repos = t(spark, d, "supplier").groupBy(_text("nation_", F.col("s_nationkey").cast("string")).alias("name")).agg(F.count("*").alias("file_count"), F.sum(F.floor(F.abs("s_acctbal"))).alias("vector_count"))
    return files.mermaid_workspace(repos)


# ----------------------------------------------------------------- events and memories
@query("select conv_id || ':' || turn as key, cast(conv_id * 1000 + turn as double) as ts from conversations where contains(lower(text), 'tion') order by ts desc limit 5")
def memory_search(spark, d):
    rows = t(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("key"), F.col("text").alias("content"), F.lit("general").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).cast("double").alias("ts"))
    return hi.search_memory(rows, "TION").select("key", "ts")


@query("""with c as (select conv_id || ':' || turn as id, text, string_split(text, ' ') as w from conversations where text is not null)
select id, 0 as ord, 'start' as kind, '' as content from c union all select id, cast(i as int), 'token', case when i > 1 then ' ' else '' end || x from (select id, unnest(w) as x, generate_subscripts(w, 1) as i from c) union all select id, cast(len(w) + 1 as int), 'done', text from c""")
def token_events(spark, d):
    return jobs.token_events(t(spark, d, "conversations").where("text is not null").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text"))


@query("""with e as (select conv_id as uri, turn as version, case role when 'system' then 'open' when 'user' then 'change' else 'close' end as event, text from conversations)
select uri, version, md5(text) as text_md5 from e qualify row_number() over (partition by uri order by version desc) = 1 and event <> 'close'""")
def open_documents(spark, d):
    event = F.when(F.col("role") == "system", "open").when(F.col("role") == "user", "change").otherwise("close")
    rows = t(spark, d, "conversations").select(F.col("conv_id").alias("uri"), F.col("turn").alias("version"), event.alias("event"), "text")
    return jobs.latest_documents(rows).select("uri", "version", F.md5("text").alias("text_md5"))


@query("""select count(*)::int as result_count, max(score)::double as top_score, array_to_string(list_sort(list_distinct(list(lang))), ',') as languages,
array_to_string(list_distinct_first[1:5], ',') as top_files from (select *, (select list(source order by r) from (select source, min(r) as r from r0 group by 1)) as list_distinct_first from r0) group by list_distinct_first""".replace("r0", f"(select x.doc_id, x.score, d.lang, d.source, row_number() over (order by x.score desc, x.doc_id) as r from (select doc_id, score from ({RX}) order by score desc, doc_id limit 25) x join documents d using (doc_id))"))
def history_record(spark, d):
    docs = t(spark, d, "documents")
    hits = se.regex_search(docs, "th[ei]", 25).select("doc_id", "score").join(docs.select("doc_id", "lang", "source"), "doc_id")
    rows = se.ranked(hits).select("rank", "score", F.col("source").alias("file_path"), F.col("lang").alias("language"))
    return hi.query_record(rows, "th[ei]", 0.0).select("result_count", F.col("top_score").cast("double").alias("top_score"), F.array_join("languages", ",").alias("languages"), F.array_join("top_files", ",").alias("top_files"))


@query("""with x as (select p_brand, string_agg('--- a/size_' || p_size || '.py' || chr(10) || '+++ b/size_' || p_size || '.py' || chr(10) || '-old' || chr(10) || '+new' || chr(10) || '+' || p_type, chr(10) order by p_partkey) as diff from part group by 1)
select p_brand, array_to_string(list_sort(list_distinct(regexp_extract_all(diff, '(?m)^\\+\\+\\+ b/(\\S+)', 1))), ',') as files, cast(3 * len(regexp_extract_all(diff, '(?m)^-old')) as int) as changed from x""")
def diff_files(spark, d):
    size = F.col("p_size").cast("string")
    one = _text("--- a/size_", size, ".py\n+++ b/size_", size, ".py\n-old\n+new\n+", F.col("p_type"))
    rows = t(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", one.alias("x")))), lambda r: r["x"]), "\n").alias("diff"))
    return rows.select("p_brand", F.array_join(F.sort_array(fn.diff_files("diff")), ",").alias("files"), fn.diff_line_count("diff").cast("int").alias("changed"))


NODE = "trim(regexp_replace({x}, '[^A-Za-z0-9_]', '_', 'g'), '_')"


@query(f"""{MOD_SQL}, p as ({DEPS}), l as (select distinct '    ' || {NODE.format(x='source_file')} || '["' || source_file || '"] --> ' || {NODE.format(x="regexp_extract(import_text, '[^:]*$')")} || '["' || regexp_extract(import_text, '[^ ]*$') || '"]' as line from p)
select '---' || chr(10) || 'title: Dependency Graph' || chr(10) || '---' || chr(10) || 'flowchart TD' || chr(10) || string_agg(line, chr(10) order by line) as text from l""")
def mermaid_dependencies(spark, d):
    return files.mermaid_dependencies(rel.dependencies(modules(spark, d)))


# ----------------------------------------------------------------- streams
def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream; the pattern stands for one file or one folder alike, which a plain path would not."""
    return jobs.watch(spark, f"{d}/{name}.parque[t]", spark.read.parquet(f"{d}/{name}.parquet").schema)


def _folder(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"


def _complete(df: DataFrame) -> DataFrame:
    """The last state of a streaming aggregation over all there is now; no rows if nothing has come."""
    spark = df.sparkSession
    at = _folder(spark)
    jobs.run_once(df, lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/out"), f"{at}/progress", "complete")
    return spark.read.schema(df.schema).parquet(f"{at}/out") if children(spark, f"{at}/out") else spark.createDataFrame([], df.schema)


@query("""with l as (select *, lag(ts) over (partition by user_id order by ts, event_id) as p from events), s as (select *, sum(case when p is null or ts - p >= interval 1 hour then 1 else 0 end) over (partition by user_id order by ts, event_id) as s from l)
select user_id, epoch_us(min(ts)) as start_us, epoch_us(max(ts)) + 3600000000 as end_us, count(*) as n from s group by user_id, s""")
def stream_sessions(spark, d):
    """Sessions of a stream of events, each open for an hour after its last event."""
    return _complete(jobs.session_counts(_stream(spark, d, "events"), "user_id", "ts")).select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("""with w as (select user_id, unnest([0, 1]) as k, cast(epoch_us(ts) // 1800000000 as bigint) as b, cast(floor(value) as bigint) as tokens from events)
select user_id, (b - k + 2) * 1800000000 as end_us, count(*) as requests, cast(sum(tokens) as bigint) as tokens from w group by 1, 2""")
def stream_rates(spark, d):
    """Requests and tokens of a stream in hours that begin every half hour."""
    events = _stream(spark, d, "events").withColumn("tokens", F.floor("value"))
    return _complete(jobs.rate(events, "user_id", "ts", "tokens", "1 hour", "30 minutes", "1 hour")).select("user_id", F.unix_micros("at").alias("end_us"), "requests", "tokens")


@query("select doc_id, md5(text) as h from documents where doc_id not in (select doc_id from labels) union all select doc_id, 'quality ' || quality from labels where toxic = 0")
def stream_index(spark, d):
    """An index kept by two streams: documents come in, then labels replace their rows or, of toxic ones, delete them."""
    at = _folder(spark)
    come = _stream(spark, d, "documents").select("doc_id", F.md5("text").alias("h"), F.lit(False).alias("deleted"))
    label = _stream(spark, d, "labels").select("doc_id", _text("quality ", F.col("quality").cast("string")).alias("h"), (F.col("toxic") == 1).alias("deleted"))
    for n, changes in enumerate((come, label)):
        jobs.keep_index(changes, f"{at}/index", "doc_id", f"{at}/progress{n}").awaitTermination()
    return jobs.read_index(spark, f"{at}/index", "doc_id").select("doc_id", "h")


# ----------------------------------------------------------------- parsed code, and sizes
#: Java files of SCOPED parts each: a class with a method, and brackets in comments and strings.
SCOPED = 50
SCOPES_SQL = f"""with p as (select *, 'native/f_' || p_partkey // {SCOPED} || '.java' as file_path, cast(5 * (row_number() over (partition by p_partkey // {SCOPED} order by p_partkey) - 1) + 1 as int) as line from part)
select file_path, 'Part_' || p_partkey as name, 'class' as kind, '' as parent, line as start_line, line + 4 as end_line, '' as parameters, 2 as complexity, 'size,weigh_' || p_size as calls from p
union all select file_path, 'size', 'method', 'Part_' || p_partkey, line + 1, line + 3, 'x,unit', 2, 'size,weigh_' || p_size from p"""


@query(SCOPES_SQL)
def scope_symbols(spark, d):
    """Definitions, scopes, parameters, complexity and calls that the parser finds in code of all parts."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = _text("class Part_", key, " {\n    int size(final int x, String unit) { // {\n        if (x > ", size, ") { return weigh_", size, "(\"} if (x) lift()\"); } return 0;\n    }\n}")
    bodies = F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", text.alias("text")))), lambda x: x["text"])
    path = F.concat(F.lit("native/f_"), F.floor(F.col("p_partkey") / SCOPED).cast("string"), F.lit(".java")).alias("file_path")
    found = parsing.symbols(t(spark, d, "part").groupBy(path).agg(F.array_join(bodies, "\n").alias("content")))
    calls = F.array_join(parsing.called_names("body", "file_path"), ",").alias("calls")
    return found.select("file_path", "name", "kind", "parent", "start_line", "end_line", F.array_join("parameters", ",").alias("parameters"), parsing.complexity_of("body", "file_path").alias("complexity"), calls)


@query(f"{SYM_SQL}, e as ({CALLS}) select count(distinct split_part(caller, ':', 2)) as upstream, 0::bigint as downstream, count(distinct split_part(caller, ':', 2)) as total_nodes from e where callee = 'part_1'")
def trace_totals(spark, d):
    s = symbols(spark, d)
    return rel.trace_size(rel.trace(s, rel.call_edges(s), "part_1"))


@query("""with recursive e as (select distinct l_suppkey as src, l_partkey as dst from lineitem),
b(node, depth) as (select 1::bigint, 0 union select e.dst, b.depth + 1 from b join e on e.src = b.node where b.depth < 5), m as (select node, min(depth) as depth from b group by 1)
select count(*) filter (depth = 1) as direct, count(*) filter (depth > 1) as transitive, count(*) filter (depth > 0) as total_affected from m""")
def impact_totals(spark, d):
    e = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return rel.impact_size(rel.reach(e, spark.createDataFrame([(1,)], "node long"), 5))


@query(f"{MOD_SQL}, f as (select {LANG} as language, regexp_extract(file_path, '\\.[^./]+$') as ending, count(distinct file_path) as n from modules group by 1, 2) select language, string_agg(ending, ',' order by ending) as endings, cast(sum(n) as bigint) as files from f group by 1")
def language_endings(spark, d):
    return ix.language_endings(modules(spark, d)).withColumn("endings", F.array_join("endings", ","))


@query(f"""{FILED_SQL}, s as (select file_path, count(*) as symbols, cast(sum(len(string_split(body, chr(10)))) as bigint) as lines, sum(len(body)) as chars from symbols group by 1)
select count(distinct file_path) as files, count(*) as chunks, cast(sum(symbols) as bigint) as symbols, round(sum(chars) / count(*), 1) as avg_chunk_chars, 'python:' || count(*) || ':' || sum(lines)::bigint as coverage from s""")
def repository_index_stats(spark, d):
    """The statistics an index keeps, of one chunk a file."""
    s = filed(spark, d)
    chunks = s.groupBy("file_path").agg(F.lit(1).alias("start_line"), F.sum(F.size(F.split("body", "\n"))).cast("int").alias("end_line"), F.array_join(F.collect_list("body"), "").alias("content"))
    cover = F.element_at("language_coverage", 1)
    return ix.index_stats(chunks, s, 0.0).select("files", "chunks", "symbols", "avg_chunk_chars", F.concat_ws(":", cover["language"], cover["chunks"], cover["lines"]).alias("coverage"))
