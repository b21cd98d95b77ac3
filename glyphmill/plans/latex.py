"""Queries on LaTeX projects."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.operators import graph, latex
from glyphmill.plans.registry import query
from glyphmill.sources.views import VIEWS, duck, view

LINES = ", lines as (select project, seq, file, l.line as line, l.t as t from (select project, seq, file, unnest(list_zip(string_split(text, chr(10)), range(1, len(string_split(text, chr(10))) + 1))) as z from units) q, lateral (select cast(z[2] as int) as line, z[1] as t) l)"
#: Patterns of tokens in DuckDB's dialect.
CITE_RE, REF_RE, LABEL_RE = r"\\(?:cite|parencite|textcite|autocite)\*?(?:\[[^\]]*\]){0,2}\{([^}]+)\}", r"\\(?:ref|eqref|autoref)\{([^}]+)\}", r"\\label\{([^}]+)\}"
STRIPPED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def occurrences(name: str, pattern: str) -> str:
    """Every match over whole texts, from the pieces between matches: (project, seq, file, line, value)."""
    return f""", {name}_all as (select project, seq, file, string_split_regex(text, '{pattern}') as gaps, regexp_extract_all(text, '{pattern}', 0) as whole, regexp_extract_all(text, '{pattern}', 1) as vals from units),
{name}_each as (select *, unnest(range(1, len(whole) + 1)) as i from {name}_all),
{name}_at as (select project, seq, file, vals[i] as value, array_to_string(gaps[1:i], '') || array_to_string(whole[1:i - 1], '') as before from {name}_each),
{name}_values as (select project, seq, file, cast(len(before) - len(replace(before, chr(10), '')) + 1 as int) as line, value from {name}_at)"""


CITES = occurrences("cite", CITE_RE) + f", cites as (select project, seq, file, line, {STRIPPED.format('k')} as key from (select *, unnest(string_split(value, ',')) as k from cite_values) q where {STRIPPED.format('k')} <> '')"
REFS = occurrences("ref", REF_RE) + f", refs as (select project, seq, file, line, {STRIPPED.format('value')} as key from ref_values)"
LABELS = occurrences("label", LABEL_RE) + f", labels_ as (select project, seq, file, line, {STRIPPED.format('value')} as key from label_values)"
UNITS = duck("units") + LINES


@query("SF13_tokens", UNITS + CITES + REFS + LABELS + " select 'cite' as kind, project, file, line, key from cites union all select 'ref', project, file, line, key from refs union all select 'label', project, file, line, key from labels_")
def sf13(spark, d):
    u = view(spark, d, "units")
    rows = [latex.tokens(u, p, k == "cite").select(F.lit(k).alias("kind"), "project", "file", "line", "key") for k, p in (("cite", latex.CITE), ("ref", latex.REF), ("label", latex.LABEL))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("J1_missing_citation", duck("units", "bib") + LINES + CITES + " select project, file, line, key from cites c where not exists (select 1 from bib b where b.project = c.project and b.key = c.key)")
def j1(spark, d):
    return latex.missing(latex.tokens(view(spark, d, "units"), latex.CITE, True), view(spark, d, "bib")).select("project", "file", "line", "key")


@query("J2_missing_reference", UNITS + REFS + LABELS + " select project, file, line, key from refs r where (project, key) not in (select project, key from labels_)")
def j2(spark, d):
    u = view(spark, d, "units")
    return latex.missing(latex.tokens(u, latex.REF), latex.tokens(u, latex.LABEL)).select("project", "file", "line", "key")


@query("J3_duplicate_label", UNITS + LABELS + " select project, file, line, key from labels_ qualify count(*) over (partition by project, key) > 1")
def j3(spark, d):
    return latex.repeated(latex.tokens(view(spark, d, "units"), latex.LABEL)).select("project", "file", "line", "key")


@query("J4_distinct_missing", duck("units", "bib") + LINES + CITES + REFS + LABELS + " select 'citation' as kind, project, key from (select project, key from cites except select project, key from bib) a union all select 'reference', project, key from (select project, key from refs except select project, key from labels_) b")
def j4(spark, d):
    u, b = view(spark, d, "units"), view(spark, d, "bib")
    cited = latex.tokens(u, latex.CITE, True).select("project", "key")
    refs, labels = (latex.tokens(u, p).select("project", "key") for p in (latex.REF, latex.LABEL))
    return cited.subtract(b.select("project", "key")).select(F.lit("citation").alias("kind"), "project", "key").unionByName(refs.subtract(labels).select(F.lit("reference").alias("kind"), "project", "key"))


@query("SE2_set_difference", UNITS + REFS + LABELS + " select key from refs except select key from labels_")
def se2(spark, d):
    u = view(spark, d, "units")
    return latex.tokens(u, latex.REF).select("key").subtract(latex.tokens(u, latex.LABEL).select("key"))


BIBTEX = "select concat('p', cast(p_partkey % 20 as string)) as project, concat('@Article {k', cast(p_partkey % 89 as string), ', title={', p_name, '}}', chr(10), '@BOOK{ b', cast(p_size as string), ',') as text from part"


@query("SC9_bib_keys", f"with b as ({BIBTEX}) select distinct project, unnest(regexp_extract_all(text, '@\\w+\\s*\\{{\\s*([^,\\s]+)', 1, 'i')) as key from b")
def sc9(spark, d):
    spark.read.parquet(f"{d}/part.parquet").createOrReplaceTempView("gm_part")
    return latex.bib_keys(spark.sql(BIBTEX.replace("from part", "from gm_part")))


DECLARED = """select concat('p', cast(doc_id % 20 as string)) as project, concat('u', cast(doc_id as string), '.tex') as file, concat(text, case when doc_id % 3 = 0
 then concat(chr(92), 'bibliography{refs,', chr(10), chr(9), 'b', cast(doc_id % 7 as string), ', }', chr(92), 'bibliography{more}') else concat(chr(92), 'addbibresource[x]{ c', cast(doc_id % 5 as string), '.bib', chr(10), '}') end) as text from documents"""
DECLARED_SQL = rf"""with u as ({DECLARED}), v as (select project, file, unnest(flatten(list_transform(regexp_extract_all(text, '\\bibliography\s*\{{([^}}]+)\}}', 1), lambda x: string_split(x, ',')))) as value from u
 union all select project, file, unnest(regexp_extract_all(text, '\\addbibresource(?:\[[^\]]*\])?\s*\{{([^}}]+)\}}', 1)) from u),
 w as (select distinct project, file, {STRIPPED.format('value')} as value from v)"""


@query("SC8_declared_bibliographies", DECLARED_SQL + " select project, file, value from w where value <> ''")
def sc8(spark, d):
    spark.read.parquet(f"{d}/documents.parquet").createOrReplaceTempView("gm_documents")
    return latex.declared_bibliographies(spark.sql(DECLARED.replace("from documents", "from gm_documents")))


@query("SE5_union_of_bibliographies", DECLARED_SQL + " select distinct project, value from w where value <> ''")
def se5(spark, d):
    return sc8(spark, d).select("project", "value").distinct()


@query("AG7_unbalanced_braces", duck("units") + " select project, file, len(text) - len(replace(text, '{', '')) as opened, len(text) - len(replace(text, '}', '')) as closed from units where len(replace(text, '{', '')) <> len(replace(text, '}', ''))")
def ag7(spark, d):
    u = view(spark, d, "units").where(latex.brace_mismatch(F.col("text")))
    return u.select("project", "file", *(latex.count_of(F.col("text"), c).cast("long").alias(n) for c, n in (("{", "opened"), ("}", "closed"))))


@query("AG8_table_mismatch", duck("units") + r" select project, file from units where len(regexp_extract_all(text, '\\begin\{(tabular|longtable)\}')) <> len(regexp_extract_all(text, '\\end\{(tabular|longtable)\}'))")
def ag8(spark, d):
    return view(spark, d, "units").where(latex.table_mismatch(F.col("text"))).select("project", "file")


HINTS_SQL = "(values (concat(chr(92), 'begin{align'), 'amsmath'), (concat(chr(92), 'includegraphics'), 'graphicx'), (concat(chr(92), 'mathbb'), 'amssymb')) h(token, package)"
HINT_SQL = " from units u join units m on m.project = u.project and m.is_main cross join " + HINTS_SQL + r" where contains(u.text, h.token) and not regexp_matches(m.text, concat('\\usepackage(?:\[[^\]]*\])?\{[^}]*\b', h.package, '\b[^}]*\}'))"


@query("J10_package_hints", duck("units") + " select u.project, u.file, h.package" + HINT_SQL)
def j10(spark, d):
    f = latex.unit_findings(view(spark, d, "units")).where("code = 'MISSING_PACKAGE'")
    return f.select("project", "file", F.split("message", " ")[0].alias("package"))


PERSIAN_SQL = """ select project, file, code from (select project, file, text, unnest(['PERSIAN_PACKAGE', 'PERSIAN_FONT', 'LATIN_FONT', 'BIDI_ENV']) as code from units where regexp_matches(text, '[\\x{0600}-\\x{06ff}]')) q
where case code when 'PERSIAN_PACKAGE' then not contains(text, concat(chr(92), 'usepackage{xepersian}')) when 'PERSIAN_FONT' then not contains(text, concat(chr(92), 'settextfont')) when 'LATIN_FONT' then not contains(text, concat(chr(92), 'setlatintextfont')) else contains(text, concat(chr(92), 'begin{latin}')) and not contains(text, concat(chr(92), 'end{latin}')) end"""


@query("SF9_persian_checks", duck("units") + PERSIAN_SQL)
def sf9(spark, d):
    codes = [r[0] for r in latex.PERSIAN_RULES]
    return latex.unit_findings(view(spark, d, "units")).where(F.col("code").isin(codes)).select("project", "file", "code")


@query("SF11_template_missing", "with p as (select distinct c_nationkey as k from customer), q as (select concat('n', cast(k as string)) as project, case when k % 3 = 0 then 'generic' else 'tehran' end as profile, k from p) select project from q where profile <> 'generic' and k % 4 <> 1")
def sf11(spark, d):
    n = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_nationkey").alias("k")).distinct()
    project = F.concat(F.lit("n"), F.col("k"))
    projects = n.select(project.alias("project"), F.when(F.col("k") % 3 == 0, "generic").otherwise("tehran").alias("profile"))
    files = n.where("k % 4 = 1").select(project.alias("project"), F.lit("x.cls").alias("file")).unionByName(n.select(project.alias("project"), F.lit("main.tex").alias("file")))
    return latex.template_missing(projects, files).select("project")


SE1_SQL = (
    duck("units", "bib") + LINES + CITES + REFS + LABELS + ", all_f as (select u.project, u.file, 'MISSING_PACKAGE' as code, cast(null as int) as line" + HINT_SQL
    + " union all select project, file, code, null from (" + PERSIAN_SQL + ") x"
    + " union all select project, file, 'UNBALANCED_BRACES', null from units where len(replace(text, '{', '')) <> len(replace(text, '}', ''))"
    + r" union all select project, file, 'TABLE_ENVIRONMENT_MISMATCH', null from units where len(regexp_extract_all(text, '\\begin\{(tabular|longtable)\}')) <> len(regexp_extract_all(text, '\\end\{(tabular|longtable)\}'))"
    + " union all select project, file, 'MISSING_CITATION', line from cites c where not exists (select 1 from bib b where b.project = c.project and b.key = c.key)"
    + " union all select project, file, 'MISSING_REFERENCE', line from refs r where (project, key) not in (select project, key from labels_)"
    + " union all select project, file, 'DUPLICATE_LABEL', line from (select project, file, line, count(*) over (partition by project, key) as n from labels_) y where n > 1)"
)


@query("SE1_all_findings", SE1_SQL + " select project, file, code, line from all_f")
def se1(spark, d):
    return latex.all_findings(view(spark, d, "units"), view(spark, d, "bib")).select("project", "file", "code", "line")


@query("SE1_findings_by_project", SE1_SQL + " select project, code, count(*) as n from all_f group by project, code")
def se1_counts(spark, d):
    return se1(spark, d).groupBy("project", "code").agg(F.count("*").alias("n"))


FRAC_SQL = r"""regexp_replace(regexp_replace(text, '\\frac(\\[A-Za-z]+|[A-Za-z0-9])(\\[A-Za-z]+|[A-Za-z0-9])', '\\frac{\1}{\2}', 'g'), '([$ ])(?:frac) ?(\\[A-Za-z]+|[A-Za-z0-9])(\\[A-Za-z]+|[A-Za-z0-9])', '\1\\frac{\2}{\3}', 'g')"""


@query("SF12_applied_changes", duck("units") + f" select project, file, {FRAC_SQL} as output from units")
def sf12(spark, d):
    u = view(spark, d, "units")
    rows = latex.changes(u).withColumn("enabled", F.lit(True))
    return latex.applied(u, rows).select("project", "file", "output")


@query("SF6_fraction_braces", duck("units") + r" select project, file, unnest(regexp_extract_all(text, '\\frac(\\[A-Za-z]+|[A-Za-z0-9])(\\[A-Za-z]+|[A-Za-z0-9])')) as before from units")
def sf6(spark, d):
    return latex.changes(view(spark, d, "units")).where("pattern = 0").select("project", "file", "before")


@query("SF7_missing_slash", duck("units") + r" select project, file, trim(unnest(regexp_extract_all(text, '[$ ]frac ?(\\[A-Za-z]+|[A-Za-z0-9])(\\[A-Za-z]+|[A-Za-z0-9])')), '$ ') as before from units")
def sf7(spark, d):
    return latex.changes(view(spark, d, "units")).where("pattern = 1").select("project", "file", "before")


WF2_SQL = duck("units") + LINES + r""", hits as (select project, seq, file, line, 0 as pattern, unnest(regexp_extract_all(t, '\\frac(\\[A-Za-z]+|[A-Za-z0-9])(\\[A-Za-z]+|[A-Za-z0-9])')) as before from lines
union all select project, seq, file, line, 1, unnest(regexp_extract_all(t, '[$ ]frac ?(\\[A-Za-z]+|[A-Za-z0-9])(\\[A-Za-z]+|[A-Za-z0-9])')) from lines),
placed as (select *, row_number() over (partition by project order by seq, pattern, line) - 1 as place from hits)"""


@query("WF2_change_position", WF2_SQL + " select project, concat('tex:', file, ':', cast(line as string), ':', cast(place as string)) as change_id from placed")
def wf2(spark, d):
    return latex.changes(view(spark, d, "units")).select("project", "change_id")


@query("WF5_line_numbers", UNITS + LABELS + " select project, file, key, line from labels_")
def wf5(spark, d):
    return latex.tokens(view(spark, d, "units"), latex.LABEL).select("project", "file", "key", "line")


@query("PF4_PF5_reviewed_changes", WF2_SQL.replace("with recursive", "with recursive reviews as (" + VIEWS["reviews"] + "),", 1) + r"""
select h.project, concat('tex:', h.file, ':', cast(line as string), ':', cast(place as string)) as change_id, coalesce(r.enabled, true) as enabled,
 case when trim(coalesce(r.override, '')) <> '' then trim(r.override) when pattern = 0 then regexp_replace(h.before, '^.frac(\\[A-Za-z]+|[A-Za-z0-9])(\\[A-Za-z]+|[A-Za-z0-9])$', '\\frac{\1}{\2}') else regexp_replace(h.before, '^[$ ]frac ?(\\[A-Za-z]+|[A-Za-z0-9])(\\[A-Za-z]+|[A-Za-z0-9])$', '\\frac{\1}{\2}') end as after
from placed h left join reviews r on r.doc_id = h.seq""")
def pf4(spark, d):
    """A decision on a document concerns all changes of its unit."""
    rows = latex.changes(view(spark, d, "units"))
    decisions = rows.select("change_id", "seq").join(view(spark, d, "reviews").withColumnRenamed("doc_id", "seq"), "seq").drop("seq")
    return latex.reviewed(rows, decisions).select("project", "change_id", "enabled", "after")


@query("SO2_splice_order", duck("units") + " select file, reverse(replace(text, chr(10), ' ')) as flipped from units")
def so2(spark, d):
    u = view(spark, d, "units")
    breaks = F.transform(latex.matches(F.col("text"), "\n", 0), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(" ").alias("after")))
    return u.select("file", F.reverse(latex.splice(F.col("text"), breaks)).alias("flipped"))


GRAPH = duck("edges") + ", nodes as (select 'd0' as project, doc_id as node from documents)"


@query("GR1_reachable_units", GRAPH + """, reach(project, node, depth) as (select 'd0', cast(0 as bigint), 0
union select e.project, e.dst, r.depth + 1 from reach r join edges e on e.project = r.project and e.src = r.node join nodes n on n.project = e.project and n.node = e.dst where r.depth < 40)
select project, node, min(depth) as depth from reach group by project, node""")
def gr1(spark, d):
    return graph.closure(*_graph(spark, d))


@query("GR1_visiting_order", GRAPH + """, least_depth as materialized (with recursive reach(node, depth) as (select cast(0 as bigint), 0
union select e.dst, r.depth + 1 from reach r join edges e on e.src = r.node join nodes n on n.node = e.dst where r.depth < 40) select node, min(depth) as depth from reach group by node),
ways(node, depth, path) as (select cast(0 as bigint), 0, cast([] as bigint[])
union all select e.dst, w.depth + 1, list_append(w.path, cast(e.line as bigint)) from ways w join edges e on e.src = w.node join least_depth l on l.node = e.dst and l.depth = w.depth + 1),
firsts as (select node, depth, min(path) as path from ways group by node, depth)
select 'd0' as project, node, depth, row_number() over (order by depth, path) - 1 as seq from firsts""")
def gr1_order(spark, d):
    """The order of the visit as numbers: its (depth, path) keys are dealt out by range, and each range counts on from those before it."""
    roots, edges, nodes = _graph(spark, d)
    return latex.numbered(graph.visited(roots, edges.withColumnRenamed("line", "pos"), nodes), "depth", "path").select("project", "node", "depth", "seq")


def _graph(spark, d):
    nodes = spark.read.parquet(f"{d}/documents.parquet").select(F.lit("d0").alias("project"), F.col("doc_id").alias("node"))
    return nodes.where("node = 0"), view(spark, d, "edges"), nodes


@query("J6_missing_include", duck("edges") + " select project, src, dst, line from edges where dst not in (select doc_id from documents)")
def j6(spark, d):
    nodes = spark.read.parquet(f"{d}/documents.parquet").select(F.lit("d0").alias("project"), F.col("doc_id").alias("node"))
    return graph.edge_findings(view(spark, d, "edges"), nodes).select("project", "src", "dst", "line")


PATHS = """select doc_id, concat('ch', cast(doc_id % 3 as string), '/u.tex') as parent, case cast(doc_id % 7 as int) when 0 then concat('sec', cast(doc_id as string)) when 1 then concat('../a', cast(doc_id as string), '.tex') when 2 then '../../secret'
 when 3 then '/abs' when 4 then '  ' when 5 then concat('x', chr(92), 'y') else concat('./b', cast(doc_id as string), '.sty') end as reference from documents"""


@query("GR2_path_resolution", f"""with q as ({PATHS}) select doc_id, case when trim(reference) = '' or contains(reference, chr(92)) or starts_with(reference, '/') or starts_with(reference, '../../') then null
 when starts_with(reference, '../') then substr(reference, 4) when starts_with(reference, './') then concat(split_part(parent, '/', 1), '/', substr(reference, 3)) else concat(split_part(parent, '/', 1), '/', reference, '.tex') end as path from q""")
def gr2(spark, d):
    spark.read.parquet(f"{d}/documents.parquet").createOrReplaceTempView("gm_documents")
    return spark.sql(PATHS.replace("from documents", "from gm_documents")).select("doc_id", graph.resolved("reference", "parent").alias("path"))


@query("SC7_size_guard", "with f as (select concat(o_orderstatus, cast(o_orderkey % 10 as string)) as project from orders) select project, 'too many source files' as error from f group by project having count(*) > 256")
def sc7(spark, d):
    project = F.concat("o_orderstatus", (F.col("o_orderkey") % 10).cast("string"))
    return graph.size_guard(spark.read.parquet(f"{d}/orders.parquet").select(project.alias("project"), F.col("o_orderkey").cast("string").alias("text")))


ADAPTER = "(values ('university.cls', 'file'), ('u1.tex', 'file'), (concat(chr(92), 'universitytitle'), 'command'), (concat(chr(92), 'label'), 'command')) r(item, kind)"


@query("J9_template_requirements", duck("units") + f" select p.project, r.kind, r.item from (select distinct project from units) p cross join {ADAPTER} where case when r.kind = 'file' then not exists (select 1 from units u where u.project = p.project and u.file = r.item) else not exists (select 1 from units u where u.project = p.project and contains(u.text, r.item)) end")
def j9(spark, d):
    from glyphmill.operators.plugins import adapter_findings

    adapter = {"name": "Example", "required_files": ["university.cls", "u1.tex"], "required_commands": ["\\universitytitle", "\\label"]}
    return adapter_findings(view(spark, d, "units"), adapter).select("project", "kind", "item")
