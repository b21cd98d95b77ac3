"""Queries on compile logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.operators import latex, logs
from glyphmill.plans.latex import SE1_SQL
from glyphmill.plans.registry import query
from glyphmill.sources.views import duck, view

#: A closing takes back the latest opening: the open file is the last opening whose depth was not undercut since.
STACK = """, ev as (select project, seq, case when starts_with(text, '(') then regexp_extract(text, '\\(([^()\\s]+)', 1) end as file, case when starts_with(text, '(') then 1 else -1 end as d, text like '(%)' as closed from logs where text like '(%' or text = ')'),
ordered as (select project, seq, file, d, row_number() over (partition by project order by seq) as i from ev where not closed),
states(project, i, stack) as (select distinct project, cast(0 as bigint), cast([] as varchar[]) from logs
  union all select s.project, o.i, case when o.d = 1 then list_append(s.stack, o.file) else s.stack[:-2] end from states s join ordered o on o.project = s.project and o.i = s.i + 1),
active as (select l.project, l.seq, l.text, (select s.stack[-1] from states s where s.project = l.project and s.i = (select count(*) from ordered o where o.project = l.project and o.seq < l.seq)) as file from logs l where l.text like '! %')"""
DIRECT = r"select project, regexp_extract(text, '^([^:]+\.tex):([0-9]+): (.+)$', 1) as file, cast(regexp_extract(text, '^([^:]+\.tex):([0-9]+): (.+)$', 2) as int) as line, regexp_extract(text, '^([^:]+\.tex):([0-9]+): (.+)$', 3) as message from logs where text like 'main.tex:%'"
BLOCKS = "select project, file, cast(regexp_extract(text, 'l\\.([0-9]+)', 1) as int) as line, 'Undefined control sequence.' as message from active"


@query("AG11_active_file", duck("logs") + STACK + " select project, seq, file from active")
def ag11(spark, d):
    v = view(spark, d, "logs")
    return logs.active_files(v).join(v.where("text like '! %'").select("project", "seq"), ["project", "seq"]).select("project", "seq", "file")


@query("AG13_distinct_errors", duck("logs") + STACK + f" select distinct project, coalesce(file, 'main.tex') as file, line, message from ({DIRECT} union {BLOCKS}) q")
def ag13(spark, d):
    return logs.findings(view(spark, d, "logs")).where("code = 'LATEX_COMPILE_ERROR'").select("project", "file", "line", "message").distinct()


@query("SF10_log_findings", duck("logs") + r""" select project, 'UNDEFINED_REFERENCE' as code, concat('Reference ''', regexp_extract(text, 'Reference .([^'']+)''', 1), ''' is undefined.') as message, cast(regexp_extract(text, 'input line ([0-9]+)', 1) as int) as line from logs where text like 'LaTeX Warning: Reference%'
union all select project, 'FONT_WARNING', trim(regexp_replace(substr(text, 22), '\s+', ' ', 'g')), null from logs where text like 'LaTeX Font Warning:%'""")
def sf10(spark, d):
    return logs.findings(view(spark, d, "logs")).where("code <> 'LATEX_COMPILE_ERROR'").select("project", "code", "message", "line")


@query("WF3_log_depth", duck("logs") + " select project, seq, sum(case when text like '(%)' then 0 when text like '(%' then 1 else -1 end) over (partition by project order by seq) as depth from logs where text like '(%' or text = ')'")
def wf3(spark, d):
    from pyspark.sql import Window

    e = logs.events(view(spark, d, "logs"))
    depth = F.sum(F.when(F.col("file").isNotNull(), 1).otherwise(-1)).over(Window.partitionBy("project").orderBy("seq", "pos"))
    return e.withColumn("depth", depth).groupBy("project", "seq").agg(F.max_by("depth", "pos").alias("depth"))


@query("WF3_active_file", duck("logs") + STACK + """, marks as (select l.project, l.seq, coalesce(sum(case when o.i is null then 0 else 1 end) over (partition by l.project order by l.seq rows between unbounded preceding and 1 preceding), 0) as i
 from logs l left join ordered o on o.project = l.project and o.seq = l.seq) select m.project, m.seq, s.stack[-1] as file from marks m join states s on s.project = m.project and s.i = m.i""")
def wf3_file(spark, d):
    """The file open before every entry of a log, errors or not."""
    return logs.active_files(view(spark, d, "logs"))


@query("SC10_log_join", duck("logs", "units") + " select u.project, count(distinct u.file) as units, count(distinct l.seq) as entries from units u left join logs l on l.project = u.project group by u.project")
def sc10(spark, d):
    entries = view(spark, d, "logs").groupBy("project").agg(F.count("*").alias("entries"))
    units = view(spark, d, "units").groupBy("project").agg(F.count("*").alias("units"))
    return units.join(entries, "project", "left").select("project", "units", F.coalesce("entries", F.lit(0)).alias("entries"))


#: Template, units, workspace and log findings together; every project but those whose name ends with 1 chose a university's profile, and none has its template.
STAGES_SQL = (
    SE1_SQL.replace(duck("units", "bib"), duck("units", "bib", "logs"), 1) + STACK
    + f""", late as (select distinct project, 'LATEX_COMPILE_ERROR' as code, coalesce(file, 'main.tex') as file, line, message from ({DIRECT} union {BLOCKS}) q),
stages as (select project, code from all_f union all select project, code from late
 union all select project, 'UNDEFINED_REFERENCE' from logs where text like 'LaTeX Warning: Reference%' union all select project, 'FONT_WARNING' from logs where text like 'LaTeX Font Warning:%'
 union all select distinct project, 'THESIS_TEMPLATE_MISSING' from units where not ends_with(project, '1'))
select project, code, count(*) as n from stages group by project, code"""
)


@query("SE1_findings_of_stages", STAGES_SQL)
def se1_stages(spark, d):
    units = view(spark, d, "units")
    chosen = units.select("project").distinct().withColumn("profile", F.when(F.col("project").endswith("1"), "generic").otherwise("tehran"))
    found = latex.all_findings(units, view(spark, d, "bib"), latex.template_missing(chosen, units.select("project", "file")), log=logs.findings(view(spark, d, "logs")))
    return found.groupBy("project", "code").agg(F.count("*").alias("n"))

