"""Queries on reports, reviews and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.operators import candidates as cand
from glyphmill.operators import latex, package
from glyphmill.operators import plugins as plug
from glyphmill.operators import reports as rep
from glyphmill.plans.formulas import KINDS, paragraphs
from glyphmill.plans.latex import WF2_SQL
from glyphmill.plans.registry import query
from glyphmill.sources.views import duck, view

STATUS = "select c_custkey as doc, case when c_nationkey % 5 = 0 then 'failed' else 'completed' end as status, c_nationkey % 3 as n_warnings, concat('error ', c_name) as error from customer"


def read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("AG1_report_counters", KINDS + " select doc, count(*) as detected from everything e join paragraphs p using (para) where e.kind is not null group by doc")
def ag1(spark, d):
    return cand.detected(paragraphs(spark, d)).groupBy("doc").agg(F.count("*").alias("detected"))


@query("AG1_repaired_counters")
def ag1_repaired(spark, d):
    return cand.counters(cand.candidates(paragraphs(spark, d)))


@query("AG14_batch_summary", f"with s as ({STATUS}) select count_if(status = 'completed') as completed, count_if(status = 'completed' and n_warnings > 0) as with_warnings, count_if(status = 'failed') as failed, min_by(error, doc) filter (where status = 'failed') as first_error from s")
def ag14(spark, d):
    read(spark, d, "customer").createOrReplaceTempView("gm_customer")
    return rep.batch_summary(spark.sql(STATUS.replace("from customer", "from gm_customer")))


@query("PF6_review_rows", WF2_SQL + " select concat('tex:', file, ':', cast(line as string), ':', cast(place as string)) as candidate_id, file as part, line - 1 as paragraph_index, case pattern when 0 then 'Missing braces around fraction arguments' else 'Missing backslash and braces in fraction command' end as repairs from placed")
def pf6(spark, d):
    return rep.review_rows(latex.changes(view(spark, d, "units"))).select("candidate_id", "part", "paragraph_index", F.array_join("repairs", "; ").alias("repairs"))


@query("PF7_locations", "select event_id, case when user_id % 3 = 0 and event_id % 2 = 0 then concat('f', cast(user_id as string), ':', cast(event_id as string)) when user_id % 3 = 0 then concat('f', cast(user_id as string)) when event_id % 2 = 0 then concat('line ', cast(event_id as string)) else '-' end as place from events")
def pf7(spark, d):
    e = read(spark, d, "events")
    file, line = F.when(e.user_id % 3 == 0, F.concat(F.lit("f"), "user_id")), F.when(e.event_id % 2 == 0, e.event_id)
    return e.select("event_id", rep.location(file, line).alias("place"))


@query("PF8_reasons", "select l_orderkey as k, case when min(l_linestatus) = 'F' then 'Skipped by user' when count(*) > 5 then 'Formula detected and normalized' else string_agg(l_returnflag, '; ' order by l_linenumber, l_returnflag) end as reason from lineitem group by 1")
def pf8(spark, d):
    g = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_linestatus").alias("s"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("x"))
    flags = F.when(F.col("n") > 5, F.array().cast("array<string>")).otherwise(F.transform("x", lambda s: s["l_returnflag"]))
    return g.select("k", rep.reason_text(flags, F.col("s") != "F").alias("reason"))


@query("PF9_file_kinds", "with f as (select p_partkey as id, concat('/x/', p_name, case p_partkey % 5 when 0 then '.DOCX' when 1 then '.docm' when 2 then '.tex' when 3 then '.pdf' else '' end) as path from part) select id, case when regexp_matches(lower(path), '\\.doc[xm]$') then 'word' when lower(path) like '%.tex' then 'tex' end as kind from f where regexp_matches(lower(path), '\\.(doc[xm]|tex)$')")
def pf9(spark, d):
    path = F.concat(F.lit("/x/"), "p_name", F.element_at(F.array(*map(F.lit, (".DOCX", ".docm", ".tex", ".pdf", ""))), (F.col("p_partkey") % 5 + 1).cast("int")))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), rep.file_kind(path).alias("kind")).where("kind is not null")


@query("PF10_endpoints", "select p_partkey as id, p_partkey % 10 in (0, 1, 5, 8, 9) as allowed from part")
def pf10(spark, d):
    urls = ("https://example.com/v1", "http://127.0.0.1:11434/api", "http://example.com", "https://u:p@example.com", "ftp://10.0.0.1", "http://192.168.1.4/x", "http://10.example.com/v1", "http://127.evil.org", "http://[::1]:8080/v1", "http://169.254.1.2/")
    url = F.element_at(F.array(*map(F.lit, urls)), (F.col("p_partkey") % 10 + 1).cast("int"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), rep.endpoint_allowed(url).alias("allowed"))


#: Every candidate id stands in two documents, and a decision concerns one of them.
DECIDED = ", decided as (select case when doc_id % 2 = 0 then 'a.docx' else 'b.docx' end as doc, doc_id as candidate_id, enabled, trim(coalesce(override, '')) as text from reviews), twice as (select doc, o_orderkey as candidate_id, o_orderpriority as normalized from orders cross join (values ('a.docx'), ('b.docx')) q(doc))"


def in_two_documents(spark, d):
    docs = F.explode(F.array(F.lit("a.docx"), F.lit("b.docx"))).alias("doc")
    rows = read(spark, d, "orders").select(docs, F.col("o_orderkey").alias("candidate_id"), F.col("o_orderpriority").alias("normalized"), F.array(F.lit("a")).alias("repairs"), F.lit(True).alias("enabled"))
    doc = F.when(F.col("doc_id") % 2 == 0, "a.docx").otherwise("b.docx").alias("doc")
    return cand.reviewed(rows, view(spark, d, "reviews").select(doc, F.col("doc_id").alias("candidate_id"), "enabled", "override"))


@query("PF4_opt_outs", duck("reviews") + DECIDED + " select t.doc, t.candidate_id from twice t left join decided r using (doc, candidate_id) where coalesce(r.enabled, true)")
def pf4(spark, d):
    return in_two_documents(spark, d).where("enabled").select("doc", "candidate_id")


@query("PF5_overrides", duck("reviews") + DECIDED + " select t.doc, t.candidate_id, case when r.text <> '' then r.text else t.normalized end as normalized, case when r.text <> '' then 'a; edited in preview' else 'a' end as repairs from twice t left join decided r using (doc, candidate_id)")
def pf5(spark, d):
    return in_two_documents(spark, d).select("doc", "candidate_id", "normalized", F.array_join("repairs", "; ").alias("repairs"))


@query("SF14_messages", "with m(lang, key, text) as (values ('en', 'a', 'A'), ('fa', 'a', 'الف'), ('en', 'b', 'B')), k as (select event_id, case event_id % 3 when 0 then 'a' when 1 then 'b' else 'c' end as key from events) select k.key, count(*) as n, min(coalesce(f.text, e.text, k.key)) as text from k left join m f on f.key = k.key and f.lang = 'fa' left join m e on e.key = k.key and e.lang = 'en' group by k.key")
def sf14(spark, d):
    m = spark.createDataFrame([("en", "a", "A"), ("fa", "a", "الف"), ("en", "b", "B")], "lang string, key string, text string")
    keys = read(spark, d, "events").select(F.element_at(F.array(*map(F.lit, "abc")), (F.col("event_id") % 3 + 1).cast("int")).alias("key"))
    return rep.translated(keys, m, "fa").groupBy("key").agg(F.count("*").alias("n"), F.min("text").alias("text"))


@query("SK1_json_reports", "select p_partkey as id, concat('{\"p_name\":\"', p_name, '\",\"p_size\":', cast(p_size as string), '}') as report from part")
def sk1(spark, d):
    return rep.json_rows(read(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_size"), "id")


@query("SK7_sanitised_paths", "select p_partkey as id, concat(p_name, '.tex') as name from part")
def sk7(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), rep.base_name(F.concat(F.lit("/private/user/"), "p_name", F.lit(".tex"))).alias("name"))



@query("SK11_free_names", "select concat('d', cast(k as string)) as dir, concat('a', case when k + 2 = 1 then '' else concat('_', cast(k + 2 as string)) end, '.docx') as name from (select distinct p_size % 5 as k from part) q")
def sk11(spark, d):
    dirs = read(spark, d, "part").select((F.col("p_size") % 5).alias("k")).distinct()
    taken = dirs.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("k") + 1))).select(F.concat(F.lit("d"), "k").alias("dir"), F.concat(F.lit("a"), F.when(F.col("n") == 1, "").otherwise(F.concat(F.lit("_"), "n")), F.lit(".docx")).alias("name"))
    wanted = dirs.select(F.concat(F.lit("d"), "k").alias("dir"), F.lit("a").alias("stem"), F.lit(".docx").alias("suffix"))
    return rep.free_names(wanted, taken).select("dir", "name")


@query("SO3_sorted_names", "select c_nationkey as k, string_agg(distinct concat('word/', case c_mktsegment when 'BUILDING' then 'document' when 'MACHINERY' then 'comments' else concat('header', cast(c_custkey % 20 as varchar)) end, '.xml'), ',' order by concat('word/', case c_mktsegment when 'BUILDING' then 'document' when 'MACHINERY' then 'comments' else concat('header', cast(c_custkey % 20 as varchar)) end, '.xml')) as names from customer where c_mktsegment <> 'FURNITURE' group by 1")
def so3(spark, d):
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "document").when(F.col("c_mktsegment") == "MACHINERY", "comments").when(F.col("c_mktsegment") == "FURNITURE", "styles").otherwise(F.concat(F.lit("header"), (F.col("c_custkey") % 20).cast("string")))
    names = read(spark, d, "customer").select(F.col("c_nationkey").alias("path"), F.concat(F.lit("word/"), kind, F.lit(".xml")).alias("name"))
    return package.story_names(names).select(F.col("path").alias("k"), F.array_join("names", ",").alias("names"))


@query("SO5_display_cut", "select doc_id, substr(text, 1, 90) as shown from documents")
def so5(spark, d):
    return read(spark, d, "documents").select("doc_id", rep.shown(F.col("text")).alias("shown"))


@query("UD3_plugin_names", "select event_id, case when event_id % 2 = 0 then 'named' else event_type end as plugin from events")
def ud3(spark, d):
    own = F.when(F.col("event_id") % 4 == 0, "named").when(F.col("event_id") % 2 == 0, "named").when(F.col("event_id") % 3 == 0, "").otherwise(F.lit(None))
    return read(spark, d, "events").select("event_id", plug.filled_plugin(own, F.col("event_type")).alias("plugin"))


@query("UD1_plugin_findings", duck("units") + " select project, 'LONG_UNIT' as code, file, 'length' as plugin from units where len(text) > 5000 union all select distinct project, 'PLUGIN_FAILURE', '', 'broken' from units")
def ud1(spark, d):
    r = plug.Registry()
    r.add("length", lambda sources, meta: [{"code": "LONG_UNIT", "message": "long", "file": f} for f, t in sources.items() if len(t) > 5000])
    r.add("broken", lambda sources, meta: 1 / 0)
    return r.findings(view(spark, d, "units")).select("project", "code", "file", "plugin")


#: Responses of three services, every fourth of them of no use in a way of its own.
AI_SQL = """with r as (select event_id, event_type, event_id % 3 as kind, cast(floor(event_id / 3) as bigint) % 8 as shape from events)
select event_id, case when shape < 4 then 'AI_FINDING' else 'AI_UNAVAILABLE' end as code, case when shape < 4 then event_type end as title, case when shape < 4 then case shape when 1 then 'error' else 'warning' end end as severity,
 case when shape in (0, 3) then cast(event_id % 1000 as int) when shape = 1 then 12 end as line,
 case shape when 4 then 'The AI response was not valid structured JSON.' when 5 then 'The AI response was not valid structured JSON.' when 6 then 'AI analysis failed: AI provider request failed: timed out' when 7 then 'AI analysis failed: AI provider returned a non-object JSON response.' end as message from r"""


@query("SC15_ai_findings", AI_SQL)
def sc15(spark, d):
    from glyphmill.operators import assistant

    e = read(spark, d, "events").select("event_id", "event_type", (F.col("event_id") % 3).alias("kind"), (F.floor(F.col("event_id") / 3) % 8).alias("shape"))
    title, shape = F.concat(F.lit('"title": "'), "event_type", F.lit('"')), F.col("shape")
    line = (F.col("event_id") % 1000).cast("string")
    answer = (
        F.when(shape == 0, F.concat(F.lit("[{"), title, F.lit(', "line": '), line, F.lit("}]"))).when(shape == 1, F.concat(F.lit(" ```json\n[{"), title, F.lit(', "severity": "error", "line": " 12 "}]\n``` ')))
        .when(shape == 2, F.concat(F.lit("[7, {"), title, F.lit("}]"))).when(shape == 3, F.concat(F.lit("[{"), title, F.lit(', "line": "'), line, F.lit('"}]'))).when(shape == 4, F.concat(F.lit("{"), title, F.lit("}")))
        .otherwise(F.concat(F.lit("[{"), title, F.lit(', "line": "none"}]')))
    )
    kinds = F.when(F.col("kind") == 0, assistant.OPENAI).when(F.col("kind") == 1, assistant.COMPATIBLE).otherwise(assistant.OLLAMA)
    body = (
        F.when(F.col("kind") == 0, F.to_json(F.struct(F.array(F.struct(F.array(F.struct(answer.alias("text"))).alias("content"))).alias("output"))))
        .when(F.col("kind") == 1, F.to_json(F.struct(F.array(F.struct(F.struct(answer.alias("content")).alias("message"))).alias("choices")))).otherwise(F.to_json(F.struct(answer.alias("response"))))
    )
    body = F.when(shape == 6, F.lit(None)).when(shape == 7, F.lit("[1]")).otherwise(body)
    responses = e.select(F.lit("p").alias("project"), F.col("event_id").cast("string").alias("file"), kinds.alias("provider"), body.alias("body"), F.when(shape == 6, "timed out").alias("error"))
    found = assistant.findings(assistant.completions(responses))
    return found.select(F.col("file").cast("long").alias("event_id"), "code", "title", "severity", "line", "message")
