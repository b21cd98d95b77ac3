"""Queries on detection and repair."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphmill.functions import detection as det
from glyphmill.functions import repairing as rep
from glyphmill.functions.text import strip
from glyphmill.operators import candidates as cand
from glyphmill.plans.registry import query
from glyphmill.sources.views import duck, view

P, FO = duck("paragraphs"), duck("formulas")
NAME = "A-Za-z0-9_₀-₉⁰¹²³⁴-⁹"
SCORED = rf""", s as (select *, trim(text, ' ') as t from paragraphs), c as (select *,
 len(regexp_extract_all(t, '\\({"|".join(det.COMMANDS)})\b')) as commands, len(regexp_extract_all(t, '{det.SYMBOL}')) as symbols,
 len(regexp_extract_all(t, '[0-9]')) as digits, len(regexp_extract_all(t, '[A-Za-z\x{{0600}}-\x{{06ff}}]{{3,}}')) as words,
 regexp_matches(t, '^\s*([A-Za-zα-ωΑ-Ω][{NAME}]*(\s*\([^)]{{0,80}}\))?|[{NAME}()]+)\s*(=|≈|≤|≥|≠|:=|→)\s*.+$') as plain,
 regexp_matches(t, '[\x{{0600}}-\x{{06ff}}]') and len(t) > 80 as persian,
 len(regexp_extract_all(t, '\$\$')) as displays, len(t) - len(replace(t, '$', '')) as dollars from s),
 scored as (select *, case when t = '' then 0.0::double else commands * 3.5::double + symbols * 1.2::double + least(digits, 8) * 0.15::double - greatest(0, words - 3) * 0.7::double + case when plain then 3.0::double else 0.0::double end - case when persian then 3.0::double else 0.0::double end end as score from c),
 judged as (select *, (displays > 0 and not (displays = 2 and starts_with(t, '$$') and ends_with(t, '$$')) and score >= 2.0) or (dollars % 2 = 1 and score >= 4.0 and words <= 3)
 or ((contains(t, concat(chr(92), 'begin{{}}')) or contains(t, concat(chr(92), 'end{{}}'))) and score >= 3.0) as broken from scored)"""


def paragraphs(spark, d):
    return view(spark, d, "paragraphs").select("doc", "part", F.col("para").alias("paragraph_index"), "text")


@query("PF1_math_score", P + SCORED + " select para, round(score, 6) as score from scored")
def pf1(spark, d):
    return view(spark, d, "paragraphs").select("para", F.round(det.math_score(F.col("text")), 6).alias("score"))


@query("SF3_score_by_document", P + SCORED + " select doc, round(sum(score), 4) as total, max(commands) as commands from scored group by doc")
def sf3(spark, d):
    v = view(spark, d, "paragraphs").select("doc", det.math_score(F.col("text")).alias("score"), F.regexp_count("text", F.lit(det.COMMAND)).alias("c"))
    return v.groupBy("doc").agg(F.round(F.sum("score"), 4).alias("total"), F.max("c").cast("long").alias("commands"))


@query("PF2_broken_paragraph", P + SCORED + " select para from judged where broken")
def pf2(spark, d):
    return view(spark, d, "paragraphs").where(det.is_broken(F.col("text"))).select("para")


#: Escaped dollars, before and after others.
ESCAPED = "concat(text, ' cost ', chr(92), chr(36), cast(para as string), chr(92), chr(92), chr(36), ' ', chr(36), case when para % 2 = 0 then concat(chr(92), chr(36)) else chr(36) end)"


@query("SF2_unescaped_dollars", P + f", e as (select para, {ESCAPED} as text from paragraphs), k as (select para, replace(text, concat(chr(92), chr(36)), '') as text from e) select para, len(text) - len(replace(text, '$', '')) as n from k")
def sf2(spark, d):
    rows = view(spark, d, "paragraphs").withColumn("text", F.expr(ESCAPED))
    return rows.select("para", det.unescaped_dollars(F.col("text")).cast("long").alias("n"))


#: The fixture's paragraphs have one form each, so a candidate's source follows from a pattern without look-around.
KINDS = P + SCORED + r""", found as (
 select para, 'latex-broken' as kind, t as source from judged where broken
 union all select para, 'latex-display', unnest(regexp_extract_all(text, '\$\$[^$]+\$\$')) from judged where not broken
 union all select para, 'latex-display', unnest(regexp_extract_all(text, '\\\[[^\]]+\\\]')) from judged where not broken
 union all select para, 'latex-inline', unnest(regexp_extract_all(text, '\\\([^)]+\\\)')) from judged where not broken
 union all select para, 'latex-inline', unnest(regexp_extract_all(text, '\$[^$]+\$')) from judged where not broken and displays = 0
 union all select para, 'latex-environment', unnest(regexp_extract_all(text, '\\begin\{cases\}.*\\end\{cases\}')) from judged where not broken),
 whole as (select *, not exists (select 1 from found f where f.para = j.para) as free from judged j where not broken and t <> ''),
 everything as (select para, kind, source from found union all
 select para, case when commands > 0 and score >= 4 then 'latex-raw' when plain and score >= 4 then 'plain-equation' when symbols > 0 and score >= 4.5 and words <= 2 and len(t) <= 160 then 'unicode-math' end, t from whole where free)"""


@query("SF1_detected_formulas", KINDS + " select para, kind, source from everything where kind is not null")
def sf1(spark, d):
    return cand.detected(paragraphs(spark, d)).select(F.col("paragraph_index").alias("para"), "kind", "source")


#: Paragraphs that one mode takes and the other leaves: formulas of symbols with words about them, and weaker ones.
LOOSE = "case when para % 13 = 4 then concat(text, ' holds for all of these', case when para % 2 = 0 then ' and the others too' else '' end) when para % 13 = 3 then concat(text, ' ≤ α ± 12') else text end"
LOOSE_KINDS = KINDS.replace(", s as (", f", loose as (select doc, part, para, {LOOSE} as text from paragraphs), s as (", 1).replace("as t from paragraphs)", "as t from loose)", 1)


@query("SF1_detected_aggressive", LOOSE_KINDS.replace("score >= 4.5 and words <= 2 and len(t) <= 160", "score >= 3.5 and len(t) <= 240") + " select para, kind, source from everything where kind is not null")
def sf1_aggressive(spark, d):
    rows = paragraphs(spark, d).withColumnRenamed("paragraph_index", "para").withColumn("text", F.expr(LOOSE)).withColumnRenamed("para", "paragraph_index")
    return cand.detected(rows, "aggressive").select(F.col("paragraph_index").alias("para"), "kind", "source")


@query("SF1_detected_loose", LOOSE_KINDS + " select para, kind, source from everything where kind is not null")
def sf1_loose(spark, d):
    rows = paragraphs(spark, d).withColumnRenamed("paragraph_index", "para").withColumn("text", F.expr(LOOSE)).withColumnRenamed("para", "paragraph_index")
    return cand.detected(rows).select(F.col("paragraph_index").alias("para"), "kind", "source")


@query("SF4_candidate_sources", KINDS + " select kind, source, count(*) as n from everything where kind is not null group by kind, source")
def sf4(spark, d):
    return cand.detected(paragraphs(spark, d)).groupBy("kind", "source").agg(F.count("*").alias("n"))


@query("PF3_safe_mode", P + r" select para, unnest(list_concat(list_concat(regexp_extract_all(text, '\$\$[^$]+\$\$'), regexp_extract_all(text, '\\\[[^\]]+\\\]')), list_concat(regexp_extract_all(text, '\\\([^)]+\\\)'), case when contains(text, '$$') then [] else regexp_extract_all(text, '\$[^$]+\$') end))) as source from paragraphs")
def pf3(spark, d):
    return cand.detected(paragraphs(spark, d), "safe").select(F.col("paragraph_index").alias("para"), "source")


@query("J12_whole_paragraph_free", KINDS + " select para from whole where free")
def j12(spark, d):
    p = view(spark, d, "paragraphs").where((strip(F.col("text")) != "") & ~det.is_broken(F.col("text")))
    return p.where(F.size(det.explicit_spans(F.col("text"), "balanced")) == 0).select("para")


#: Ids of every kind of paragraph.  A candidate's place follows from where its source stands.
PLACED = KINDS + r""", placed as (select e.para, e.kind, e.source, strpos(p.text, e.source) - 1 as start, row_number() over (partition by e.para order by strpos(p.text, e.source)) - 1 as i from everything e join paragraphs p on p.para = e.para where e.kind is not null)"""


@query("WF1_ordinals", PLACED + r""" select concat('word/document.xml:', cast(para as string), ':', case when kind = 'latex-broken' then concat(cast(start as string), ':', cast(start + len(source) as string)) else cast(i as string) end) as candidate_id, source from placed""")
def wf1(spark, d):
    return cand.detected(paragraphs(spark, d)).select("candidate_id", "source")


@query("SO1_sorted_candidates", KINDS + " select para, count(*) as n, string_agg(concat(e.kind, ' ', e.source), ' | ' order by strpos(p.text, e.source)) as in_order from everything e join paragraphs p using (para) where e.kind is not null group by para")
def so1(spark, d):
    """The array of a paragraph's candidates as it comes, unsorted here."""
    rows = paragraphs(spark, d).select(F.col("paragraph_index").alias("para"), "text", det.candidate_spans(F.col("text")).alias("spans")).where("size(spans) > 0")
    named = F.transform("spans", lambda s: F.concat_ws(" ", s["kind"], F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    return rows.select("para", F.size("spans").cast("long").alias("n"), F.array_join(named, " | ").alias("in_order"))


def spans(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey as k", "l_linenumber as pr", "cast(l_partkey % 40 as int) as start", "cast(l_partkey % 40 + 1 + l_suppkey % 12 as int) as `end`")
    item = F.struct("pr", F.struct("start", "end", F.lit("").alias("kind"), F.lit(False).alias("display"), F.lit(0.0).alias("confidence")).alias("s"))
    return rows.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]).alias("spans"))


#: One span a step, in order of priority; a step keeps it if it overlaps none of those kept.
PACK = """with recursive sp as (select l_orderkey as k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey % 40, l_partkey % 40 + 1 + l_suppkey % 12) as i, cast(l_partkey % 40 as int) as s, cast(l_partkey % 40 + 1 + l_suppkey % 12 as int) as e from lineitem),
 st(k, i, kept) as (select distinct l_orderkey, cast(0 as bigint), cast([] as struct(s int, e int)[]) from lineitem
 union all select st.k, sp.i, case when len(list_filter(st.kept, lambda y: y.s < sp.e and sp.s < y.e)) > 0 then st.kept else list_append(st.kept, struct_pack(s := sp.s, e := sp.e)) end from st join sp on sp.k = st.k and sp.i = st.i + 1)
 select k, array_to_string(list_transform(max_by(kept, i), lambda y: concat(cast(y.s as string), '-', cast(y.e as string))), ',') as packed from st group by k"""


@query("AG9_greedy_packing", PACK)
def ag9(spark, d):
    packed = F.transform(det.packed(F.col("spans")), lambda s: F.concat_ws("-", s["start"], s["end"]))
    return spans(spark, d).select("k", F.array_join(packed, ",").alias("packed"))


@query("J11_overlapping_pairs", "select a.l_orderkey as k, a.l_linenumber as a, b.l_linenumber as b from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber where a.l_partkey % 40 < b.l_partkey % 40 + 1 + b.l_suppkey % 12 and b.l_partkey % 40 < a.l_partkey % 40 + 1 + a.l_suppkey % 12")
def j11(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey as k", "l_linenumber as n", "cast(l_partkey % 40 as int) as start", "cast(l_partkey % 40 + 1 + l_suppkey % 12 as int) as `end`")
    s = F.struct("start", "end")
    a, b = rows.select("k", F.col("n").alias("a"), s.alias("x")), rows.select("k", F.col("n").alias("b"), s.alias("y"))
    return a.join(b, "k").where((F.col("a") < F.col("b")) & det.overlap(F.col("x"), F.col("y"))).select("k", "a", "b")


def formulas(spark, d):
    return view(spark, d, "formulas")


@query("SF5_1_composition", "select p_partkey as id, nfc_normalize(concat('e', '́', p_name, 'ñ')) as out from part")
def sf5_1(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), rep.nfc(F.concat(F.lit("é"), "p_name", F.lit("ñ"))).alias("out"))


PEEL = r"""case when starts_with(t, '$$') and ends_with(t, '$$') and len(t) >= 4 then trim(t[3:-3]) when starts_with(t, concat(chr(92), '[')) and ends_with(t, concat(chr(92), ']')) then trim(t[3:-3]) when starts_with(t, '$') and ends_with(t, '$') and len(t) >= 2 then trim(t[2:-2]) else t end"""
PEELED = FO + f", p as (select id, plain_math, source, {PEEL} as peeled from (select *, trim(source) as t from formulas) q)"


@query("SF5_2_strip_delimiters", PEELED + " select id, replace(peeled, '$', '') as out, contains(peeled, '$') as stray from p")
def sf5_2(spark, d):
    t, stray = rep.strip_delimiters(F.col("source"))
    return formulas(spark, d).select("id", t.alias("out"), stray.alias("stray"))


@query("SF5_3_variants", "select p_partkey as id, concat(chr(92), 'a b', p_name) as out from part")
def sf5_3(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), rep.fold_variants(F.concat(F.lit("＼a\u00a0b\u200e"), "p_name", F.lit("\u200f"))).alias("out"))


@query("SF5_4_bold", FO + r" select id, regexp_replace(source, '\*\*([^*]+)\*\*', '\1', 'g') as out from formulas")
def sf5_4(spark, d):
    return formulas(spark, d).select("id", rep.drop_bold(F.col("source")).alias("out"))


@query("SF5_5_environments", FO + r" select id, case when contains(source, '{}') then replace(replace(source, concat(chr(92), 'begin{}'), concat(chr(92), 'begin{', n, '}')), concat(chr(92), 'end{}'), concat(chr(92), 'end{', n, '}')) else source end as out from (select *, case when contains(source, '&') and regexp_matches(source, '\\text\s*\{\s*if\b') then 'cases' else 'aligned' end as n from formulas) q")
def sf5_5(spark, d):
    return formulas(spark, d).select("id", rep.name_environments(F.col("source"))[0].alias("out"))


@query("SF5_6_expectations", FO + r" select id, regexp_replace(source, '(E\s*\[[^\]]{1,240}?)(\s*=\s*(\\begin|E\s*\[))', '\1]\2', 'g') as out from formulas")
def sf5_6(spark, d):
    return formulas(spark, d).select("id", rep.close_expectations(F.col("source")).alias("out"))


@query("SF5_7_unicode_math", FO + r" select id, replace(replace(replace(replace(replace(replace(source, 'σ', concat(chr(92), 'sigma ')), '²', '^{2}'), '≤', concat(chr(92), 'le ')), '√(ab)', concat(chr(92), 'sqrt{ab}')), '₁₂', '_{12}'), '×', concat(chr(92), 'times ')) as out from formulas where id % 10 <> 3 union all select id, concat(chr(92), 'sigma ^{2} ', chr(92), 'le  ', chr(92), 'sqrt{ab} + x_{12} ', chr(92), 'times  ', chr(92), 'infty ') from formulas where id % 10 = 3")
def sf5_7(spark, d):
    return formulas(spark, d).select("id", rep.unicode_math(F.col("source")).alias("out"))


@query("SF5_8_brackets")
def sf5_8(spark, d):
    return formulas(spark, d).select("id", rep.balance_brackets(F.col("source")).alias("b")).select("id", F.col("b.text").alias("out"), F.array_join("b.repairs", "; ").alias("notes"))


#: The fixture has no escaped brace, so characters are steps and the least running depth says what closes nothing.
BRACES = """, ch as (select id, i, substr(source, i, 1) as c from (select id, source, unnest(range(1, len(source) + 1)) as i from formulas) q),
 dep as (select *, sum(case c when '{' then 1 when '}' then -1 else 0 end) over (partition by id order by i) as depth from ch),
 low as (select *, least(0, coalesce(min(depth) over (partition by id order by i rows between unbounded preceding and 1 preceding), 0)) as floor_ from dep),
 fixed as (select id, string_agg(case when c = '}' and depth < floor_ then '' else c end, '' order by i) as kept, max_by(depth, i) - least(0, min(depth)) as open_ from low group by id)"""


@query("WF4_SF5_9_braces", FO + BRACES + " select f.id, concat(coalesce(kept, ''), repeat('}', cast(coalesce(open_, 0) as int))) as out from formulas f left join fixed using (id)")
def wf4(spark, d):
    return formulas(spark, d).select("id", rep.balance_braces(F.col("source"))["text"].alias("out"))


@query("WF4_brace_window", FO + BRACES + " select id, i as pos from low where c = '}' and depth < floor_")
def wf4_window(spark, d):
    ch = formulas(spark, d).select("id", F.posexplode(F.split("source", "")).alias("pos", "c"))
    run = Window.partitionBy("id").orderBy("pos")
    depth = ch.withColumn("depth", F.sum(F.when(F.col("c") == "{", 1).when(F.col("c") == "}", -1).otherwise(0)).over(run))
    floor = F.least(F.lit(0), F.coalesce(F.min("depth").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return depth.withColumn("floor", floor).where("c = '}' and depth < floor").select("id", (F.col("pos") + 1).cast("long").alias("pos"))


@query("SF5_10_SF5_11_settle", FO + r" select id, trim(regexp_replace(regexp_replace(source, '\\(begin|end)\s*\{\s*\}', '\\\1{aligned}', 'g'), '[ \t]+', ' ', 'g')) as out from formulas")
def sf5_10(spark, d):
    return formulas(spark, d).select("id", rep.settle(F.col("source")).alias("out"))


@query("SF5_repaired_formulas")
def sf5(spark, d):
    out = rep.repaired(formulas(spark, d), "source", "plain_math")
    return out.select("id", "normalized", F.array_join("repairs", "; ").alias("repairs"))


@query("AG12_ordered_distinct", "select k, string_agg(f, ';' order by n, f) as v from (select l_orderkey as k, l_returnflag as f, min(l_linenumber) as n from lineitem group by 1, 2) q group by k")
def ag12(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("x"))
    return rows.select("k", F.array_join(F.array_distinct(F.transform("x", lambda s: s["l_returnflag"])), ";").alias("v"))


COMPILED = ", known as (select distinct trim(source) as f from formulas where id % 4 = 0)"


@query("J5_compiled_formulas", FO + COMPILED + " select id, trim(source) as formula from formulas where trim(source) in (select f from known)")
def j5(spark, d):
    rows = formulas(spark, d).select("id", F.lit("p").alias("part"), F.col("id").alias("paragraph_index"), F.col("source").alias("normalized"))
    known = cand.distinct_formulas(rows.where("id % 4 = 0")).withColumn("compiled", F.lit("m"))
    return cand.compiled(rows, known)[0].select("id", F.trim("normalized").alias("formula"))


@query("J5_failed_formulas", FO + COMPILED + " select id as paragraph_index, source as formula from formulas where trim(source) not in (select f from known)")
def j5_failed(spark, d):
    rows = formulas(spark, d).select("id", F.lit("p").alias("part"), F.col("id").alias("paragraph_index"), F.col("source").alias("normalized"))
    known = cand.distinct_formulas(rows.where("id % 4 = 0")).withColumn("compiled", F.lit("m"))
    return cand.compiled(rows, known)[1].select("paragraph_index", "formula")
