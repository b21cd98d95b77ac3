"""Queries on packages and rasters."""

from __future__ import annotations

import atexit
import io
import uuid
import zipfile
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from glyphmill.operators import compiling, graph, images, package, raster
from glyphmill.plans.registry import query
from glyphmill.sources.views import duck, view

E = duck("entries")


def as_members(rows):
    return rows.select(F.concat_ws("/", "doc", "side").alias("path"), "name", "size", "csize", "flags", "crc")


#: Members that one task counts: hashes of their names are memory, and shuffles of such rows are compressed too well for their bytes to say so.
MEMBERS_OF_TASK = 200_000
ADMIT = """, m as (select concat(doc, '/', side) as path, name, size, csize, flags from entries union all select concat(doc, '/', side), n, 10, 5, 0 from (select distinct doc, side from entries) q cross join (values ('[Content_Types].xml'), ('word/document.xml')) r(n) where not (doc like '%7' and n like 'word%')),
g as (select path, count(*) as n, count(distinct name) as names, max(size) as largest, sum(size) as total, max(size / greatest(csize, 1)) as ratio, max(flags & 1) as locked, sum(csize) as packed, max(case when name = '[Content_Types].xml' then 1 else 0 end) + max(case when name = 'word/document.xml' then 1 else 0 end) as req from m group by path)"""


@query("SC6_admission", E + ADMIT + " select path, case when n <> names then 'duplicate member' when req < 2 then 'required part is missing' when locked > 0 then 'encrypted member' when ratio > 2500 then 'suspicious compression ratio' end as error from g")
def sc6(spark, d):
    e = as_members(view(spark, d, "entries"))
    extra = e.select("path").distinct().withColumn("name", F.explode(F.array(*map(F.lit, package.REQUIRED))))
    extra = extra.where(~(F.split("path", "/")[0].endswith("7") & F.col("name").startswith("word"))).select("path", "name", F.lit(10).alias("size"), F.lit(5).alias("csize"), F.lit(0).alias("flags"), F.lit(0).alias("crc"))
    return package.admission(graph.dealt(e.unionByName(extra), MEMBERS_OF_TASK, "path", "name")).select("path", "error")


BOTH = """, b as (select doc, name, min(crc) as b, bool_or(modified) as modified from entries where side = 'before' group by 1, 2), a as (select doc, name, min(crc) as a from entries where side = 'after' group by 1, 2),
f as (select coalesce(b.doc, a.doc) as doc, coalesce(b.name, a.name) as name, b.b, a.a, coalesce(b.modified, false) as modified, b.b is not distinct from a.a as same from b full join a on a.doc = b.doc and a.name = b.name)"""


@query("J7_entry_comparison", E + BOTH + " select doc, bool_and(a is not null and b is not null) as entries_equal, bool_and(same or modified) as unmodified_equal, bool_and(same or not ends_with(name, '.rels')) as relations_equal, coalesce(string_agg(case when not same then name end, ',' order by name), '') as changed from f group by doc")
def j7(spark, d):
    return package.entry_comparison(view(spark, d, "entries"))


@query("AG3_verdict", E + BOTH + " select doc, bool_and((a is not null and b is not null) and (same or modified) and (same or not ends_with(name, '.rels'))) as valid from f group by doc")
def ag3(spark, d):
    c = package.entry_comparison(view(spark, d, "entries"))
    return c.select("doc", (F.col("entries_equal") & F.col("unmodified_equal") & F.col("relations_equal")).alias("valid"))


@query("SE3_entry_sets", E + BOTH + " select doc, bool_or(a is null) as lost, bool_or(b is null) as new from f where a is null or b is null group by doc")
def se3(spark, d):
    return package.entry_sets(view(spark, d, "entries"))


@query("SE4_required_parts", "with m as (select concat('p', cast(l_orderkey as varchar)) as path, case l_linenumber when 1 then '[Content_Types].xml' when 2 then 'word/document.xml' else concat('word/media/', cast(l_linenumber as varchar)) end as name from lineitem) select path, count(distinct name) filter (where name in ('[Content_Types].xml', 'word/document.xml')) < 2 as missing from m group by path")
def se4(spark, d):
    n, path = F.col("l_linenumber"), F.concat(F.lit("p"), F.col("l_orderkey").cast("string"))
    name = F.when(n == 1, package.REQUIRED[0]).when(n == 2, package.REQUIRED[1]).otherwise(F.concat(F.lit("word/media/"), n.cast("string")))
    # numbers are shuffled, by their paths, so members are made, counted and admitted where they arrive
    keys = graph.dealt(spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber"), MEMBERS_OF_TASK, path)
    rows = keys.select(path.alias("path"), name.alias("name"), F.lit(10).alias("size"), F.lit(5).alias("csize"), F.lit(0).alias("flags"), F.lit(0).alias("crc")).distinct()
    return package.admission(rows).select("path", F.coalesce(F.col("error") == "required part is missing", F.lit(False)).alias("missing"))


W_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
FORMULA = "<m:oMath><m:r><m:t>x</m:t></m:r></m:oMath>"


@lru_cache(maxsize=64)
def _built(tables: int, formulas: int, loose: int = 0, media: str | None = "png", rels: str = "<r/>") -> bytes:
    """A small package: tables, formulas in a paragraph each, formulas outside of paragraphs, a picture, relations."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f"<w:document {W_NS}><w:body>{'<w:tbl/>' * tables}{f'<w:p>{FORMULA}</w:p>' * formulas}{FORMULA * loose}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", rels)
        if media:
            z.writestr("word/media/image1.png", media)
    return out.getvalue()


#: Pairs that one task builds and checks: seconds of Python for a few bytes of the table, so its splits say nothing of the work.
PAIRS_OF_TASK = 5000


PAIR = {"path": "string", "before": "binary", "after": "binary", "expected": "int"}


def built_pairs(spark, d, *names):
    """(path, before, after, expected) of packages made from the table of parts, altered in one way of seven each; names: those of the columns that are made."""
    names = names or tuple(PAIR)

    def run(batches):
        for pdf in batches:
            rows = []
            for k, size in zip(pdf["p_partkey"], pdf["p_size"]):
                t, how = int(size) % 3, int(k) % 7
                after = _built(t + (how == 3), 1 + (how in (4, 6)), int(how == 5), None if how == 1 else "png", "<r2/>" if how == 2 else "<r/>")
                rows.append((str(k), _built(t, 1), after, int(how == 6)))
            yield pd.DataFrame(rows, columns=list(PAIR))[list(names)]

    parts = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size")
    return graph.dealt(parts, PAIRS_OF_TASK, "p_partkey").mapInPandas(run, ", ".join(f"{n} {PAIR[n]}" for n in names))


@query("AG2_structure", "select cast(p_partkey as string) as path, cast(p_size % 3 + case when p_partkey % 7 = 3 then 1 else 0 end as bigint) as tables, cast(1 + case when p_partkey % 7 in (4, 5, 6) then 1 else 0 end as bigint) as math, cast(case when p_partkey % 7 = 5 then 1 else 0 end as bigint) as misplaced from part")
def ag2(spark, d):
    return package.structure(built_pairs(spark, d, "path", "after").withColumnRenamed("after", "content")).select("path", "tables", "math", "misplaced")


@query("AG3_output_verdict", "select cast(p_partkey as string) as path, p_partkey % 7 <> 1 as entries_equal, p_partkey % 7 not in (1, 2) as unmodified_equal, true as content_types_equal, p_partkey % 7 <> 2 as relations_equal, p_partkey % 7 <> 3 as structure_equal, true as readable, p_partkey % 7 not in (4, 5) as math_valid, p_partkey % 7 <> 5 as placement_valid, p_partkey % 7 in (0, 6) as valid from part")
def ag3_output(spark, d):
    return package.verdicts(built_pairs(spark, d)).drop("error")


WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
HEAD = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{WORD}"><w:body><w:p><w:r><w:t>Start</w:t></w:r></w:p>'
TAIL = f'<w:p   w:rsidR = "1" ><w:choice xmlns:wps="urn:wps" Requires="wps"/><w:r><w:t>End &amp; $</w:t></w:r></w:p></w:body></w:document>'
OMML = b'<m:oMath xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"><m:r><m:t>x</m:t></m:r></m:oMath>'


#: Tasks that build packages, which are few and grow with the table.
PACKAGE_TASKS = 64


def word_folder(spark, d):
    """A folder of packages in the shared folder, one for each size of the parts, published through the sink: a paragraph with a formula for each part."""
    from glyphmill.operators.graph import shared_dir
    from glyphmill.sources import word

    def run(batches):
        for pdf in batches:
            rows = []
            for size, texts in zip(pdf["p_size"], pdf["texts"]):
                body = "".join(f'<w:p><w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">{t}</w:t></w:r></w:p>' for t in texts)
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("[Content_Types].xml", "<Types/>")
                    z.writestr("word/document.xml", HEAD + body + TAIL)
                    z.writestr("word/styles.xml", f"<w:styles xmlns:w='{WORD}'/>")
                rows.append((f"/s{size}.docx", out.getvalue(), 0, [], None))
            yield pd.DataFrame(rows, columns=["path", "content", "converted", "warnings", "error"])

    folder = f"{shared_dir(spark)}/words-{uuid.uuid4().hex}"
    text = F.concat("p_name", F.lit(" $x_{"), F.col("p_partkey").cast("string"), F.lit("}$ or $y$."))
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_size", "p_name", "p_partkey")
    parts = rows.repartition(PACKAGE_TASKS, "p_size").groupBy("p_size").agg(F.array_sort(F.collect_list(text)).alias("texts"))
    word.publish(parts.mapInPandas(run, package.PATCHED), folder)
    atexit.register(_removed, spark, folder)
    return folder


def _removed(spark, folder):
    if spark.sparkContext._jsc is not None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


FILE = "element_at(split(path, '/'), -1) as file"


@query("SC1_package_parts", "select concat('s', cast(p_size as varchar), '.docx') as file, 'word/document.xml' as part, count(*) + 2 as paragraphs, cast(sum(len(p_name) + len(cast(p_partkey as varchar)) + 15) + 12 as bigint) as chars from part group by p_size")
def sc1(spark, d):
    from glyphmill.sources import word

    parts = word.read_parts(spark, word_folder(spark, d)).where("part = 'word/document.xml'")
    chars = F.aggregate("texts", F.lit(0).cast("long"), lambda acc, t: acc + F.length(t))
    return package.scanned(parts).withColumn("chars", chars).selectExpr(FILE, "part", "cast(size(texts) as bigint) as paragraphs", "chars")


#: What the packages of word_folder hold after repair, byte for byte, by size.
RUN = '<w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">'
REPAIRED = (
    f"select concat('s', cast(p_size as varchar), '.docx') as file, count(*) as n, '{HEAD}' || string_agg('<w:p>{RUN}' || p_name || ' </w:t></w:r>{OMML.decode()}{RUN} or </w:t></w:r>{OMML.decode()}"
    f"{RUN.replace(' xml:space="preserve"', '')}.</w:t></w:r></w:p>', '' order by p_name || ' $x_{{' || cast(p_partkey as varchar) || '}}$ or $y$.') || '{TAIL}' as text from part group by p_size"
)


@query("SK3_published_packages", f"select file, true as published, cast(2 * n as integer) as converted, cast(null as varchar) as error, sha256(text) as part_sha256 from ({REPAIRED}) q")
def sk3(spark, d):
    from glyphmill import api
    from glyphmill.sources import word

    folder = word_folder(spark, d)
    status = api.publish_words(spark, folder, f"{folder}/repaired", batch_compiler=lambda formulas: dict.fromkeys(formulas, OMML))
    parts = word.read_parts(spark, f"{folder}/repaired").selectExpr(FILE, "sha2(content, 256) as part_sha256")
    return status.drop("warnings").join(parts, "file")


@query("AG1_package_counters", "select concat('s', cast(p_size as varchar), '.docx') as doc, cast(1 as bigint) as scanned_parts, count(*) + 2 as scanned_paragraphs, cast(0 as bigint) as already_native, 2 * count(*) as detected, 2 * count(*) - count(*) filter (where p_partkey % 3 = 0) as converted, count(*) filter (where p_partkey % 3 = 0) as skipped from part group by p_size")
def ag1_packages(spark, d):
    """Opt-outs: the first formula of every third part."""
    from glyphmill import api

    folder = word_folder(spark, d)
    prepared = api.prepared_words(spark, folder)
    rows = prepared[1]
    number = F.regexp_extract("source", r"x_\{(\d+)\}", 1)
    out = rows.where(number != "").where(number.cast("int") % 3 == 0).select("doc", "candidate_id", F.lit(False).alias("enabled"), F.lit("").alias("override"))
    decisions = graph.short(out)
    done = api.repair_words(spark, folder, decisions=decisions, prepared=prepared, batch_compiler=lambda formulas: dict.fromkeys(formulas, OMML))
    counted = api.words_report(spark, folder, graph.short(done.drop("content")), decisions, prepared=prepared)
    return counted.drop("repaired", "error").withColumn("doc", F.element_at(F.split("doc", "/"), -1))


COMPILED = """with f as (select distinct trim(p_name) || case when p_size % 5 = 0 then ' (odd' when p_size % 5 = 1 then ' [bad' else '' end as normalized from part)
select normalized, case when normalized like '%[bad' then 'PANDOC_BATCH_FAILED' when normalized like '%(odd' then 'PANDOC_FORMULA_FAILED' end as code, case when normalized not like '%[bad' and normalized not like '%(odd' then 'm:' || normalized end as markup from f"""


def _compile(formulas):
    """Fails as a whole when a formula has a bracket, and leaves out those with a parenthesis."""
    if any("[" in f for f in formulas):
        raise ValueError("bracket")
    return {f: f"m:{f}".encode() for f in formulas if "(" not in f}


@query("DM4_compiled_formulas", COMPILED)
def dm4(spark, d):
    end = F.when(F.col("p_size") % 5 == 0, " (odd").when(F.col("p_size") % 5 == 1, " [bad").otherwise("")
    formulas = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("  "), "p_name", end, F.lit("\t")).alias("normalized"))
    return compiling.compiled(formulas, _compile, total=600).select("normalized", "code", F.decode("markup", "UTF-8").alias("markup"))


@query("AG4_math_delta", E + " select doc, cast(sum(case when side = 'after' then flags else -flags end) as bigint) as delta, sum(case when side = 'after' then flags else -flags end) = 0 as valid from entries group by doc")
def ag4(spark, d):
    e = view(spark, d, "entries").select("doc", "side", F.col("flags").alias("math"))
    return package.math_delta(e, e.select("doc").distinct().withColumn("n", F.lit(0)))


@query("AG10_by_part", "select l_orderkey as doc, l_linenumber as part, count(*) as n, string_agg(cast(l_partkey as string), ',' order by l_partkey) as items from lineitem group by 1, 2")
def ag10(spark, d):
    from glyphmill.operators.candidates import by_part

    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("part"), F.lit(0).alias("paragraph_index"), F.col("l_partkey").alias("start"), F.col("l_partkey").alias("end"), F.lit("").alias("normalized"))
    return by_part(rows).select("doc", "part", F.size("items").cast("long").alias("n"), F.array_join(F.transform("items", lambda s: s["start"].cast("string")), ",").alias("items"))


@query("DM2_text_kept", "select p_partkey as id, p_partkey % 7 <> 0 as kept from part")
def dm2(spark, d):
    from glyphmill.operators.candidates import text_kept

    p = spark.read.parquet(f"{d}/part.parquet")
    before = F.concat(F.lit("ab"), "p_name", F.lit("$x$"))
    n = F.length("p_name")
    spans = F.array(F.struct((n + 2).alias("start"), (n + 5).alias("end")))
    after = F.concat(F.lit("ab"), "p_name", F.when(F.col("p_partkey") % 7 == 0, "!").otherwise(""))
    return p.select(F.col("p_partkey").alias("id"), text_kept(before, after, spans).alias("kept"))


@query("DM5_atomic_documents", "select l_orderkey as doc, count(*) as n from lineitem group by 1 having bool_and(l_suppkey % 5 <> 0)")
def dm5(spark, d):
    from glyphmill.operators.candidates import atomic

    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("doc"), "l_suppkey")
    return atomic(rows, rows.where("l_suppkey % 5 = 0")).groupBy("doc").agg(F.count("*").alias("n"))


@query("SC2_story_parts", "select p_partkey as id from part where p_partkey % 4 in (0, 1)")
def sc2(spark, d):
    names = F.element_at(F.array(*map(F.lit, ("word/document.xml", "word/header12.xml", "word/styles.xml", "word/media/header1.xml"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return spark.read.parquet(f"{d}/part.parquet").where(package.is_story(names)).select(F.col("p_partkey").alias("id"))


@query("SK9_valid_pdf", "select p_partkey as id, p_partkey % 3 = 0 as valid from part")
def sk9(spark, d):
    body = F.concat(F.when(F.col("p_partkey") % 3 == 1, "%XXX-").otherwise("%PDF-"), F.repeat(F.lit("x"), F.lit(5000)), F.when(F.col("p_partkey") % 3 == 2, "").otherwise("%%EOF"))
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), package.valid_pdf(F.encode(body, "UTF-8")).alias("valid"))


PIX = duck("pixels") + """, s as (select page, x, y, coalesce(max(case when side = 'before' then r end), 255) as r0, coalesce(max(case when side = 'before' then g end), 255) as g0, coalesce(max(case when side = 'before' then b end), 255) as b0,
 coalesce(max(case when side = 'after' then r end), 255) as r1, coalesce(max(case when side = 'after' then g end), 255) as g1, coalesce(max(case when side = 'after' then b end), 255) as b1 from pixels group by page, x, y),
 q as (select page, sum(case when (abs(r0 - r1) * 19595 + abs(g0 - g1) * 38470 + abs(b0 - b1) * 7471 + 32768) >> 16 > 12 then 1 else 0 end) as changed, max(greatest(abs(r0 - r1), abs(g0 - g1), abs(b0 - b1))) as maximum_delta from s group by page),
 g as (select page, max(case when side = 'before' then x + 1 end) as w0, max(case when side = 'before' then y + 1 end) as h0, max(case when side = 'after' then x + 1 end) as w1, max(case when side = 'after' then y + 1 end) as h1 from pixels group by page),
 diff as (select q.page, cast(changed as bigint) as changed, maximum_delta, cast(greatest(coalesce(w0, w1), coalesce(w1, w0)) * greatest(coalesce(h0, h1), coalesce(h1, h0)) as bigint) as area, coalesce(w0 = w1 and h0 = h1, false) as same_size from q join g using (page))"""


@query("J8_AG5_page_diffs", PIX + " select page, changed, area, maximum_delta, round(changed / area, 9) as changed_ratio, same_size from diff")
def ag5(spark, d):
    return raster.page_diffs(view(spark, d, "pixels")).withColumn("changed_ratio", F.round("changed_ratio", 9))


@query("AG6_visual_verdict", PIX + " select round(sum(changed) / sum(area), 9) as ratio, bool_and(same_size) as same_geometry, count(*) as pages, bool_and(same_size) and sum(changed) / sum(area) <= 0.002 as passed from diff")
def ag6(spark, d):
    return raster.verdict(raster.page_diffs(view(spark, d, "pixels"))).withColumn("ratio", F.round("ratio", 9))


def image_folder(spark, d):
    """Folders before and after of page images, one for each ten thousand and tenth of the vectors: eight rows of eight pixels a vector, some of which change."""
    from glyphmill.sources.word import store_of

    root = f"{graph.shared_dir(spark)}/pages-{uuid.uuid4().hex}"

    def run(batches):
        for pdf in batches:
            for doc, page, vectors in zip(pdf["doc"], pdf["page"], pdf["vectors"]):
                v = np.array([x["embedding"] for x in vectors], dtype=np.float32).astype(float)
                odd = np.array([x["vec_id"] % 7 == 0 for x in vectors])[:, None] & (np.arange(v.shape[1]) % 5 == 0)
                r = np.abs(np.floor(v * 100)).astype(int) % 256
                for side in images.SIDES:
                    g = (r + 60 * odd * (side == "after")) % 256
                    pixels = np.stack((r, g, np.broadcast_to(np.arange(v.shape[1]), r.shape)), axis=2).astype(np.uint8).reshape(-1, 8, 3)
                    store, at = store_of(f"{root}/{side}/d{doc}")
                    store.create_dir(at, recursive=True)
                    with store.open_output_stream(f"{at}/p{page:06d}.png") as f:
                        f.write(images.png(8, len(pixels), [images.deflated(pixels, True)]))
            yield pd.DataFrame({"n": [len(pdf)]})

    e = spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id is not null and embedding is not null")
    vectors = F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("vectors")
    e.groupBy((F.col("vec_id") % 10).alias("doc"), F.floor(F.col("vec_id") / 10_000).alias("page")).agg(vectors).mapInPandas(run, "n long").agg(F.sum("n")).collect()
    atexit.register(_removed, spark, root)
    return root


@query("SC12_SK6_page_images", """with px as (select vec_id, unnest(range(0, len(embedding))) as i, embedding from embeddings),
q as (select vec_id, abs(cast(floor(cast(embedding[i + 1] as double) * 100) as bigint)) % 256 as r, case when vec_id % 7 = 0 and i % 5 = 0 then 60 else 0 end as more from px),
p as (select concat('d', cast(vec_id % 10 as varchar)) as doc, vec_id // 10000 as n, abs((r + more) % 256 - r) as delta from q),
n as (select *, cast(dense_rank() over (partition by doc order by n) as int) as page from p)
select doc, page, count(*) filter (where (delta * 38470 + 32768) >> 16 > 12) as changed, count(*) as area, cast(max(delta) as int) as maximum_delta, true as same_size from n group by doc, page""")
def sc12(spark, d):
    root = image_folder(spark, d)
    found = images.Comparison(spark, f"{root}/before", f"{root}/after")
    heat = found.heatmaps().where("octet_length(heatmap) > 60").select("doc", "page")
    return found.pages.join(heat, ["doc", "page"]).select("doc", "page", "changed", "area", "maximum_delta", "same_size")
