"""Input relations built from the star-schema tables, as SQL that Spark and DuckDB both run.

The tables hold no formulas, so these views write some into their rows.  Backslashes and dollars come from chr(), as the two
engines read them differently in literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

B, D, N = "chr(92)", "chr(36)", "chr(10)"


def _tex(*parts: str) -> str:
    """concat() of parts; in a part, ~ is a backslash, ` a dollar, | a newline, and {{...}} a SQL expression."""
    out = []
    for part in parts:
        if part.startswith("="):
            out.append(f"cast({part[1:]} as string)")
            continue
        piece = ""
        for c in part:
            if c in "~`|":
                if piece:
                    out.append(f"'{piece}'")
                out.append({"~": B, "`": D, "|": N}[c])
                piece = ""
            else:
                piece += c
        if piece:
            out.append(f"'{piece}'")
    return f"concat({', '.join(out)})"


def _when(condition: str, *parts: str) -> str:
    return f"case when {condition} then {_tex(*parts)} else '' end"


VIEWS = {
    # LaTeX sources: 20 projects, the smallest document of each is its main file
    "units": f"""
select concat('p', cast(doc_id % 20 as string)) as project, doc_id as seq, doc_id < 20 as is_main,
  concat('u', cast(doc_id as string), '.tex') as file,
  concat(text,
    {_tex("|Eq `x=~frac", "=doc_id % 9 + 1", "=n_chars % 9 + 1", "` ~cite[see]{k", "=doc_id % 97", ",|  k", "=n_chars % 131", ",", "=chr(9)", "} ~label{eq:", "=doc_id % 700", " } ~ref{|", "=chr(9)", "eq:", "=doc_id % 900", "}")},
    {_when("doc_id % 5 = 0", "| متن ~settextfont{V}")}, {_when("doc_id % 10 = 0", "|~usepackage{xepersian}")},
    {_when("doc_id % 6 = 0", "|~begin{align} a ~end{align} ~includegraphics{f}")}, {_when("doc_id % 4 = 1", "|~mathbb R")},
    {_when("doc_id % 3 = 0", "|~usepackage[x]{amsmath,amssymb}")}, {_when("doc_id % 8 = 0", "|~begin{tabular} a ~end{longtable}")},
    {_when("doc_id % 7 = 0", "|~begin{longtable}")}, {_when("doc_id % 9 = 0", "| {open")}, {_when("doc_id % 15 = 0", "|~begin{latin} abc")},
    {_when("doc_id % 11 = 2", "|`y=~frac~alpha~beta` and `z= frac", "=doc_id % 10", "x`")}, {_when("doc_id % 13 = 1", "|~eqref{eq:", "=doc_id % 50", "}~autoref{fig}")}) as text
from documents""",
    "bib": "select concat('p', cast(p_partkey % 20 as string)) as project, concat('k', cast(p_partkey % 89 as string)) as key from part",
    # include graph: a tree by thirds, with missing targets, cycles and shorter ways to some
    "edges": """
select 'd0' as project, cast(floor((doc_id - 1) / 3) as bigint) as src,
  case when doc_id % 17 = 3 then doc_id + 100000000 when doc_id % 29 = 5 then 0 else doc_id end as dst, doc_id as line
from documents where doc_id > 0
union all select 'd0', cast(floor(doc_id / 7) as bigint), doc_id, -doc_id from documents where doc_id % 4 = 1""",
    "paragraphs": f"""
select concat('doc', cast(p_partkey % 50 as string)) as doc, 'word/document.xml' as part, p_partkey as para,
  case cast(p_partkey % 13 as int)
    when 0 then {_tex("The value `x_i = ", "=p_size", "` and `y` hold for ")} || p_name
    when 1 then {_tex("``E = m c^", "=p_size", "``")}
    when 2 then {_tex("x = y + ", "=p_partkey")}
    when 3 then p_name
    when 4 then 'σ² = √(x) ≤ ∑ xᵢ'
    when 5 then {_tex("  ~frac{a}{b} + ~alpha = ", "=p_size")}
    when 6 then 'این یک جمله فارسی است و چیز دیگری نیست'
    when 7 then {_tex("text ``a ~alpha b ``0.5, ", "=p_size", "]``")}
    when 8 then {_tex("see ~begin{cases} a & b ~end{cases} + ~sqrt{", "=p_size", "}")}
    when 9 then {_tex("~[ x_", "=p_size", " ~] then ~( y ~) and z")}
    when 10 then {_tex("odd `x = ~frac{1}{2} + ", "=p_partkey")}
    when 11 then '   '
    else {_tex("~begin{} a & b = ~alpha ~end{} + ", "=p_size")} end as text
from part""",
    "formulas": f"""
select p_partkey as id, p_partkey % 3 = 0 as plain_math,
  case cast(p_partkey % 10 as int)
    when 0 then {_tex("`~frac{a}{", "=p_size", "`")}
    when 1 then {_tex("``a}b{", "=p_size", "``")}
    when 2 then {_tex("~[ E[x = E[y] ~]")}
    when 3 then 'σ² ≤ √(ab) + x₁₂ × ∞'
    when 4 then {_tex("~begin{} a & ~text{if} ~end{}  **b**")}
    when 5 then {_tex("~begin{} ", "=p_size", " ~end{}")}
    when 6 then {_tex("(a + b]) * c", "=p_size")}
    when 7 then {_tex("}} {x")}
    when 8 then {_tex("[0, ", "=p_size", ")")}
    else p_name end as source
from part""",
    # package entries before and after a change
    "entries": """
select concat('pkg', cast(l_orderkey % 500 as string)) as doc, side, concat('word/', cast(l_linenumber as string), '_', cast(l_orderkey as string), case when l_linenumber = 1 then '.rels' else '.xml' end) as name,
  case when side = 'after' and l_partkey % 50 = 0 then l_partkey + 1 else l_partkey end as crc,
  cast(l_quantity * 1000 as bigint) as size, cast(l_quantity * 10 as bigint) + 1 as csize, cast(case when l_suppkey % 97 = 0 then 1 else 0 end as int) as flags,
  l_linenumber = 2 as modified
from lineitem cross join (select 'before' as side union all select 'after' as side) s
where not (side = 'after' and l_orderkey % 31 = 0 and l_linenumber = 3)""",
    # pixels of page rasters: a page for each vector, 8 x 8; after: some changed, some wider
    "pixels": """
select side, vec_id as page, cast(i % 8 as int) as x, cast(floor(i / 8) as int) as y,
  cast(abs(floor(v * 100)) % 256 as int) as r, cast((abs(floor(v * 100)) + case when side = 'after' and vec_id % 7 = 0 and i % 5 = 0 then 60 else 0 end) % 256 as int) as g, cast(i as int) as b
from pixel_values cross join (select 'before' as side union all select 'after' as side) s
where not (side = 'after' and vec_id % 41 = 0) and not (side = 'before' and vec_id % 43 = 0) and not (side = 'before' and vec_id % 11 = 0 and i % 8 = 7)""",
    "logs": f"""
select concat('p', cast(event_id % 40 as string)) as project, event_id as seq,
  case cast(event_id % 9 as int)
    when 0 then concat('(./ch', cast(user_id % 7 as string), '.tex')
    when 1 then ')'
    when 2 then concat('main.tex:', cast(user_id % 60 as string), ': Missing }} inserted ', event_type)
    when 3 then concat('LaTeX Warning: Reference ', chr(96), 'eq:', cast(user_id % 30 as string), ''' on page 1 undefined on input line ', cast(event_id % 300 as string), '.')
    when 4 then concat('LaTeX Font Warning:  Size   ', cast(user_id % 5 as string), ' not available')
    when 5 then concat('! Undefined control sequence.', {N}, 'l.', cast(event_id % 400 as string), ' ', {B}, 'foo')
    when 6 then concat('(ch', cast(user_id % 7 as string), '.sty)')
    else event_type end as text
from events""".replace("}}", "}"),
    "reviews": "select doc_id, quality = 1 as enabled, case when toxic = 1 then concat('edited ', cast(doc_id as string)) when doc_id % 11 = 0 then '  ' else '' end as override from labels",
}

TABLES = {"units": ["documents"], "bib": ["part"], "edges": ["documents"], "paragraphs": ["part"], "formulas": ["part"], "entries": ["lineitem"], "pixels": ["embeddings"], "logs": ["events"], "reviews": ["labels"]}
SPARK_PIXELS = "select vec_id, i, cast(v as double) as v from embeddings lateral view posexplode(embedding) e as i, v"
DUCK_PIXELS = "select vec_id, cast(i - 1 as bigint) as i, cast(embedding[i] as double) as v from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings) e"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The relation in Spark."""
    sql = VIEWS[name]
    for t in TABLES[name]:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"gm_{t}")
    for t in TABLES[name]:
        sql = sql.replace(f"from {t}", f"from gm_{t}")
    return spark.sql(sql.replace("from pixel_values", f"from ({SPARK_PIXELS.replace('from embeddings', 'from gm_embeddings')}) pv"))


def duck(*names: str) -> str:
    """WITH clause of the relations for DuckDB."""
    return "with recursive " + ", ".join(f"{n} as ({VIEWS[n].replace('from pixel_values', f'from ({DUCK_PIXELS}) pv')})" for n in names)
