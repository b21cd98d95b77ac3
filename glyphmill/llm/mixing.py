"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

``targets``: sources by code point, null last, weigh 5, 2, 1, repeating; they share all words by weight, none above 3 times
its own; what exceeds that is shared again.  Complete epochs come first: every document floor(target / source size) times.
The rest of a target is filled in the order of exponential keys -ln(u) / quality weight; u comes from the md5 of seed,
id and text, so reruns agree.  The document at the budget is taken up to the budget.

No source is sorted as a whole: keys are counted in ``BINS`` ranges, which show the range in which a source's budget ends;
that range is counted again in as many until its rows are at most ``most_rows``, and only those are sorted.  The result is a
threshold for each source, so texts are neither sorted nor joined with documents.

Null texts have size 0 and are taken 0 times.  Repeated rows are one group; where the budget ends in such a group its rows
share what is left equally, rounded down.  An empty table gives no rows.  Rows may have any other columns: ``repeated`` keeps
all of them as they are, under whatever names; ``mixed`` reads doc_id, text and source alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import cut, table

#: Fixed values.
WORD, CUTS = r"[^\x20\x09-\x0D]+", (5.0, 2.0, 1.0)
MOST_TIMES, BINS = 3, 1024
#: Sources up to which the table of thresholds is broadcast.
SMALL = 200_000


def measured(docs: DataFrame, seed: int = 1) -> DataFrame:
    """docs with _size, _digest, _key and _pos: where the key stands in [0, 1)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    symbols = F.coalesce(F.regexp_count("text", F.lit(r"[#*$%&|<>!]")), F.lit(0))
    weight = F.greatest(F.lit(0.05), 1 - 2 * symbols / F.greatest(F.length("text"), F.lit(1)))
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")), F.lit(":"), F.coalesce("text", F.lit("")))
    digest = F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")  # 60 bits
    u = (digest + F.lit(0.5)) / F.lit(float(1 << 60))
    out = docs.withColumn("_size", size).withColumn("_digest", digest)
    out = out.withColumn("_key", -F.log(u) / F.coalesce(weight, F.lit(1.0)))
    return out.withColumn("_pos", F.col("_key") / (1 + F.col("_key")))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> with target double; a row for each source.  Windows run over sources, never over documents."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, CUTS)), F.pmod(F.col("rank") - 1, F.lit(3)) + 1)
    ranked = ranked.withColumn("w", weight).withColumn("cap", (MOST_TIMES * F.col("source_size")).cast("double")).withColumn("r", F.col("cap") / F.col("w"))
    before = Window.orderBy("r", "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    filled = ranked.withColumn("level", level)
    water = F.min(F.when(F.col("level") <= F.col("r"), F.struct("r", "rank", "level"))).over(everything)
    return filled.withColumn("water", water["level"]).select("source", "source_size", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("w") * F.col("water"), F.col("cap"))).alias("target"))


def _by_source(left: DataFrame, right: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """Joins on source, null with null; right has a row for each source."""
    other = right.withColumnRenamed("source", "_source")
    return left.join(F.broadcast(other) if small else other, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def thresholds(docs: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """measured docs -> (source, source_size, target, epochs, end_key, end_digest, part): a document is taken `epochs` times, once
    more if its key comes before the end, and `part` words more if it is the end."""
    rows = cut(docs.groupBy("source", "_digest", "_key", "_pos", "_size").agg(F.count("*").alias("m")))
    sizes = rows.groupBy("source").agg(F.coalesce(F.sum(F.col("_size") * F.col("m")), F.lit(0)).alias("source_size"))
    goals = targets(sizes)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = goals.withColumn("epochs", epochs).withColumn("budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    goals = cut(goals.withColumns({"low": F.lit(0.0), "wide": F.lit(1.0), "before": F.lit(0).cast("long")}))
    small = goals.count() <= SMALL
    for _ in range(6):
        within = _by_source(rows, goals.where("budget > 0").select("source", "low", "wide"), small)
        bin_of = F.floor((F.col("_pos") - F.col("low")) / F.col("wide") * BINS)
        bins = within.withColumn("bin", bin_of).where(f"bin >= 0 and bin < {BINS}").groupBy("source", "bin").agg(F.sum(F.col("_size") * F.col("m")).alias("words"), F.count("*").alias("n"))
        bins = _by_source(bins, goals.select("source", "before", "budget"), small)
        prefix = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
        last = bins.withColumn("upto", prefix).where("upto >= budget").groupBy("source").agg(F.min(F.struct("bin", "upto", "words", "n")).alias("b"))
        found = F.col("b.bin").isNotNull()
        moved = _by_source(goals, last, small, "left")
        goals = cut(moved.select("source", "source_size", "target", "epochs", "budget", F.when(found, F.col("low") + F.col("b.bin") * F.col("wide") / BINS).otherwise(F.col("low")).alias("low"), F.when(found, F.col("wide") / BINS).otherwise(F.col("wide")).alias("wide"), F.when(found, F.col("b.upto") - F.col("b.words")).otherwise(F.col("before")).alias("before"), F.coalesce("b.n", F.lit(0)).alias("n")))
        if (goals.agg(F.max("n")).first()[0] or 0) <= most_rows:
            break
    # low and wide are multiples of powers of BINS, a power of two, so these differences and quotients are exact
    near = _by_source(rows, goals.where("budget > 0").select("source", "low", "wide", "before", "budget"), small).where(F.floor((F.col("_pos") - F.col("low")) / F.col("wide")) == 0)
    order = Window.partitionBy("source").orderBy("_key", "_digest")
    near = near.withColumn("upto", F.col("before") + F.sum(F.col("_size") * F.col("m")).over(order)).where("upto >= budget")
    end = near.groupBy("source").agg(F.min(F.struct("_key", "_digest", "upto", "_size", "m", "budget")).alias("e"))
    end = end.select("source", F.col("e._key").alias("end_key"), F.col("e._digest").alias("end_digest"), F.floor((F.col("e.budget") - (F.col("e.upto") - F.col("e._size") * F.col("e.m"))) / F.col("e.m")).cast("long").alias("part"))
    return cut(_by_source(goals.select("source", "source_size", "target", "epochs"), end, small, "left"))


def _more() -> Column:
    """Words of the fractional part."""
    key, end = F.struct("_key", "_digest"), F.struct(F.col("end_key").alias("_key"), F.col("end_digest").alias("_digest"))
    return F.when(F.col("end_key").isNull(), F.lit(0)).when(key < end, F.col("_size")).when(key == end, F.col("part")).otherwise(F.lit(0)).cast("long")


def _taken(docs: DataFrame, seed: int) -> DataFrame:
    """docs (doc_id, text, source, perhaps row) with _size, source_size, target, epochs, _taken."""
    sized = measured(docs, seed)
    ends = thresholds(sized.select("source", "_digest", "_key", "_pos", "_size"))
    return _by_source(sized, ends, ends.count() <= SMALL).withColumn("_taken", F.col("epochs") * F.col("_size") + _more())


def mixed(docs: DataFrame, seed: int = 1) -> DataFrame:
    """docs (doc_id, text, source) -> (doc_id, text, source, size, source_size, target, epochs, taken); a row for each row."""
    out = _taken(docs.select("doc_id", "text", "source"), seed)
    return out.select("doc_id", "text", "source", F.col("_size").alias("size"), "source_size", "target", "epochs", F.col("_taken").alias("taken"))


def repeated(docs: DataFrame, seed: int = 1, counted: str | None = None) -> DataFrame:
    """The mix: documents as often as they are taken, all columns; the copy at a source's budget ends at the budget.  counted: a column for the text's length."""
    own = docs.select("doc_id", "text", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = _taken(own, seed).where("_taken > 0").withColumn("_copies", F.ceil(F.col("_taken") / F.col("_size")).cast("int"))
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    rest = F.col("_taken") - (F.col("_copy") - 1) * F.col("_size")
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(rest >= F.col("_size"), F.col("text")).otherwise(F.array_join(F.slice(pieces, F.lit(1), rest.cast("int")), ""))
    rows = rows.withColumn("text", text)
    new = {"text": F.col("text")} | ({counted: F.length("text").cast("long")} if counted else {})
    return rows.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", "taken", "epochs")


ORACLE_SQL = {
    "op4_source_mix": r"""
with d as (select cast(doc_id as bigint) as doc_id, source, coalesce(text, '') as t from documents),
k as (select *, cast(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) as bigint) as size,
             cast('0x' || substr(md5(concat('1:', coalesce(cast(doc_id as varchar), 'null'), ':', t)), 1, 15) as bigint) as digest,
             greatest(0.05, 1 - 2 * len(regexp_extract_all(t, '[#*$%&|<>!]')) / greatest(len(t), 1)) as worth from d),
keyed as (select *, -ln((digest + 0.5) / 1152921504606846976.0) / worth as key from k),
sizes as (select source, cast(sum(size) as bigint) as source_size from keyed group by source),
ranked as (select *, row_number() over (order by source nulls last) as place from sizes),
capped as (select *, [5.0, 2.0, 1.0][((place - 1) % 3) + 1]::double as w, cast(3 * source_size as double) as cap from ranked),
filled as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, place rows between unbounded preceding and 1 preceding), 0))
                     / (sum(w) over () - coalesce(sum(w) over (order by cap / w, place rows between unbounded preceding and 1 preceding), 0)) as level from capped),
water as (select arg_min(level, (cap / w, place)) as level from filled where level <= cap / w),
goals as (select source, source_size, case when water.level is null then cap else least(w * water.level, cap) end as target from filled, water),
parts as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as epochs from goals),
budgets as (select *, cast(floor(target - epochs * source_size) as bigint) as budget from parts),
groups as (select source, key, digest, size, count(*) as m from keyed group by source, key, digest, size),
run as (select g.*, b.budget, sum(g.size * g.m) over (partition by g.source order by g.key, g.digest) as upto
        from groups g join budgets b on g.source is not distinct from b.source where b.budget > 0),
ends as (select source, arg_min((key, digest, cast(floor((budget - (upto - size * m)) / m) as bigint)), (key, digest)) as e from run where upto >= budget group by source)
select r.doc_id, r.size, b.source_size, b.target, b.epochs,
       cast(b.epochs * r.size + case when e.e is null then 0 when (r.key, r.digest) < (e.e[1], e.e[2]) then r.size when (r.key, r.digest) = (e.e[1], e.e[2]) then e.e[3] else 0 end as bigint) as taken
from keyed r join budgets b on r.source is not distinct from b.source left join ends e on r.source is not distinct from e.source
"""
}
