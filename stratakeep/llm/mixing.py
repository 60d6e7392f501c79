"""Mixing sources to target weights by weighted fair queueing.

Sources are sized in words. Weights share the total size; a source takes at most ``MAX_EPOCHS``
times its size, and what it cannot take is shared anew by weight. Each document of a source stands
in a shuffled queue. Its virtual finish time is the source's words up to and including it, over
all earlier passes through the queue too, divided by the source's target. Served in order of finish
time, all sources advance at the same relative pace; the mix ends where the total budget is spent, but
for the next document of each source, which is rounded to the nearer side of the source's target.

Running sums never need one task for a source or for the whole queue: sums per bucket of the
queue (a hash range of a source, then a slice of virtual time) give each bucket's start, and only
a bucket is ever sorted. Places in the queue are written once; what the slices before the last one take
follows from a row alone, and only rows of the last slice and the next document of each source are joined back.
What one task sees together is BUCKETS sums of a source, 3 * SLICES sums of virtual time, one row a source,
or one slice, a SLICES-th of the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, durable, prefix_totals, table, unused

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Slices of virtual time, and shuffled queue buckets a source has at most; more only means smaller sorts.
SLICES = 1 << 14
BUCKETS = 1 << 14


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets from (source, source_size), one row a source: water-filling under a cap of ``epochs`` sizes.

    Weights repeat along the sources in code point order, null last. A source is capped if the
    share left after capping all sources with less room per weight would exceed its cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", w.cast("double")).withColumn("cap", epochs * F.col("source_size").cast("double"))
    t = t.withColumn("room", F.col("cap") / F.col("weight"))
    before = Window.orderBy("room", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("total", F.sum(F.col("source_size").cast("double")).over(everything)).withColumn("weights", F.sum("weight").over(everything))
    t = t.withColumn("cap0", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("w0", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("capped", F.col("room") <= (F.col("total") - F.col("cap0")) / (F.col("weights") - F.col("w0")))
    t = t.withColumn("capped_sum", F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything))
    t = t.withColumn("free_weight", F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(everything))
    share = (F.col("total") - F.col("capped_sum")) * F.col("weight") / F.col("free_weight")
    return t.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(share).alias("target"))


def mix_sources(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``source_size``, ``target`` and ``taken`` to rows of (doc_id, source, size, mark).

    ``mark`` (60 bits) shuffles the queue and, with the ids, breaks ties, so reruns agree; repeated rows are
    separate documents, null sources a source. Rows of size 0 take nothing; no rows give none. Other
    columns are not kept.
    """
    rows = durable(rows.select("doc_id", "source", "size", "mark").withColumn("row", F.monotonically_increasing_id()).withColumn("bucket", F.shiftrightunsigned("mark", 46).cast("int")), "mixing")
    sizes = durable(targets(rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), weights, epochs), "mixing-targets")
    goal = sizes.select(F.col("source").alias("_source"), "source_size", "target")
    cells = prefix_totals(rows.groupBy("source", "bucket").agg(F.sum("size").alias("n")), ["source"], "bucket", "n", "start").select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "start")
    inside_bucket = Window.partitionBy("source", "bucket").orderBy("mark", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("size").over(inside_bucket)).join(cells, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    # bounded by the number of sources, which may be large: Spark picks broadcast or merge join from its size
    placed = placed.join(goal, F.col("source").eqNullSafe(F.col("_source")))
    served = durable(placed.select("row", "doc_id", "source", "size", "mark", "source_size", "target", (F.col("upto") + F.col("start")).alias("upto")), "served")
    discard(rows)
    # a pass is entered only if it can begin before twice the budget is served: virtual time 1 is the budget
    passes = F.least(F.lit(epochs), F.ceil(F.col("target") / F.col("source_size")) + 1).cast("int")
    finish = lambda p: (p * F.col("source_size") + F.col("upto")) / F.col("target")
    time_slice = lambda t: F.floor(t * SLICES).cast("long")
    entry = served.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), passes - 1)))
    entry = entry.select("row", "source", "target", "size", "mark", finish(F.col("pass")).alias("finish")).withColumn("slice", time_slice(F.col("finish")))
    # the slices before the one in which the budget runs out are taken whole; only that one is sorted
    slices = entry.groupBy("slice").agg(F.sum("size").alias("n"))
    upto = slices.select("slice", F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    budget = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("b")).first()["b"]
    cut = upto.where(F.col("before") <= budget).agg(F.max("slice").alias("at"), F.max("before").alias("before")).first()
    at, before = (cut["at"], cut["before"]) if cut["at"] is not None else (0, 0)
    last = entry.where(F.col("slice") == at).withColumn("total", F.sum("size").over(Window.orderBy("finish", "mark", "row").rowsBetween(Window.unboundedPreceding, 0)) + before)
    last = durable(last, "last-slice")
    # the first document of each source beyond the cut is served too if its source ends nearer its target
    beyond = entry.where(F.col("slice") > at).unionByName(last.where(F.col("total") > budget).drop("total"))
    first = beyond.groupBy("source").agg(F.min_by(F.struct("row", "size", "target", "finish"), F.struct("finish", "mark", "row")).alias("x")).select("x.*")
    nearer = first.where(F.col("target") * (F.lit(1.0) - F.col("finish")) > -F.col("size") / 2)
    extra = last.where(F.col("total") <= budget).select("row", "size").union(nearer.select("row", "size")).groupBy("row").agg(F.sum("size").cast("long").alias("extra")).withColumnRenamed("row", "_row")
    whole = sum((F.when((F.col("size") > 0) & (passes > p) & (time_slice(finish(F.lit(p))) < at), F.col("size")).otherwise(0) for p in range(epochs)), F.lit(0))
    out = served.join(extra, F.col("row") == F.col("_row"), "left")
    return out.select("doc_id", "source", "size", "mark", "source_size", "target", (whole + F.coalesce("extra", F.lit(0))).cast("long").alias("taken"))


def queue_mark(doc_id: Column, text: Column) -> Column:
    """60 bits that shuffle a source's queue."""
    name = F.concat(F.lit("queue "), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(" "), F.md5(F.encode(text, "UTF-8")))
    return F.conv(F.substring(F.md5(F.encode(name, "UTF-8")), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, mark) of documents; null text has size 0, null source is a source."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), queue_mark(F.col("doc_id").cast("long"), text).alias("mark"))


def cuts(mixed: DataFrame) -> DataFrame:
    """(source, least, last) of a mix: where each source's queue is cut, one row a source.

    All rows of a source with words are taken ``last.times`` times up to the place (mark, doc_id) of ``last`` in its
    queue, and ``least`` times behind it, as a source goes through its queue in order.
    """
    times = F.floor(F.col("taken") / F.col("size")).cast("int")
    rows = mixed.where("size > 0").withColumn("times", times)
    return rows.groupBy("source").agg(F.min("times").alias("least"), F.max(F.struct("times", "mark", "doc_id")).alias("last"))


def times_taken(rows: DataFrame, number: str, mixed: DataFrame, name: str) -> DataFrame:
    """``rows`` (source, text, and ``number``, unique) that a mix of them takes, with the times as column ``name``.

    A row's times follow from its own place and its source's cut, so no text is shuffled; the cuts are one row a
    source. Null texts and those without words are not taken.
    """
    mark, key, least, last = unused(rows, "mark", "of", "least", "last")
    cut = durable(cuts(mixed), "cuts").select(F.col("source").alias(key), F.col("least").alias(least), F.col("last").alias(last))
    text = F.coalesce(F.col("text"), F.lit("")).cast("string")
    placed = rows.where(F.regexp_like(text, F.lit(WORD))).withColumn(mark, queue_mark(F.col(number), text)).join(cut, F.col("source").cast("string").eqNullSafe(F.col(key)))
    before = (F.col(mark) < F.col(f"{last}.mark")) | ((F.col(mark) == F.col(f"{last}.mark")) & (F.col(number) <= F.col(f"{last}.doc_id")))
    return placed.withColumn(name, F.when(before, F.col(f"{last}.times")).otherwise(F.col(least))).where(F.col(name) > 0).select(*rows.columns, name)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
with s as (
  select row_number() over () as r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || substr(md5('queue ' || coalesce(doc_id::varchar, '') || ' ' || md5(coalesce(text, ''))), 1, 15))::bigint as mark from documents
), z as (
  select source, sum(size)::bigint as source_size from s group by source
), a as (
  select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight, 3 * source_size::double as cap from z
), b as (
  select *, cap / weight as room, sum(source_size::double) over () as total, sum(weight) over () as weights from a
), c as (
  select *, room <= (total - coalesce(sum(cap) over w, 0)) / (weights - coalesce(sum(weight) over w, 0)) as capped from b
  window w as (order by room, source nulls last rows between unbounded preceding and 1 preceding)
), g as (
  select source, source_size, case when capped then cap else (total - sum(case when capped then cap else 0 end) over ()) * weight / sum(case when capped then 0 else weight end) over () end as target from c
), q as (
  select s.*, source_size, target, sum(size) over (partition by s.source order by mark, doc_id, size, r rows unbounded preceding)::bigint as upto from s join g on s.source is not distinct from g.source
), e as (
  select *, (p * source_size + upto) / target as finish from q, (select unnest(range(0, 3)) as p) where size > 0 and p < least(3, ceil(target / source_size) + 1)
), f as (
  select *, sum(size) over (order by finish, mark, r rows unbounded preceding) <= (select sum(size) from s) as inside from e
), n as (
  select r, size from (select *, row_number() over (partition by source order by finish, mark, r) as k from f where not inside) where k = 1 and target * (1.0::double - finish) > -size / 2
), t as (
  select r, sum(size)::bigint as taken from (select r, size from f where inside union all select * from n) group by r
)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken from q left join t using (r)
"""
