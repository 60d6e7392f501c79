"""URL filtering by a path-template tree.

Explicit rules come first. All other urls are judged by what the rules say about their
neighbours: urls that a rule fits are the labelled ones. In a path, runs of digits and long hexadecimal
ids become wildcards, which gives its shape; urls are counted by host and shape, and only these counts go
on. Each host has a tree of the segments of its shapes. Going down, a child with little support becomes
``*``; so does a labelled child whose share of blocked urls among its labelled ones is not statistically
different, by Hoeffding's bound, from that of its labelled siblings, which merges similar branches.
Branches without labels are not merged with others, as nothing says that they are alike. A branch that
only one shape goes down is a template. So is each of the others at its end; its purity is the blocked
share of its labelled urls, smoothed towards PRIOR, so that a template without labels is allowed;
a template with a purity over one half is rejected.

Every step is an aggregation over shapes; nodes of any size are aggregated before they are shuffled
and joined back.
"""

from __future__ import annotations

from math import log, sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, durable, table

RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
SUPPORT, SHARE = 3, 0.01
CONFIDENCE = 0.05
BOUND = sqrt(0.5 * log(2 / CONFIDENCE))
SMOOTHING = 4.0
PRIOR = 0.3
_ID = "[0-9a-fA-F]{16,}|[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(`_url`, instr(`_url`, '://') + 3)")).otherwise("")
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, upper.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def first_rule(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    found = F.lit(None)
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the last ``when`` wins
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def shape_of(path: Column) -> Column:
    """The path with its numbers and ids as wildcards, without its first slash."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, _ID, "{id}"), "[0-9]+", "{n}"), "^/", "")


def templates(shapes: DataFrame) -> DataFrame:
    """(host, shape, template, purity) from (host, shape, n, blocked, labelled), one row a shape of a host.

    The tree is walked down a level at a time, until no node has two shapes and a further segment;
    there is no greatest depth.
    """
    keys, counts = ["host", "template"], ["n", "blocked", "labelled"]
    nodes = shapes.withColumn("seg", F.split("shape", "/")).withColumn("template", F.lit("")).withColumn("ended", F.lit(False))
    nodes, level = durable(nodes, "url-nodes"), 0
    while True:
        live = nodes.where(~F.col("ended")).withColumn("child", F.get("seg", level))
        kids = live.groupBy(*keys, "child").agg(*[F.sum(c).alias(f"c_{c}") for c in counts], F.count("*").alias("c_shapes"))
        above = kids.groupBy(*keys).agg(*[F.sum(f"c_{c}").alias(f"p_{c}") for c in counts], F.sum("c_shapes").alias("p_shapes"))
        above = above.select(F.col("host").alias("_h"), F.col("template").alias("_t"), *[f"p_{c}" for c in counts], "p_shapes")
        kids = kids.join(above, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")))
        rest, rest_blocked = F.col("p_labelled") - F.col("c_labelled"), F.col("p_blocked") - F.col("c_blocked")
        gap = F.abs(F.col("c_blocked") / F.col("c_labelled") - rest_blocked / rest)
        alike = F.when((F.col("c_labelled") > 0) & (rest > 0), gap <= BOUND * (1 / F.sqrt("c_labelled") + 1 / F.sqrt(rest))).otherwise(False)
        literal = (F.col("c_n") >= F.greatest(F.lit(SUPPORT), SHARE * F.col("p_n"))) & ~alike
        # a node of one shape ends here, with all that is left of the shape
        names = kids.select(F.col("host").alias("_h"), F.col("template").alias("_t"), F.col("child").alias("_c"), F.when(literal, F.col("child")).otherwise("*").alias("name"), (F.col("p_shapes") == 1).alias("alone"))
        joined = live.join(names, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")) & (F.col("child") == F.col("_c")))
        tail = F.array_join(F.slice("seg", level + 1, F.greatest(F.size("seg") - level, F.lit(1))), "/")
        joined = joined.withColumn("template", F.concat("template", F.lit("/"), F.when(F.col("alone"), tail).otherwise(F.col("name"))))
        joined = joined.withColumn("ended", F.col("alone") | (F.size("seg") <= level + 1))
        now = durable(nodes.where("ended").union(joined.select(*nodes.columns)), "url-nodes")
        discard(nodes)
        nodes, level = now, level + 1
        if not nodes.where("not ended").take(1):
            break
    sums = nodes.groupBy(*keys).agg(((F.sum("blocked") + SMOOTHING * PRIOR) / (F.sum("labelled") + SMOOTHING)).alias("purity"))
    sums = sums.select(F.col("host").alias("_h"), F.col("template").alias("_t"), "purity")
    return nodes.join(sums, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t"))).select("host", "shape", "template", "purity")


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for each row of (page_id, url).

    A null url or one without ``://`` has an empty host and path, and is judged by the template of
    that empty host. Repeated rows and null ids are judged alike, very long urls whole, however many
    segments they have. No rows give none. Other columns are not read.
    """
    host, path = split_url(F.col("_url"))
    seen = pages.select("page_id", F.col("url").cast("string").alias("_url")).select("page_id", host.alias("host"), path.alias("path"))
    seen = durable(seen.withColumn("shape", shape_of(F.col("path"))).withColumn("hit", first_rule(F.col("host"), F.col("path"), rules)), "urls")
    verdict = F.col("hit.verdict")
    shapes = seen.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count(F.when(verdict == "block", 1)).alias("blocked"), F.count("hit").alias("labelled"))
    judged = durable(templates(shapes), "templates").select(F.col("host").alias("_h"), F.col("shape").alias("_s"), "template", "purity")
    out = seen.join(judged, (F.col("host") == F.col("_h")) & (F.col("shape") == F.col("_s")))
    method = F.when(F.col("purity") > 0.5, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(verdict, method).alias("verdict"), "template", "purity")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def _oracle(levels: int = 12) -> str:
    """SQL for urls of at most so many segments; each level of the tree is a query over the one above."""
    fits = lambda rule: (lambda name, rest: f"(host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '/{rest}')")(*rule.split("/", 1))
    longest = sorted(RULES, key=lambda r: -len(r[0]))
    case = lambda k: "case " + " ".join(f"when {fits(r[0])} then '{r[k]}'" for r in longest) + " end"
    steps = ["nodes0 as (select host, shape, n, blocked, labelled, string_split(shape, '/') as seg, '' as template, false as ended from shapes)"]
    for k in range(levels):
        steps.append(
            f"""kids{k} as (
  select host, template, seg[{k + 1}] as child, sum(n) as c_n, sum(blocked) as c_b, sum(labelled) as c_l, count(*) as c_s from nodes{k} where not ended group by all
), sums{k} as (
  select *, sum(c_n) over w as p_n, (sum(c_b) over w) - c_b as r_b, (sum(c_l) over w) - c_l as r_l, sum(c_s) over w as p_s from kids{k} window w as (partition by host, template)
), names{k} as (
  select host, template, child, p_s = 1 as alone, case when c_n >= greatest({SUPPORT}, {SHARE} * p_n) and not (c_l > 0 and r_l > 0
    and abs(c_b / nullif(c_l, 0) - r_b / nullif(r_l, 0)) <= {BOUND!r} * (1 / sqrt(nullif(c_l, 0)) + 1 / sqrt(nullif(r_l, 0)))) is true then child else '*' end as name from sums{k}
), nodes{k + 1} as (
  select * from nodes{k} where ended
  union all
  select d.host, shape, n, blocked, labelled, seg, d.template || '/' || case when alone then array_to_string(list_slice(seg, {k + 1}, len(seg)), '/') else name end, alone or len(seg) <= {k + 1}
  from nodes{k} d join names{k} m on m.host = d.host and m.template = d.template and m.child = seg[{k + 1}] where not ended
)"""
        )
    upper = "".join(map(chr, range(65, 91)))
    return f"""
with cut as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), split as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{upper.lower()}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut
), seen as (
  select *, regexp_replace(regexp_replace(regexp_replace(path, '{_ID}', '{{id}}', 'g'), '[0-9]+', '{{n}}', 'g'), '^/', '') as shape, {case(0)} as rule, {case(1)} as said from split
), shapes as (
  select host, shape, count(*) as n, count(case when said = 'block' then 1 end) as blocked, count(said) as labelled from seen group by all
), {", ".join(steps)}, judged as (
  select host, shape, template, (sum(blocked) over w + {SMOOTHING * PRIOR!r}::double) / (sum(labelled) over w + {SMOOTHING!r}::double) as purity from nodes{levels} window w as (partition by host, template)
)
select page_id, s.host, path, rule, coalesce(said, case when purity > 0.5 then 'block' else 'allow' end) as verdict, template, purity from seen s join judged j on j.host = s.host and j.shape = s.shape
"""


ORACLE = _oracle()
