"""Mix sources to target weights: random keys, prefix sums of words, a cut at each source's budget."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ranked, stored, table
from .registry import query

WEIGHTS, MOST, SEED = (5, 2, 1), 3, "mix-1"
#: Rows of a source that one task sorts to find the cut, about.
SLICE_ROWS = 50_000


def words_in(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def random_key(seed: str = SEED) -> Column:
    """32 hex digits that depend on the seed, the id and the text only, so reruns agree."""
    own = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return F.md5(own.cast("binary"))


def _targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """``sources(source, source_size, weight)`` with ``target``: shares by weight of all words, none above
    ``most`` times its source; what is over is shared again by weight until nothing is."""
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    total, held = total or 0, 0
    limit = (F.col("source_size") * most).cast("double")
    while True:
        share = F.col("weight") * F.lit(float(total - held)) / F.lit(float(weight or 1))
        over = (share > limit) if held == 0 else (share > limit) | capped
        now, left = sources.agg(F.coalesce(F.sum(F.when(over, F.col("source_size") * most)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if now == held or not left:
            return sources.withColumn("target", F.when(over, limit).otherwise(share))
        held, weight, capped = now, left, over


def plan_mix(light: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """For each source of ``light(source, size, key)``: source_size, target and where the mix stops.

    ``epochs`` whole passes are taken, then documents in key order while the remaining budget lasts:
    all rows below ``cut_key`` whole, and ``part`` of the ``tie_size`` words at that key. Keys are hash
    values, so a source's key range cuts into slices of equal depth without sampling: slices are summed,
    the sums are prefix-summed by source, and only the slice that holds the cut is sorted, in a task of
    its own. A source with a third of all rows is as many slices as its size asks for.
    """
    per = light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    per = ranked(per, [F.col("source").asc_nulls_last()], "mix-sources")
    per = stored(per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int") + 1)), "mix-weights")
    goal = _targets(per, weights, most)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    goal = stored(goal.select("source", "source_size", "target", "epochs", "rest"), "mix-goals")

    most_rows = per.agg(F.max("rows")).first()[0] or 1
    digits = max(1, math.ceil(math.log(max(1, most_rows / SLICE_ROWS), 16)))
    sliced = light.withColumn("slice", F.substring("key", 1, digits))
    sums = stored(sliced.groupBy("source", "slice").agg(F.sum("size").alias("words")), "mix-slices")
    earlier = (Window.unboundedPreceding, -1)
    upto = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("slice").rowsBetween(*earlier)), F.lit(0))
    cut = _meet(sums.withColumn("before", upto), goal).where("before <= rest AND rest < before + words")
    cut = stored(cut.select("source", "slice", "before", "rest"), "mix-cut-slices")
    near = sliced.join(cut.withColumnRenamed("source", "s").withColumnRenamed("slice", "sl"), F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("sl")))
    near = near.groupBy("source", "key", "before", "rest").agg(F.sum("size").alias("tie_size"))
    inside = F.coalesce(F.sum("tie_size").over(Window.partitionBy("source").orderBy("key").rowsBetween(*earlier)), F.lit(0))
    near = near.withColumn("begun", F.col("before") + inside).where("begun <= rest AND rest < begun + tie_size")
    near = near.select(F.col("source").alias("s"), F.col("key").alias("cut_key"), (F.col("rest") - F.col("begun")).alias("part"), "tie_size")
    out = goal.join(near, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "rest")
    return stored(out, "mix-plan")


def _meet(left: DataFrame, per_source: DataFrame) -> DataFrame:
    """Join on ``source``, null matching null; one row a source on the right."""
    right = per_source.withColumnRenamed("source", "__source")
    return left.join(right, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def mixed(light: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of ``light`` with ``taken``: the words the mix takes from each, repeats counted.

    The sum over a source is its budget exactly when the keys at the cut differ; rows that are equal in id
    and text share a key and split the part between them, rounded down.
    """
    at_cut = F.coalesce(F.col("key") == F.col("cut_key"), F.lit(False))
    part = F.floor(F.col("part") * F.col("size") / F.col("tie_size")).cast("long")
    last = F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(at_cut, part).otherwise(0)
    return _meet(light, plan).withColumn("taken", (F.col("epochs") * F.col("size") + last).cast("long"))


SQL = rf"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
  md5(concat('{SEED}|', coalesce(CAST(doc_id AS VARCHAR), ''), '|', md5(coalesce(text, '')))) AS key FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM p),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k FROM w),
c AS (SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
  coalesce(sum(weight) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone,
  sum(source_size) OVER () AS total, sum(weight) OVER () AS all_w FROM o),
m AS (SELECT *, CAST(weight AS DOUBLE) * CAST(total - held AS DOUBLE) / CAST(all_w - gone AS DOUBLE) > 3 * source_size AS capped FROM c),
f AS (SELECT coalesce(sum(3 * source_size) FILTER (WHERE capped), 0) AS held, sum(weight) FILTER (WHERE NOT capped) AS weight FROM m),
t AS (SELECT m.source, m.source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
  ELSE CAST(m.weight AS DOUBLE) * CAST(total - f.held AS DOUBLE) / CAST(f.weight AS DOUBLE) END AS target FROM m, f),
b AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b),
g AS (SELECT source, key, sum(size) AS tie FROM d GROUP BY source, key),
r AS (SELECT *, coalesce(sum(tie) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM g)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, e.source_size, e.target,
  CAST(epochs * d.size + CASE WHEN budget - epochs * e.source_size >= begun + tie THEN d.size
    WHEN budget - epochs * e.source_size <= begun OR tie = 0 THEN 0
    ELSE floor((budget - epochs * e.source_size - begun) * d.size / tie) END AS BIGINT) AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source JOIN r ON d.source IS NOT DISTINCT FROM r.source AND d.key = r.key"""


@query("op8_weighted_mix", SQL)
def op8_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that the mix takes. Null texts have no words; null sources are one source;
    an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    light = stored(docs.select("doc_id", "source", words_in().alias("size"), random_key().alias("key")), "mix-light")
    return mixed(light, plan_mix(light)).select("doc_id", "size", "source_size", "target", "taken")


def take_mix(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: whole rows, each as often as its source's budget asks, the row at the
    cut included. Texts are not shuffled; they meet a table of one row a source."""
    keyed = docs.withColumns({"__size": words_in(), "__key": random_key()})
    light = stored(keyed.select("source", F.col("__size").alias("size"), F.col("__key").alias("key")), "mix-light")
    plan = plan_mix(light).select("source", *[F.col(c).alias(f"__{c}") for c in ("epochs", "cut_key", "part")])
    more = (F.col("__key") < F.col("__cut_key")) | ((F.col("__key") == F.col("__cut_key")) & (F.col("__part") > 0))
    times = (F.col("__epochs") + F.when(more, 1).otherwise(0)).cast("int")
    taken = _meet(keyed, plan).withColumn("__times", times).where("__times > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)
