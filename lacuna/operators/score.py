"""Scoring of findings against labels: greedy one-to-one matching, counts, precision, recall, slices, false positives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a stretch of a document whose findings are sorted together.
STRETCH = 1 << 14
#: Tolerance of start offsets; codes of the two slices.
TOLERANCE = 20
ABSENT_CODES = ("GAP_ABSENT",)
UNUSABLE_CODES = ("GAP_UNPARSEABLE", "GAP_RANGE_NOT_POINT", "GAP_VAGUE", "GAP_DEFERRED_TO_REF", "GAP_DEFERRED_TO_DISPLAY", "GAP_DIMENSION_MISMATCH", "GAP_OUT_OF_RANGE")


def match_single(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """doc_id, field_id, code, outcome (tp, fp, fn), where a report has at most one finding for a field.

    pred: doc_id, field_id, code, start, ord; gold: likewise. A finding takes the first label in order with equal field and
    code within the tolerance. Findings of documents without labels don't count.
    """
    keys = ["doc_id", "field_id", "code"]
    p = pred.join(gold.select("doc_id").distinct(), "doc_id", "semi")
    near = p.select(*keys, F.col("start").alias("p_start"), F.col("ord").alias("p_ord")).join(gold.select(*keys, F.col("start").alias("g_start"), F.col("ord").alias("g_ord")), keys).where(F.abs(F.col("p_start") - F.col("g_start")) <= TOLERANCE)
    taken = near.withColumn("n", F.row_number().over(Window.partitionBy(*keys, "p_ord").orderBy("g_ord"))).where("n = 1")
    tp = taken.select(*keys, F.lit("tp").alias("outcome"))
    fp = p.join(taken.select(*keys, F.col("p_ord").alias("ord")), [*keys, "ord"], "anti").select(*keys, F.lit("fp").alias("outcome"))
    fn = gold.join(taken.select(*keys, F.col("g_ord").alias("ord")), [*keys, "ord"], "anti").select(*keys, F.lit("fn").alias("outcome"))
    return tp.unionByName(fp).unionByName(fn)


def islands(rows: DataFrame) -> DataFrame:
    """rows (doc_id, field_id, code, start, ..) with island: equal for rows of a key that nearby starts link, however far the chain goes.

    Starts over TOLERANCE apart link nothing, so matches stay within an island. A key is cut into stretches of STRETCH
    characters, whose rows are sorted apart; only a row for each stretch meets the key's others.
    """
    keys = ["doc_id", "field_id", "code"]
    cut = rows.withColumn("stretch", F.floor(F.col("start") / STRETCH))
    order = Window.partitionBy(*keys, "stretch").orderBy("start")
    gap = F.coalesce((F.col("start") - F.lag("start").over(order) > TOLERANCE).cast("int"), F.lit(0))
    cut = cut.withColumn("gap", gap).withColumn("nth", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = cut.groupBy(*keys, "stretch").agg(F.min("start").alias("first"), F.max("start").alias("last"), F.max("nth").alias("gaps"))
    along = Window.partitionBy(*keys).orderBy("stretch")
    opens = F.coalesce(F.col("first") - F.lag("last").over(along) > TOLERANCE, F.lit(True))
    ends = ends.withColumn("opens", opens)
    name = lambda n: F.struct("stretch", n.cast("long").alias("nth"))
    # the island that a stretch ends in; null: the one it began in, from the stretch before
    own = F.when(F.col("gaps") > 0, name(F.col("gaps"))).when(F.col("opens"), name(F.lit(0)))
    ends = ends.withColumn("own", own)
    before = F.last("own", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    heads = ends.select(*keys, "stretch", F.when(F.col("opens"), name(F.lit(0))).otherwise(before).alias("head"))
    return cut.join(heads, [*keys, "stretch"]).withColumn("island", F.when(F.col("nth") == 0, F.col("head")).otherwise(name(F.col("nth")))).drop("stretch", "gap", "nth", "head")


def match_greedy(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """As match_single, for any number of findings: in order, each takes the first label within tolerance that is still free.

    Findings without a label of their key, and labels without a finding, are told apart first: only keys that have both are
    matched, and only the rows of an island are listed in one place.
    """
    keys = ["doc_id", "field_id", "code"]
    p = pred.join(gold.select("doc_id").distinct(), "doc_id", "semi")
    labelled, found = gold.select(keys).distinct(), p.select(keys).distinct()
    alone = p.join(labelled, keys, "anti").select(*keys, F.lit("fp").alias("outcome")).unionByName(gold.join(found, keys, "anti").select(*keys, F.lit("fn").alias("outcome")))
    p, gold = p.join(labelled, keys, "semi"), gold.join(found, keys, "semi")
    both = islands(p.select(*keys, "start", "ord", F.lit(0).alias("side")).unionByName(gold.select(*keys, "start", "ord", F.lit(1).alias("side"))))
    listed = both.groupBy(*keys, "island").agg(*(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("ord", "start")))).alias(n) for s, n in ((0, "p"), (1, "g"))))
    start = F.struct(F.col("g").alias("free"), F.lit(0).alias("tp"), F.lit(0).alias("fp"))

    def take(a, x):
        fits = F.filter(a["free"], lambda y: F.abs(y["start"] - x["start"]) <= TOLERANCE)
        hit = F.size(fits) > 0
        return F.struct(F.when(hit, F.filter(a["free"], lambda y: y["ord"] != F.get(fits, F.lit(0))["ord"])).otherwise(a["free"]).alias("free"), (a["tp"] + hit.cast("int")).alias("tp"), (a["fp"] + (~hit).cast("int")).alias("fp"))

    done = listed.select(*keys, F.aggregate("p", start, take, lambda a: F.concat(F.array_repeat(F.lit("tp"), a["tp"]), F.array_repeat(F.lit("fp"), a["fp"]), F.array_repeat(F.lit("fn"), F.size(a["free"])))).alias("outcomes"))
    return done.select(*keys, F.explode("outcomes").alias("outcome")).unionByName(alone)


def rates(counts: DataFrame) -> DataFrame:
    """counts (tp, fp, fn) with precision, recall, f1 and support; 0 where a denominator is 0."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    out = counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("support", F.col("tp") + F.col("fn"))


def count_outcomes(outcomes: DataFrame) -> DataFrame:
    """bucket, tp, fp, fn for each field, each code (code:<code>) and ALL, in one pass."""
    buckets = outcomes.select(F.explode(F.array(F.col("field_id"), F.concat(F.lit("code:"), F.col("code")), F.lit("ALL"))).alias("bucket"), "outcome")
    return buckets.groupBy("bucket").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn")))


def slices(outcomes: DataFrame) -> DataFrame:
    """The same for ABSENT and PRESENT_BUT_UNUSABLE; an unknown code raises."""
    name = F.when(F.col("code").isin(*ABSENT_CODES), "ABSENT").when(F.col("code").isin(*UNUSABLE_CODES), "PRESENT_BUT_UNUSABLE").otherwise(F.raise_error(F.concat(F.lit("unknown code "), F.col("code"))))
    return outcomes.select(name.alias("bucket"), "outcome").groupBy("bucket").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn")))


def noise_ratio(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: share of findings, in labelled documents, with no blocking label near, whatever its field and code; 0 for none."""
    p = pred.join(gold.select("doc_id").distinct(), "doc_id", "semi").select("doc_id", "ord", "start")
    b = gold.where(F.coalesce("blocking", F.lit(False))).select(F.col("doc_id").alias("b_doc"), F.col("start").alias("b_start"))
    noise = p.join(b, (F.col("doc_id") == F.col("b_doc")) & (F.abs(F.col("start") - F.col("b_start")) <= TOLERANCE), "anti").agg(F.count("*").alias("noise"))
    return p.agg(F.count("*").alias("emitted")).crossJoin(noise).select("emitted", "noise", F.when(F.col("emitted") > 0, F.col("noise") / F.col("emitted")).otherwise(F.lit(0.0)).alias("ratio"))
