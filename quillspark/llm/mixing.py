"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, the closest to 1 in relative entropy for which every source's words add up to its target; the
rates are exponentially tilted by size, rate = exp(lambda of its source * size / mean size) up to a cap, and the multipliers are found by Newton's
method on the convex dual. Gradient and curvature are sums over a histogram of sizes, taken once over all documents. Rates are
then rounded into whole copies. DataFrame operations only; what meets in one task is bounded by the number of sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: A word, as in every count of this subpackage.
WORD = r"[^\x20\x09-\x0D]+"
_FINE = 1 << 30


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: the words of each text; null: 0."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def _weighed(sizes: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """sizes with weight: the weights, repeated over the sources by code point, null last. Sources are numbered within ranges of names, so that none of them need meet in one task."""
    order = F.col("source").asc_nulls_last()
    ranged = cut(sizes.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    before, so_far = {}, 0
    for r in ranged.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row a range
        before[r["part"]], so_far = so_far, so_far + r["n"]
    first = F.element_at(F.create_map(*(F.lit(x) for pair in before.items() for x in pair)), F.col("part")) if before else F.lit(0)
    nth = first + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return ranged.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(nth, F.lit(len(weights))) + 1).cast("int"))).drop("part")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """source, source_size, target: all sizes shared by the weights, repeated over the sources by code point, null last.

    A target stops at `most` times its source's size; the excess is reshared by weight until none is above, a round an aggregate over the sources. sizes: one row per source.
    """
    w = cut(_weighed(sizes, weights).withColumn("bound", most * F.col("source_size")), "weighed")
    first = w.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("weight")).first()
    unit, before = (first["all"] / first["weight"] if first["weight"] else 0.0), None
    while unit != before:
        full = F.col("weight") * unit > F.col("bound")
        sums = w.agg(F.sum(F.when(full, F.col("bound"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        before, unit = unit, ((first["all"] - (sums["full"] or 0.0)) / sums["open"] if sums["open"] else unit)
    return w.select("source", "source_size", F.least("bound", F.col("weight") * unit).alias("target"))


def _tilt(prior: str) -> Column:
    """The exponent's factor: size over its mean where documents weigh equally beforehand, 1 where words do."""
    if prior not in ("words", "documents"):
        raise ValueError("prior: words or documents")
    return F.lit(1.0) if prior == "words" else F.try_divide(F.col("size") * F.col("n_docs"), F.col("source_size"))


def _rate(cap: float) -> Column:
    return F.least(F.lit(cap), F.exp(F.col("multiplier") * F.col("x")))


def multipliers(histogram: DataFrame, wanted: DataFrame, cap: float = 3.0, prior: str = "documents", close: float = 1e-9, rounds: int = 80) -> DataFrame:
    """source, multiplier: Newton's method on the dual, all sources at once; a round is one aggregate over the histogram.

    histogram: source, size, n. wanted: source, source_size, n_docs, target. A step is cut to 2 or the multiplier's own size, and halved while it would leave the
    bracket that the signs of earlier gradients give, so sources whose target needs all documents at the cap end there: the bracket lets a document of one word get there.
    """
    _tilt(prior)
    reach = 60.0 * (F.lit(1.0) if prior == "words" else F.greatest(F.lit(1.0), F.col("source_size") / F.col("n_docs")))
    state = cut(wanted.where("target > 0").select("source", "source_size", "n_docs", "target", F.lit(0.0).alias("multiplier"), (-reach).alias("low"), reach.alias("high"), F.lit(False).alias("done")), "dual")
    names = state.columns
    for _ in range(rounds):
        held = histogram.join(state.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).withColumn("x", _tilt(prior)).withColumn("rate", _rate(cap))
        words = F.col("n") * F.col("size") * F.col("rate")
        sums = held.groupBy("source").agg(F.sum(words).alias("reached"), F.sum(F.when(F.col("rate") < cap, words * F.col("x")).otherwise(0.0)).alias("slope")).withColumnRenamed("source", "of")
        gap = F.col("target") - F.col("reached")
        low, high = F.when(gap > 0, F.col("multiplier")).otherwise(F.col("low")), F.when(gap < 0, F.col("multiplier")).otherwise(F.col("high"))
        far = F.greatest(F.lit(2.0), F.abs("multiplier"))
        newton = F.col("multiplier") + F.greatest(-far, F.least(far, gap / F.col("slope")))
        inside = F.when((F.col("slope") > 0) & (newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        done = F.abs(gap) <= close * F.col("target")
        moved = state.join(sums, F.col("source").eqNullSafe(F.col("of")))
        state = cut(moved.select("source", "source_size", "n_docs", "target", F.when(done, F.col("multiplier")).otherwise(inside).alias("multiplier"), low.alias("low"), high.alias("high"), done.alias("done")).select(names), "dual")
        if not state.where("not done").limit(1).count():
            break
    return state.select("source", "multiplier")


def _corrections(units: DataFrame, cap: int, candidates: int) -> DataFrame:
    """source, doc_id, size, change: copies to add or take so that a source's words meet its target.

    Of each source and power of two of sizes, `candidates` units are drawn by hash; from the largest down, each takes up what it
    can of what is missing, so what remains is less than half of the smallest.
    """
    missing = units.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("step"))).alias("missing")).withColumnRenamed("source", "of")
    drawn = Window.partitionBy("source", "power").orderBy("draw", "doc_id", "size")
    few = units.where("step > 0 and doc_id is not null").withColumn("power", F.floor(F.log2("step"))).withColumn("draw", F.xxhash64("doc_id", F.lit("correction"))).withColumn("nth", F.row_number().over(drawn)).where(F.col("nth") <= candidates)
    listed = few.groupBy("source").agg(F.reverse(F.array_sort(F.collect_list(F.struct("step", "doc_id", "size", "copies")))).alias("of_size"))

    def take(acc: Column, c: Column) -> Column:
        k = F.greatest(-c["copies"], F.least(cap - c["copies"], F.round(acc["missing"] / c["step"]).cast("long")))
        change = F.array(F.struct(c["doc_id"].alias("doc_id"), c["size"].alias("size"), k.alias("change")))
        return F.struct((acc["missing"] - k * c["step"]).alias("missing"), F.when(k != 0, F.concat(acc["out"], change)).otherwise(acc["out"]).alias("out"))

    none = F.array().cast("array<struct<doc_id:bigint,size:bigint,change:bigint>>")
    changes = F.aggregate("of_size", F.struct(F.col("missing").alias("missing"), none.alias("out")), take, lambda acc: acc["out"])
    return listed.join(missing, F.col("source").eqNullSafe(F.col("of"))).select("source", F.explode(changes).alias("c")).select("source", "c.*")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, prior: str = "documents", candidates: int = 64) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken (copies * size), for each document.

    docs needs doc_id, source and text. A null source is a source, by name the last; null and empty texts have size 0 and take nothing. Rows that
    repeat a doc_id in a source at one size have as many copies each. Draws are hashes of doc_id, so reruns agree. Empty table: no rows.
    prior: "documents" takes each document as likely as any other beforehand, so that the rates are tilted by their size; "words" each word, which gives the documents of a source one rate.
    Rows without doc_id are drawn alike and not corrected. Other columns aren't read.
    """
    base = cut(sized(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "source", "size"), "sizes")
    histogram = cut(base.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    per = histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs"))
    wanted = cut(per.join(targets(per.select("source", "source_size"), weights, float(cap)).select(F.col("source").alias("of"), "target"), F.col("source").eqNullSafe(F.col("of"))).drop("of"), "targets")
    found = multipliers(histogram, wanted, float(cap), prior).withColumnRenamed("source", "of")
    of_source = wanted.join(found, F.col("source").eqNullSafe(F.col("of")), "left").drop("of").withColumnRenamed("source", "of")
    rate = F.round(F.when(F.col("multiplier").isNull() | (F.col("size") == 0), F.lit(0.0)).otherwise(_rate(float(cap))), 9)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(_FINE)) / _FINE
    units = base.groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows")).join(of_source, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    units = units.withColumn("x", _tilt(prior)).withColumn("rate", rate).withColumn("copies", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).cast("long")).withColumn("step", F.col("size") * F.col("rows"))
    units = cut(units.select("source", "doc_id", "size", "rows", "source_size", "target", "rate", "copies", "step"), "units")
    fix = _corrections(units, cap, candidates).select(F.col("source").alias("of"), F.col("doc_id").alias("id"), F.col("size").alias("s"), "change")
    rounded = units.join(fix, F.col("source").eqNullSafe(F.col("of")) & (F.col("doc_id") == F.col("id")) & (F.col("size") == F.col("s")), "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0)))
    out = rounded.withColumn("copies", F.col("copies").cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    # one row for each of a unit's rows
    return out.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix of all documents, with the weights 5, 2, 1 and at most 3 copies."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
