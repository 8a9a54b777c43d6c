"""Mixing sources by a time-varying curriculum: integrated weight schedules, inverted demand, range sort by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count

#: Prefix sums run within ranges of about so many rows, whatever a source's share and however often an id is repeated.
RANGE_ROWS = 500_000
WEIGHTS = (5.0, 2.0, 1.0)
#: Slope of the schedule by rank of the source: weight(t) is share * (1 + slope * (2 t - 1)) over training time 0 to 1.
SLOPES = (-0.5, 0.25, 0.75)


def _cycle(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(rank, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) to weights and targets: budget * total shared by weight, none above cap * its size.

    The excess is reshared by weight until none is above: with sources in order of cap / weight there is one
    water level, found with running sums. One row per source; this small table alone is sorted in one task.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", _cycle(WEIGHTS, F.col("rank"))).withColumn("slope", _cycle(SLOPES, F.col("rank")))
    ranked = ranked.withColumn("most", F.lit(cap) * F.col("source_size"))
    every, order = Window.partitionBy(), Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(budget) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("most"))
    final = F.max(F.when(F.col("open"), F.col("level"))).over(every)
    return leveled.select("source", "source_size", "rank", "slope", F.least("most", F.coalesce(final * F.col("weight"), F.col("most"))).alias("target"))


def position(demand: Column, slope: Column) -> Column:
    """Training time at which a source has been asked for this fraction of its tokens: inverse of t + slope * (t^2 - t)."""
    b = F.lit(1.0) - slope
    root = F.sqrt(b * b + F.lit(4.0) * slope * demand)
    return F.lit(2.0) * demand / (b + root)


def curriculum_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: list[str] | None = None, ordered: bool = True) -> DataFrame:
    """One row per document, with what the mix takes of it and when.

    Adds size (words), source_size, target, taken (words, repeats counted), position (training time, 0 to 1, of
    the first pass; null if nothing is taken) and repeat_position (of a second pass). A source whose target is e
    times its size goes round floor(e) times whole, and then as far as the rest reaches in an order by MD5 of the
    id; the last document reached is cut, so that a source's taken words are its target rounded down.
    No document is taken more than twice. Null source: a source of its own, sorted last. Null text: size 0. Texts of any
    length are counted whole; repeated rows are taken one after another; extra columns may have any names, those
    of results are replaced; an empty table gives none.
    The result is range-sorted by position, nothing taken last, unless the caller sorts it (ordered=False); rows with
    equal keys may come in any order.
    """
    carry = docs.columns if carry is None else carry
    made = {"size", "source_size", "target", "taken", "position", "repeat_position"}
    own = [c for c in carry if c.lower() not in made and c != source_col]
    digest = lambda c: F.unhex(F.md5(F.coalesce(c, F.lit(""))))
    # long texts are left aside until their places are known
    wide = text_col in own
    carried = F.struct(F.lit(0).alias("_"), *[docs[c] for c in own]).alias("_carry")
    full = docs.select(F.monotonically_increasing_id().alias("_uid"), carried, docs[source_col].alias("_source"), word_count(docs[text_col]).alias("size"), digest(docs[id_col].cast("string")).alias("_order"), digest(docs[text_col]).alias("_tie"))
    full = materialize(full, "mix-sizes")
    keyed = full.drop("_carry") if wide else full
    # ranges of (source, order): rows that repeat an id and a text are told apart by a number, so no range need be large
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-full.count() // RANGE_ROWS))
    keyed = materialize(keyed.repartitionByRange(ranges, "_source", "_order", "_tie", "_uid").withColumn("_range", F.spark_partition_id()), "mix-ranges")
    sums = keyed.groupBy("_source", "_range").agg(F.sum("size").alias("_in"))
    before = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_source", "_range", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_start"))
    targets = source_targets(sums.groupBy(F.col("_source").alias("source")).agg(F.sum("_in").alias("source_size")))
    starts = starts.join(targets, starts["_source"].eqNullSafe(targets["source"])).drop("source")
    joined = keyed.alias("k").join(starts.alias("s"), (F.col("k._range") == F.col("s._range")) & F.col("k._source").eqNullSafe(F.col("s._source")))
    joined = joined.select("k.*", "s._start", "s.source_size", "s.slope", "s.target")
    inside = Window.partitionBy("_range", "_source").orderBy("_order", "_tie", "_uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = joined.withColumn("_at", F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    words = F.floor(F.col("target")).cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size")).cast("long")).otherwise(F.lit(0).cast("long"))
    rest = words - rounds * F.col("source_size")
    partial = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("_at")))
    taken = F.col("size") * rounds + partial
    demand = lambda turn: F.least(F.lit(1.0), (F.col("_at") + turn * F.col("source_size")) / F.col("target"))
    out = placed.withColumn("taken", taken).withColumn("_rounds", rounds)
    out = out.withColumn("position", F.when((F.col("taken") > 0), position(demand(F.lit(0)), F.col("slope"))))
    out = out.withColumn("repeat_position", F.when(F.col("taken") > F.col("size"), position(demand(F.lit(1)), F.col("slope"))))
    if wide:
        out = out.join(full.select("_uid", "_carry"), "_uid")
    out = out.select(*[F.col("_carry").getField(c).alias(c) for c in own], F.col("_source").alias(source_col), "size", "source_size", "target", "taken", "position", "repeat_position", "_order", "_uid")
    return (out.orderBy(F.col("position").asc_nulls_last(), "_order", "_uid") if ordered else out).drop("_order", "_uid")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars") -> DataFrame:
    """The mix itself, with the columns of docs, in training order: a row for each pass over a document.

    Documents that are not taken are left out; one that is taken in part appears with that many of its first words,
    and a length to match.
    """
    columns = docs.columns
    inner = docs.select(*[docs[c].alias(f"_c{i}") for i, c in enumerate(columns)])
    names = dict(zip(columns, inner.columns, strict=True))
    mix = curriculum_mix(inner, names[id_col], names[text_col], names[source_col], ordered=False)
    passes = F.array(F.struct(F.least("taken", "size").alias("words"), F.col("position").alias("at")), F.struct((F.col("taken") - F.col("size")).alias("words"), F.col("repeat_position").alias("at")))
    rows = mix.where("taken > 0").withColumn("_pass", F.explode(passes)).where("_pass.words > 0")
    text = F.col(names[text_col])
    # one document of a source, at most, is cut
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("_pass.words").cast("int")), "")
    whole = F.col("_pass.words") == F.col("size")
    rows = rows.withColumn("_text", F.when(whole, text).otherwise(cut))
    final = {text_col: F.col("_text")} | ({length_col: F.when(whole, F.col(names[length_col])).otherwise(F.length("_text")).cast(docs.schema[length_col].dataType)} if length_col in columns else {})
    return rows.orderBy("_pass.at", F.md5(F.coalesce(F.col(names[id_col]).cast("string"), F.lit("")))).select(*[final.get(c, F.col(names[c])).alias(c) for c in columns])
