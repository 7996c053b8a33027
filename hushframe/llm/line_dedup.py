"""Line dedup: repeated runs of lines by distributed prefix doubling; later copies are deleted.

Lines become ids: the rank of their 128-bit hash. The suffixes of all documents' line sequences are sorted by prefix doubling
with discarding: from the ranks of runs of 2^k lines, the pair of ranks at a position and 2^k lines on gives the rank of
the run of 2^(k+1) lines there. A rank is the number of suffixes that sort before, so equal ranks are an interval of the
suffix array whose longest common prefix is at least that long; suffixes alone in theirs are settled and drop out.
Each interval knows its first member. Any maximal repeated run is the union of two runs of a power of two of lines, so
these intervals mark all of its lines; where these alone have too few words, the run's whole length is found from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, read_table, release, running_total, save

#: A repeated run is deleted if it has at least so many words.
MIN_WORDS = 5
_AT = ["_id", "_dk", "ln"]


def _keyed(docs: DataFrame) -> DataFrame:
    """(_id, _dk, _row): rows of the same id and text count as one document; _row is the whole row."""
    row = F.struct(*docs.columns)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("_id"), F.xxhash64("doc_id", "text").alias("_dk"), row.alias("_row"))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(_id, _dk, gone): the places, from 0, of each document's lines that are later copies."""
    lines = (
        _keyed(docs.select("doc_id", "text").where("text is not null"))
        .select("_id", "_dk", F.posexplode(F.split("_row.text", "\n", -1)).alias("ln", "line"))
        .select(*_AT, F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line", F.length("line")).alias("h2"), F.size(F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "")).alias("w"))
    )
    lines = save(lines, "lines")
    unique = lines.dropDuplicates(_AT)
    place = F.struct(*_AT)
    groups = unique.groupBy("h", "h2").agg(F.count("*").alias("c"), F.min(place).alias("first")).where("c > 1")
    ranked = running_total(groups, ["h", "h2"], "c", "ranks")
    level = save(unique.join(ranked, ["h", "h2"]).select(*_AT, "w", F.col("before").alias("r"), "first"), "level")
    drop(lines, ranked)
    levels, k = [level], 0
    while True:
        step = 1 << k
        ahead = level.select("_id", "_dk", (F.col("ln") - step).alias("ln"), F.col("r").alias("r2"), F.col("w").alias("w2"))
        pairs = save(level.select(*_AT, "r", "w").join(ahead, _AT).select(*_AT, F.col("r").alias("r1"), "r2", (F.col("w") + F.col("w2")).alias("w")), "pairs")
        groups = pairs.groupBy("r1", "r2").agg(F.count("*").alias("c"), F.min(place).alias("first")).where("c > 1")
        ranked = running_total(groups, ["r1", "r2"], "c", "ranks")
        level = save(pairs.join(ranked, ["r1", "r2"]).select(*_AT, "w", F.col("before").alias("r"), "first"), "level")
        drop(pairs, ranked)
        if level.isEmpty():
            drop(level)
            break
        levels.append(level)
        k += 1
    release(docs.sparkSession)
    marks = None
    for k, x in enumerate(levels):
        own = x.where(F.col("first") < place).select(*_AT, F.lit(1 << k).alias("n"), "w")
        marks = own if marks is None else marks.unionByName(own)
    best = marks.groupBy(*_AT).agg(F.max("n").alias("n"), F.max(F.when(F.col("w") >= min_words, F.col("n"))).alias("long"))
    doc = Window.partitionBy("_id", "_dk").orderBy("ln")
    so_far = doc.rowsBetween(Window.unboundedPreceding, 0)
    reach = levels[0].select(*_AT, "w").join(best, _AT, "left").withColumn("to", F.max(F.col("ln") + F.coalesce("long", F.lit(0))).over(so_far)).withColumn("any", F.max(F.col("ln") + F.coalesce("n", F.lit(0))).over(so_far))
    starts = F.coalesce(F.lag("any").over(doc) <= F.col("ln"), F.lit(True))
    reach = save(reach.withColumn("start", starts).withColumn("seg", F.max(F.when(F.col("start"), F.col("ln"))).over(so_far)).drop("start"), "reach")
    more, spread = _longer(reach, levels, min_words), reach
    if more is not None:
        spread = reach.join(more, _AT, "left").withColumn("to", F.greatest("to", F.max(F.col("ln") + F.coalesce("more", F.lit(0))).over(so_far)))
    gone = spread.where(F.col("to") > F.col("ln"))
    out = save(gone.groupBy("_id", "_dk").agg(F.collect_list("ln").alias("gone")), "gone")
    drop(reach, *levels, *([more] if more is not None else []))
    return out


def _longer(reach: DataFrame, levels: list[DataFrame], min_words: int) -> DataFrame | None:
    """(_id, _dk, ln, more): whole lengths of runs of min_words that occur earlier; None if none can add a line.

    Only stretches of repeated lines (seg) that have words enough and a line in no run of a power of two with words
    enough are looked at. A place's length is its longest power of two 2^k and further bits: a run of l lines,
    2^k < l < 2^(k+1), is known by the ranks of its first and of its last 2^k lines.
    """
    inside = reach.where(F.col("any") > F.col("ln"))
    wanted = inside.groupBy("_id", "_dk", "seg").agg(F.sum("w").alias("words"), F.count("*").alias("c"), F.max(F.col("to") <= F.col("ln")).alias("left"))
    wanted = wanted.where((F.col("words") >= min_words) & (F.col("c") > 2) & F.col("left")).select("_id", "_dk", "seg")
    total = F.sum("w").over(Window.partitionBy("_id", "_dk", "seg").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0))
    found = save(inside.join(wanted, ["_id", "_dk", "seg"]).withColumn("total", total), "open")
    top = found.agg(F.max("n")).first()[0] or 1
    if top < 2:
        drop(found)
        return None
    ranks = None
    for k, x in enumerate(levels[1:], 1):
        own = x.select(*_AT, F.lit(k).alias("k"), "r")
        ranks = own if ranks is None else ranks.unionByName(own)
    now = found.where("n > 1").select(*_AT, F.round(F.log2("n")).cast("int").alias("k"), F.col("n").alias("l"), (F.col("total") - F.col("w")).alias("before"))
    now = save(now.join(ranks, [*_AT, "k"]).withColumnRenamed("r", "c"), "lengths")
    place = F.struct(*_AT)
    for s in range(1, top.bit_length()):
        asked = now.withColumn("l2", F.expr(f"if(k >= {s}, l + shiftleft(1, k - {s}), null)"))
        keys = asked.where("l2 is not null").select("k", "c", "l2").distinct()
        heads = ranks.withColumnRenamed("r", "c").join(keys, ["k", "c"]).withColumn("at", F.expr("ln + l2 - shiftleft(1, k)"))
        tails = ranks.select("_id", "_dk", F.col("ln").alias("at"), "k", F.col("r").alias("r2"))
        runs = save(heads.join(tails, ["_id", "_dk", "at", "k"]).select(*_AT, "k", "c", "l2", "r2"), "runs")
        first = runs.groupBy("k", "c", "l2", "r2").agg(F.min(place).alias("first"))
        earlier = runs.join(first, ["k", "c", "l2", "r2"]).where(F.col("first") < place).select(*_AT, "l2", F.lit(True).alias("ok"))
        after = save(asked.join(earlier, [*_AT, "l2"], "left").select(*_AT, "k", F.when(F.col("ok"), F.col("l2")).otherwise(F.col("l")).alias("l"), "before", "c"), "lengths")
        drop(now, runs)
        now = after
    ends = found.select("_id", "_dk", F.col("ln").alias("end"), "total")
    whole = now.withColumn("end", F.col("ln") + F.col("l") - 1).join(ends, ["_id", "_dk", "end"])
    out = save(whole.where(F.col("total") - F.col("before") >= min_words).select(*_AT, F.col("l").alias("more")), "more")
    drop(now, found)
    return out


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with ``text`` rid of lines that are later copies; adds lines_kept and lines_deleted.

    A line goes if it lies in a run of whole lines, of any number, ``min_words`` words or more in all, that also starts
    at an earlier place: at a smaller doc_id, or further up in the document. Lines are parted by line feeds alone and
    told apart by 128 bits of hashes and their length. Null ids come last; a null text stays null with no lines; an empty
    one is one empty line, which has no words. Rows of the same id and text lose the same lines. A text that loses all
    lines becomes empty. Input columns lines_kept and lines_deleted are replaced, all others kept under any name. The work
    on a text is linear in its lines. An empty table gives no rows.
    """
    gone = repeated_lines(docs, min_words)
    kept = [c for c in docs.columns if c not in ("lines_kept", "lines_deleted")]
    joined = _keyed(docs.select(*kept)).join(gone, ["_id", "_dk"], "left")
    text = F.col("_row").getField("text")
    lines = F.split(text, "\n", -1)

    def rest(x):
        left = F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["gone"])
        return F.array_join(F.transform(left, lambda i: F.get(x["lines"], i)), "\n")

    # as a variable of the lambda, a text is split once
    rebuilt = F.get(F.transform(F.array(F.struct(lines.alias("lines"), F.col("gone").alias("gone"))), rest), F.lit(0))
    new = F.when(F.col("gone").isNull(), text).otherwise(rebuilt)
    total = F.when(text.isNull(), F.lit(0)).otherwise(F.size(lines))
    deleted = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone"))
    return joined.select(*((new if c == "text" else F.col("_row").getField(c)).alias(c) for c in kept), (total - deleted).alias("lines_kept"), deleted.alias("lines_deleted"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later copies of repeated line runs."""
    return dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
