"""Repeated passages: chunks of two lines or sentences that stand at two places, where they make a run of 20 words or more.

Native: DataFrame and SQL functions only.  A document is cut into lines, and lines into sentences, so that a passage inside a
longer line is found too; these units are hashed.  The boundaries of chunks come from the content alone, and every unit is
one: a chunk is a unit and the next one, or one unit of 20 words, named by the hashes of its units.  (Boundaries at chosen units only, by a
rolling hash, leave the ends of a passage in chunks that reach into its surroundings, and most passages of 50 to 150 words untouched.)
All chunks are counted; those that occur once are left out early, by a filter of fixed size.  Before anything goes, the bytes
of all units that share a hash are compared; a unit whose hash stands for different texts stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read

#: Repeated chunks go where they make a run of so many words at least.
WORDS = 20
#: A unit ends with a line end or a blank after a full stop and takes blank lines before it along, so it has one word at least.
UNIT = r"(?s)\s*\S.*?(?:\n|(?<=[.!?]) |\z)(?:\s+\z)?"
#: Texts without any of these, and without white space at the start, are cut the same way by plain replacement.
ODD = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x01")
#: Bits (a power of two) of the filters; one is half a megabyte.
FILTER_BITS = 22


def _odd(text: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(s)) for s in ODD)) | text.startswith(" ") | text.startswith("\n")


def _units(text: Column, odd: Column) -> Column:
    marked = reduce(lambda t, s: F.replace(t, F.lit(s), F.lit(s + "\x01")), ("\n", ". ", "! ", "? "), text)
    plain = F.split(F.rtrim(marked, F.lit("\x01")), "\x01")
    return F.when(odd, F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))).otherwise(plain)


def unit_hash(unit: Column) -> Column:
    return F.xxhash64(unit)


def _bare(unit: Column, odd: Column) -> Column:
    """A unit without blanks and line ends around it."""
    return F.when(odd, F.trim(unit, F.lit(" \n\t\r"))).otherwise(F.when(unit.endswith("\n"), F.left(unit, F.char_length(unit) - 1)).otherwise(F.rtrim(unit)))


def _words(unit: Column, odd: Column) -> Column:
    """Words of a bare unit; by its blanks where that gives the same."""
    return F.when(odd, F.regexp_count(unit, F.lit(r"\S+"))).otherwise(F.octet_length(unit) - F.octet_length(F.replace(unit, F.lit(" "), F.lit(""))) + 1)


def filter_of(df: DataFrame, value: str) -> Column:
    """2^FILTER_BITS bits as a scalar array; those at the values' lowest bits are set.  Grows with nothing: with many values it only lets more pass."""
    slot = F.col(value).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = df.groupBy(F.shiftright(slot, 6).alias("id")).agg(F.bit_or(F.expr(f"shiftleft(1L, int({value} & 63))")).alias("b"))
    dense = df.sparkSession.range(1 << (FILTER_BITS - 6)).join(words, "id", "left").select("id", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    return cut(dense.agg(F.expr("transform(array_sort(collect_list(struct(id, b))), x -> x.b)").alias("bits"))).scalar()


def may_hold(bits: Column, value: Column) -> Column:
    slot = value.bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).cast("int")
    return F.call_function("shiftright", F.get(bits, F.shiftright(slot, 6)), slot.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 1


def _free(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, whatever their case."""
    out: list[str] = []
    for n in names:
        while n.lower() in {c.lower() for c in (*df.columns, *out)}:
            n = "_" + n
        out.append(n)
    return out


def _chunks(units: DataFrame) -> DataFrame:
    """_key, _mark, pos, a, b, w, w2 of each chunk: hashes and words of a unit and the next one; b is 0 (and w2 too) for a unit of enough words by itself."""
    zipped = F.arrays_zip(F.col("_h").alias("a"), F.expr("slice(_h, 2, size(_h))").alias("b"), F.col("_w").alias("w"), F.expr("slice(_w, 2, size(_w))").alias("w2"))
    rows = units.select("_key", "_mark", F.posexplode(zipped).alias("pos", "x")).select("_key", "_mark", "pos", "x.*")
    more = F.when(F.col("w") >= WORDS, F.array(F.struct("b", "w2"), F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).alias("w2")))).otherwise(F.array(F.struct("b", "w2")))
    return rows.select("_key", "_mark", "pos", "a", "w", F.explode(more).alias("y")).select("_key", "_mark", "pos", "a", "w", "y.b", "y.w2").filter("b is not null")


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without repeated passages, with `n_removed` (units) added; rows that lose nothing stay as they are.

    Of a chunk's copies the first one in the document with the smallest key stays.  A null key or text, and an
    empty text, take no part and stay.  Rows with equal keys count as one document: whatever one
    of them may keep, all may.  White space between units counts for nothing.  Very long texts count whole; an empty table
    stays empty.  Other columns stay, whatever their names, but `n_removed` is replaced.
    """
    docs = docs.drop("n_removed")
    mark = F.xxhash64(F.col(text)).bitwiseAND(F.lit((1 << 24) - 1))  # tells texts with equal keys apart
    part = docs.select(F.col(key).alias("_key"), mark.alias("_mark"), F.col(text).alias("_text")).filter("_key is not null and _text <> ''")

    def named(df: DataFrame) -> DataFrame:
        df = df.withColumn("_odd", _odd(F.col("_text"))).withColumn("_u", _units(F.col("_text"), F.col("_odd")))
        return df.withColumn("_e", F.transform("_u", lambda x: _bare(x, F.col("_odd"))))

    units = cut(named(part).select("_key", "_mark", F.transform("_e", unit_hash).alias("_h"), F.transform("_e", lambda x: _words(x, F.col("_odd")).cast("int")).alias("_w")))
    chunks = _chunks(units).withColumn("c", F.xxhash64("a", "b"))
    twice = chunks.groupBy("c").agg(F.count("*").alias("n")).filter("n > 1")
    likely = chunks.filter(may_hold(filter_of(twice, "c"), F.col("c"))).drop("c")
    groups = likely.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("_key").alias("first")).filter("n > 1")
    # One more key than the grouping's, always equal: the join gets exchanges of its own, so that the planner can split a frequent chunk.
    seen = likely.withColumn("z", F.bit_count("a")).join(groups.select("a", "b", F.bit_count("a").alias("z"), "first"), ["a", "b", "z"])
    # One exchange by document serves all that follows.  Where the document may keep the chunk, its first place stays.
    seen = seen.repartition("_key")
    own = Window.partitionBy("_key", "_mark", "a", "b")
    seen = seen.withColumn("at0", F.min("pos").over(own)).withColumn("lost", F.expr("first <> _key or pos > at0"))
    # Where a copy overlaps the first one in the same document, what the first one holds stays.
    ours = "struct(pos, w, lost and not (b <> 0 and first = _key and pos = at0 + 1) as lost)"
    parts = F.explode(F.expr(f"if(b = 0, array({ours}), array({ours}, struct(pos + 1 as pos, w2 as w, lost)))")).alias("x")
    held = seen.select("_key", "_mark", parts).groupBy("_key", "_mark", "x.pos").agg(F.max("x.w").alias("w"), F.max("x.lost").alias("lost"))
    # Runs of units in repeated chunks, and within them of units that aren't at their chunk's first place.
    by_doc = Window.partitionBy("_key", "_mark")
    runs = held.withColumn("run", F.col("pos") - F.row_number().over(by_doc.orderBy("pos")))
    runs = runs.withColumn("in_run", F.sum("w").over(Window.partitionBy("_key", "_mark", "run"))).filter(F.col("in_run") >= WORDS)
    runs = runs.withColumn("own", F.col("pos") - F.row_number().over(Window.partitionBy("_key", "_mark", "lost").orderBy("pos")))
    runs = runs.withColumn("gone", F.col("lost") & (F.sum("w").over(Window.partitionBy("_key", "_mark", "lost", "own")) >= WORDS))
    runs = runs.groupBy("_key", "_mark", "run").agg(F.struct(F.min("pos").alias("s"), F.count("*").cast("int").alias("n")).alias("r"), F.collect_list(F.when(F.col("gone"), F.col("pos"))).alias("g"))
    found = cut(runs.groupBy("_key", "_mark").agg(F.collect_list("r").alias("_held"), F.array_sort(F.flatten(F.collect_list("g"))).alias("_gone")))
    # Bytes: the texts of all units in these runs, by their hash.
    some = may_hold(filter_of(found.select(F.xxhash64("_key", "_mark").alias("v")), "v"), F.xxhash64(F.col("_key"), F.col("_mark")))
    texts = named(part.filter(some).join(found, ["_key", "_mark"])).withColumn("_z", F.arrays_zip(F.transform("_e", unit_hash).alias("h"), F.col("_e").alias("e")))
    texts = texts.select("_key", "_mark", F.explode(F.flatten(F.transform("_held", lambda r: F.slice("_z", r["s"] + 1, r["n"])))).alias("x"))
    unlike = cut(texts.select("x.h", "x.e").distinct().groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    lost = found.filter("size(_gone) > 0").drop("_held")
    if unlike.isEmpty():
        lost = lost.withColumn("_stay", F.lit(None).cast("array<bigint>"))
    else:
        lost = lost.join(texts.select("_key", "_mark", "x.h").join(unlike, "h", "left_semi").groupBy("_key", "_mark").agg(F.collect_set("h").alias("_stay")), ["_key", "_mark"], "left")
    k, m, gone, stays, u = _free(docs, "key", "mark", "gone", "stay", "u")
    lost = lost.toDF(k, m, gone, stays)
    # Only documents that may lose something are shuffled.
    some = may_hold(filter_of(lost.select(F.xxhash64(k, m).alias("v")), "v"), F.xxhash64(F.col(key), mark))
    out = docs.filter(some).join(lost, (F.col(key) == F.col(k)) & (mark == F.col(m)), "left")
    odd = _odd(F.col(text))
    out = out.withColumn(u, F.when(F.size(gone) > 0, _units(F.col(text), odd)))
    hashed = F.transform(u, lambda x: unit_hash(_bare(x, odd)))
    out = out.withColumn(gone, F.when(F.col(stays).isNotNull(), F.filter(gone, lambda i: ~F.array_contains(stays, F.get(hashed, i)))).otherwise(F.col(gone)))
    # What lies between the removed units, which are in order.
    gap = f"slice({u}, int(if(j = 0, 1, {gone}[j - 1] + 2)), int(if(j = size({gone}), size({u}), {gone}[j]) - if(j = 0, 0, {gone}[j - 1] + 1)))"
    left = F.expr(f"array_join(flatten(transform(sequence(0, size({gone})), j -> {gap})), '')")
    new = F.when(F.size(gone) > 0, left).otherwise(F.col(text))
    out = out.select(*((new if c == text else F.col(c)).alias(c) for c in docs.columns), F.greatest(F.size(gone), F.lit(0)).cast("long").alias("n_removed"))
    return out.union(docs.filter(~some).withColumn("n_removed", F.lit(0).cast("long")))


def op6_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
