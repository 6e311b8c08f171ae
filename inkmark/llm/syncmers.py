"""Document fingerprints from closed syncmers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmark.llm.common import let, stored

#: Lengths in code points of the k-mers and of their inner substrings, and the fingerprint's number of bins.
K, S, BINS = 13, 8, 64
#: An anchor is one number: 31 bits of its k-mer's hash, then 32 bits of its place in the text.
_PLACE = 1 << 32


def _hash(at: int, length: int) -> Column:
    return F.xxhash64(F.substring(F.col("data"), (F.col("i") + (at - 1)) * 4 + 1, F.lit(4 * length)))


def _anchor(hash_: Column, place: Column) -> Column:
    return F.shiftrightunsigned(hash_, 33) * F.lit(_PLACE) + place


def binned(texts: DataFrame) -> DataFrame:
    """texts(id, ..., text) with anchor and bin: a row for each closed syncmer, and one with first for each text.

    A k-mer is chosen if the least of its inner substrings' hashes is the first or the last: nothing outside it
    decides, so equal passages give equal anchors wherever they stand. Positions are a generator, filtered in the
    same compiled stage; they count code points, of four bytes each. A text shorter than a k-mer, if not empty, is one
    anchor.
    """
    names = [c for c in texts.columns if c != "text"]
    data = texts.select(*names, F.encode("text", "UTF-32").alias("data")).withColumn("size", F.floor(F.octet_length("data") / 4).cast("int"))
    each = data.select(*names, "data", "size", F.explode(F.sequence(F.lit(1), F.greatest(F.col("size") - (K - 1), F.lit(1)))).alias("i"))
    inner = [_hash(j, S) for j in range(K - S + 1)]
    closed = F.least(inner[0], inner[-1]) <= reduce(F.least, inner[1:-1])
    first, short, place = F.col("i") == 1, F.col("size") < K, F.col("i").cast("long") - 1
    anchor = F.when(F.col("size") == 0, F.lit(None)).when(short, _anchor(F.xxhash64("data"), place)).when(~first | closed, _anchor(_hash(0, K), place))
    chosen = each.where(first | closed).select(*names, first.alias("first"), anchor.alias("anchor"))
    return chosen.withColumn("bin", F.shiftright("anchor", 32).bitwiseAND(F.lit(BINS - 1)).cast("int"))


def likeness(a: Column, b: Column) -> Column:
    """Of the bins that either has, the share with matching anchors: equal k-mers at consistent places.

    Two texts that share a passage have its anchors at one offset from each other, so a match counts if another has
    the same offset, or if it is the only one. What several edits leave are several offsets.
    """
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))

    def of(x: Column) -> Column:
        there = F.size(F.filter(x, lambda p: p["a"].isNotNull() | p["b"].isNotNull()))
        same = F.filter(x, lambda p: F.shiftright(p["a"], 32) == F.shiftright(p["b"], 32))
        return F.when(there == 0, 1.0).otherwise(let(F.array_sort(F.transform(same, lambda p: p["a"] - p["b"])), consistent) / F.when(there == 0, 1).otherwise(there))

    def consistent(offsets: Column) -> Column:
        again = F.filter(offsets, lambda d, i: F.get(offsets, i - 1).eqNullSafe(d) | F.get(offsets, i + 1).eqNullSafe(d))
        return F.when(F.size(offsets) == 1, 1).otherwise(F.size(again))

    return let(pairs, of)


def digits(bins: Column) -> Column:
    """A bin's hash in eight characters and its place after a dot; the empty text has no fingerprint."""

    def shown(x: Column) -> Column:
        return F.concat(F.lower(F.lpad(F.hex(F.shiftright(x, 32)), 8, "0")), F.lit("."), F.lower(F.hex(x.bitwiseAND(F.lit(_PLACE - 1)))))

    each = F.transform(bins, lambda x: F.coalesce(shown(x), F.lit("-")))
    return F.when(F.exists(bins, lambda x: x.isNotNull()), F.array_join(each, " ")).otherwise(F.lit(""))


def successors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """((id, next_id, n), whether ids repeat): the next larger id of each, the smallest after the largest.

    Ids are dealt out by range. The next id is found in each range, and that of a range's last id among the ranges'
    first ids, of which there is one a partition.
    """
    own = docs.select(F.col(id_col).alias("id"), F.length(F.col(text_col)).alias("n")).where("id is not null")
    own = own.groupBy("id").agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.count("*").alias("rows"))
    ranged = stored(own.repartitionByRange("id").withColumn("range", F.spark_partition_id()), "ranges")
    firsts = ranged.groupBy("range").agg(F.min("id").alias("first"))
    after = F.lead("first").over(Window.orderBy("range"))
    firsts = firsts.select("range", F.coalesce(after, F.min("first").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    follow = ranged.withColumn("next", F.lead("id").over(Window.partitionBy("range").orderBy("id")))
    follow = follow.join(F.broadcast(firsts), "range")  # a row for each partition of the ids
    repeats = bool(ranged.where("rows > 1").head(1))
    return follow.select("id", F.coalesce("next", "after").alias("next_id"), "n"), repeats


def edited(docs: DataFrame, follow: DataFrame, repeats: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, changed): each text, and it with its second half replaced by the beginning of the next document's.

    The next text travels as far as it is asked for, and no further. Both joins read the texts by id, from the same
    shuffle. For rows with an id.
    """
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    asked = follow.select(F.col("id").alias("for_id"), "next_id", F.floor(F.col("n") / 2).cast("int").alias("most"))
    met = own.join(asked, own.id == asked.next_id).select("for_id", F.left("text", F.col("most")).alias("head"), *(["text"] if repeats else []))
    if repeats:
        met = met.groupBy("for_id").agg(F.min(F.struct("text", "head")).alias("m")).select("for_id", "m.head")
    return own.join(met, own.id == met.for_id, "left").select("id", "text", _changed(F.coalesce("head", F.lit(""))).alias("changed"))


def _changed(head: Column) -> Column:
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    return F.concat(F.left("text", n - half), F.left(head, half))


def sketches(both: DataFrame) -> DataFrame:
    """both(id, text, changed) -> (id, t0, t1, rows, n_chars, edited_sha256, own, edited).

    Of each text and bin the anchor of the least hash, the first of equal ones: where the input lies by id, as after a join, no row is shuffled again. t0 and
    t1 are hashes of the text, rows counts rows that are equal; own and edited are arrays of bins, null where empty.
    """
    digest = F.sha2("changed", 256)
    parts = [F.conv(F.substring(digest, 1 + 16 * k, 16), 16, -10).cast("long").alias(f"d{k}") for k in range(4)]
    facts = ["n_chars", "d0", "d1", "d2", "d3"]
    own = both.select("id", F.xxhash64("text").alias("t0"), F.xxhash64("text", F.lit("text")).alias("t1"), F.length("text").cast("long").alias("n_chars"), *parts, F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("text")), F.struct(F.lit(1).alias("v"), F.col("changed").alias("text")))).alias("x"))
    rows = binned(own.select("id", "t0", "t1", *facts, "x.v", "x.text"))
    kept = [F.max(F.when(F.col("first"), F.col(c))).alias(c) for c in facts]
    cells = rows.groupBy("id", "t0", "t1", "v", "bin").agg(F.min("anchor").alias("anchor"), F.sum(F.when(F.col("first") & (F.col("v") == 0), 1).otherwise(0)).alias("rows"), *kept)
    cell = F.struct("bin", "anchor")
    lists = cells.groupBy("id", "t0", "t1").agg(F.sum("rows").cast("int").alias("rows"), *[F.max(c).alias(c) for c in facts], *[F.collect_list(F.when((F.col("v") == v) & F.col("anchor").isNotNull(), cell)).alias(f"l{v}") for v in (0, 1)])  # BINS at most
    sha = F.lower(F.concat(*[F.lpad(F.hex(f"d{k}"), 16, "0") for k in range(4)]))

    def bins(cells: Column) -> Column:
        known = F.map_from_entries(cells)
        return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda k: F.element_at(known, k))

    return lists.select("id", "t0", "t1", "rows", "n_chars", sha.alias("edited_sha256"), bins(F.col("l0")).alias("own"), bins(F.col("l1")).alias("edited"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, own, edited, near_edited, near_next); own and edited are arrays of bins.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next document
    by id (all, if it has fewer; the first document follows the last). Null texts count as empty. Ids that repeat
    have the same next document, the row of the next id with the least text; near_next holds them against one of its
    rows. Rows without an id have an empty next document. Very long texts are read whole; other columns of docs, of
    any name, are left alone. Repeated rows give repeated rows, an empty table none.
    """
    follow, repeats = successors(docs, id_col, text_col)
    alone = docs.where(F.col(id_col).isNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    alone = sketches(alone.select("id", "text", _changed(F.lit("")).alias("changed")))
    prints = stored(sketches(edited(docs, follow, repeats, id_col, text_col)).unionByName(alone), "prints")
    least = prints.groupBy("id").agg(F.min_by("own", F.struct("t0", "t1")).alias("next_own")) if repeats else prints.where("id is not null").select("id", F.col("own").alias("next_own"))
    nexts = follow.select(F.col("id").alias("for_id"), "next_id").join(least.withColumnRenamed("id", "of"), F.col("next_id") == F.col("of")).select("for_id", "next_own")
    joined = prints.join(nexts, prints.id == nexts.for_id, "left")
    none = F.array(*[F.lit(None).cast("long")] * BINS)
    each = joined.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return each.select("id", "n_chars", "edited_sha256", "own", "edited", likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.coalesce("next_own", none)).alias("near_next"))
