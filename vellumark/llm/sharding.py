"""Contiguous shards of near equal bytes, by global prefix sums; groups of equal texts stay whole. DataFrame functions only.

Rows are put in one order (text hash, then id, so equal texts are neighbours) over range partitions; each partition's total gives its place in the global
sum. Groups of over ``LARGE`` of a shard (so at most ``1 / LARGE`` for each shard, however many rows there are) are dealt first, largest first, each to the
shard with the fewest bytes so far. What is left of each shard's equal part is the target of a cut through the other rows: a row's shard is where its first
byte falls among the targets' sums. A small group that straddles a cut goes whole to the earlier shard. Only a group of more bytes than a shard is cut, into as
many equal pieces as it has shards' worth.

Null texts have size 8 and checksum 0, like empty ones; shared ids and repeated rows are placed one by one; ties in the
order are any way round; texts of any length are measured whole; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumark.llm.scratch import id_and_text, table

#: Part of a shard beyond which a group of equal texts is dealt by itself.
LARGE = 0.01


def _deal(large: DataFrame, shards: int) -> DataFrame:
    """One row: ``loads`` of the shards and ``dealt`` (group key, its start and bytes, shard of each piece), largest pieces first; for at most ``shards / LARGE`` groups."""
    pieces = large.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("bytes") * shards / F.col("all_bytes"))).cast("int"))
    pieces = pieces.select("h", "size", "text_crc32", "from", "bytes", "pieces", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    item = F.struct((-F.col("bytes") / F.col("pieces")).alias("minus"), "h", "size", "text_crc32", "piece", "from", "bytes", "pieces")
    # A fold over the sorted pieces: the least loaded shard takes the next.
    fold = F.expr(f"""aggregate(items, struct(transform(sequence(0, {shards - 1}), k -> double(0)) as loads, cast(array() as array<int>) as chosen),
        (s, x) -> struct(transform(s.loads, (l, k) -> if(k = array_position(s.loads, array_min(s.loads)) - 1, l - x.minus, l)) as loads,
                         concat(s.chosen, array(int(array_position(s.loads, array_min(s.loads)) - 1))) as chosen))""")
    return pieces.agg(F.sort_array(F.collect_list(item)).alias("items")).select("items", fold.alias("s")).select("items", "s.loads", "s.chosen")


def shard_by_bytes(docs: DataFrame, shards: int = 24, overhead: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = id_and_text(docs, id_col, text_col).select("doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"))
    narrow = table(narrow, "sizes")
    group, order = ["h", "size", "text_crc32"], ["h", "size", "text_crc32", "doc_id"]
    # After the sort the id holds partition and place in it; written, so that it stays.
    placed = table(narrow.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("pid", F.shiftright("at", 33))
    zero, everywhere = F.lit(0).cast("long"), Window.partitionBy()
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("pid").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition: that bounds the windows and the broadcasts.
    bases = placed.groupBy("pid").agg(F.sum("size").alias("bytes")).select("pid", F.coalesce(F.sum("bytes").over(before), zero).alias("base"), F.sum("bytes").over(everywhere).alias("all_bytes"))
    rows = placed.withColumn("until", F.coalesce(F.sum("size").over(inside), zero)).join(F.broadcast(bases), "pid").select("doc_id", *group, "at", "pid", "all_bytes", (F.col("base") + F.col("until")).alias("start"))
    rows = table(rows, "prefix")
    large = rows.groupBy(*group).agg(F.sum("size").alias("bytes"), F.min("start").alias("from"), F.max("all_bytes").alias("all_bytes")).where(F.col("bytes") * shards > LARGE * F.col("all_bytes"))
    dealt = table(_deal(large, shards), "dealt")
    chosen = dealt.select(F.inline(F.arrays_zip("items", "chosen"))).select("items.*", "chosen").groupBy(*group).agg(F.first("from").alias("from"), F.first("bytes").alias("bytes"), F.first("pieces").alias("pieces"), F.transform(F.array_sort(F.collect_list(F.struct("piece", "chosen"))), lambda x: x["chosen"]).alias("to"))
    piece = F.least(F.col("pieces") - 1, F.floor((F.col("start") - F.col("from")) * F.col("pieces") / F.col("bytes"))).cast("int")
    rows = rows.join(F.broadcast(chosen), group, "left").select("doc_id", *group, "at", "pid", "all_bytes", F.get("to", piece).alias("own"))
    # The other rows' bytes before each, and the sums of what the shards have room for.
    small = F.when(F.col("own").isNull(), F.col("size")).otherwise(zero)
    rows = table(rows.withColumn("until", F.coalesce(F.sum(small).over(inside), zero)), "small")
    bases = rows.groupBy("pid").agg(F.sum(small).alias("bytes"), F.max("all_bytes").alias("all_bytes")).select("pid", F.coalesce(F.sum("bytes").over(before), zero).alias("base"), F.sum("bytes").over(everywhere).alias("rest"), F.max("all_bytes").over(everywhere).alias("total"))
    room = F.expr(f"transform(loads, l -> greatest(double(0), total / {shards} - l))")
    bounds = F.expr("transform(room, (r, k) -> aggregate(slice(room, 1, k + 1), double(0), (s, x) -> s + x) * rest / greatest(aggregate(room, double(0), (s, x) -> s + x), double(1)))")
    loads = dealt.select("loads").first()["loads"]  # a number a shard
    bases = bases.withColumn("loads", F.array(*map(F.lit, loads))).withColumn("room", room).withColumn("bounds", bounds)
    start = F.col("base") + F.col("until")
    cut = F.least(F.lit(shards - 1), F.size(F.filter("bounds", lambda b: b <= F.col("start")))).cast("int")
    rows = rows.join(F.broadcast(bases.select("pid", "base", "bounds")), "pid").withColumn("start", start).withColumn("cut", F.when(F.col("own").isNull(), cut)).select("doc_id", *group, "at", "pid", "own", "cut")
    # A group that straddles a cut covers it, so there are fewer such groups than shards.
    straddling = rows.where("own is null").groupBy(*group).agg(F.min("cut").alias("low"), F.max("cut").alias("high")).where("low < high").select(*group, "low")
    rows = table(rows.join(F.broadcast(straddling), group, "left").withColumn("shard", F.coalesce("own", "low", "cut")).drop("own", "cut", "low"), "shards")
    # Places: by partition and shard (rows of the partitions times those of the shards), then inside.
    earlier = Window.partitionBy("shard").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("pid", "shard").agg(F.count(F.lit(1)).alias("n")).select("pid", "shard", F.coalesce(F.sum("n").over(earlier), zero).alias("first"))
    place = F.row_number().over(Window.partitionBy("pid", "shard").orderBy("at")) - 1
    return rows.withColumn("place", place).join(counts, ["pid", "shard"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
