"""Byte streams as relations: runs, run-length tokens, repeat packets.

A stream is keyed by ``stream`` and ordered by ``i``; windows are partitioned by stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def capped_runs(bytes_: DataFrame, cap: int) -> DataFrame:
    """Runs of equal bytes, cut at ``cap``: (stream, start, v, n), ``start`` counted from 0."""
    w = Window.partitionBy("stream").orderBy("i")
    rows = bytes_.withColumn("pos", F.row_number().over(w) - 1).withColumn("new", F.when(F.lag("v").over(w) == F.col("v"), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("new").over(w))
    rows = rows.withColumn("piece", F.floor((F.row_number().over(Window.partitionBy("stream", "run").orderBy("i")) - 1) / cap))
    return rows.groupBy("stream", "run", "piece").agg(F.min("pos").cast("long").alias("start"), F.first("v").alias("v"), F.count("*").alias("n")).select("stream", "start", "v", "n")


def rle_tokens(bytes_: DataFrame, cap: int = 127, shortest: int = 3) -> DataFrame:
    """Tokens of the run/literal codec: (stream, start, kind, n); runs of ``shortest`` or more are ``run``
    tokens of one value, what lies between is ``literal`` tokens of at most ``cap`` bytes."""
    runs = capped_runs(bytes_, cap)
    w = Window.partitionBy("stream").orderBy("start")
    is_run = F.col("n") >= shortest
    groups = runs.withColumn("g", F.sum(F.when(is_run, 1).otherwise(0)).over(w)).withColumn("kind", F.when(is_run, "run").otherwise("literal"))
    own = groups.where(is_run).select("stream", "start", "kind", "n")
    literal = groups.where(~is_run).groupBy("stream", "g").agg(F.min("start").alias("s"), F.sum("n").alias("total"))
    cut = literal.select("stream", "s", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / cap))).alias("j"))
    cut = cut.select("stream", (F.col("s") + F.col("j") * cap).alias("start"), F.lit("literal").alias("kind"), F.least(F.lit(cap), F.col("total") - F.col("j") * cap).alias("n"))
    return own.unionByName(cut)


def rarest_byte(bytes_: DataFrame) -> DataFrame:
    """(stream, tag): the smallest byte that does not occur, else the smallest of the least used."""
    counts = bytes_.groupBy("stream", "v").agg(F.count("*").alias("n"))
    used = counts.groupBy("stream").agg(F.map_from_entries(F.collect_list(F.struct(F.col("v").cast("int"), "n"))).alias("m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: F.struct(F.coalesce(F.element_at("m", v), F.lit(0).cast("long")).alias("n"), v.alias("v")))
    return used.select("stream", F.array_min(every)["v"].alias("tag"))


def tagged_tokens(bytes_: DataFrame, cap: int = 255) -> DataFrame:
    """Tokens of the tagged run codec: (stream, start, bytes in hex).

    The stream opens with its tag (start -1) and ends with the tag and 0. A run is its value, then again for two, or
    tag and length - 1 for more; a value that is the tag itself is followed by 1.
    """
    byte = lambda v: F.lower(F.lpad(F.hex(v), 2, "0"))
    tags = rarest_byte(bytes_).withColumn("mark", byte(F.col("tag")))
    runs = capped_runs(bytes_, cap).join(tags, "stream")
    literal = F.concat(byte(F.col("v")), F.when(F.col("v") == F.col("tag"), "01").otherwise(""))
    again = F.when(F.col("n") == 2, literal).when(F.col("n") > 2, F.concat("mark", byte(F.col("n") - 1))).otherwise("")
    body = runs.select("stream", "start", F.concat(literal, again).alias("bytes"))
    head = tags.select("stream", F.lit(-1).cast("long").alias("start"), F.col("mark").alias("bytes"))
    end = runs.groupBy("stream").agg(F.max(F.col("start") + F.col("n")).alias("start"), F.concat(F.first("mark"), F.lit("00")).alias("bytes"))
    return head.unionByName(body).unionByName(end)


def packets(bytes_: DataFrame, distance: int) -> DataFrame:
    """Repeat packets of eight bytes: (stream, packet, control, literals in hex).

    Bit 7 - i of control is set where byte i equals the one ``distance`` places before it; bytes before the
    first are 0. The last packet is filled up by repeating its last ``distance`` bytes.
    """
    w = Window.partitionBy("stream").orderBy("i")
    rows = bytes_.withColumn("pos", F.row_number().over(w) - 1).select("stream", "pos", "v")
    listed = rows.groupBy("stream", F.floor(F.col("pos") / 8).alias("packet")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("b"))
    before = F.lag("b").over(Window.partitionBy("stream").orderBy("packet"))
    n = F.size("b")
    if distance == 1:
        full = F.concat("b", F.array_repeat(F.element_at("b", -1), F.lit(8) - n))
    else:
        # an odd packet first repeats what stands two places before its end (of the packet before if it is alone)
        even = F.when(n % 2 == 0, F.col("b")).when(n == 1, F.concat("b", F.array(F.coalesce(F.element_at("prev", -1), F.lit(0))))).otherwise(F.concat("b", F.array(F.element_at("b", -2))))
        full = F.slice(F.concat("even", F.flatten(F.array_repeat(F.slice("even", -2, 2), 4))), 1, 8)
    out = listed.withColumn("prev", F.coalesce(before, F.array(*[F.lit(0)] * 8)))
    if distance != 1:
        out = out.withColumn("even", even)
    out = out.withColumn("full", F.when(n == 8, F.col("b")).otherwise(full)).withColumn("seen", F.concat(F.slice("prev", -distance, distance), "full"))
    same = F.transform("full", lambda v, i: F.get("seen", i) == v)
    bits = F.array(*[F.lit(128 >> i) for i in range(8)])
    control = F.aggregate(F.transform(same, lambda s, i: F.when(s, F.get(bits, i)).otherwise(0)), F.lit(0), lambda a, x: a + x)
    literal = F.filter(F.transform("full", lambda v, i: F.when(F.get("seen", i) == v, F.lit(None)).otherwise(v)), lambda v: v.isNotNull())
    return out.select("stream", "packet", control.alias("control"), F.lower(F.array_join(F.transform(literal, lambda v: F.lpad(F.hex(v), 2, "0")), "")).alias("literals"))
