"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only.

Every source has a weight; together they share all words. A source's target stops at ``repeats``
times its own words, and the excess is shared again by weight until no target is above. Targets
become whole numbers of blocks of ``block`` words: the blocks of the mix go to the sources of the
highest quotients target / (2 * blocks so far + 1), and a source's blocks go in the same way to
its shards by their words. So each shard has a quota of its own, and no task sees a source.

The quotients are not listed one by one. Where the divisor must lie is known to within half a
block for each party, so all blocks below are given at once, and only the few that are left (about
as many as there are parties) are ranked.

A shard's documents lie in the order of their hashes as one run of words, cut into equal blocks. A
quota of more words than the run has takes it whole as often as it goes; the blocks of the rest
are those that a seeded permutation of the block numbers puts first, and the one behind them
gives the words that are still missing to a whole number of blocks of the quota. A document's
``taken`` is what the blocks take of its words, so no document is taken more often than ``repeats`` times.

Defined results: null and empty texts have no words and are taken 0 times; the null source is a
source, the last one; sources without words have the target 0. Equal rows (id, text) share their
place in the order and may be taken differently. Null ids are ids. An empty table gives an empty
mix; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, written

#: Words of a block: small, so that small sources come near their targets too.
BLOCK = 8
#: Documents and words of a shard, about.
SHARD_DOCS, SHARD_WORDS = 1 << 14, 1 << 28
#: Prime multipliers of the permutations, above any number of blocks in a shard.
PRIMES = (4294967291, 4294967279, 4294967231, 4294967197, 4294967189, 4294967161, 4294967143, 4294967111)
_WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, seed: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id``, ``source``, ``size`` in words and ``place``, a 60-bit hash of seed, id and text."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit("")), F.lit(":"), text))
    size = F.coalesce(F.regexp_count(docs[text_col].cast("string"), F.lit(_WORD)), F.lit(0)).cast("long")
    return docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), size.alias("size"), F.conv(F.substring(key, 1, 15), 16, 10).cast("long").alias("place"))


def targets(sources: DataFrame, repeats: int) -> DataFrame:
    """``sources`` (weight, words) with ``target``: each round counts whole numbers only, so the doubles do not depend on an order."""
    total = sources.agg(F.sum("words")).first()[0] or 0
    full = F.lit(False)
    rate, known = 0.0, -1
    while True:
        row = sources.agg(F.coalesce(F.sum(F.when(full, F.col("words") * repeats)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)), F.count(F.when(full, 1))).first()
        if row[2] == known or not row[1]:
            break
        known, rate = row[2], (total - row[0]) / row[1]
        full = full | (F.col("weight") * F.lit(rate) > F.col("words") * repeats)
    return sources.withColumn("target", F.when(full, (F.col("words") * repeats).cast("double")).otherwise(F.col("weight") * F.lit(rate)))


def apportion(parties: DataFrame, group: Sequence[str], key: str, share: str, seats: Column, cap: str) -> DataFrame:
    """``parties`` with ``seats``: those of their group (a column), dealt by highest quotients share / (2 * seats + 1).

    Nobody gets more than ``cap``; ties go to the smaller ``key``; parties without a share get nothing.
    """
    alike = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_g{i}") for i, c in enumerate(group)]
    marks = [f"_g{i}" for i in range(len(group))]
    # nulls of a group's columns are marked, as they are values here
    rows = parties.select("*", *alike, *[F.col(c).isNull().alias(f"_n{i}") for i, c in enumerate(group)], seats.cast("long").alias("_all"))
    marks += [f"_n{i}" for i in range(len(group))]
    of = Window.partitionBy(*marks) if marks else Window.partitionBy(F.lit(1))
    share_of, n = F.sum(share).over(of), F.sum(F.when(F.col(share) > 0, 1).otherwise(0)).over(of)
    rows = rows.withColumn("_sum", share_of).withColumn("_n", n)

    def at(count: Column) -> Column:
        """Seats by the divisor that would give ``count`` of them without rounding."""
        return F.when((F.col(share) > 0) & (count > 0), F.least(F.col(cap), F.floor(F.col(share) * count / F.col("_sum") + 0.5))).otherwise(0).cast("long")

    rows = rows.withColumn("_low", at(F.col("_all") - F.col("_n") / 2))
    ceiling = F.when(F.col(share) > 0, F.least(F.col(cap), F.ceil(F.col(share) * F.col("_all") / F.col("_sum")) + 1)).otherwise(0)
    rows = rows.withColumn("_high", F.greatest(at(F.col("_all") + F.col("_n") / 2), ceiling).cast("long"))
    rows = rows.withColumn("_left", F.col("_all") - F.sum("_low").over(of))
    offers = rows.where("_high > _low").select(*marks, key, "_left", F.explode(F.sequence("_low", F.col("_high") - 1)).alias("_seat"), F.col(share).alias("_share"))
    order = Window.partitionBy(*(marks or [F.lit(1)])).orderBy(F.desc(F.col("_share") / (2 * F.col("_seat") + 1)), F.asc(key), "_seat")
    won = offers.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= F.col("_left")).groupBy(*marks, key).agg(F.count("*").alias("_more"))
    joined = rows.join(won, [*marks, key], "left")
    return joined.select(*parties.columns, (F.col("_low") + F.coalesce("_more", F.lit(0))).alias("seats"))


def shares(sizes: DataFrame, weights: Sequence[int], repeats: int, block: int) -> DataFrame:
    """A row for each source: ``rank``, ``source``, ``words``, ``target``, ``shards`` and ``seats`` (blocks)."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)  # a row for each source
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    shards = F.greatest(F.ceil(F.col("docs") / SHARD_DOCS), F.ceil(F.col("words") / SHARD_WORDS)).cast("long")
    aimed = targets(written(ranked.withColumn("weight", weight).withColumn("shards", shards), "sources"), repeats)
    cap = F.ceil(F.col("words") * repeats / block).cast("long")
    total = aimed.agg(F.sum("words")).first()[0] or 0
    return apportion(aimed.withColumn("cap", cap), [], "rank", "target", F.lit(total // block), "cap").drop("cap", "weight", "docs")


def quotas(sizes: DataFrame, sources: DataFrame, repeats: int, block: int) -> DataFrame:
    """A row for each source's shard: ``rank``, ``shard``, ``run`` (its words) and ``seats`` (blocks to take)."""
    same = sizes["source"].eqNullSafe(sources["source"])
    placed = sizes.join(sources, same).select("rank", "target", F.col("seats").alias("of_source"), F.pmod("place", F.col("shards")).alias("shard"), "size")
    cells = placed.groupBy("rank", "shard").agg(F.sum("size").alias("run"), F.first("of_source").alias("of_source"))
    cap = F.ceil(F.col("run") * repeats / block).cast("long")
    return apportion(cells.withColumn("cap", cap), ["rank"], "shard", "run", F.col("of_source"), "cap").drop("cap", "of_source")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), repeats: int = 3, block: int = BLOCK, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target`` of its source and ``taken`` words of each document.

    Sources in order of code points, null last, have the ``weights`` in turn.
    """
    spark = docs.sparkSession
    with scratch(spark):
        sizes = written(sized(docs, seed, id_col, text_col, source_col), "sizes", lasting=True)
        sources = written(shares(sizes, weights, repeats, block), "shares", lasting=True)
        cells = written(quotas(sizes, sources, repeats, block), "quotas", lasting=True)
    same = sizes["source"].eqNullSafe(sources["source"])
    placed = sizes.join(sources, same).select("doc_id", "size", "place", F.col("words").alias("source_size"), "target", "rank", F.pmod("place", F.col("shards")).alias("shard"))
    start = F.sum("size").over(Window.partitionBy("rank", "shard").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    rows = placed.withColumn("start", F.coalesce(start, F.lit(0))).join(cells, ["rank", "shard"])

    rows = rows.withColumn("wanted", F.least(F.col("seats") * block, F.col("run") * repeats))
    rows = rows.withColumn("whole", F.when(F.col("run") > 0, F.floor(F.col("wanted") / F.col("run"))).otherwise(0)).withColumn("rest", F.col("wanted") - F.col("whole") * F.col("run"))
    rows = rows.withColumn("blocks", F.floor(F.col("run") / block)).withColumn("full", F.floor(F.col("rest") / block)).withColumn("piece", F.col("rest") % block)
    turn = F.pmod(F.lit(seed) * 7919 + F.col("rank") * 104729 + F.col("shard") * 1299709, F.lit(2**31 - 1))
    factor = F.element_at(F.array(*map(F.lit, PRIMES)), (turn % len(PRIMES) + 1).cast("int"))
    rows = rows.withColumn("factor", F.when(F.col("blocks") > 0, factor % F.col("blocks")).otherwise(0)).withColumn("turn", turn)
    end = F.col("start") + F.col("size")

    def words(b: Column) -> Column:
        """Words of the document that block number ``b`` takes; the number behind the last is the run's tail."""
        order = F.when(b < F.col("blocks"), F.pmod(F.col("factor") * b + F.col("turn"), F.col("blocks"))).otherwise(F.col("blocks"))
        upto = F.when(order < F.col("full"), F.lit(block)).when(order == F.col("full"), F.col("piece")).otherwise(0)
        return F.greatest(F.lit(0).cast("long"), F.least(end, b * block + upto) - F.greatest(F.col("start"), b * block))

    covered = F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))
    part = F.when((F.col("size") > 0) & (F.col("rest") > 0), F.aggregate(covered, F.lit(0).cast("long"), lambda a, b: a + words(b))).otherwise(0)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken"))


def _apportioned(rows: str, group: str, key: str, share: str) -> str:
    """SQL of all quotients of ``rows`` (with columns seats_of, cap), the highest of which win."""
    return f"""select {group} {key}, count(*) as seats from (select *, row_number() over (partition by {group or "1,"} 1 order by {share}::double / (2 * seat + 1) desc, {key}, seat) as nth
        from (select *, unnest(range(0, cap)) as seat from {rows} where {share} > 0)) where nth <= seats_of group by all"""


ORACLE = rf"""
with recursive sizes as materialized (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5('1:' || coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, 15))::bigint as place from documents),
ranked as materialized (select *, (row_number() over (order by source nulls last) - 1)::bigint as rank from (select source, sum(size)::bigint as words, count(*) as docs from sizes group by source)),
weighed as materialized (select *, [5, 2, 1][(rank % 3 + 1)::int] as weight, greatest(ceil(docs / {SHARD_DOCS}), ceil(words / {SHARD_WORDS}))::bigint as shards, ceil(words * 3 / {BLOCK})::bigint as cap, (sum(words) over () // {BLOCK})::bigint as seats_of from ranked),
rates as (select 0 as step, -1::double as rate, -1::bigint as known union all
    select step + 1, (select (sum(words) - coalesce(sum(case when r.step > 0 and weight * r.rate > words * 3 then words * 3 end), 0))::double / sum(case when r.step > 0 and weight * r.rate > words * 3 then 0 else weight end) from weighed),
           (select count(*) filter (where r.step > 0 and weight * r.rate > words * 3) from weighed)
    from rates r where step < 60 and not isnan(rate)
        and (select count(*) filter (where r.step > 0 and weight * r.rate > words * 3) from weighed) <> r.known
        and (select count(*) filter (where not (r.step > 0 and weight * r.rate > words * 3)) from weighed) > 0),
rate as (select rate from rates order by step desc limit 1),
aimed as materialized (select *, case when weight * rate > words * 3 then (words * 3)::double else weight * rate end as target from weighed, rate),
given as materialized ({_apportioned("aimed", "", "rank", "target")}),
placed as materialized (select doc_id, size, place, rank, place % shards as shard, words as source_size, target, coalesce(seats, 0) as seats_of from sizes join aimed on sizes.source is not distinct from aimed.source left join given using (rank)),
cells as materialized (select rank, shard, sum(size)::bigint as run, any_value(seats_of) as seats_of, ceil(sum(size) * 3 / {BLOCK})::bigint as cap from placed group by rank, shard),
quota as materialized ({_apportioned("cells", "rank,", "shard", "run")}),
laid as (select p.*, coalesce(sum(size) over (partition by rank, shard order by place, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as start, run, least(coalesce(seats, 0) * {BLOCK}, run * 3) as wanted
    from placed p join cells using (rank, shard) left join quota using (rank, shard)),
cut as (select *, case when run > 0 then wanted // run else 0 end as whole, case when run > 0 then wanted % run else 0 end as rest, run // {BLOCK} as blocks,
    (7919 + rank * 104729 + shard * 1299709) % 2147483647 as turn, {list(PRIMES)}[(turn % {len(PRIMES)} + 1)::int] as prime from laid),
words as (select *, unnest(case when size > 0 and rest > 0 then range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1) else [-1] end) as b from cut),
taken as (select *, case when b < 0 then -1 when b < blocks then ((prime % blocks) * b + turn) % blocks else blocks end as nth,
    case when b < 0 then 0 when nth < rest // {BLOCK} then {BLOCK} when nth = rest // {BLOCK} then rest % {BLOCK} else 0 end as upto from words)
select doc_id, size, source_size, target, (whole * size + sum(greatest(0, least(start + size, b * {BLOCK} + upto) - greatest(start, b * {BLOCK}))))::bigint as taken
from taken group by doc_id, size, place, start, source_size, target, whole, rank, shard
"""
