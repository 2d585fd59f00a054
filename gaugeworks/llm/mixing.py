"""Mixing sources to target weights (operator 8), in DataFrame functions only.

Every source is one stream of words, cut into blocks of a fixed length: 32 words, doubled up to 256 while the source
still has 16,384 blocks, and from there on as far as its blocks stay below 2^31, whatever its size.  The mix is a number of output
shards of SHARD_SLOTS slots.  Each slot draws its source by a seeded hash of its number, so a shard's
source counts are multinomial.  Counts are then corrected along the shards so that each source's total
is exact: its cumulative count is scaled to the total and rounded down, which moves a shard by a slot
or two.  The k-th slot of a source takes the block that the source's own keyed permutation gives for
k, and slots and blocks are joined by (source, block).

The permutation of a source's n blocks is their order by a keyed hash: cells of the hash's range are
ranked by themselves, and a block's place is its rank in its cell after all blocks of earlier cells.
Hashes are affine maps modulo two primes in turn, with a square between, in whole numbers, so that SQL
can compute the same and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WORD = "[^\\x20\\x09-\\x0D]+"
#: Words of the shortest blocks.
BLOCK_WORDS = 32
#: A source's blocks are doubled while they are more than 2^14, three times at most, and beyond that while they are more than 2^30.
DOUBLED = (*range(14, 17), *range(33, 63))
#: Slots of an output shard.
SHARD_SLOTS = 1024
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
#: Documents of a stretch, within which sizes are summed one after the other.
STRETCH_ROWS = 512
#: Stretches, or shards, whose sums make one row of the next level.
LEVEL = 1024
SEED = 42
#: Blocks of a cell of a source's permutation.
CELL_BLOCKS = 4096
#: Blocks that one row stands for before it is opened.
RUN = 1 << 14
#: Sources whose totals may be sent to every task (some 20 MB).
FEW_SOURCES = 200_000
#: Cells of the unit interval that draws and sources meet by.
CELLS = 4096
# fixed values: the two largest primes below 2^31 and multipliers below them
PRIME, OTHER = 2147483647, 2147483629
TIMES = (1103515245, 1664525, 214013)


def hashed(x: Column) -> Column:
    """Of x in [0, 2^32): a number below PRIME."""
    return ((x.cast("long") * TIMES[0] + SEED) % PRIME * TIMES[1] + SEED) % OTHER * TIMES[2] % PRIME


def scattered(df: DataFrame, x: Column, name: str) -> DataFrame:
    """df with a number below PRIME drawn by x: an affine map alone would spread its values too evenly, their squares scatter."""
    return df.withColumn("_y", hashed(x)).withColumn(name, hashed(F.col("_y") * F.col("_y") % PRIME)).drop("_y")


def _running(df: DataFrame, at: str, value: str) -> DataFrame:
    """df with `before`: what rows of its source_no with a smaller `at` (a whole number, once for each source) sum to.

    Sums of LEVEL numbers first, then over those sums, so that no task takes a source's rows one by one."""
    g = df.withColumn("_g", F.floor(F.col(at) / LEVEL))
    inside = Window.partitionBy("source_no", "_g").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("source_no").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    sums = g.groupBy("source_no", "_g").agg(F.sum(value).alias("_n")).select("source_no", "_g", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_earlier"))
    # here and below: a plan's guess of a size doesn't see what explode makes of a few rows, so joins of many rows are asked for by name
    out = g.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).hint("shuffle_merge").join(sums, ["source_no", "_g"])
    return out.withColumn("before", F.col("_earlier") + F.col("_inside")).drop("_g", "_inside", "_earlier")


def _targets(sizes: DataFrame) -> DataFrame:
    """source, source_no (by code point, null last), source_size, target.

    Water-filling: sources in the order of what their limit is worth by weight are full as long as
    the common level would lift them over their limits; the others share the rest by weight.  One row
    per source passes these windows."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "source_no")
    to_here = by_limit.rowsBetween(Window.unboundedPreceding, 0)
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("source_no", F.row_number().over(by_name) - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("source_no") % len(WEIGHTS) + 1).cast("int")))
    s = s.withColumn("limit", F.col("source_size") * F.lit(MOST)).withColumn("all", F.sum("source_size").over(every) * F.lit(SHARE)).withColumn("weights", F.sum("weight").over(every))
    s = s.withColumn("level", (F.col("all") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    s = s.withColumn("full", F.col("level") * F.col("weight") >= F.col("limit"))
    # the level of the first source that isn't full holds for it and for all behind it
    s = s.withColumn("first", F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(to_here))
    return s.select("source", "source_no", "source_size", F.coalesce(F.col("first") * F.col("weight"), F.col("limit")).alias("target"))


def sized(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """row (a number for each row, fixed by writing the table), doc_id, source, size."""
    row = F.col("row") if "row" in docs.columns and text != "text" else F.monotonically_increasing_id()
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return common.write_table(docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size")), "mix-sizes")


def shard_counts(sources: DataFrame) -> DataFrame:
    """shard, source_no, drawn, first, last: the multinomial draw of each shard, and the slots [first, last) of the source that it gets.

    sources: source_no, n_slots, the slots `earlier` of sources before it; the driver takes the number of all slots."""
    spark = sources.sparkSession
    one = sources.agg(F.sum("n_slots").alias("slots"), F.count(F.lit(1)).alias("n")).first()
    total = one["slots"] or 0
    # tables of a few rows per source go to all tasks while there are few sources
    few = "broadcast" if one["n"] <= FEW_SOURCES else "shuffle_merge"
    shards = -(-total // SHARD_SLOTS)
    share = lambda x: x / F.lit(max(total, 1)) * F.lit(CELLS)
    # a source's cells, and one to each side for rounding: CELLS and three for each source at most
    cells = sources.where("n_slots > 0").select("source_no", "n_slots", "earlier", F.explode(F.sequence(F.floor(share(F.col("earlier"))) - 1, F.floor(share(F.col("earlier") + F.col("n_slots"))) + 1)).alias("cell"))
    slots = spark.range(0, shards, 1, max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards // 4096)).select(F.col("id").alias("shard"))
    slots = slots.select("shard", F.explode(F.sequence(F.col("shard") * SHARD_SLOTS, F.least((F.col("shard") + 1) * SHARD_SLOTS, F.lit(total)) - 1)).alias("t"))
    slots = scattered(slots, (F.col("t") % PRIME + F.floor(F.col("t") / PRIME) * 7919) % PRIME, "w")
    slots = slots.select("shard", F.floor(F.col("w") / F.lit(PRIME) * F.lit(total)).alias("v"), F.floor(F.col("w") / F.lit(PRIME) * F.lit(CELLS)).alias("cell"))
    met = slots.join(cells.hint(few), "cell").where((F.col("v") >= F.col("earlier")) & (F.col("v") < F.col("earlier") + F.col("n_slots")))
    counts = met.groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("drawn"))
    # a source so small that no slot drew it goes to one shard
    counts = common.write_table(counts, "mix-draws")
    none = sources.where("n_slots > 0").join(counts.select("source_no").distinct(), "source_no", "left_anti")
    every = counts.unionByName(none.select((hashed(F.col("source_no")) % F.lit(max(shards, 1))).alias("shard"), "source_no", F.lit(1).cast("long").alias("drawn")))
    totals = every.groupBy("source_no").agg(F.sum("drawn").alias("all")).join(sources.select("source_no", "n_slots"), "source_no")
    r = _running(every, "shard", "drawn").join(totals.hint(few), "source_no")
    scaled = lambda c: F.when(c == F.col("all"), F.col("n_slots")).otherwise(F.floor(c.cast("double") * (F.col("n_slots") / F.col("all"))))
    return r.select("shard", "source_no", "drawn", scaled(F.col("before")).alias("first"), scaled(F.col("before") + F.col("drawn")).alias("last"))


def permuted(sources: DataFrame) -> DataFrame:
    """source_no, n_blocks, n_slots, block, place: the permutation of each source's blocks."""
    runs = sources.where("n_slots > 0").select("source_no", "n_blocks", "n_slots", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_blocks") - 1) / RUN))).alias("run"))
    # spread the runs before they are opened: a source may have a third of all blocks
    runs = runs.repartition("source_no", "run")
    b = runs.select("source_no", "n_blocks", "n_slots", F.explode(F.sequence(F.col("run") * RUN, F.least((F.col("run") + 1) * RUN, F.col("n_blocks")) - 1)).alias("block"))
    b = scattered(b, (F.col("block") + hashed(F.col("source_no") % PRIME)) % PRIME, "w")
    b = b.withColumn("cell", F.floor(F.col("w") / F.lit(PRIME) * F.ceil(F.col("n_blocks") / CELL_BLOCKS)))
    sizes = _running(b.groupBy("source_no", "cell").agg(F.count(F.lit(1)).alias("n")), "cell", "n").select("source_no", "cell", "before")
    rank = F.row_number().over(Window.partitionBy("source_no", "cell").orderBy("w", "block")) - 1
    return b.withColumn("rank", rank).hint("shuffle_merge").join(sizes, ["source_no", "cell"]).select("source_no", "n_blocks", "n_slots", "block", (F.col("before") + F.col("rank")).alias("place"))


def slots(sources: DataFrame) -> DataFrame:
    """source_no, k (which of its source's slots), shard, block: a row for each slot of the mix."""
    k = shard_counts(sources).where("last > first").select("source_no", "shard", F.explode(F.sequence(F.col("first"), F.col("last") - 1)).alias("k"))
    # a source's slots go through its permutation once, and then backwards: a block is taken twice at most
    both = permuted(sources).select("source_no", "block", "n_slots", F.explode(F.array("place", 2 * F.col("n_blocks") - 1 - F.col("place"))).alias("k")).where("k < n_slots").drop("n_slots")
    return k.hint("shuffle_merge").join(both, ["source_no", "k"])


def _sources(sizes: DataFrame, block_words: int) -> DataFrame:
    """_targets with length (words of the source's blocks), n_blocks, n_slots, and the slots `earlier` of sources before it."""
    whole = lambda n, d: F.expr(f"({n} + {d} - 1) div ({d})")
    s = _targets(sizes).withColumn("shortest", whole("source_size", block_words))
    doubled = sum((F.col("shortest") > F.lit(1 << i)).cast("int") for i in DOUBLED)
    s = s.withColumn("length", F.lit(block_words).cast("long") * F.pow(F.lit(2), doubled).cast("long")).withColumn("n_blocks", whole("source_size", "length")).drop("shortest")
    wanted = F.least(F.round(F.col("target") * F.col("n_blocks") / F.greatest("source_size", F.lit(1))).cast("long"), 2 * F.col("n_blocks"))
    earlier = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    return s.withColumn("n_slots", wanted).withColumn("earlier", F.coalesce(F.sum("n_slots").over(earlier), F.lit(0)))


def drawn(sizes: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: row, doc_id, size, source_no, source_size, target; sources; blocks of documents: row, source_no, block, size,
    first and last word that they take from the document (from 0))."""
    count = sizes.count()
    sources = common.write_table(_sources(sizes, block_words), "mix-sources")  # a row per source
    # written small, so that Spark knows that it can send it along
    d = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).select("row", "doc_id", "size", "source_no", "source_size", "target", "length")

    # where a document starts in its source's stream: summed within stretches, then over stretches; empty ones are nowhere
    stretches = max(1, -(-count // STRETCH_ROWS))
    own = F.coalesce(F.pmod("doc_id", F.lit(PRIME)), F.pmod("row", F.lit(PRIME)))
    cut = d.where("size > 0").select("row", "doc_id", "size", "source_no", "length", (hashed(own + F.col("size")) % stretches).alias("stretch"))
    lengths = _running(cut.groupBy("source_no", "stretch").agg(F.sum("size").alias("n")), "stretch", "n").select("source_no", "stretch", "before")
    inside = Window.partitionBy("source_no", "stretch").orderBy(F.col("doc_id").asc_nulls_first(), "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).hint("shuffle_merge").join(lengths, ["source_no", "stretch"])
    placed = placed.select("row", "size", "source_no", "length", (F.col("before") + F.col("inside")).alias("start"))
    parts = placed.select("*", F.explode(F.sequence(F.expr("start div length"), F.expr("(start + size - 1) div length"))).alias("block"))
    begin = F.greatest("start", F.col("block") * F.col("length")) - F.col("start")
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("length")) - F.col("start")
    return d.drop("length"), sources, parts.select("row", "source_no", "block", "size", begin.alias("begin"), end.alias("end"))


def blocks_of_mix(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix by shards: shard, source_no, k (of the source's slots), doc_id, begin, end (the words of the document that the slot holds)."""
    sizes = sized(docs)
    _, sources, parts = drawn(sizes, block_words)
    return slots(sources).hint("shuffle_merge").join(parts, ["source_no", "block"]).join(sizes.select("row", "doc_id"), "row").select("shard", "source_no", "k", "doc_id", "begin", "end")


def _taken(sources: DataFrame, parts: DataFrame) -> DataFrame:
    """parts with times (how often the mix takes the block) and its first and last shard."""
    times = slots(sources).groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    return parts.hint("shuffle_merge").join(times, ["source_no", "block"])


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, and the first and last shard that has words of it (null: none).

    Null and empty texts have size 0 and are never taken; a null source is a source of its own, last in
    order.  Repeated rows and null doc_ids are documents like any other.  All targets are 0 where all
    sizes are 0.  Only doc_id, text and source are read; an empty table gives no rows."""
    d, sources, parts = drawn(sized(docs), block_words)
    taken = _taken(sources, parts).groupBy("row").agg(F.sum((F.col("end") - F.col("begin")) * F.col("times")).alias("taken"), F.min("first_shard").alias("first_shard"), F.max("last_shard").alias("last_shard"))
    return d.hint("shuffle_merge").join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard", "last_shard")


def mixed(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as documents, in docs' columns: the first copy of a document holds the words taken at least once, the
    second those taken twice.  A copy of all words keeps the text as it is; other copies have single spaces."""
    rows, scan = common.numbered(docs)
    _, sources, parts = drawn(sized(scan, "doc.text", "doc.source"), block_words)
    # of one document: a range for each of its own blocks
    ranges = _taken(sources, parts).groupBy("row").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("begin", "end", "times"))).alias("ranges"))
    copies = ranges.select("row", "size", "ranges", F.explode(F.sequence(F.lit(1), F.array_max(F.transform("ranges", lambda r: r["times"])))).alias("copy"))
    held = copies.select("row", "size", F.filter("ranges", lambda r: r["times"] >= F.col("copy")).alias("ranges"))
    held = held.withColumn("words", F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["begin"])).withColumn("part", F.shiftright("row", 33).cast("int"))
    both = rows.hint("shuffle_merge").join(held, ["part", "row"])  # rows are bucketed by part, so no text moves
    # split once for a document, not for each range
    part = F.concat_ws(" ", F.flatten(F.transform(F.array(F.regexp_extract_all("doc.text", F.lit(WORD), F.lit(0))), lambda words: F.flatten(F.transform("ranges", lambda r: F.slice(words, (r["begin"] + 1).cast("int"), (r["end"] - r["begin"]).cast("int")))))))
    text = F.when(F.col("words") == F.col("size"), F.col("doc.text")).otherwise(part)
    new = both.select("doc", text.alias("new"))
    return new.select(*((F.col("new") if c == "text" else F.length("new").cast("long") if c == "n_chars" else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


def op8_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.documents(spark, sf_dir))


def oracle_sql(block_words: int = BLOCK_WORDS) -> str:
    h = lambda x: f"((({x}) * {TIMES[0]} + {SEED}) % {PRIME} * {TIMES[1]} + {SEED}) % {OTHER} * {TIMES[2]} % {PRIME}"
    doubled = " + ".join(f"cast(shortest > {1 << i} as integer)" for i in DOUBLED)
    return f"""
with d as (select row_number() over () as row, doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size from documents),
s0 as (select source, sum(size) as source_size, row_number() over (order by source nulls last) - 1 as source_no from d group by source),
s1 as (select *, [3, 1, 2][source_no % 3 + 1] as weight, source_size * {MOST} as cap, (select sum(source_size) from s0) * {SHARE} as total from s0),
s2 as (select *, (total - coalesce(sum(cap) over (order by cap / weight, source_no rows between unbounded preceding and 1 preceding), 0))
              / ((select sum(weight) from s1) - coalesce(sum(weight) over (order by cap / weight, source_no rows between unbounded preceding and 1 preceding), 0)) as level from s1),
s3 as (select *, first_value(case when level * weight < cap then level end ignore nulls) over (order by cap / weight, source_no rows between unbounded preceding and current row) as lvl from s2),
s4 as (select source, source_no, cast(source_size as bigint) as source_size, coalesce(lvl * weight, cast(cap as double)) as target, {block_words} * cast(2 ** ({doubled}) as bigint) as length from (select *, (cast(source_size as bigint) + {block_words} - 1) // {block_words} as shortest from s3)),
s4b as (select *, (source_size + length - 1) // length as n_blocks from s4),
s5 as (select *, least(cast(round(target * n_blocks / greatest(source_size, 1)) as bigint), 2 * n_blocks) as n_slots from s4b),
s as materialized (select *, cast(coalesce(sum(n_slots) over (order by source_no rows between unbounded preceding and 1 preceding), 0) as bigint) as earlier, cast(sum(n_slots) over () as bigint) as slots from s5),
t as (select unnest(range(0, (select max(slots) from s))) as t),
y as (select t, {h(f'(t % {PRIME} + t // {PRIME} * 7919) % {PRIME}')} as y from t),
w as (select t, cast(floor(({h(f'y * y % {PRIME}')}) / {PRIME} * (select max(slots) from s)) as bigint) as v from y),
c0 as (select t // {SHARD_SLOTS} as shard, source_no, count(*) as drawn from w join s on v >= earlier and v < earlier + n_slots group by all),
c1 as (select * from c0 union all select ({h('source_no')}) % greatest(1, (slots + {SHARD_SLOTS - 1}) // {SHARD_SLOTS}), source_no, 1 from s where n_slots > 0 and source_no not in (select source_no from c0)),
c2 as (select shard, source_no, drawn, n_slots, n_blocks, cast(sum(drawn) over (partition by source_no order by shard) as bigint) as upto, cast(sum(drawn) over (partition by source_no) as bigint) as every from c1 join s using (source_no)),
c3 as (select *, case when upto - drawn = every then n_slots else cast(floor(cast(upto - drawn as double) * (n_slots / every)) as bigint) end as lo, case when upto = every then n_slots else cast(floor(cast(upto as double) * (n_slots / every)) as bigint) end as hi from c2),
k as (select source_no, shard, unnest(range(lo, hi)) as k from c3),
b0 as (select source_no, n_blocks, n_slots, unnest(range(0, n_blocks)) as block from s where n_slots > 0),
b1 as (select *, {h(f"(block + {h('source_no')}) % {PRIME}")} as y from b0),
b2 as (select source_no, n_blocks, n_slots, block, row_number() over (partition by source_no order by {h(f"y * y % {PRIME}")}, block) - 1 as place from b1),
b3 as (select source_no, n_slots, block, unnest([place, 2 * n_blocks - 1 - place]) as k from b2),
b as (select b3.source_no, block, count(*) as times, min(shard) as a, max(shard) as z from b3 join k on k.source_no = b3.source_no and k.k = b3.k where b3.k < n_slots group by 1, 2),
e as (select d.*, s.source_no, s.source_size, s.target, s.length from d join s on d.source is not distinct from s.source),
st as (select *, ({h(f'coalesce((doc_id % {PRIME} + {PRIME}) % {PRIME}, row % {PRIME}) + size')}) % cast(greatest(1, ceil((select count(*) from d) / {STRETCH_ROWS}.0)) as bigint) as stretch from e where size > 0),
a as (select *, cast(coalesce(sum(size) over (partition by source_no order by stretch, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0) as bigint) as start from st),
p as (select row, size, source_no, start, length, unnest(range(start // length, (start + size - 1) // length + 1)) as block from a),
x as (select row, sum((least(start + size, (block + 1) * length) - greatest(start, block * length)) * times) as taken, min(a) as first_shard, max(z) as last_shard from p join b using (source_no, block) group by row)
select doc_id, size, source_size, target, cast(coalesce(taken, 0) as bigint) as taken, cast(first_shard as bigint) as first_shard, cast(last_shard as bigint) as last_shard from e left join x using (row)"""
