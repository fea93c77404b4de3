"""Mixing sources to target weights, in DataFrame functions only.

The words of each source are laid end to end and cut into blocks of a fixed length. Every slot of
an output shard draws a source, so that the source counts of a shard are multinomial. Chance leaves
the totals of the sources off their targets; the counts are then corrected in proportion, shard
after shard, until the totals are met. The slots of a source walk its blocks through one
pseudorandom permutation of their indices per pass, and blocks are joined by index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, WORD, column, fresh, stage

#: Rounds of the index permutation, and the prime and factors of its hash (all products fit a long).
ROUNDS, P, A1, A2 = 12, 2147483647, 48271, 69621

#: Slots looked up by one key when they are matched with the intervals of the sources.
LOOKUP = 4096

#: Slots that a task draws or permutes.
SLOTS_A_TASK = 65_536

#: Rows that share a bucket when offsets are summed up.
BUCKET_ROWS = 1_000


def hash_sql(v: str, key: str, r: str) -> str:
    """A number below P from ``v``, a key and a round, in SQL that Spark and DuckDB read alike."""
    h1 = f"((({v}) % {P}) * {A1} + (({key}) % {P}) + ({r}) * 7919) % {P}"
    return f"(((({h1}) * ({h1})) % {P}) * {A2} + ({r}) * 104729 + 12345) % {P}"


def step_sql(x: str, n: str, key: str, r: str, div: str = "div") -> str:
    """One swap-or-not round (Hoang, Morris and Rogaway) on ``x`` in 0..n-1: x or its mirror image."""
    k = f"((({hash_sql('1', key, r)}) * {P} + ({hash_sql('2', key, r)})) % ({n}))"
    y = f"(({k} - {x} + ({n})) % ({n}))"
    bit = f"((({hash_sql(f'greatest({x}, {y})', key, r)}) {div} 4096) % 2)"
    return f"case when {bit} = 1 then {y} else {x} end"


def permuted(df: DataFrame, x: str, n: str, key: str, out: str) -> DataFrame:
    """``df`` with column ``out``: the place of index ``x`` in a keyed pseudorandom permutation of 0..n-1 (column names).

    A projection for each round, so that all rounds run as generated code.
    """
    df = df.withColumn(out, F.col(x).cast("long"))
    for r in range(ROUNDS):
        df = df.withColumn(out, F.expr(step_sql(out, n, key, f"{r}L")))
    return df


def draw_sql(slot: str, total: str, seed: int) -> str:
    """A pseudorandom number in 0..total-1 for each slot: the source whose span holds it is drawn."""
    return f"((({hash_sql(slot, str(seed), '31')}) * {P} + ({hash_sql(slot, str(seed), '32')})) % ({total}))"


@dataclass
class Mix:
    """Tables of a mix: ``rows`` (id, source, key, text_hash, other_hash, size, start), ``sources``
    (one row each with size, target, blocks, draws), ``shards`` (shard, key, drawn, slots, base),
    ``slots`` (shard, key, block, pass) and ``pieces`` (key, start, block, first word, words, shard)."""

    rows: DataFrame
    sources: DataFrame
    shards: DataFrame
    slots: DataFrame
    pieces: DataFrame
    repeated: bool


def targets(sizes: DataFrame, weights=(5, 2, 1), cap: int = 3) -> DataFrame:
    """``sizes`` (source, key, size) with each source's weight and target.

    Sources in code point order, null last, take ``weights`` in turn and share the sum of all
    sizes; none gets over ``cap`` times its size, the excess going to the others by weight. In
    order of size by weight, a source is full if an even share of what the earlier ones leave
    exceeds its cap. One row per source, so the windows hold as many rows as there are sources.
    """
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((place - 1) % len(weights) + 1).cast("int"))
    full = F.col("size") * F.lit(float(cap))
    s = sizes.withColumn("weight", weight).withColumn("full", full).withColumn("ratio", F.col("full") / F.col("weight"))
    every = W.partitionBy(F.lit(0))
    before = W.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("size").over(every) - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("rate", left / open_weight)
    s = s.withColumn("level", F.max(F.when(F.col("rate") <= F.col("ratio"), F.col("rate"))).over(every))
    share = F.least(F.col("full"), F.col("level") * F.col("weight"))
    return s.withColumn("target", F.coalesce(share, F.col("full"))).select("source", "key", "size", "weight", "target")


def source_key(docs: DataFrame, source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), column(docs, source_col).cast("string")), F.lit("n"))


def other_hash(docs: DataFrame, *read: str) -> Column:
    """A hash of the columns of ``docs`` other than ``read``, which tells rows apart that agree in those."""
    rest = [column(docs, f.name) for f in docs.schema if f.name not in read and "map<" not in f.dataType.simpleString()]
    maps = [F.to_json(F.struct(column(docs, f.name))) for f in docs.schema if f.name not in read and "map<" in f.dataType.simpleString()]
    return F.xxhash64(F.lit(0), *rest, *maps)


def shard_draws(sources: DataFrame, total: int, shard_slots: int, seed: int) -> DataFrame:
    """``shard, key, drawn, slots, base``: the multinomial source counts of each output shard, corrected.

    ``drawn`` is how many of the shard's ``shard_slots`` slots drew the source. Over all shards in
    order, a source keeps its drawn slots in proportion to ``draws`` by what it drew altogether,
    which adds slots to one that was drawn too seldom; a source that no slot drew fills slots of
    shard 0. ``base`` is the number of its slots in earlier shards.
    """
    spark = sources.sparkSession
    some = sources.where("draws > 0")
    spans = some.select("key", "ahead", "draws", F.explode(F.sequence(F.floor(F.col("ahead") / LOOKUP), F.floor((F.col("ahead") + F.col("draws") - 1) / LOOKUP))).alias("lookup"))
    slots = spark.range(0, total, 1, max(1, -(-total // SLOTS_A_TASK))).select(
        F.floor(F.col("id") / shard_slots).alias("shard"), F.expr(draw_sql("id", f"{total}L", seed)).alias("drawn")
    )
    slots = slots.withColumn("lookup", F.floor(F.col("drawn") / LOOKUP))
    spans = F.broadcast(spans) if total <= 100_000 * LOOKUP else spans
    drawn = slots.join(spans, "lookup").where("drawn >= ahead and drawn < ahead + draws").groupBy("shard", "key").agg(F.count("*").alias("drawn"))
    drawn = stage(drawn)
    sums = drawn.groupBy("key").agg(F.sum("drawn").alias("all_drawn"))
    before = W.partitionBy("key").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)  # a row for each shard
    counts = some.select("key", "draws").join(sums, "key", "left").join(drawn, "key", "left")
    counts = counts.select("key", "draws", F.coalesce("all_drawn", "draws").alias("all_drawn"), F.coalesce("shard", F.lit(0)).alias("shard"), F.coalesce("drawn", F.lit(0)).alias("drawn"), F.coalesce("drawn", "draws").alias("by"))
    counts = counts.withColumn("upto", F.sum("by").over(before))
    share = lambda upto: F.expr(f"cast(cast({upto} as decimal(19,0)) * cast(draws as decimal(19,0)) div all_drawn as bigint)")
    counts = counts.withColumn("base", share("(upto - by)")).withColumn("slots", share("upto") - F.col("base"))
    return stage(counts.select("shard", "key", "drawn", "slots", "base"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=(5, 2, 1), cap: int = 3, block: int = 128, shard_slots: int = 8192, seed: int = 42, other: Column | None = None) -> Mix:
    """Plan which words of ``docs`` a mix takes, how often, and for which output shards.

    A document's size is its number of words between ASCII white space (null text: 0). A block
    is taken as often as its source's target asks, at most ``cap`` times; a source's last block
    may be short. Null ids and sources are values like any other, repeated rows are separate
    documents, other columns are not read (``other`` tells rows apart that agree in the three);
    texts of any length are read whole; an empty table gives empty tables. Reruns agree.

    Rows are dealt to the windows that sum up their sizes by a digest of id and text; rows that
    agree in both are one row there with a number of copies.
    """
    text = column(docs, text_col)
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    name = F.concat(F.coalesce(column(docs, id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    rows = docs.select(
        column(docs, id_col).alias("id"),
        column(docs, source_col).alias("source"),
        source_key(docs, source_col).alias("key"),
        F.xxhash64(text).alias("text_hash"),
        (F.lit(0).cast("long") if other is None else other).alias("other_hash"),
        size.alias("size"),
        F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long").alias("deal"),
    )
    rows = stage(rows)
    own = ["source", "key", "deal", "id", "size", "text_hash", "other_hash"]
    n_rows = rows.count()
    buckets = max(1, -(-n_rows // BUCKET_ROWS))
    rows = stage(rows.groupBy(*own).agg(F.count("*").alias("copies")).withColumn("bucket", F.col("deal") % buckets))
    repeated = rows.count() < n_rows
    every = F.col("size") * F.col("copies")
    sums = stage(rows.groupBy("source", "key", "bucket").agg(F.sum(every).alias("size")))
    base = F.sum("size").over(W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    bases = stage(sums.select("key", "bucket", base.alias("base")))
    inside = W.partitionBy("key", "bucket").orderBy("deal", "id", "size", "text_hash", "other_hash").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum(every).over(inside)).join(bases, ["key", "bucket"])
    rows = rows.withColumn("start", F.col("base") + F.col("upto") - every)
    if repeated:
        rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        rows = rows.withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    rows = stage(rows.select("id", "source", "key", "text_hash", "other_hash", "size", "start"))

    sources = targets(sums.groupBy("source", "key").agg(F.sum("size").alias("size")), weights, cap)
    blocks = F.ceil(F.col("size") / block).cast("long")
    sources = sources.withColumn("blocks", blocks)
    draws = F.when(F.col("size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("size"))).otherwise(0).cast("long")
    sources = sources.withColumn("draws", draws)
    ahead = F.sum("draws").over(W.orderBy(F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, 0)) - F.col("draws")
    number = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")).cast("long")
    sources = stage(sources.withColumn("ahead", ahead).withColumn("number", number))

    total = sources.agg(F.coalesce(F.sum("draws"), F.lit(0))).first()[0]
    shards = shard_draws(sources, total, shard_slots, seed)
    of = sources.select("key", "blocks", "number")
    slots = shards.where("slots > 0").join(F.broadcast(of) if of.count() <= 100_000 else of, "key")
    slots = slots.repartition(max(1, -(-total // SLOTS_A_TASK)), "shard", "key").select("shard", "key", "blocks", "number", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("slots") - 1)).alias("turn"))
    lap = F.floor(F.col("turn") / F.col("blocks"))
    slots = slots.select("shard", "key", "blocks", (F.col("turn") % F.col("blocks")).alias("index"), lap.alias("pass"), (F.lit(seed) + F.col("number") * 1000 + lap).cast("long").alias("lap_key"))
    # staged, since a filter that the join infers would be pushed through all rounds
    slots = stage(permuted(slots, "index", "blocks", "lap_key", "block").select("shard", "key", "block", "pass"))

    covers = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))
    pieces = rows.where("size > 0").select("key", "start", "size", F.explode(covers).alias("block"))
    pieces = pieces.join(slots, ["key", "block"])
    low = F.greatest(F.col("block") * block, F.col("start"))
    high = F.least((F.col("block") + 1) * block, F.col("start") + F.col("size"))
    pieces = pieces.select("key", "start", "block", (low - F.col("start")).alias("first"), (high - low).alias("words"), "shard")
    return Mix(rows, sources, shards, slots, pieces, repeated)


def mix_sizes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """``id, source, size, source_size, target, taken, shards`` for every row of ``docs`` (see :func:`mix`).

    ``shards`` counts the output shards that hold words of the document.
    """
    m = mix(docs, id_col, source_col, text_col, **options)
    taken = m.pieces.groupBy("key", "start").agg(F.sum("words").alias("taken"), F.size(F.collect_set("shard")).cast("long").alias("shards"))
    # documents without words share their start with the next one and take nothing
    some = m.rows.where("size > 0").join(taken, ["key", "start"], "left").select("id", "source", "key", "size", "taken", "shards")
    zero = F.lit(0).cast("long")
    none = m.rows.where("size = 0").select("id", "source", "key", "size", zero.alias("taken"), zero.alias("shards"))
    of = m.sources.select("key", F.col("size").alias("source_size"), "target")
    out = some.unionByName(none).join(F.broadcast(of) if of.count() <= 100_000 else of, "key")
    return out.select("id", "source", "size", "source_size", "target", F.coalesce("taken", zero).alias("taken"), F.coalesce("shards", zero).alias("shards"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """The mixed corpus: ``docs`` with the words that the mix takes, in the same columns.

    A document comes back once for each pass that takes any of its words (none: it goes; up to
    ``cap`` rows). A pass that takes all of them keeps the text as it is; else the text is the
    taken runs of words with the white space between them. ``length_col`` (if there is such a
    column) becomes the length of the new text. Rows that agree in id, source and text keep
    their own other columns; nulls, repeated rows and empty tables are as in :func:`mix`.
    """
    read = (id_col, source_col, text_col)
    m = mix(docs, *read, other=other_hash(docs, *read), **options)
    taken = m.pieces.groupBy("key", "start", "first", "words").agg(F.count("*").alias("takes"))
    parts = F.sort_array(F.collect_list(F.struct("first", "words", "takes"))).alias("parts")
    lists = taken.groupBy("key", "start").agg(parts, F.sum("words").alias("found"))
    plan = m.rows.where("size > 0").join(lists, ["key", "start"])
    i, k, h, o, part, pass_, now, whole = fresh(docs, "mix_id", "mix_key", "mix_hash", "mix_other", "mix_parts", "mix_pass", "mix_now", "mix_whole")
    plan = plan.select(F.col("id").alias(i), F.col("key").alias(k), F.col("text_hash").alias(h), F.col("other_hash").alias(o), F.col("parts").alias(part), (F.col("found") == F.col("size")).alias(whole))
    plan = stage(plan)
    if m.repeated:  # one of equal rows stands for all; the plan has a row for each
        own, rest = fresh(docs, "mix_own", "mix_rest")
        docs_ = docs.withColumn(own, F.xxhash64(column(docs, text_col))).withColumn(rest, other_hash(docs, *read))
        docs = docs_.dropDuplicates([id_col, source_col, own, rest]).select(*[column(docs_, c) for c in docs.columns])
    text = column(docs, text_col)
    same = column(docs, id_col).eqNullSafe(F.col(i)) & (source_key(docs, source_col) == F.col(k)) & (F.xxhash64(text) == F.col(h)) & (other_hash(docs, *read) == F.col(o))
    joined = docs.join(plan, same)
    most = F.array_max(F.transform(F.col(part), lambda p: p["takes"]))
    joined = joined.withColumn(pass_, F.explode(F.sequence(F.lit(1).cast("long"), most)))
    joined = joined.withColumn(now, F.filter(F.col(part), lambda p: p["takes"] >= F.col(pass_)))
    complete = F.col(whole) & (F.size(now) == F.size(part))
    words = F.regexp_extract_all(F.col(text_col), F.lit(f"{WORD}[{SPACE}]*"), F.lit(0))
    runs = F.flatten(F.transform(F.col(now), lambda p: F.slice(words, (p["first"] + 1).cast("int"), p["words"].cast("int"))))
    cut = F.rtrim(F.array_join(runs, ""))
    out = joined.withColumn(text_col, F.when(complete, F.col(text_col)).otherwise(cut))
    if length_col is not None and length_col in docs.columns:
        out = out.withColumn(length_col, F.char_length(text_col).cast(docs.schema[length_col].dataType))
    return out.select(*[column(out, c) for c in docs.columns])


def mix_sql(block: int = 128, weights=(5, 2, 1), cap: int = 3, seed: int = 42, shard_slots: int = 8192) -> str:
    """DuckDB SQL for the rows of :func:`mix_sizes` over ``documents``."""
    steps = "".join(
        f"x{r + 1} as materialized (select key, shard, blocks, pass, {step_sql('x', 'blocks', 'pass', str(r), '//')} as x from x{r}),\n"
        for r in range(ROUNDS)
    )
    pick = " ".join(f"when {i} then {float(w)}" for i, w in enumerate(weights))
    return f"""
with n as (select greatest(1, cast(ceil(count(*) / {float(BUCKET_ROWS)}) as bigint)) as buckets from documents),
r as (select doc_id, source, coalesce('s' || source, 'n') as key, text,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
  ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')), 1, 8))::bigint as deal from documents),
rows as (select r.*, sum(size) over (partition by key order by deal % buckets, deal, doc_id nulls first, size
  rows between unbounded preceding and current row)::bigint - size as start from r, n),
s0 as (select source, key, sum(size)::bigint as size from r group by source, key),
s1 as (select *, row_number() over (order by source is null, source) as number from s0),
s2 as (select *, case (number - 1) % {len(weights)} {pick} end::double as weight, size * {float(cap)}::double as full_size from s1),
s3 as (select *, (sum(size) over ()::double - coalesce(sum(full_size) over b, 0.0)) / (sum(weight) over () - coalesce(sum(weight) over b, 0.0)) as rate,
  full_size / weight as ratio from s2
  window b as (order by full_size / weight, source is null, source rows between unbounded preceding and 1 preceding)),
s4 as (select *, coalesce(least(full_size, max(case when rate <= ratio then rate end) over () * weight), full_size) as target,
  cast(ceil(size / {float(block)}) as bigint) as blocks from s3),
s5 as (select *, case when size > 0 then cast(round(target * blocks / size) as bigint) else 0 end as draws from s4),
s as (select *, sum(draws) over (order by source is null, source rows between unbounded preceding and current row)::bigint - draws as ahead from s5),
d0 as (select unnest(range(total)) as slot, total from (select sum(draws)::bigint as total from s)),
d1 as (select slot // {shard_slots} as shard, {draw_sql("slot", "total", seed)} as drawn from d0),
d as (select shard, key, count(*) as drawn from d1 join s on d1.drawn >= s.ahead and d1.drawn < s.ahead + s.draws group by shard, key),
c0 as (select s.key, draws, coalesce(shard, 0) as shard, coalesce(drawn, draws) as part, number, blocks from s left join d on s.key = d.key where draws > 0),
c1 as (select *, sum(part) over (partition by key)::hugeint as all_drawn, sum(part) over (partition by key order by shard)::hugeint as upto from c0),
c as (select *, ((upto - part) * draws // all_drawn)::bigint as low, (upto * draws // all_drawn)::bigint as high from c1),
x0 as materialized (select key, shard, blocks, j % blocks as x, {seed} + number * 1000 + j // blocks as pass
  from c, lateral (select unnest(range(low, high)) as j)),
{steps}t as (select key, x as block, shard from x{ROUNDS}),
p as (select rows.*, unnest(range(start // {block}, (start + size - 1) // {block} + 1)) as block from rows where size > 0),
q as (select p.key, p.start, sum(least((p.block + 1) * {block}, p.start + p.size) - greatest(p.block * {block}, p.start)) as taken, count(distinct shard) as shards
  from p join t on p.key = t.key and p.block = t.block group by p.key, p.start)
select rows.doc_id, rows.size, s.size as source_size, s.target,
  coalesce(case when rows.size > 0 then q.taken end, 0)::bigint as taken,
  coalesce(case when rows.size > 0 then q.shards end, 0)::bigint as shards
from rows join s on rows.key = s.key left join q on rows.key = q.key and rows.start = q.start
"""
