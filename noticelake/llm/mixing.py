"""Mixing sources to target weights by Sainte-Laguë apportionment.

Words are dealt in equal blocks.  The blocks of the mix go to sources by the
highest quotients ``target / (2 k + 1)``, a source's blocks to its groups of
shards, and a group's blocks to its shards, in the same way.  In a shard the
documents stand in a seeded order; from a seeded block on, the shard gives as
many blocks as its quota says, going round at most twice.

Rows that are alike in id, source and text are one line with a number of
copies, and rows without words stand in no line, so that neither can fill a
task.  A shard holds about ``SHARD_WORDS`` words and a group up to ``FAN``
shards; only the tables of sources (a row each) and of a source's groups (a row
for ``SHARD_WORDS * FAN`` words) pass through one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticelake.llm.common import guarded, stored

WEIGHTS = (5, 2, 1)
#: The words of the mix as a share of all words, and the most a source gives, in times its words.
SHARE, LIMIT = 1.5, 2
#: Words of a block; a source, group or shard misses its target by one block or two.
BLOCK_WORDS = 8
SHARD_WORDS = 50_000
FAN = 512
SEED = 17
#: Halvings of the interval that holds the last quotient; so many reach neighbouring doubles.
HALVINGS = 100


def words(text: Column) -> Column:
    """The number of runs of characters other than white space; null counts as none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(source, source_size) -> the same with ``target`` and the source's ``number``.

    Sources in code-point order, null last, weigh ``weights`` in turn.  A target
    stops at ``limit`` times the size; what is above goes to the others by
    weight.  So the level of the others follows from the sources that stop,
    which are the first ones by ``limit * size / weight``.  One row per source
    passes through these windows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    w = sizes.withColumn("number", F.row_number().over(order) - 1).withColumn("weight", F.get(cycle, F.col("number") % len(weights)).cast("double"))
    w = w.withColumn("ratio", limit * F.col("source_size") / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    total = share * F.sum("source_size").over(all_)
    w = w.withColumn("level", (total - F.coalesce(F.sum(limit * F.col("source_size")).over(before), F.lit(0.0))) / (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    w = w.withColumn("open", F.when(F.col("level") <= F.col("ratio"), F.col("level"))).withColumn("level", F.coalesce(F.max("open").over(all_), F.max("ratio").over(all_)))
    return w.select("number", "source", "source_size", F.least(limit * F.col("source_size").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def apportion(df: DataFrame, within: list[str], keys: list[str], votes: str, seats: str, most: str) -> DataFrame:
    """Appends ``quota``: Sainte-Laguë seats of the rows of each ``within`` group, ``seats`` seats a group, at most ``most`` a row.

    The seats go to the highest quotients ``votes / (2 k + 1)``, ties by
    ``keys``; where all rows reach their most, the rest stays undealt.  Halving
    finds two neighbouring bounds between which the last quotient that gets a
    seat must lie: what is above the upper one is seated, and the few seats left
    go to the highest next quotients.  A group's votes make one array.
    """
    above = lambda v, m, bound: F.least(F.when(v > bound, F.ceil((v / bound - 1) / 2)).otherwise(0), m)
    group = df.groupBy(*within).agg(F.max(seats).alias("_seats"), F.collect_list(F.struct(F.col(votes).cast("double").alias("v"), F.col(most).cast("long").alias("m"))).alias("_rows"))
    start = F.struct(F.lit(0.0).alias("low"), F.array_max(F.transform("_rows", lambda r: r["v"])).alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        bound = (acc["low"] + acc["high"]) / 2
        dealt = F.aggregate("_rows", F.lit(0).cast("long"), lambda n, r: n + above(r["v"], r["m"], bound).cast("long"))
        more = (bound > 0) & (dealt > F.col("_seats"))
        return F.struct(F.when(more, bound).otherwise(acc["low"]).alias("low"), F.when(more | (bound == 0), acc["high"]).otherwise(bound).alias("high"))

    bounds = group.select(*within, F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda acc: acc["high"]).alias("_bound"))
    base = df.join(bounds, within).withColumn("_base", above(F.col(votes).cast("double"), F.col(most).cast("long"), F.col("_bound")).cast("long"))
    base = base.withColumn("_lack", F.col(seats) - F.sum("_base").over(Window.partitionBy(*within)))
    following = F.when((F.col("_base") < F.col(most)) & (F.col(votes) > 0), F.col(votes).cast("double") / (2 * F.col("_base") + 1))
    turn = F.row_number().over(Window.partitionBy(*within).orderBy(following.desc_nulls_last(), *keys))
    extra = F.when(following.isNotNull() & (turn <= F.col("_lack")), 1).otherwise(0)
    return base.withColumn("quota", (F.col("_base") + extra).cast("long")).drop("_bound", "_base", "_lack")


def _number(text: Column, of: Column) -> Column:
    """A number from 0 to ``of`` - 1 that the text's hash gives."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % of


def _lines(df: DataFrame, block: int, shard_words: int, seed: int) -> DataFrame:
    """(doc_id, source, h, size, copies, source_size, target, start, rounds, low, high, again): alike rows once, where they stand in their shard's line, and what the shard gives.

    ``h`` is a hash of the text.  The shard gives its whole line ``rounds``
    times, and the words from ``low`` to ``high`` and from 0 to ``again``.
    """
    text = F.col("text").cast("string")
    docs = df.select("doc_id", F.col("source").cast("string").alias("source"), words(text).alias("size"), F.md5(F.coalesce(text, F.lit(""))).alias("h"))
    docs = stored(docs.groupBy("doc_id", "source", "size", "h").agg(F.count(F.lit(1)).alias("copies")))
    sizes = docs.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    sources = targets(sizes).withColumns({"seats": F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long"), "most": LIMIT * F.ceil(F.col("source_size") / block), "all": F.lit(1)})
    shards_ = F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("long").alias("shards")
    sources = stored(apportion(sources, ["all"], ["number"], "target", "seats", "most").select("number", "source", "source_size", "target", F.col("quota").alias("source_quota"), shards_))

    named = docs.join(sources, docs["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "h", F.lit(seed).cast("string"))
    # the same hash gives the shard, and the turn in it
    placed = named.where("size > 0").withColumns({"shard": _number(key, F.col("shards")), "turn": F.substring(F.md5(key), 16, 17), "length": F.col("size") * F.col("copies")})
    shards = placed.groupBy("number", "source", "shard").agg(F.sum("length").alias("shard_size"))
    shards = stored(shards.withColumns({"group": F.floor(F.col("shard") / FAN), "shard_blocks": F.ceil(F.col("shard_size") / block)}))
    groups = shards.groupBy("number", "group").agg(F.sum("shard_size").alias("group_size"), (LIMIT * F.sum("shard_blocks")).alias("most")).join(sources.select("number", "source_quota"), "number")
    groups = stored(apportion(groups, ["number"], ["group"], "group_size", "source_quota", "most").select("number", "group", F.col("quota").alias("group_quota")))
    shards = shards.join(groups, ["number", "group"]).withColumn("most", LIMIT * F.col("shard_blocks"))
    shards = apportion(shards, ["number", "group"], ["shard"], "shard_size", "group_quota", "most")
    # the quota as whole rounds and a run of blocks from a seeded one on, in words
    first = _number(F.concat_ws("|", F.coalesce("source", F.lit("")), F.col("shard").cast("string"), F.lit(seed).cast("string")), F.col("shard_blocks"))
    shards = shards.withColumns({"rounds": F.floor(F.col("quota") / F.col("shard_blocks")), "run": F.col("quota") % F.col("shard_blocks"), "first": first})
    gives = {"low": F.col("first") * block, "high": (F.col("first") + F.col("run")) * block, "again": F.greatest(F.lit(0), F.col("first") + F.col("run") - F.col("shard_blocks")) * block}
    shards = stored(shards.select("number", "shard", "rounds", *[c.alias(n) for n, c in gives.items()]))

    order = Window.partitionBy("number", "shard").orderBy("turn", "doc_id", "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lined = placed.withColumn("start", F.sum("length").over(order) - F.col("length")).join(shards, ["number", "shard"])
    columns = ["doc_id", "source", "h", "size", "copies", "source_size", "target"]
    nothing = [F.lit(0).cast("long").alias(c) for c in ("start", "rounds", "low", "high", "again")]
    return lined.select(*columns, "start", "rounds", "low", "high", "again").unionByName(named.where("size = 0").select(*columns, *nothing))


def _taken(start: Column, length: Column) -> Column:
    """The words that the mix takes of so many from ``start`` on in a shard's line."""
    over = lambda low, high: F.greatest(F.lit(0), F.least(start + length, high) - F.greatest(start, low))
    return (F.col("rounds") * length + over(F.col("low"), F.col("high")) + over(F.lit(0), F.col("again"))).cast("long")


def mix(df: DataFrame, block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, text, source) -> (doc_id, size, source_size, target, taken), one row per row.

    ``taken`` is the number of the document's words in the mix, repeats
    counted, and at most twice its size.  Null and blank texts have a size of
    0 and nothing is taken; null sources make one source; null ids are ids like
    any other.  Rows that repeat are documents of their own, which stand side by
    side.  Reruns give the same rows.  An empty table gives an empty table.
    """
    lines = _lines(df, block, shard_words, seed).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return lines.select("doc_id", "size", "source_size", "target", _taken(F.col("start") + F.col("copy") * F.col("size"), F.col("size")).alias("taken"))


def mixed(df: DataFrame, block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """The documents of the mix with all their columns: each as often as its taken words say, rounded, once at least if any are taken.

    Rows that are alike in id, source and text share what is taken of them
    evenly.  No row is joined by its id alone, so null and repeated ids stay.
    """
    rows, back = guarded(df, "doc_id", "text", "source")
    lines = _lines(rows, block, shard_words, seed).withColumn("length", F.col("size") * F.col("copies"))
    share = _taken(F.col("start"), F.col("length"))
    times = lines.where(share > 0).select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("h").alias("__h"), F.greatest(F.round(share / F.col("length")), F.lit(1)).cast("int").alias("__times"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").cast("string").eqNullSafe(F.col("__source")) & (F.col("__text_h") == F.col("__h"))
    out = rows.withColumn("__text_h", F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).join(times, same)
    return back(out.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__times"))))
