"""N-gram Jaccard join by T-occurrence search (DivideSkip).

A document's set holds its distinct 3-word shingles.  Of two linked sets of sizes
n and m at least ``T = ceil(0.9 * max(n, m))`` shingles are common, so of the
``n - T + r`` rarest ones of either, in any order that all documents share, at
least ``r`` are (r: ``repeats``).  Those are a document's *short* lists; the
others, whose inverted lists are long, are never merged.

1. Frequencies are counted in a fixed table of ``SLOTS`` hashed slots over all
   documents (its size doesn't grow with them; what shares a slot only moves in the order).
2. Rows with the same set collapse to one head.  Lists hold the heads whose
   short part has the shingle; lists of one head are dropped.
3. T-occurrence search: for a query the sorted lists of its short shingles are
   merged by a heap that skips ids which can't occur often enough; what is found
   in ``repeats`` lists is a candidate.  Its own sorted set is then probed by
   binary search for the query's shingles, rarest first, until the required
   overlap is reached or out of reach.
4. Two searches are run.  Leaders first: each list is led by the member with the
   fewest shingles of its own, each head goes to the leader of most of its lists, and leaders
   are the queries: a search is linear in the lists.  What lies in one component after that needs no
   pair.  Then all heads whose lists hold several components, against members
   of *other* components whose size and parity bits leave the overlap possible
   (a sound bound: it loses no pair).  Nothing is capped.

Queries with many candidates are dealt to several tasks by the candidate's hash,
each with the query's own set.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import documents, stored
from noticelake.llm.components import components, extended
from noticelake.llm.minhash import _parts, set_key, shingles, texts

WIDTH = 3
#: Links need 100 * |A and B| >= PERCENT * |A or B|.
PERCENT = 90
#: Slots of the frequency table, as bits, and slots that travel together.
SLOT_BITS, SLOT_BLOCK = 20, 1 << 13
#: 64-bit words of the parity bits: each shingle turns one bit over, so that sets which differ in k shingles differ in k bits at most.
PARITY = 4
#: Candidates of a query that one task merges or probes.
TOGETHER = 4_096


def least_overlap(n: int) -> int:
    """Shingles that a set of n has in common with any other that it links to."""
    return -(-PERCENT * n // 100)


def repeats(n: int) -> int:
    """Short lists in which a document must occur: more for longer sets, whose short part holds that many more shingles in return."""
    return 1 + (n >= 32) + (n >= 100)


def n_short(n: int) -> int:
    return n - least_overlap(n) + repeats(n)


def _slots(items: np.ndarray) -> np.ndarray:
    return (items >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def counted_batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, n_shingles, set_key, block, counts): a row for each document, and at the end of a task its part of the frequency table."""
    total, schema = np.zeros(1 << SLOT_BITS, np.int32), pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("block", pa.int32()), ("counts", pa.list_(pa.int32()))])
    for part in _parts(frames):
        n, keys = [], []
        for data in texts(part.column("text")):
            items = shingles(data, WIDTH)
            np.add.at(total, _slots(items), 1)
            n.append(len(items))
            keys.append(set_key(items) if len(items) else None)
        none = part.num_rows
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.list_(pa.int32()))], schema=schema)
    if total.any():
        for k in range(0, len(total), SLOT_BLOCK):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([k // SLOT_BLOCK], pa.int32()), pa.array([total[k : k + SLOT_BLOCK]], pa.list_(pa.int32()))], schema=schema)


def _sum_batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, counts) of all tasks -> one row of sums for each block."""
    sums: dict[int, np.ndarray] = {}
    for frame in frames:
        for block, counts in zip(frame.column("block").to_pylist(), frame.column("counts")):
            sums[block] = sums.get(block, 0) + counts.values.to_numpy(zero_copy_only=False).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.int64()))], ["block", "counts"])


def frequencies(counted: DataFrame) -> np.ndarray:
    """The frequency table: of one size, whatever the input's."""
    rows = counted.where("block is not null").select("block", "counts").repartition("block").mapInArrow(_sum_batches, "block int, counts array<long>").collect()
    out = np.zeros(1 << SLOT_BITS, np.int64)
    for r in rows:
        out[r.block * SLOT_BLOCK : (r.block + 1) * SLOT_BLOCK] = r.counts
    return out


def rarest_first(items: np.ndarray, often: np.ndarray) -> np.ndarray:
    """A sorted set in the order that all documents share: by frequency of the slot, then by hash."""
    return items[np.argsort(often[_slots(items)], kind="stable")]


def parity(items: np.ndarray) -> np.ndarray:
    bits = np.bincount((items & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64)


def _short_batches(often):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, longs = often.value, pa.list_(pa.int64())
        for part in _parts(frames):
            n, keys, short, bits = [], [], [], []
            for data in texts(part.column("text")):
                items = shingles(data, WIDTH)
                n.append(len(items))
                keys.append(set_key(items) if len(items) else None)
                short.append(rarest_first(items, table)[: n_short(len(items))].view(np.int64))
                bits.append(parity(items))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(short, longs), pa.array(bits, longs)], ["doc_id", "set_key", "n", "short", "parity"])

    return run


def divide_skip(lists: Sequence[Sequence[int]], times: int) -> Iterator[tuple[int, int]]:
    """(id, lists that hold it) for the ids in at least ``times`` of the sorted lists.

    The lists' heads lie in a heap.  Where the smallest id is in too few lists,
    so many heads are taken that any id before the next head can't be in enough;
    these lists go on, by binary search, at that head.
    """
    heap = [(x[0], k) for k, x in enumerate(lists) if len(x)]
    at = [0] * len(lists)
    heapq.heapify(heap)
    while len(heap) >= times:
        low, taken = heap[0][0], []
        while heap and heap[0][0] == low:
            taken.append(heapq.heappop(heap)[1])
        if len(taken) >= times:
            yield low, len(taken)
            goal = low + 1
        else:
            while heap and len(taken) < times - 1:
                taken.append(heapq.heappop(heap)[1])
            if not heap:
                return
            goal = heap[0][0]
        for k in taken:
            at[k] = bisect_left(lists[k], goal, at[k])
            if at[k] < len(lists[k]):
                heapq.heappush(heap, (lists[k][at[k]], k))


def _merge_batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(q, part, times, item, b), sorted -> the candidates (q, b) of each query's lists."""
    key, lists, item, times, a, b = None, [], None, 1, [], []

    def found() -> None:
        for other, _ in divide_skip(lists, times):
            a.append(key[0])
            b.append(other)

    for frame in frames:
        for q, part, least, it, other in zip(*[frame.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("q", "part", "times", "item", "b")]):
            if (q, part) != key:
                if key is not None:
                    found()
                key, lists, item, times = (q, part), [], None, least
            if it != item:
                lists.append([])
                item = it
            lists[-1].append(other)
        if len(a) >= TOGETHER:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["q", "b"])
            a, b = [], []
    if key is not None:
        found()
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["q", "b"])


def reaches(query: np.ndarray, other: np.ndarray, first: int = 64) -> bool:
    """Whether a query's shingles, rarest first, and a sorted set have the overlap that the threshold asks; probes go on only while that is open."""
    need, at, got, width = -(-PERCENT * (len(query) + len(other)) // (100 + PERCENT)), 0, 0, first
    while at < len(query) and got < need <= got + len(query) - at:
        probe = query[at : at + width]
        place = np.searchsorted(other, probe)
        got += int((other[np.minimum(place, len(other) - 1)] == probe).sum())
        at, width = at + len(probe), 2 * width
    return got >= need


def _probe_batches(often):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(q, part, b, text), a query's own texts (b null) before its candidates' -> the pairs (a, b) that reach the threshold."""
        table, key, own = often.value, None, []
        for frame in _parts(frames):
            a, b = [], []
            for q, part, other, data in zip(*[frame.column(c).to_pylist() for c in ("q", "part", "b")], texts(frame.column("text"))):
                if (q, part) != key:
                    key, own = (q, part), []
                items = shingles(data, WIDTH)
                if other is None:
                    own.append(rarest_first(items, table))
                elif len(items) and any(len(x) and reaches(x, items) for x in own):
                    a.append(q)
                    b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """Appends ``part``: queries with many candidates (q, b) are dealt to several tasks by the candidate.

    Those queries are written first, so that the join reads two plain exchanges, of which Spark can split the hot ones.
    """
    many = stored(rows.groupBy("q").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > TOGETHER))
    parts = F.coalesce(F.ceil(F.col("_n") / TOGETHER), F.lit(1))
    return rows.join(many, "q", "left").withColumn("part", F.pmod(F.xxhash64("b"), parts)).drop("_n")


def _merged(hits: DataFrame) -> DataFrame:
    """(q, times, item, b) -> the candidates (q, b) by the heap merge; q and b are heads."""
    dealt = _dealt(hits).select("q", "part", "times", "item", "b")
    return dealt.repartition("q", "part").sortWithinPartitions("q", "part", "item", "b").mapInArrow(_merge_batches, "q long, b long")


def _linked(candidates: DataFrame, bodies: DataFrame, often) -> DataFrame:
    """The pairs (q, b) of documents, by their whole sets: (a, b)."""
    dealt = _dealt(candidates.distinct()).select("q", "part", "b")
    dealt = stored(dealt)
    body = lambda end: bodies.select(F.col("doc_id").alias(end), "text")
    others = dealt.join(body("b"), "b").select("q", "part", "b", "text")
    own = dealt.select("q", "part").distinct().join(body("q"), "q").select("q", "part", F.lit(None).cast("long").alias("b"), "text")
    rows = others.unionByName(own).repartition("q", "part").sortWithinPartitions("q", "part", F.asc_nulls_first("b"))
    return stored(rows.mapInArrow(_probe_batches(often), "a long, b long"))


def _possible(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _leaders(shared: DataFrame, about: DataFrame) -> DataFrame:
    """(h, q): for each head the leader of most of its lists, where the sizes allow a link; a list is led by the member with the fewest shingles of its own."""
    ranked = shared.join(about.select("h", "own", "n"), "h")
    lead = ranked.groupBy("item").agg(F.min(F.struct("own", "h", "n")).alias("lead"))
    votes = ranked.join(lead, "item").where((F.col("lead.h") != F.col("h")) & _possible(F.col("lead.n"), F.col("n")))
    counts = votes.groupBy("h", F.col("lead.h").alias("q")).agg(F.count(F.lit(1)).alias("lists"))
    return counts.groupBy("h").agg(F.max_by("q", F.struct("lists", (-F.col("q")).alias("first"))).alias("q"))


def _apart() -> Column:
    """Whether heads a and b, of different components, may reach the threshold: by their sizes, and by the parity bits in which they differ."""
    differ = sum((F.bit_count(F.col(f"a.p{k}").bitwiseXOR(F.col(f"b.p{k}"))) for k in range(PARITY)), F.lit(0))
    total = F.col("a.n") + F.col("b.n")
    return (F.col("a.h") < F.col("b.h")) & (F.col("a.component") != F.col("b.component")) & _possible(F.col("a.n"), F.col("b.n")) & ((100 + PERCENT) * differ <= (100 - PERCENT) * total)


def jaccard_join(df: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_shingles, component_id), one row for each row.

    ``component_id`` is the smallest ``doc_id`` reachable over links.  Null and
    blank texts have an empty set and link with nothing; rows without a
    ``doc_id`` stay alone, with a null component.  Links within a component
    aren't listed, as that would be all pairs of a group.  Rows that repeat a
    ``doc_id`` are one node: its links are those of all its texts.  An empty
    table gives an empty table.
    """
    docs = documents(df)
    spark = df.sparkSession
    counted = stored(docs.mapInArrow(counted_batches, "doc_id long, n_shingles long, set_key binary, block int, counts array<int>"))
    rows = counted.where("block is null").select("doc_id", "n_shingles", "set_key")
    often = spark.sparkContext.broadcast(frequencies(counted))
    named = rows.where("doc_id is not null and set_key is not null").select("doc_id", "set_key")
    first = stored(named.groupBy("set_key").agg(F.min("doc_id").alias("doc_id")))
    same = named.distinct().join(first.withColumnRenamed("doc_id", "first"), "set_key").where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))

    shorts = docs.mapInArrow(_short_batches(often), "doc_id long, set_key binary, n long, short array<long>, parity array<long>")
    heads = shorts.join(first, ["set_key", "doc_id"]).dropDuplicates(["set_key", "doc_id"]).withColumn("h", F.monotonically_increasing_id())
    heads = stored(heads.select("h", "doc_id", "n", "short", *[F.get("parity", k).alias(f"p{k}") for k in range(PARITY)]))
    posts = heads.select("h", F.explode("short").alias("item"))
    several = posts.groupBy("item").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("item")
    shared = stored(posts.join(several, "item").select("item", "h"))
    mine = shared.groupBy("h").agg(F.count(F.lit(1)).alias("_n"))
    about = stored(heads.join(mine, "h").select("h", "doc_id", "n", (F.size("short") - F.col("_n")).alias("own"), *[f"p{k}" for k in range(PARITY)]))
    bodies = stored(docs.join(about.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))

    name = lambda pairs: pairs.join(about.select(F.col("h").alias("q"), F.col("doc_id").alias("_q")), "q").join(about.select(F.col("h").alias("b"), F.col("doc_id").alias("_b")), "b").select(F.col("_q").alias("q"), F.col("_b").alias("b")).where("q <> b")
    least = F.when(F.col("n") * PERCENT >= 100 * 100, 3).when(F.col("n") * PERCENT >= 32 * 100, 2).otherwise(1)  # repeats() of the smallest partner
    leader = stored(_leaders(shared, about))
    queries = leader.select("q").distinct().join(about.select(F.col("h").alias("q"), least.alias("times")), "q")
    lists = shared.withColumnRenamed("h", "q").join(queries, "q")
    hits = shared.join(leader, "h").select("item", "q", F.col("h").alias("b")).join(lists, ["item", "q"])
    tried = stored(name(_merged(hits)))
    links = _linked(tried, bodies, often)

    found = components(links)
    lies = about.join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")).withColumn("times", least)
    lies = stored(lies.drop("own"))
    within = shared.join(lies.select("h", "component"), "h").groupBy("item").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("item")
    members = stored(shared.join(within, "item").join(lies, "h"))
    hits = members.alias("a").join(members.alias("b"), (F.col("a.item") == F.col("b.item")) & _apart()).select(F.col("a.h").alias("q"), F.col("a.times").alias("times"), F.col("a.item").alias("item"), F.col("b.h").alias("b"))
    more = name(_merged(stored(hits))).join(tried.unionByName(tried.select(F.col("b").alias("q"), F.col("q").alias("b"))), ["q", "b"], "left_anti")
    classes = extended(found, _linked(more, bodies, often).unionByName(same))
    out = rows.select("doc_id", "n_shingles").join(classes.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
