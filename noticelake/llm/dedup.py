"""Near-duplicate classes: sketch, band, verify on whole sets, connect.

No step emits all pairs of a bucket:

1. Rows with the same set collapse to the smallest ``doc_id``.
2. A bucket's centre is the member whose own buckets hold the most members: of
   an original and its copies that is the original, whatever the ids, as copies
   leave some of its buckets.  Every member is checked against the best centre of
   its buckets, and the confirmed links are connected; those that still lie in
   another component than the centre of one of their buckets (a star) are
   checked against that, and connected.
3. What is left are pairs of *different* components in one bucket.  The join
   that looks for them emits a pair only in the first bucket the two share,
   and only where sizes and sketches leave a similarity of 0.8 possible.
   Members of buckets with more than ``LARGE`` left go through a prefix join
   instead: two sets with a Jaccard similarity of 0.8 or more share one of
   their ``n - ceil(0.8 n) + 1`` rarest shingles, and such rare shingles have
   short lists whatever passage filled the bucket.  So nothing is capped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.llm import minhash
from noticelake.llm.common import documents, stored
from noticelake.llm.components import components, extended

#: Links need 100 * |A and B| >= 80 * |A or B|.
PERCENT = 80
#: Members of a bucket up to which it is searched for pairs directly.
LARGE = 4_000
_WORDS = minhash.BINS // 64
_PLANES = [f"p{k}" for k in range(minhash.BITS * _WORDS)]


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= PERCENT * (F.size("left") + F.size("right") - both)).select("a", "b")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, items) of the documents named in ids, from whole texts."""
    found = docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return stored(found.select("doc_id", "text").mapInArrow(minhash.shingle_batches, "doc_id long, items array<long>"))


def _unlinked(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) of a bucket's centre and a member that lie in different components."""
    named = stored(buckets.join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("band", "a", "doc_id", F.coalesce("component", "doc_id").alias("component")))
    centre = named.where("doc_id = a").select(F.col("band").alias("of"), F.col("component").alias("other"))
    apart = named.join(centre, (F.col("band") == F.col("of")) & (F.col("component") != F.col("other")))
    return apart.where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()


def _left(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """(band, doc_id, component, n_members) of the buckets that hold several components."""
    named = stored(buckets.join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("component")))
    counts = named.groupBy("band").agg(F.count(F.lit(1)).alias("n_members"), F.min("component").alias("low"), F.max("component").alias("high"))
    return stored(named.join(stored(counts.where("low < high").select("band", "n_members")), "band"))


def _possible() -> Column:
    """Whether rows a and b, of different components, may reach the threshold by their sizes and the bits of their sketches."""
    a, b = F.col("a.n"), F.col("b.n")
    apart = [F.bit_count(reduce(lambda x, y: x.bitwiseOR(y), [F.col(f"a.p{k + i * _WORDS}").bitwiseXOR(F.col(f"b.p{k + i * _WORDS}")) for i in range(minhash.BITS)])) for k in range(_WORDS)]
    differ = reduce(lambda x, y: x + y, apart)
    return (F.col("a.doc_id") < F.col("b.doc_id")) & (F.col("a.component") != F.col("b.component")) & (100 * F.least(a, b) >= PERCENT * F.greatest(a, b)) & (differ <= minhash.BINS - minhash.AGREE)


def _across(members: DataFrame, key: str, first: Column | None = None) -> DataFrame:
    """Pairs a < b that share ``key``, lie in different components and may reach the threshold."""
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & _possible()
    pairs = members.alias("a").join(members.alias("b"), on if first is None else on & first)
    return pairs.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")).distinct()


def _rare(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(doc_id, item) for the rarest items of each member's set, as many as the threshold needs."""
    items = sets.join(members, "doc_id", "left_semi").select("doc_id", F.size("items").alias("size"), F.explode("items").alias("item"))
    often = stored(items.groupBy("item").agg(F.count(F.lit(1)).alias("often")).where("often > 1"))
    shared = items.join(often, "item")
    # items of one document alone come first in the order and link nothing
    own = F.col("size") - F.size("in_order")
    needed = F.col("size") - F.ceil(F.col("size") * PERCENT / 100.0 - 1e-9) + 1
    ordered = shared.groupBy("doc_id", "size").agg(F.array_sort(F.collect_list(F.struct("often", "item"))).alias("in_order"))
    return ordered.select("doc_id", F.explode(F.slice("in_order", 1, F.greatest(needed - own, F.lit(0)).cast("int"))).alias("x")).select("doc_id", F.col("x.item").alias("item"))


def near_duplicates(df: DataFrame, large: int = LARGE) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_shingles, component_id, kept), one row for each row.

    ``component_id`` is the smallest ``doc_id`` reachable over links, ``kept``
    says that the row is that document.  Null and blank texts have an empty
    set and stay alone; rows without a ``doc_id`` stay alone too, with a null
    component, and are kept.  Rows that repeat a ``doc_id`` get the same class;
    where their texts differ, the class follows the links of all of them.
    An empty table gives an empty table.
    """
    docs = documents(df)
    sketched = stored(docs.mapInArrow(minhash.sketch_batches, "doc_id long, n_shingles long, set_key binary, bands array<long>, planes array<long>"))
    named = sketched.where("doc_id is not null and set_key is not null")
    first = stored(named.groupBy("set_key").agg(F.min("doc_id").alias("first")))
    same = named.select("doc_id", "set_key").distinct().join(first, "set_key").where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    heads = stored(named.join(first, "set_key").where("doc_id = first").select("doc_id", F.explode("bands").alias("band")).distinct())
    full = stored(heads.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    shared = stored(heads.join(full, "band"))
    rank = stored(shared.groupBy("doc_id").agg((-F.sum("members")).alias("few")).select("doc_id", F.struct("few", "doc_id").alias("rank")))
    centres = stored(shared.join(rank, "doc_id").groupBy("band").agg(F.min("rank").alias("centre")))
    buckets = stored(shared.select("band", "doc_id").join(centres, "band").select("band", "doc_id", F.col("centre.doc_id").alias("a"), "centre"))

    sets = _sets(docs, buckets.select("doc_id").distinct())
    nearest = stored(buckets.where("doc_id <> a").groupBy(F.col("doc_id").alias("b")).agg(F.min("centre")["doc_id"].alias("a")))
    found = components(stored(_verified(nearest, sets)))
    rest = stored(_unlinked(buckets, found))
    found = extended(found, stored(_verified(rest, sets)))

    left = _left(buckets.select("band", "doc_id"), found)
    # a row for each set of an id: where an id repeats with other texts, any of its sketches may admit a pair
    about = named.select("doc_id", "set_key", F.col("n_shingles").alias("n"), "bands", *[F.get("planes", k).alias(p) for k, p in enumerate(_PLANES)]).dropDuplicates(["doc_id", "set_key"]).drop("set_key")
    about = stored(about.join(left.select("doc_id", "component").distinct(), "doc_id"))
    here = left.where(F.col("n_members") <= large).select("band", "doc_id").join(about, "doc_id")
    first = F.array_min(F.array_intersect("a.bands", "b.bands")) == F.col("a.band")
    crowd = left.where(F.col("n_members") > large).select("doc_id").distinct()
    rare = stored(_rare(crowd, sets)).join(about.drop("bands"), "doc_id")
    tried = nearest.select("a", "b").unionByName(rest).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = _across(here, "band", first).unionByName(_across(rare, "item")).distinct().join(tried, ["a", "b"], "left_anti")
    classes = extended(found, stored(_verified(more, sets)).unionByName(same))
    out = sketched.select("doc_id", "n_shingles").join(classes.select(F.col("node").alias("doc_id"), F.col("component")), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component.isNull() | (F.col("doc_id") == component)).alias("kept"))
