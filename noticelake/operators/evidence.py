"""Evidence: segments of long texts, retrieval of sections for requirements, and quotes found by their place."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticelake.operators.documents import greedy_fit, tokens


def split_segments(c: Column, n: int = 4000) -> Column:
    """Segments of up to n characters that give the text when they are joined; none for null and empty texts.

    A window of n characters ends after the last line break or space of its
    second half; without one, at its full length; what is left at the end isn't
    cut if it fits.  As sentences and clauses end before a space, the last
    sentence that fits is never cut in favour of an earlier break.  A regular
    expression takes the longest such window each time, which stays one
    pass in the JVM.
    """
    pattern = rf"[\s\S]{{1,{n}}}\z|[\s\S]{{{n // 2},{n - 1}}}[\n ]|[\s\S]{{{n}}}"
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))


def split_chunks(chunks: DataFrame, n: int = 4000) -> DataFrame:
    """(doc_id, location, text) -> (doc_id, location, part, start, text): the segments of each chunk under its location, with where in the chunk they begin, from 0."""
    parts = split_segments(F.col("text"), n)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, text: string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + F.length(x)).alias("at"), F.array_append(acc["out"], F.struct(acc["at"].alias("start"), x.alias("text"))).alias("out"))

    return chunks.select("doc_id", "location", F.posexplode(F.aggregate(parts, start, step, lambda acc: acc["out"])).alias("part", "x")).select("doc_id", "location", "part", "x.start", "x.text")


#: Tokens of requirements that are held in memory together: larger tables of requirements are answered in blocks.
INDEX_TOKENS = 1 << 20


_NO_LIMIT = 1 << 62


class Standing:
    """What of the sections seen so far can still be taken for a requirement.

    A section can't be taken if ``k`` sections before it, by score and name, are
    no longer than it: each of them would fit wherever it does.  So the walk
    keeps those that have fewer, about ``k`` times the logarithm of all.
    """

    def __init__(self, k: int) -> None:
        self.k, self.kept = k, []
        #: Of the kept ones, in order: -score, and before each place the k-th smallest size of those ahead.
        self.order, self.limits = [], [_NO_LIMIT]

    def possible(self, score: int, size: int) -> bool:
        """Whether a section may be kept, by those with a higher score alone."""
        return size < self.limits[bisect_left(self.order, -score)]

    def add(self, entries: list[tuple]) -> None:
        """Entries (-score, name, size, ...)."""
        entries, smallest = sorted([*self.kept, *entries], key=lambda e: e[:2]), []
        self.kept, self.order, self.limits = [], [], [_NO_LIMIT]
        for e in entries:
            if e[2] >= self.limits[-1]:
                continue
            self.kept.append(e)
            self.order.append(e[0])
            heapq.heappush(smallest, -e[2])
            if len(smallest) > self.k:
                heapq.heappop(smallest)
            self.limits.append(-smallest[0] if len(smallest) == self.k else _NO_LIMIT)


def _scoring(needs: list[tuple], k: int, chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An inverted index of the requirements; a task gives of its sections those that stand, for each requirement."""
    words = sorted({w for _, ws in needs for w in ws})
    number = {w: i for i, w in enumerate(words)}
    lists: list[list[int]] = [[] for _ in words]
    for r, (_, ws) in enumerate(needs):
        for w in ws:
            lists[number[w]].append(r)
    postings = [np.array(x, np.int64) for x in lists]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        standing: dict[int, Standing] = {}
        for frame in frames:
            found: dict[int, list[tuple]] = {}
            for name, size, tokens_ in zip(*[frame.column(c).to_pylist() for c in ("name", "size", "tokens")]):
                mine = [i for i in map(number.get, tokens_) if i is not None]
                if not mine or size > chars:
                    continue
                hit, score = np.unique(np.concatenate([postings[i] for i in mine]), return_counts=True)
                for r, n in zip(hit.tolist(), score.tolist()):
                    s = standing.get(r)
                    if s is None or s.possible(n, size):
                        found.setdefault(r, []).append((-n, name, size, mine))
            for r, entries in found.items():
                standing.setdefault(r, Standing(k)).add(entries)
        rows = [(needs[r][0], name, -n, size, sorted(words[i] for i in mine if r in lists[i])) for r, s in standing.items() for n, name, size, mine in s.kept]
        columns = list(zip(*rows)) if rows else [[]] * 5
        types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["req", "name", "score", "size", "common"])

    return run


_STANDING = "req string, name string, score long, size long, common array<string>"


def _narrowed(rows: DataFrame, k: int) -> DataFrame:
    """The same choice again over what the tasks gave, requirement by requirement and part by part."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        standing: dict[str, Standing] = {}
        for frame in frames:
            found: dict[str, list[tuple]] = {}
            for req, name, score, size, common in zip(*[frame.column(c).to_pylist() for c in ("req", "name", "score", "size", "common")]):
                found.setdefault(req, []).append((-score, name, size, common))
            for req, entries in found.items():
                standing.setdefault(req, Standing(k)).add(entries)
        out = [(req, name, -n, size, common) for req, s in standing.items() for n, name, size, common in s.kept]
        columns = list(zip(*out)) if out else [[]] * 5
        types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["req", "name", "score", "size", "common"])

    return rows.repartition("req").mapInArrow(run, _STANDING)


def retrieve_evidence(requirements: DataFrame, sections: DataFrame, k: int = 8, chars: int = 12_000, index_tokens: int = INDEX_TOKENS) -> DataFrame:
    """(req_id, text) and (section_id, text) -> (req_id, section_id, score, position, signals).

    The score is the number of tokens in common; ``signals`` names them.
    Sections in the order of score and id *as text* are taken while they fit the
    budget of ``k`` sections and ``chars`` characters, headings included; what is too big is
    skipped, however many those are.  ``sections`` may have ``heading`` and
    ``metadata``, whose tokens count as the text's do.

    Requirements are an inverted index in every task (so many tokens at a time as
    ``index_tokens``; further ones are further passes), so sections' tokens are
    never shuffled.  A task hands on only the sections that ``Standing`` leaves
    possible, a few dozen for each requirement; the walk itself is a fold over those.
    """
    heading = F.coalesce(F.col("heading").cast("string"), F.lit("")) if "heading" in sections.columns else F.lit("")
    more = [heading, *([F.coalesce(F.col("metadata").cast("string"), F.lit(""))] if "metadata" in sections.columns else [])]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = sections.where("section_id is not null").select(F.col("section_id").cast("string").alias("name"), (F.length(text) + F.length(heading)).cast("long").alias("size"), tokens(F.concat_ws(" ", text, *more)).alias("tokens"))
    words = requirements.where("req_id is not null").select(F.col("req_id").cast("string").alias("req"), tokens(F.coalesce("text", F.lit(""))).alias("words"))
    sized = words.groupBy("req").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))
    total = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    # whole requirements in blocks: by hash into parts, parts by their running sums of tokens
    parts = sized.groupBy(F.pmod(F.xxhash64("req"), F.lit(4096)).alias("block")).agg(F.sum(F.size("words")).alias("n")).select("block", F.floor(F.sum("n").over(total) / index_tokens).alias("turn"))
    turns: dict[int, list[int]] = {}
    for r in parts.collect():
        turns.setdefault(r.turn, []).append(r.block)
    out = None
    for blocks in turns.values():
        needs = [(r.req, r.words) for r in sized.where(F.pmod(F.xxhash64("req"), F.lit(4096)).isin(blocks)).collect()]
        stand = read.mapInArrow(_scoring(needs, k, chars), _STANDING)
        out = stand if out is None else out.unionByName(stand)
    if out is None:
        out = read.select(F.lit("").alias("req"), "name", F.lit(0).cast("long").alias("score"), "size", F.col("tokens").alias("common")).limit(0)
    first = _narrowed(out, k)
    items = first.groupBy("req").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("rank"), "name", "score", "size", "common"))).alias("items"))
    taken = items.select("req", F.posexplode(greedy_fit(F.col("items"), chars, k)).alias("position", "x"))
    signals = F.transform("x.common", lambda w: F.concat(F.lit("keyword:"), w))
    of = lambda df, c: df.schema[c].dataType
    return taken.select(F.col("req").cast(of(requirements, "req_id")).alias("req_id"), F.col("x.name").cast(of(sections, "section_id")).alias("section_id"), F.col("x.score").alias("score"), F.col("position").cast("long").alias("position"), signals.alias("signals"))


def _in_order(chunks: DataFrame) -> list[Column]:
    """A document's chunks in their order: by ``pos`` where it is given, else by the kind and the number that their locations say."""
    if "pos" in chunks.columns:
        return [F.col("pos")]
    place = F.col("location").cast("string")
    return [F.regexp_replace(place, "[0-9]+$", ""), F.regexp_extract(place, "([0-9]+)$", 1).try_cast("long"), place]


def offset_index(chunks: DataFrame, normalize: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, location, text, optionally pos) -> a row per document: ``whole``, its chunks' normalised texts joined by spaces, and ``parts``, its chunks in order (location, text, norm, at), ``at`` being where the chunk begins in ``whole``, from 1."""
    normed = chunks.select("doc_id", F.struct(*_in_order(chunks)).alias("turn"), F.col("location").cast("string").alias("location"), F.coalesce("text", F.lit("")).alias("text")).withColumn("norm", normalize(F.col("text")))
    length = F.when(F.col("norm") != "", F.length("norm") + 1).otherwise(0)
    before = Window.partitionBy("doc_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    placed = normed.withColumn("at", F.coalesce(F.sum(length).over(before), F.lit(0)) + 1)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "location", "text", "norm", "at"))), lambda x: x.dropFields("turn"))
    docs = placed.groupBy("doc_id").agg(parts.alias("parts"))
    return docs.withColumn("whole", F.array_join(F.filter(F.transform("parts", lambda x: x["norm"]), lambda t: t != ""), " "))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def verify_quotes(citations: DataFrame, chunks: DataFrame, normalize: Callable[[Column], Column]) -> DataFrame:
    """(cite_id, doc_id, location, quote) and (doc_id, location, text) -> (cite_id, level, found_at), one row for each citation.

    A citation's location, or one of its comma list, must be a chunk's of the
    document, or it is ``location_unknown``; a quote of nothing is
    ``empty_quote``; ``document_missing`` without chunks.  Then: ``exact`` in a
    cited chunk, ``normalized`` there, ``document`` anywhere in the document,
    ``fragments`` if the parts between ellipses that are longer than 15
    characters follow each other there, else ``quote_not_found``.

    ``found_at`` is the location of the chunk where the quote begins, told by
    its offset in the document, so quotes that go across chunks have one
    too.  Texts are normalised and put together once for each cited document, and meet
    their citations where they lie.
    """
    cited = citations.select("cite_id", "doc_id", F.coalesce(F.col("location").cast("string"), F.lit("")).alias("cited"), F.coalesce("quote", F.lit("")).alias("quote"))
    docs = offset_index(chunks.join(cited.select("doc_id").distinct(), "doc_id", "left_semi"), normalize)
    # pieces are normalised together, with a mark between them, so that any normalisation of texts will do
    ellipsis, mark = r"\.{3,}|…", "\x01"
    raw, normed = F.split("quote", ellipsis), F.split(normalize(F.regexp_replace("quote", ellipsis, mark)), mark)
    named = cited.withColumns({"wanted": F.transform(F.split("cited", ","), _strip), "normed": normalize(F.col("quote")), "pieces": F.zip_with(raw, normed, lambda r, n: F.struct((F.length(_strip(r)) > 15).alias("long"), F.trim(n).alias("text")))})
    both = named.join(docs, "doc_id", "left").withColumn("mine", F.filter("parts", lambda p: F.array_contains("wanted", p["location"])))
    first = lambda test: F.get(F.filter("mine", test), 0)["location"]
    exact = first(lambda p: F.contains(p["text"], F.col("quote")))
    near = F.when(F.col("normed") != "", first(lambda p: F.contains(p["norm"], F.col("normed"))))
    anywhere = F.when(F.col("normed") != "", F.position(F.col("normed"), F.col("whole")))

    def step(acc: Column, piece: Column) -> Column:
        at = F.position(piece, F.col("whole"), acc["next"])
        lost = (acc["next"] == 0) | (at == 0)
        return F.struct(F.when(lost, 0).otherwise(at + F.length(piece)).alias("next"), F.when(acc["first"] == 0, at).otherwise(acc["first"]).alias("first"))

    start = F.struct(F.lit(1).alias("next"), F.lit(0).alias("first"))
    parts = F.transform(F.filter("pieces", lambda x: x["long"] & (x["text"] != "")), lambda x: x["text"])
    followed = F.aggregate(parts, start, step, lambda acc: F.when(acc["next"] > 0, acc["first"]))
    holds = lambda at: F.element_at(F.filter("parts", lambda p: (p["norm"] != "") & (p["at"] <= at)), -1)["location"]
    found = both.withColumns({"_exact": exact, "_near": near, "_at": anywhere, "_follow": followed})
    level = (
        F.when(F.col("whole").isNull(), "document_missing").when(F.size("mine") == 0, "location_unknown").when(F.col("quote") == "", "empty_quote").when(F.col("_exact").isNotNull(), "exact")
        .when(F.col("_near").isNotNull(), "normalized").when(F.col("_at") > 0, "document").when((F.col("whole") != "") & (F.col("_follow") > 0), "fragments").otherwise("quote_not_found")
    )
    out = found.withColumn("level", level)
    place = F.when(F.col("level") == "exact", F.col("_exact")).when(F.col("level") == "normalized", F.col("_near")).when(F.col("level") == "document", holds(F.col("_at"))).when(F.col("level") == "fragments", holds(F.col("_follow")))
    return out.select("cite_id", "level", place.alias("found_at"))
