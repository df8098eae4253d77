"""Documents: language, bundles, duplicates, sections, packing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticelake.functions.text import normalize_language

#: Languages in the order in which ties are settled, with the names of Spark's own stop-word lists.
LANGUAGES = {"en": "english", "fr": "french", "pt": "portuguese", "de": "german", "es": "spanish", "it": "italian"}


def stopwords(languages: dict[str, str] = LANGUAGES) -> dict[str, list[str]]:
    """Stop words of letters by language: the lists that come with Spark ML (Apache License 2.0).  Any other table does as well."""
    from pyspark.ml.feature import StopWordsRemover

    return {k: sorted({w for w in StopWordsRemover.loadDefaultStopWords(name) if w.isalpha()}) for k, name in languages.items()}


def detect_language(docs: DataFrame, words: dict[str, Sequence[str]], keys: Sequence[str] = ("doc_id",), least_tokens: int = 20, least_score: float = 0.04) -> DataFrame:
    """(keys, text) -> (keys, language, confidence), both null for short texts and weak scores.

    The score is the share of a text's letter tokens among a language's stop
    words; ties go to the language listed first.  A row is a document, a page or
    a section, as ``keys`` say; each is judged alone, so nothing is shuffled.
    """
    split = docs.select(*keys, F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0)).alias("_tokens"))
    hits = [F.struct(F.size(F.filter("_tokens", _among(ws))).alias("hits"), F.lit(-k).alias("rank"), F.lit(language).alias("language")) for k, (language, ws) in enumerate(words.items())]
    best = split.withColumns({"_best": F.array_max(F.array(*hits)), "_total": F.size("_tokens")})
    score = F.col("_best.hits") / F.col("_total")
    known = (F.col("_total") >= least_tokens) & (score >= least_score)
    return best.select(*keys, F.when(known, F.col("_best.language")).alias("language"), F.when(known, F.round(score, 4)).alias("confidence"))


def _among(words: Sequence[str]) -> Callable[[Column], Column]:
    return lambda t: t.isin(*words)


def bundle_languages(docs: DataFrame, by: str, language: str, target: str = "en") -> DataFrame:
    """The sorted normalised tags of a bundle, unknown ones ignored, and those that a translation into ``target`` would be from."""
    tags = F.array_sort(F.collect_set(normalize_language(F.col(language))))
    return docs.groupBy(by).agg(tags.alias("languages")).withColumn("translate_from", F.array_remove("languages", target))


def bundle_completeness(docs: DataFrame, by: str) -> DataFrame:
    """Extracted, failed and skipped documents of a bundle; incomplete if one failed, its acquisition did, or the notice stands in (``from_notice``); archives and unsupported files don't count."""
    n = lambda c: F.count_if(c)
    failed = F.col("status") == "failed"
    lost = (F.col("status") == "skipped") & (F.col("reason") == "acquisition_failed")
    forced = F.col("from_notice") if "from_notice" in docs.columns else F.lit(False)
    return docs.groupBy(by).agg(n(F.col("status") == "extracted").alias("extracted"), n(failed).alias("failed"), n(F.col("status") == "skipped").alias("skipped"), (n(failed | lost | forced) > 0).alias("incomplete"))


def reuse_duplicates(docs: DataFrame, by: str) -> DataFrame:
    """Appends ``master``: the first extracted document of the bundle with the same checksum, null where none was extracted."""
    same = Window.partitionBy(by, "checksum")
    return docs.withColumn("master", F.min(F.when(F.col("status") == "extracted", F.col("doc_id"))).over(same))


def tokens(c: Column) -> Column:
    """Distinct lower-cased tokens of three or more ASCII letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{3,}"), F.lit(0)))


def greedy_fit(items: Column, cap: int, most: int | None = None) -> Column:
    """Walks an ordered array of (..., size) and takes what still fits; what is too big is skipped, not the end."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.filter(items, lambda x: F.lit(False)).alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["size"] <= cap
        if most is not None:
            fits = fits & (F.size(acc["taken"]) < most)
        return F.struct(F.when(fits, acc["used"] + x["size"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.array_append(acc["taken"], x)).otherwise(acc["taken"]).alias("taken"))

    return F.aggregate(items, start, step, lambda acc: acc["taken"])


def first_by_size(items: DataFrame, by: Sequence[str], order: Sequence[Column], size: str, cap: int, most: int | None = None) -> DataFrame:
    """The items that ``greedy_fit`` can take from a group, whatever the group's length.

    Of items of one size a later one is taken only where all before it were, so
    the first ``cap // size`` of each size are all that can be.  A group keeps
    about ``cap * ln(cap)`` items then, and items of size 0.
    """
    turn = F.row_number().over(Window.partitionBy(*by, size).orderBy(*order))
    limit = F.when(F.col(size) > 0, F.floor(F.lit(cap) / F.col(size)))
    limit = limit if most is None else F.least(F.coalesce(limit, F.lit(most)), F.lit(most))
    return items.where(F.col(size) <= cap).withColumns({"_turn": turn, "_limit": limit}).where("_limit IS NULL OR _turn <= _limit").drop("_turn", "_limit")


def flatten_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as (key, location, text) rows: their parts between line breaks that hold more than white space, and for a document without any the whole text at ``document``."""
    parts = docs.select(key, F.posexplode(F.split(text, "\n")).alias("_k", "text")).where("trim(text) <> ''")
    some = parts.select(key, F.concat(F.lit("section:"), (F.col("_k") + 1).cast("string")).alias("location"), "text")
    blank = docs.where(F.trim(F.regexp_replace(text, "\n", "")) == "")
    return some.unionByName(blank.select(key, F.lit("document").alias("location"), F.col(text).alias("text")))


def flatten_bundle(bundles: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pages, tables, sections, text) -> (key, location, text): pages and sections as they are, tables as rows of cells joined by bars, and the text where there is nothing else.

    ``pages`` is an array of texts, ``tables`` of (section, rows of cells) and
    ``sections`` of (heading, text, is_table); a section that is a table isn't
    given twice.
    """
    pages = bundles.select(key, F.posexplode("pages").alias("k", "text")).select(key, F.concat(F.lit("page:"), (F.col("k") + 1).cast("string")).alias("location"), "text")
    rows = F.array_join(F.transform("x.rows", lambda r: F.array_join(r, " | ")), "\n")
    tables = bundles.select(key, F.posexplode("tables").alias("k", "x")).select(key, F.concat(F.lit("table:"), (F.col("k") + 1).cast("string")).alias("location"), rows.alias("text"))
    sections = bundles.select(key, F.posexplode("sections").alias("k", "x")).where("NOT x.is_table").select(key, F.concat(F.lit("section:"), F.col("x.heading")).alias("location"), F.col("x.text").alias("text"))
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) < 1
    rest = bundles.where(empty("pages") & empty("tables") & empty("sections")).select(key, F.lit("document").alias("location"), "text")
    return pages.unionByName(tables).unionByName(sections).unionByName(rest)


def common_vocabulary(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, text) of both sides -> (key, common, signals): the tokens that a requirement and a section share, as ``keyword:`` signals in order."""
    a, b = left.select(key, tokens(F.col("text")).alias("_a")), right.select(key, tokens(F.col("text")).alias("_b"))
    both = F.array_sort(F.array_intersect("_a", "_b"))
    return a.join(b, key).select(key, F.size(both).cast("long").alias("common"), F.transform(both, lambda w: F.concat(F.lit("keyword:"), w)).alias("signals"))


def new_versions(uploads: DataFrame, versions: DataFrame, content: str) -> DataFrame:
    """The uploads whose content no version has; of equal uploads each one."""
    h = lambda df: df.withColumn("_hash", F.sha2(content, 256))
    return h(uploads).join(h(versions).select("_hash"), "_hash", "left_anti").drop("_hash")


def kb_sections(kb: DataFrame, key: str = "kb_id") -> DataFrame:
    """(key, content) -> (key, position, heading, text): a knowledge base cut at its ``#`` headings; what stands before the first has none."""
    parts = kb.select(key, F.posexplode(F.split("content", r"(?m)^(?=#)")).alias("position", "part")).where("trim(part) <> ''")
    first = F.split_part("part", F.lit("\n"), F.lit(1))
    headed = F.startswith("part", F.lit("#"))
    heading = F.when(headed, F.trim(F.regexp_replace(first, "^#+", "")))
    text = F.when(headed, F.substring(F.col("part"), F.length(first) + 2, F.length("part"))).otherwise(F.col("part"))
    return parts.select(key, "position", heading.alias("heading"), F.regexp_replace(text, r"^\s+|\s+$", "").alias("text"))


def plan_delivery(attachments: DataFrame, providers: DataFrame) -> DataFrame:
    """(notification_id, pos, size) by provider limits -> (notification_id, provider_id, attached, linked).

    For each provider files are taken in order while count, size and the
    Base64-coded sum allow; a file that doesn't fit becomes a link and smaller
    ones are still tried.  The first provider by priority that carries all
    wins, else the one with most files, then fewest bytes.
    """
    # the configuration as one value, a scalar subquery of the plan
    each = providers.agg(F.array_sort(F.collect_list(F.struct(*providers.columns)))).scalar()
    coded = 4 * F.ceil(F.col("size") / 3)
    # of files of one size a later one is attached only where all before it were: so many as some provider could carry
    most = F.array_max(F.transform("_each", lambda p: F.when(F.col("size") <= p["max_file"], F.least(p["max_files"], F.coalesce(F.floor(p["max_message"] / F.nullif(coded, F.lit(0))), p["max_files"]))).otherwise(0)))
    turn = F.row_number().over(Window.partitionBy("notification_id", "size").orderBy("pos"))
    first = attachments.withColumn("_each", each).withColumn("_most", most).drop("_each").where("_most > 0").withColumn("_turn", turn).where("_turn <= _most")
    total = attachments.groupBy("notification_id").agg(F.count(F.lit(1)).alias("total"))
    items = first.groupBy("notification_id").agg(F.array_sort(F.collect_list(F.struct("pos", coded.alias("coded"), F.col("size").alias("raw")))).alias("items"))
    both = total.join(items, "notification_id", "left").withColumn("items", F.coalesce("items", F.array().cast("array<struct<pos: bigint, coded: bigint, raw: bigint>>")))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("bytes"))

    def packed(p: Column) -> Column:
        """What a provider takes, with what makes it better than others first."""

        def step(acc: Column, x: Column) -> Column:
            fits = (x["raw"] <= p["max_file"]) & (acc["n"] < p["max_files"]) & (acc["bytes"] + x["coded"] <= p["max_message"])
            return F.when(fits, F.struct((acc["n"] + 1).alias("n"), (acc["bytes"] + x["coded"]).alias("bytes"))).otherwise(acc)

        def ranked(acc: Column) -> Column:
            whole = acc["n"] == F.col("total")
            return F.struct((~whole).alias("some"), F.when(whole, p["priority"]).alias("first"), (-acc["n"]).alias("n"), acc["bytes"].alias("bytes"), p["priority"].alias("priority"), p["provider_id"].alias("provider_id"))

        return F.aggregate("items", start, step, ranked)

    best = both.withColumn("_each", each).where(F.size("_each") > 0).select("notification_id", "total", F.array_min(F.transform("_each", packed)).alias("best"))
    return best.select("notification_id", F.col("best.provider_id").alias("provider_id"), (-F.col("best.n")).cast("long").alias("attached"), (F.col("total") + F.col("best.n")).cast("long").alias("linked"))


def version_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Lines added and removed between two versions, as a multiset with counts."""
    counts = lambda df, sign: df.groupBy("line").agg((sign * F.count(F.lit(1))).alias("n"))
    net = counts(old, -1).unionByName(counts(new, 1)).groupBy("line").agg(F.sum("n").alias("n")).where("n <> 0")
    return net.select("line", F.when(F.col("n") > 0, "added").otherwise("removed").alias("change"), F.abs("n").alias("times"))
