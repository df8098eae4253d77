"""Deadlines from several sources, citations, coverage, verdict rules, table roles, context budgets and guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticelake.functions.text import fold_tokens
from noticelake.functions.urls import bare_media_type


#: Why there is no deadline, the most telling first.
REASONS = ("UNPARSEABLE", "NO_TIMEZONE", "MISSING")


def resolve_deadlines(listing: DataFrame, detail: DataFrame, documents: DataFrame, tolerance: int = 900) -> DataFrame:
    """(notice_id, deadline) of listings and details, and (notice_id, doc_order, deadline) of documents, each with a ``reason`` where it has none -> (notice_id, deadline, source, reason, listing, detail).

    Listing and detail more than ``tolerance`` seconds apart conflict and give
    no value, but both stay as evidence; otherwise the listing counts, then the
    detail, then the first document in order with one; else the notice is
    unresolved, with the most telling reason of all.
    """
    why = lambda df: F.col("reason") if "reason" in df.columns else F.lit(None).cast("string")
    rank = lambda c: F.array_position(F.array(*map(F.lit, REASONS)), c)
    worst = lambda *cs: F.get(F.array(*map(F.lit, REASONS)), (F.least(*[F.nullif(rank(c), F.lit(0)) for c in cs]) - 1).cast("int"))
    l, e = listing.select("notice_id", F.col("deadline").alias("listing"), why(listing).alias("_r1")), detail.select("notice_id", F.col("deadline").alias("detail"), why(detail).alias("_r2"))  # noqa: E741
    first = documents.select("notice_id", "doc_order", "deadline", why(documents).alias("_r")).groupBy("notice_id").agg(F.min_by("deadline", F.when(F.col("deadline").isNotNull(), F.col("doc_order"))).alias("document"), F.min(F.nullif(rank(F.col("_r")), F.lit(0))).alias("_r3"))
    first = first.withColumn("_r3", F.get(F.array(*map(F.lit, REASONS)), (F.col("_r3") - 1).cast("int")))
    both = l.join(e, "notice_id", "full_outer").join(first, "notice_id", "full_outer")
    apart = F.coalesce(F.abs(F.unix_timestamp("listing") - F.unix_timestamp("detail")) > tolerance, F.lit(False))
    source = F.when(apart, "conflicting").when(F.col("listing").isNotNull(), "listing").when(F.col("detail").isNotNull(), "detail").when(F.col("document").isNotNull(), "document").otherwise("unresolved")
    reason = F.when(source == "conflicting", "CONFLICTING").when(source == "unresolved", F.coalesce(worst(F.col("_r1"), F.col("_r2"), F.col("_r3")), F.lit("MISSING")))
    return both.select("notice_id", F.when(~apart, F.coalesce("listing", "detail", "document")).alias("deadline"), source.alias("source"), reason.alias("reason"), "listing", "detail")


def verify_kb_citations(citations: DataFrame, sections: DataFrame) -> DataFrame:
    """(cite_id, section, quote) against (heading, content): the canonical heading of each, matched without regard to ``#`` and case, and whether the quote stands ``verbatim`` in the knowledge base; citations of no section are dropped."""
    key = lambda c: F.lower(F.trim(F.regexp_replace(F.trim(c), "^#+", "")))
    known = sections.groupBy(key(F.col("heading")).alias("_k")).agg(F.min("heading").alias("heading"))
    kept = citations.withColumn("_k", key(F.col("section"))).join(known, "_k")
    hits = kept.join(sections.select(key(F.col("heading")).alias("_k"), "content"), "_k").groupBy("cite_id").agg(F.bool_or(F.contains("content", F.col("quote"))).alias("verbatim"))
    return kept.join(hits, "cite_id").drop("_k")


def unsupported(assessments: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Assessments with ``status`` unverified where they were met without a citation that was kept."""
    some = kept.select(key).distinct().withColumn("_cited", F.lit(True))
    lost = (F.col("status") == "met") & F.col("_cited").isNull()
    return assessments.join(some, key, "left").withColumn("status", F.when(lost, "unverified").otherwise(F.col("status"))).drop("_cited")


def bind_assessments(assessments: DataFrame, requirements: DataFrame) -> DataFrame:
    """(notice_id, pos, text) of both sides -> assessments with ``req_no``: by folded text, else by position where a notice's counts are equal."""
    fold = lambda c: F.lower(F.trim(c))
    n = F.count(F.lit(1)).over(Window.partitionBy("notice_id"))
    a = assessments.withColumn("n_a", n)
    r = requirements.withColumn("n_r", n)
    by_text = r.select("notice_id", fold(F.col("text")).alias("k"), "pos").groupBy("notice_id", "k").agg(F.min("pos").alias("by_text"))
    by_pos = r.select("notice_id", "pos", "n_r")
    both = a.withColumn("k", fold(F.col("text"))).join(by_text, ["notice_id", "k"], "left").join(by_pos, ["notice_id", "pos"], "left")
    return both.select("notice_id", "pos", F.coalesce("by_text", F.when(F.col("n_a") == F.col("n_r"), F.col("pos"))).alias("req_no"))


def requirement_coverage(established: DataFrame, listed: DataFrame, assessed: DataFrame, evidence: DataFrame | None = None, given: DataFrame | None = None) -> DataFrame:
    """(notice_id, requirement) of three sides -> what is missing from one of them or twice in it, with the ``problem``.

    What was established independently must be listed and assessed exactly; with
    ``evidence`` (notice_id, requirement, reference) each assessment must also
    give the established references.
    """
    keys = ["notice_id", "requirement"]
    named = lambda df, problem: df.withColumn("problem", F.lit(problem))
    lacks = lambda a, b, problem: named(a.select(*keys).distinct().join(b, keys, "left_anti"), problem)
    twice = lambda df, problem: named(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys), problem)
    out = [lacks(established, listed, "not_listed"), lacks(listed, established, "listed_not_established"), lacks(established, assessed, "not_assessed"), lacks(assessed, established, "assessed_not_established"), twice(listed, "listed_twice"), twice(assessed, "assessed_twice")]
    if evidence is not None and given is not None:
        out.append(named(evidence.join(given, [*keys, "reference"], "left_anti").select(*keys).distinct().join(assessed, keys, "left_semi"), "evidence_omitted"))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def requirement_set_equal(a: DataFrame, b: DataFrame, by: str, item: str) -> DataFrame:
    """By group: whether both sides hold the same set of items, whether the first is a subset, and whether they agree with repeats counted."""
    count = lambda df, n: df.groupBy(by, item).agg(F.count(F.lit(1)).alias(n))
    both = count(a, "x").join(count(b, "y"), [by, item], "full_outer")
    return both.groupBy(by).agg(F.bool_and(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("equal"), F.bool_and(F.col("x").isNull() | F.col("y").isNotNull()).alias("subset"), F.bool_and(F.col("x").eqNullSafe(F.col("y"))).alias("same_counts"))


VERDICTS = ("APPLY", "DO NOT APPLY", "APPLY WITH CONDITIONS")
STATUSES = ("met", "not_met", "partially_met", "unverified")
NO_EVIDENCE = "no evidence on file"
#: Parts of a deadline as it is shown.
SHOWN = ("date", "time", "zone", "source_zone")


def verdict_rules(schema_version: str) -> dict[str, Column]:
    """The semantic rules of a verdict, each as a condition that must not hold.

    A verdict has schema_version, verdict, incomplete and what it should be
    (incomplete_inputs), deadline_status, deadline_utc and what they should be
    (expected_status, expected_utc), deadline_shown, the date, time, zone and the
    source's zone as shown and as they should be (deadline_date, expected_date
    and so on), assessments (status, gap,
    assessment, tender and company as counts of evidence), has_tender_text,
    gaps, limitations, urgent, days_left (business days) and urgency_window.
    """
    col, some = F.col, lambda bad: F.exists("assessments", bad)
    none = lambda n: F.coalesce(n, F.lit(0)) == 0
    says = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(NO_EVIDENCE))
    follows = F.when(some(lambda x: x["status"] == "not_met"), "DO NOT APPLY").when(F.forall("assessments", lambda x: x["status"] == "met") & (F.coalesce(F.size("gaps"), F.lit(0)) <= 0), "APPLY").otherwise("APPLY WITH CONDITIONS")
    resolved = col("deadline_status") == "RESOLVED"
    urgent = F.coalesce(resolved & col("urgency_window").isNotNull() & col("days_left").between(F.lit(0), col("urgency_window")), F.lit(False))
    return {
        "schema_version_mismatch": col("schema_version") != schema_version,
        "invalid_verdict": ~F.coalesce(col("verdict").isin(*VERDICTS), F.lit(False)),
        "incomplete_mismatch": ~col("incomplete").eqNullSafe(col("incomplete_inputs")),
        "deadline_mismatch": ~col("deadline_status").eqNullSafe(col("expected_status")) | ~col("deadline_utc").eqNullSafe(col("expected_utc")),
        "deadline_display_mismatch": F.exists(F.array(*[~col(f"deadline_{part}").eqNullSafe(col(f"expected_{part}")) for part in SHOWN]), lambda x: x),
        "assessments_required": F.coalesce(F.size("assessments"), F.lit(0)) <= 0,
        "invalid_status": some(lambda x: ~F.coalesce(x["status"].isin(*STATUSES), F.lit(False))),
        "citation_missing": some(lambda x: (x["status"] == "met") & none(x["company"])),
        "negative_without_evidence": some(lambda x: (x["status"] == "not_met") & (none(x["company"]) | none(x["tender"]))),
        "unsupported_not_unverified": some(lambda x: (x["status"] != "unverified") & none(x["company"])),
        "gap_missing": some(lambda x: (x["status"] == "unverified") & x["gap"].isNull()),
        "tender_evidence_missing": col("has_tender_text") & some(lambda x: none(x["tender"])),
        "no_evidence_wording": some(lambda x: (x["status"] == "unverified") & none(x["company"]) & ~(says(x["gap"]) & says(x["assessment"]))),
        "verdict_does_not_follow": col("verdict") != follows,
        "limitation_missing": col("incomplete_inputs") & (F.coalesce(F.size("limitations"), F.lit(0)) <= 0),
        "deadline_fabricated": ~resolved & col("deadline_shown").isNotNull(),
        "urgency_mismatch": ~col("urgent").eqNullSafe(urgent),
    }


def verdict_violations(verdicts: DataFrame, rules: dict[str, Column] | None = None, schema_version: str = "1.0") -> DataFrame:
    """One row per verdict and broken rule; a rule is a condition that must not hold, ``verdict_rules`` unless others are given."""
    rules = verdict_rules(schema_version) if rules is None else rules
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return verdicts.select("verdict_id", F.explode(broken).alias("rule"))


def reference_violations(cited: DataFrame, chunks: DataFrame, established: DataFrame | None = None) -> DataFrame:
    """(verdict_id, doc_id, location, quote) against (doc_id, location, text) -> (verdict_id, rule): verdicts with a tender reference that doesn't exist.

    A reference needs its quote word for word in a chunk of that document and
    place; quotes of ``established`` evidence (verdict_id, doc_id, location,
    quote) are places of their verdict, as chunks may have been left out.
    Equi-joins on document and place, so no document is put together.
    """
    place = ["doc_id", "location"]
    # a row of its own for each reference, so that what repeats is looked up once
    asked = cited.select("verdict_id", *place, "quote").distinct()
    holds = lambda text: F.coalesce(F.contains(text, F.coalesce("quote", F.lit(""))), F.lit(False))
    found = asked.join(chunks.select(*place, "text"), place).where(holds(F.col("text"))).select(*asked.columns)
    if established is not None:
        found = found.unionByName(asked.join(established.select("verdict_id", *place, F.col("quote").alias("text")), ["verdict_id", *place]).where(holds(F.col("text"))).select(*asked.columns))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"f.{c}")) for c in asked.columns]
    lost = asked.alias("a").join(found.distinct().alias("f"), same, "left_anti")
    return lost.select("verdict_id", F.lit("invalid_tender_reference").alias("rule")).distinct()


def kb_violations(cited: DataFrame, kb: DataFrame) -> DataFrame:
    """(verdict_id, kb_id, section, quote) against (kb_id, content) -> (verdict_id, rule): verdicts with a citation whose section isn't a heading of the knowledge base, or whose quote doesn't stand in it."""
    heads = F.transform(F.filter(F.split("content", "\n"), lambda line: line.startswith("#")), lambda line: F.trim(F.regexp_replace(line, "^[# ]+", "")))
    both = cited.select("verdict_id", "kb_id", "section", "quote").distinct().join(kb.select("kb_id", "content", heads.alias("_heads")), "kb_id", "left")
    sound = F.array_contains("_heads", F.col("section")) & F.contains("content", F.col("quote"))
    return both.where(~F.coalesce(sound, F.lit(False))).select("verdict_id", F.lit("invalid_kb_citation").alias("rule")).distinct()


def apply_notice_penalty(verdicts: DataFrame, limitation: str, penalty: float = 0.25) -> DataFrame:
    """Confidence less the penalty, not below 0, and the limitation put first once."""
    has = F.exists("limitations", lambda x: x == limitation)
    return verdicts.withColumns({"confidence": F.greatest(F.lit(0.0), F.round(F.col("confidence") - penalty, 4)), "limitations": F.when(has, F.col("limitations")).otherwise(F.concat(F.array(F.lit(limitation)), F.col("limitations")))})


# Words of each role in English, French and Portuguese, in the singular and without accents; the roles' order settles ties.
ROLES = {
    "deadline": "date deadline due milestone schedule calendar time period submission closing opening delai echeance calendrier jalon limite depot cloture ouverture prazo data cronograma marco entrega abertura encerramento vigencia",
    "eligibility": "requirement mandatory eligibility eligible evidence required qualification registration certificate licence exclusion exigence eligibilite obligatoire attestation certificat inscription requis requisito elegibilidade obrigatorio certidao exclusao comprovacao",
    "evaluation": "criterion criteria weight weighting threshold score scoring point rating percentage mark critere seuil ponderation note bareme notation pourcentage criterio peso pontuacao ponderacao nota avaliacao classificacao percentual",
    "financial": "price cost budget amount total fee payment turnover revenue currency invoice guarantee prix cout montant paiement devise facture garantie bilan preco custo valor orcamento pagamento moeda fatura garantia balanco",
    "experience": "project client experience year reference contract portfolio staff specialist similar projet annee contrat realisation equipe specialiste projeto experiencia ano referencia contrato especialista",
}


def table_vocabulary(spark: SparkSession, roles: dict[str, str] = ROLES) -> DataFrame:
    """(word, role, rank): the words of the roles with their plurals, as a table to join with; a word of several roles counts for each.

    A plural takes s, after a consonant that asks for it es; Portuguese words in
    -ao have -oes too, English ones in -y -ies.
    """

    def forms(w: str) -> set[str]:
        out = {w, w if w.endswith("s") else f"{w}es" if w.endswith(("x", "ch", "sh", "r", "z")) else f"{w}s"}
        return out | ({f"{w[:-2]}oes"} if w.endswith("ao") else set()) | ({f"{w[:-1]}ies"} if w.endswith("y") else set()) | ({f"{w}s"} if w.endswith("r") else set())

    rows = [(form, role, rank) for rank, (role, words) in enumerate(roles.items()) for w in words.split() for form in sorted(forms(w))]
    return spark.createDataFrame(sorted(set(rows)), "word string, role string, rank int")


def classify_tables(cells: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(table_id, row, text) -> (table_id, role): by distinct vocabulary words, without case and accents, in the header (row 0, twice) and the first body row; two at least, ties by the roles' order."""
    words = cells.where("row <= 1").select("table_id", "row", F.explode(fold_tokens(F.col("text"))).alias("word")).distinct()
    hits = words.join(vocabulary, "word").groupBy("table_id", "role", "rank").agg(F.count_distinct("word").alias("n"), F.sum(F.when(F.col("row") == 0, 2).otherwise(1)).alias("score")).where("n >= 2")
    best = hits.groupBy("table_id").agg(F.max_by("role", F.struct("score", -F.col("rank"))).alias("role"))
    return cells.select("table_id").distinct().join(best, "table_id", "left").fillna("other", ["role"])


def map_reduce_gate(bundles: DataFrame, window: int, reserve: int, overhead: int = 1400, segment_overhead: int = 1200) -> DataFrame:
    """Appends ``needs_map``: whether a bundle's tokens with overhead and reserve exceed the model's window; and with ``longest``, the tokens of its longest segment, the ``error`` of one that can't be mapped either."""
    out = bundles.withColumn("needs_map", F.col("tokens") + overhead + reserve > window)
    if "longest" in bundles.columns:
        out = out.withColumn("error", F.when(F.col("needs_map") & (F.col("longest") + segment_overhead + reserve > window), "segment_exceeds_window"))
    return out


def archive_lineage(docs: DataFrame) -> DataFrame:
    """(url, ok) -> (parent, members, acquired): the archive before ``!/``; acquired only if every member is."""
    return docs.groupBy(F.split_part("url", F.lit("!/"), F.lit(1)).alias("parent")).agg(F.count(F.lit(1)).alias("members"), F.bool_and("ok").alias("acquired"))


def document_identity(docs: DataFrame, keys: Sequence[str], newest: str, tie: str) -> DataFrame:
    """The newest row of each identity, by notice and checksum, or for retries by notice, address and file name; of equally new ones the largest ``tie``."""
    order = [F.desc(newest), F.desc(tie)]
    return docs.withColumn("_turn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_turn = 1").drop("_turn")


def size_mismatch(advertised: Column, actual: Column) -> Column:
    """More than 1 MiB apart and more than a quarter of what was stated (or nothing stated)."""
    delta = F.abs(actual - advertised)
    return (delta > 1 << 20) & ((advertised == 0) | (delta > 0.25 * advertised))


HTML_TYPES = ("text/html", "application/xhtml+xml")
BINARY_SUFFIXES = ("pdf", "doc", "docx", "xls", "xlsx", "zip")


def invalid_response(media_type: Column, name: Column) -> Column:
    """Whether a page came where a binary document was asked for."""
    return bare_media_type(media_type).isin(*HTML_TYPES) & F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)).isin(*BINARY_SUFFIXES)


def needs_ocr(text: Column, least: int = 25) -> Column:
    """Whether a page's own text is too short to be its content."""
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < least


def notification_events(verdicts: DataFrame, diff: DataFrame) -> DataFrame:
    """(notice_id, failed) and (notice_id, outcome) -> kind and whether it goes out as a raw notice; notices of unknown provenance are rejected."""
    both = verdicts.join(diff, "notice_id", "left")
    kind = F.when(F.col("outcome") == "UPDATE", "UPDATE").when(F.col("outcome") == "NEW", "NEW").otherwise("REJECTED")
    return both.select("notice_id", kind.alias("kind"), F.when(F.col("failed"), "raw-notice").otherwise("verdict").alias("form"))


def resolve_profile(roles: DataFrame, profiles: DataFrame) -> DataFrame:
    """(role, primary_id, fallback_id) -> (role, profile_id): the first that is active and approved; null waits for approval."""
    fit = profiles.where("active AND approved").select("profile_id")
    a = fit.select(F.col("profile_id").alias("primary_id"), F.lit(True).alias("p"))
    b = fit.select(F.col("profile_id").alias("fallback_id"), F.lit(True).alias("f"))
    return roles.join(a, "primary_id", "left").join(b, "fallback_id", "left").select("role", F.when(F.col("p"), F.col("primary_id")).when(F.col("f"), F.col("fallback_id")).alias("profile_id"))


def subject(title: Column, urgent: Column, test: Column) -> Column:
    """``[TEST]`` once and first, then ``URGENT``."""
    plain = F.regexp_replace(title, r"^(\[TEST\] *)+", "")
    return F.concat(F.when(test, "[TEST] ").otherwise(""), F.when(urgent, "URGENT ").otherwise(""), plain)


def test_mode_violation(list_types: Column, test: Column) -> Column:
    """Whether a notification in test mode would reach anyone but the developers, or no one at all."""
    return test & ((F.coalesce(F.size(list_types), F.lit(0)) <= 0) | (F.size(F.array_except(list_types, F.array(F.lit("dev_alert")))) > 0))
