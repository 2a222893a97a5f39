"""Whole flows composed from the operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake import vocab
from policylake.functions import answers as A
from policylake.functions import chunk as C
from policylake.functions import extract as E
from policylake.functions import score as S
from policylake.functions import text as X
from policylake.operators import coverage as CV
from policylake.operators import embed as EM
from policylake.operators import hooks as H
from policylake.operators import lifecycle as L
from policylake.operators import linkgraph as LG
from policylake.operators import merge as G
from policylake.operators import pages as PG
from policylake.operators import reports as RP
from policylake.operators import retrieval as RT
from policylake.operators import similar as M
from policylake.session import checkpointed, computed_once


def rule_fields(docs: DataFrame, payers: Mapping[str, Sequence[str]] = vocab.PAYERS_EXTRACTION,
                text: str = "text") -> DataFrame:
    """Fields found by patterns, with the confidence in them."""
    body = F.col(text)
    found = docs.withColumns({
        "payer": S.detect_payer(body, payers), "policy_type": S.detect_policy_type(body),
        "title": X.extract_title(body), "_dates": E.raw_dates_hybrid(body),
        "key_requirements": E.key_requirements(body), "timely_filing_days": E.timely_filing_days(body),
        "prior_auth_required": S.detect_prior_auth(body),
    })
    found = found.withColumn("effective_date", F.col("_dates.effective")).withColumn(
        "expiration_date", F.col("_dates.expiration")).drop("_dates")
    return computed_once(found, "confidence_score", S.confidence_fields(
        F.col("payer"), F.col("policy_type"), F.col("effective_date"), F.col("timely_filing_days"),
        F.col("prior_auth_required"), F.col("key_requirements")))


def section_chunks(docs: DataFrame, size: int = vocab.SENTENCE_CHUNK[0], overlap: int = vocab.SENTENCE_CHUNK[1],
                   compat: bool = False) -> DataFrame:
    """Chunk records of ``docs(filename, payer, text)``: sections, cut further where they are long."""
    def pieces(s: Column) -> Column:
        # A text without headers is always cut; a section only when it is too long.
        cut = (s["section"] == "General") | (F.length(s["content"]) > size)
        texts = F.when(cut, F.transform(C.chunk_sentence(s["content"], size, overlap), lambda c: c["chunk"])).otherwise(
            F.array(s["content"]))
        return F.transform(texts, lambda t: F.struct(s["section"].alias("section"), t.alias("chunk")))

    # Chunks are numbered inside their document, so that a text needs no shuffle and equal file names don't mix.
    numbered = F.flatten(F.transform(C.split_sections(F.col("text"), compat), pieces))
    own = [c for c in ("doc_id",) if c in docs.columns]
    rows = docs.select(*own, "filename", "payer", F.posexplode(numbered).alias("number", "c")).select(
        *own, "filename", "payer", "number", "c.section", "c.chunk")
    return rows.select(
        *own, F.concat("filename", F.lit("_"), F.col("number").cast("string")).alias("chunk_id"),
        F.col("chunk").alias("text"), "section", S.topics(F.col("chunk")).alias("topics"),
        F.coalesce("payer", F.lit("unknown")).alias("payer"), F.coalesce("filename", F.lit("unknown")).alias("source_file"),
        F.length("chunk").alias("char_count"))


def policy_flow(docs: DataFrame, as_of: str, load_model: Callable[[], H.Model] | None = None,
                prompt: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(policies left in the store, status per document).

    ``docs(doc_id, payer_name, source_pdf, crawl_timestamp, text)``. A document's
    content is its complete model reply where there is one, else its first rule
    by patterns; a document with neither fails. Policies replace one another in
    the order they arrive.
    """
    asked = docs
    reply = F.lit(None).cast("string")
    if load_model is not None:
        asked = H.model_extract(docs, prompt if prompt is not None else F.col("text"), load_model)
        cleaned = E.clean_model_json(F.col("model_output"))
        reply = F.when(E.valid_policy_json(cleaned), cleaned)
    rule = E.first_of(E.rules_with_window(F.col("text")))
    found = asked.select(*docs.columns, reply.alias("reply"), rule.alias("rule"))
    produced = found.withColumn("policy_type", F.coalesce(
        F.get_json_object("reply", "$.policy_type"), F.col("rule.policy_type")))
    # The model and the patterns run once; both results are read from what they gave.
    nothing = F.array().cast("array<string>")
    identity = L.policy_identity(produced.drop("reply", "rule").withColumns({"requirements": nothing, "procedures": nothing}))
    once = checkpointed(identity.drop("text", "requirements", "procedures"))
    known = F.col("policy_type").isNotNull()
    status = once.select("doc_id", F.when(known, "success").otherwise("failed").alias("status"), known.cast("int").alias("policies"))
    identified = once.where(known)
    return L.replay_arrivals(identified, as_of), status


def hybrid_extract(docs: DataFrame, load_model: Callable[[], H.Model] | None = None, threshold: float = 0.75,
                   payers: Mapping[str, Sequence[str]] = vocab.PAYERS_EXTRACTION, template: str = "{text}",
                   prompt_chars: int | None = None, known_payer: str | None = None) -> DataFrame:
    """Fields by patterns; documents below the threshold also ask a model, whose keys win."""
    fields = ("payer", "policy_type", "title", "effective_date", "expiration_date")
    found = rule_fields(docs, payers)
    if known_payer is not None:
        found = found.withColumn("payer", F.when(F.col("payer") == "Unknown", F.col(known_payer)).otherwise(F.col("payer")))
    low = S.needs_fallback(F.col("confidence_score"), threshold, load_model is not None)
    sure = found.where(~low).withColumns({
        "summary": F.lit(None).cast("string"), "ai_used": F.lit(False), "ai_error": F.lit(None).cast("string"),
        "extraction_method": F.lit("rules")})
    if load_model is None:
        return sure
    asked = H.model_extract(found.where(low), H.truncated(F.col("text"), template, prompt_chars), load_model)
    reply = asked.withColumn("reply", E.clean_model_json(F.col("model_output"))).withColumn(
        "ai_used", F.coalesce(F.json_object_keys("reply").isNotNull(), F.lit(False)))
    merged = reply.select(
        *[c for c in found.columns if c not in fields],
        *[E.overlay(F.col(f), F.col("reply"), f).alias(f) for f in fields],
        E.overlay(F.lit(None).cast("string"), F.col("reply"), "summary").alias("summary"),
        "ai_used", F.when(~F.col("ai_used"), F.coalesce("model_error", F.lit("the reply is no JSON object"))).alias("ai_error"),
        F.when(F.col("ai_used"), "hybrid").otherwise("rules").alias("extraction_method"))
    return sure.unionByName(merged)


def quality_funnel(docs: DataFrame, max_docs: int | None = None, threshold: float = 0.8) -> DataFrame:
    """(doc_id, url, stage, reason, dup_of) for every input.

    ``docs(doc_id, url, pages)``. Addresses are scored first; the accepted ones,
    in id order and up to ``max_docs``, have their pages cleaned and judged.
    A document that resembles an accepted earlier one is a duplicate whatever
    its own verdict.
    """
    scored = docs.withColumn("u", S.url_score(F.col("url")))
    refused = scored.where("not u.accepted").select(
        "doc_id", "url", F.lit("url_rejected").alias("stage"), F.col("u.reason").alias("reason"),
        F.lit(None).cast("long").alias("dup_of"))
    accepted = scored.where("u.accepted").drop("u")
    if max_docs is not None:
        accepted = accepted.orderBy("doc_id").limit(max_docs)
    cleaned = accepted.select("doc_id", "url", X.clean_pages(F.col("pages")).alias("c"))
    judged = cleaned.select("doc_id", "url", F.col("c.full_text").alias("text"), S.assess_content(
        F.col("c.full_text"), F.col("c.content_length"), F.col("c.word_count"),
        F.size(E.content_sections(F.col("c.full_text")))).alias("a"))
    repeats = M.near_duplicates(judged, "doc_id", "text", threshold,
                                eligible=F.col("a.recommendation") == "accept")
    decided = judged.select("doc_id", "url", "a.recommendation", "a.reason").join(
        repeats.select(F.col("id").alias("doc_id"), "dup_of"), "doc_id", "left")
    is_copy = F.col("dup_of").isNotNull()
    return decided.select(
        "doc_id", "url",
        F.when(is_copy, "duplicate").when(F.col("recommendation") == "accept", "accepted").otherwise("rejected").alias("stage"),
        F.when(is_copy, "Duplicate content").otherwise(F.col("reason")).alias("reason"), "dup_of",
    ).unionByName(refused)


def quality_analysis(docs: DataFrame, top: int) -> dict[str, DataFrame]:
    """Documents with their quality, and the report's parts; ``top`` documents are listed as most relevant.

    ``docs(doc_id, url, title, page_count, file_size, content_type, text)``.
    """
    gated = docs.withColumn("rejected", S.size_gate(F.col("url"), F.col("content_type"), F.col("file_size")))
    analysed = gated.where("rejected is null").withColumn("quality", S.quality_flags(
        F.col("title"), F.col("text"), F.col("page_count"), S.estimated_length(F.col("text"), F.col("page_count"))))
    members = M.exact_duplicate_groups(analysed, "doc_id", "text")
    return {
        "rejected": gated.where("rejected is not null").groupBy("rejected").agg(F.count("*").alias("n")),
        "documents": analysed, "summary": RP.quality_summary(analysed), "flags": RP.quality_flag_counts(analysed),
        "categories": RP.category_counts(analysed), "top": RP.top_relevant(analysed, "doc_id", top),
        "duplicates": RP.duplicate_listing(members, "doc_id"),
    }


def rule_mining(docs: DataFrame, text: str = "text", min_chars: int = 100, keep_newlines: bool = True,
                threshold: float = 0.85, numeric_as_sentence: bool = True) -> DataFrame:
    """Documents with their valid, rated and de-duplicated rules, headers and statistics.

    Texts under ``min_chars`` yield nothing.
    """
    cleaned = docs.where(F.length(text) >= min_chars).withColumn(
        "clean_text", X.clean_noise(F.col(text), keep_newlines=keep_newlines))
    found = E.rules_in_sentence(F.col("clean_text"), numeric_as_sentence=numeric_as_sentence)
    valid = F.filter(found, lambda r: S.is_valid_rule(r["requirement"], r["full_context"]))
    rated = F.transform(valid, lambda r: F.struct(
        r["rule_type"].alias("rule_type"), r["requirement"].alias("requirement"),
        r["full_context"].alias("full_context"), S.rule_confidence(r["full_context"], r["rule_type"]).alias("confidence"),
        r["source_text"].alias("source_text")))
    mined = cleaned.withColumn("found", rated).withColumn(
        "rules", M.dedupe_rules(F.col("found"), lambda r: r["requirement"], threshold)).drop("found")
    length = F.length("clean_text")
    return mined.withColumns({
        "sections": E.section_headers(F.col("clean_text")),
        "payer": S.detect_payer(F.col("clean_text"), vocab.PAYERS_MINING, None),
        "state": S.detect_state(F.col("clean_text")),
        "effective_date": E.effective_date_text(F.col("clean_text")),
        "rules_by_type": RP.rules_by_type(F.col("rules")),
        "quality": RP.extraction_quality(F.col("rules"), length),
        "text_length": length,
    })


def manual_extract(docs: DataFrame, load_model: Callable[[], H.Model], template: str = "{section}\n{text}",
                   min_chars: int = 200) -> DataFrame:
    """(doc_id, payer, policy_type, title, summary, dates, section, field, item) of manuals.

    ``docs(doc_id, payer, text)``. Each section's evidence goes to the model; a
    reply counts when it is complete, and its deadlines when the evidence names
    them.
    """
    cleaned = docs.select("doc_id", "payer", X.drop_boilerplate_lines(F.col("text")).alias("text"))
    typed = cleaned.withColumns({"policy_type": S.classify_policy_type(F.col("text")),
                                 "dates": E.raw_dates_strict(F.col("text"))})
    evidence = F.array(*[F.struct(F.lit(n).alias("section"), E.section_text(F.col("text"), n).alias("evidence"))
                         for n in vocab.MANUAL_SECTIONS])
    named = typed.withColumn("evidence", F.filter(evidence, lambda e: e["evidence"].isNotNull()))
    titled = named.withColumns({
        "title": S.manual_title(F.col("payer"), F.col("policy_type")),
        "summary": S.manual_summary(F.col("payer"), F.col("policy_type"), F.transform("evidence", lambda e: e["section"])),
    })
    parts = titled.select("doc_id", "payer", "policy_type", "title", "summary", "dates.*", F.inline_outer("evidence"))
    usable = F.length("evidence") >= min_chars
    before, after = template.split("{text}")
    prompt = F.concat(F.replace(F.lit(before), F.lit("{section}"), F.col("section")), F.col("evidence"), F.lit(after))
    replied = H.model_extract(parts.where(usable), prompt, load_model)
    cut = computed_once(replied.select("doc_id", "section", "evidence", "model_output"), "reply", E.clean_model_json(F.col("model_output")))
    # One pass over the replies: the fields asked for depend on the section.
    items = F.array().cast("array<struct<field:string,items:array<string>>>")
    def listed(fields: Sequence[str]) -> Callable[[Column], Column]:
        return lambda found: F.array(*[F.struct(F.lit(n).alias("field"), (
            E.validate_deadlines(found[n], F.col("evidence")) if n == "deadlines" else found[n]).alias("items")) for n in fields])

    for section, fields in vocab.SECTION_FIELDS.items():
        replies = X.let(E.section_fields(F.col("reply"), section), listed(fields))
        items = F.when(F.col("section") == section, replies).otherwise(items)
    rows = cut.select("doc_id", "section", F.inline(items)).select("doc_id", "section", "field", F.explode("items").alias("item"))
    heads = titled.select("doc_id", "payer", "policy_type", "title", "summary", "dates.*")
    return heads.join(rows, "doc_id", "left")


def rag_index(docs: DataFrame, load=None, dims: int = 64) -> DataFrame:
    """Chunk records with vectors, from ``docs(filename, payer, text)``."""
    return EM.embed(section_chunks(docs), F.col("text"), load, dims)


def rag_answer(questions: DataFrame, index: DataFrame, k: int = 5, payer: str | None = None, load=None,
               dims: int = 64) -> DataFrame:
    """(qid, context, sources): the nearest chunks' texts and the first sources."""
    asked = EM.embed(questions, F.col("question"), load, dims)
    kept = index if payer is None else index.where(F.col("payer") == payer)
    numbered = kept.withColumn("id", G.surrogate_key(F.col("chunk_id")))
    hits = RT.search(asked, numbered, k)
    detail = numbered.select("id", F.col("text").alias("content"), F.col("source_file").alias("filename"), "section")
    ranked = hits.join(detail, "id").groupBy("qid").agg(F.array_sort(F.collect_list(
        F.struct("rank", "similarity", "id", "content", "filename", "section"))).alias("hits"))
    return ranked.select("qid", A.chunk_context(F.col("hits")).alias("context"), A.source_lines(F.col("hits")).alias("sources"))


def regional_report(docs: DataFrame, expected: DataFrame) -> dict[str, DataFrame]:
    """Coverage per payer and overall, gaps and what to try, from ``docs(payer_name, url, text)``."""
    analysed = CV.document_regions(docs)
    coverage = CV.payer_coverage(analysed, expected)
    return {
        "documents": analysed, "payers": coverage, "regions": CV.payer_regions(analysed),
        "scopes": CV.distribution(analysed, "scope"), "types": CV.distribution(analysed, "coverage_type"),
        "gaps": CV.coverage_gaps(analysed, expected), "overall": CV.overall_coverage(analysed),
        "strategy": CV.discovery_strategy(coverage),
    }


def portal_analysis(pages: DataFrame, targets: Mapping[str, Sequence[str]] = vocab.TARGET_SECTIONS,
                    link_terms: Sequence[str] = vocab.PAGE_LINK_TERMS) -> dict[str, DataFrame]:
    """Sections, links, downloads and target matches of stored pages ``(page_id, url, html)``."""
    parsed = PG.parsed_pages(pages)
    found = PG.target_sections(parsed, targets, link_terms)
    links = PG.page_links(parsed)
    return {
        "sections": PG.page_sections(parsed), "links": links.where("relevant"), "downloads": PG.page_downloads(parsed),
        "targets": found, "rules": PG.detailed_pages(found, links, parsed),
        "summary": found.groupBy("section_type", "kind").agg(F.count("*").alias("n")),
    }


def targeted_crawl(seeds: DataFrame, links: DataFrame, allowed: DataFrame, **options) -> dict[str, DataFrame]:
    """Visited pages, classified documents and their counts per company and rule."""
    visited, documents = LG.crawl(seeds, links, allowed, **options)
    return {"visited": visited, "documents": documents,
            "summary": LG.crawl_summary(documents, seeds, list(vocab.LINK_RULES))}


def simple_rules_index(docs: DataFrame, text: str = "text", min_chars: int = 100,
                       payers: Mapping[str, Sequence[str]] = vocab.PAYERS_INDEX) -> DataFrame:
    """(filename, payer, rules, rule_count, character_count); short and rule-free documents are left out."""
    body = F.col(text)
    found = docs.where(F.length(X.strip(body)) >= min_chars).select(
        "filename", S.detect_payer(body, payers, "UNKNOWN", filename=F.col("filename")).alias("payer"),
        E.rules_first_match(body).alias("rules"), F.length(body).alias("character_count"))
    return found.where(F.size("rules") > 0).withColumn("rule_count", F.size("rules"))
