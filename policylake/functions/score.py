"""Scores, classes and gates, Column to Column."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from policylake import vocab
from policylake.functions.text import extract_title, head, let, nullif_empty, rx, strip


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def total(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0))


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    return any_of(text.contains(t) for t in terms)


def presence_score(text: Column, terms: Iterable[str]) -> Column:
    """How many of the terms occur; ``text`` is already lower-case."""
    return total(text.contains(t).cast("int") for t in terms)


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a term."""
    if not term:
        raise ValueError("empty term")
    lost = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(term), F.lit("")))
    return (lost / F.lit(len(term.encode()))).cast("int")


def occurrence_score(text: Column, weights: Mapping[str, int]) -> Column:
    return total(occurrences(text, t) * F.lit(w) for t, w in weights.items())


def keyword_relevance(text: Column, high: Sequence[str] = vocab.HIGH_VALUE_KEYWORDS,
                      medium: Sequence[str] = vocab.MEDIUM_VALUE_KEYWORDS) -> Column:
    """Weighted occurrence count: high-value terms 3, medium-value terms 1."""
    return let(F.lower(text), lambda low: occurrence_score(low, {**{t: 1 for t in medium}, **{t: 3 for t in high}}))


def first_hit(cases: Iterable[tuple[Column, str]], default: Column | str | None = None) -> Column:
    """Name of the first true condition."""
    hits = [F.when(condition, F.lit(name)) for condition, name in cases]
    if default is not None:
        hits.append(default if isinstance(default, Column) else F.lit(default))
    return F.coalesce(*hits)


def score_array(scores: Sequence[tuple[str, Column]]) -> Column:
    return F.array(*[s for _, s in scores])


def argmax_of(names: Sequence[str], values: Column, default: str | None) -> Column:
    """Name at the highest positive value; the earlier name wins a tie."""
    best = F.array_max(values)
    place = F.array_position(values, best).cast("int")
    return F.when(best > 0, F.element_at(F.array(*[F.lit(n) for n in names]), place)).otherwise(F.lit(default))


def argmax_first(scores: Sequence[tuple[str, Column]], default: str | None) -> Column:
    return let(score_array(scores), lambda v: argmax_of([n for n, _ in scores], v, default))


def positive_map(names: Sequence[str], values: Column) -> Column:
    """Map of the positive values."""
    return F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), values), lambda _, v: v > 0)


def array_total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


# --- URLs and links -----------------------------------------------------------

def url_score(url: Column, high: Sequence[str] = vocab.URL_HIGH_PATTERNS,
              low: Sequence[str] = vocab.URL_LOW_PATTERNS) -> Column:
    """struct(score, reason, accepted) from URL patterns."""
    def hits(text: Column, patterns: Sequence[str]) -> Column:
        return F.array_compact(F.array(*[F.when(text.rlike(rx(p)), F.lit(p)) for p in patterns]))

    def verdict(h: Column) -> Column:
        score = F.size(h["high"]) * 2 - F.size(h["low"])
        reason = (
            F.when(F.size(h["high"]) > 0,
                   F.concat(F.lit("High-value patterns: "), F.array_join(h["high"], ", ")))
            .when(F.size(h["low"]) > 0,
                  F.concat(F.lit("Low-value patterns: "), F.array_join(h["low"], ", ")))
            .otherwise("Neutral URL pattern")
        )
        return F.struct(score.alias("score"), reason.alias("reason"), (score > 0).alias("accepted"))

    return let(F.lower(url), lambda text: let(
        F.struct(hits(text, high).alias("high"), hits(text, low).alias("low")), verdict))


def link_rules(edition: str = "all") -> dict[str, tuple[tuple[str, ...], tuple[str, ...]]]:
    """Rule vocabulary; the 'single' edition knows some more keywords."""
    if edition == "all":
        return dict(vocab.LINK_RULES)
    return {name: (keywords + vocab.LINK_RULES_EXTRA[name], patterns)
            for name, (keywords, patterns) in vocab.LINK_RULES.items()}


def classify_link(text: Column, href: Column, url: Column, edition: str = "all", min_score: int = 2) -> Column:
    """struct(relevant_rules, primary_rule, scores, is_targeted) for a document link."""
    rules = link_rules(edition)
    names = list(rules)

    def scored(joined: Column) -> Column:
        raw = F.array(*[presence_score(joined, k) * 2 + presence_score(joined, p) for k, p in rules.values()])
        # Baseline manual words count only where nothing else does.
        baseline = F.array(*[F.lit(min_score if n == vocab.LINK_BASELINE_RULE else 0) for n in names])
        return let(raw, lambda v: F.struct(
            F.when((F.array_max(v) == 0) & contains_any(joined, vocab.LINK_BASELINE_TERMS), baseline)
            .otherwise(v).alias("values"),
            contains_any(joined, vocab.LINK_EXCLUDED_TERMS).alias("excluded")))

    def verdict(s: Column) -> Column:
        targeted = ~s["excluded"] & (F.array_max(s["values"]) >= min_score)
        kept = F.when(targeted, s["values"]).otherwise(F.array_repeat(F.lit(0), len(names)))
        return let(kept, lambda v: let(positive_map(names, v), lambda found: F.struct(
            F.map_keys(found).alias("relevant_rules"), argmax_of(names, v, None).alias("primary_rule"),
            found.alias("scores"), (F.size(found) > 0).alias("is_targeted"))))

    return let(F.lower(F.concat_ws(" ", text, href, url)), lambda joined: let(scored(joined), verdict))


def link_relevant(text: Column, href: Column, edition: str = "all") -> Column:
    """Worth following: any rule keyword, URL pattern or extra term."""
    terms = [t for keywords, patterns in link_rules(edition).values() for t in keywords + patterns]
    # A term that contains another term adds nothing to "any of them".
    every = dict.fromkeys(terms + list(vocab.LINK_EXTRA_TERMS))
    shortest = [t for t in every if not any(o != t and o in t for o in every)]
    return let(F.lower(F.concat_ws(" ", text, href)), lambda joined: contains_any(joined, shortest))


def page_link_relevant(text: Column, href: Column, terms: Sequence[str] = vocab.PAGE_LINK_TERMS) -> Column:
    return contains_any(F.lower(text), terms) | contains_any(F.lower(href), terms)


def link_type(text: Column, href: Column) -> Column:
    low_text, low_href = F.lower(text), F.lower(href)
    return first_hit(
        ((contains_any(low_href if name == "document" else low_text, terms), name)
         for name, terms in vocab.LINK_TYPES), "general")


def is_pdf_url(url: Column) -> Column:
    return F.lower(url).contains(".pdf")


def is_download(href: Column) -> Column:
    return contains_any(F.lower(href), vocab.DOWNLOAD_EXTENSIONS)


def download_type(href: Column) -> Column:
    return F.lower(F.substring_index(href, ".", -1))


def document_relevance(text: Column, filename: Column,
                       terms: Sequence[str] = vocab.PAGE_DOCUMENT_TERMS) -> Column:
    return presence_score(F.lower(F.concat(text, F.lit(" "), filename)), terms)


def is_rule_content(text: Column, section_type: str, min_chars: int = 20,
                    indicators: Mapping[str, Sequence[str]] = vocab.RULE_INDICATORS) -> Column:
    return contains_any(F.lower(text), indicators.get(section_type, ())) & (F.length(text) > min_chars)


# --- payers, states, types ------------------------------------------------------

def detect_payer(text: Column, payers: Mapping[str, Sequence[str]] = vocab.PAYERS_EXTRACTION,
                 default: str | None = "Unknown", chars: int | None = None,
                 filename: Column | None = None) -> Column:
    """First listed payer with a keyword in the text (or in the file name)."""
    def hit(low: Column, terms: Sequence[str]) -> Column:
        inside = contains_any(low, terms)
        return inside if filename is None else contains_any(F.lower(filename), terms) | inside
    return let(F.lower(head(text, chars)), lambda low: first_hit(
        ((hit(low, terms), name) for name, terms in payers.items()), default))


def detect_state(text: Column, states: Sequence[str] = vocab.MINING_STATES, chars: int | None = None) -> Column:
    return let(F.lower(head(text, chars)), lambda low: first_hit((low.contains(s), s.title()) for s in states))


def state_from_path(path: Column) -> Column:
    """First state code standing before '_' or as a folder of its own."""
    codes = [c for c in vocab.STATES if c not in vocab.TERRITORIES]
    return let(F.upper(path), lambda up: first_hit(
        (up.contains(f"{c}_") | up.contains(f"/{c}/"), c) for c in codes))


def detect_policy_type(text: Column, types: Mapping[str, Sequence[str]] = vocab.POLICY_TYPES) -> Column:
    return let(F.lower(text), lambda low: argmax_first(
        [(name, total(occurrences(low, t) for t in terms)) for name, terms in types.items()], "general"))


def classify_policy_type(text: Column, share: float = 0.6) -> Column:
    """A topic holding more than ``share`` of the topic words; manuals are general."""
    names = list(vocab.MANUAL_TOPICS)

    def verdict(low: Column) -> Column:
        counts = F.array(*[occurrences(low, t) for t in vocab.MANUAL_TOPICS.values()])
        return F.when(contains_any(low, vocab.MANUAL_INDICATORS), F.lit("general")).otherwise(let(counts, lambda v: F.when(
            F.array_max(v) > array_total(v) * F.lit(share), argmax_of(names, v, "general")).otherwise("general")))

    return let(F.lower(text), verdict)


def detect_prior_auth(text: Column, strict: bool = False) -> Column:
    """True when prior authorization is mentioned, else null.

    A negated mention still counts as a mention; ``strict`` reads it as False.
    """
    low = F.lower(text)
    mentioned = contains_any(low, ("prior auth", "preauthorization"))
    if not strict:
        return F.when(mentioned, F.lit(True))
    negated = contains_any(low, ("no prior authorization", "not require prior authorization"))
    return F.when(negated, F.lit(False)).when(mentioned, F.lit(True))


def coverage_type(url: Column, text: Column) -> Column:
    low_url, low_text = F.lower(url), F.lower(text)
    return first_hit(((low_url.contains(t) | low_text.contains(t), name) for name, t in vocab.COVERAGE_TYPES),
                     "General")


def topics(text: Column, patterns: Mapping[str, Sequence[str]] = vocab.TOPICS) -> Column:
    """Sorted topic names."""
    return let(F.lower(text), lambda low: F.array_compact(F.array(*[
        F.when(any_of(low.rlike(rx(p)) if ".*" in p else low.contains(p) for p in terms), F.lit(name))
        for name, terms in sorted(patterns.items())])))


# --- quality --------------------------------------------------------------------

def quality_flags(title: Column, text: Column, page_count: Column, text_length: Column,
                  categories: Mapping[str, Sequence[str]] = vocab.QUALITY_CATEGORIES,
                  exclusions: Sequence[str] = vocab.QUALITY_EXCLUSIONS) -> Column:
    """Category scores, exclusions, four quality flags and the relevance verdict."""
    names = list(categories)

    def measured(joined: Column) -> Column:
        return F.struct(
            F.array(*[presence_score(joined, terms) for terms in categories.values()]).alias("values"),
            presence_score(joined, exclusions).alias("excluded"))

    def verdict(m: Column) -> Column:
        relevance = array_total(m["values"]) - m["excluded"] * 2
        flags = {
            "has_meaningful_title": F.length(strip(title)) > 10,
            "sufficient_content": text_length > 1000,
            "reasonable_pages": page_count.between(1, 500),
            "no_exclusions": m["excluded"] == 0,
        }
        quality = total(f.cast("int") for f in flags.values())
        return F.struct(
            argmax_of(names, m["values"], "uncategorized").alias("primary_category"),
            positive_map(names, m["values"]).alias("category_scores"),
            m["excluded"].alias("exclusion_score"),
            relevance.alias("relevance_score"),
            quality.alias("quality_score"),
            ((relevance > 0) & (quality >= 2)).alias("is_relevant"),
            *[f.alias(name) for name, f in flags.items()],
        )

    return let(F.concat(F.lower(title), F.lit(" "), F.lower(text)), lambda joined: let(measured(joined), verdict))


def estimated_length(sample: Column, page_count: Column, sample_pages: int = 3) -> Column:
    """Length of the whole document, scaled up from a sample of its pages."""
    return F.length(sample) * page_count / F.least(F.lit(sample_pages), page_count)


def assess_content(text: Column, content_length: Column, word_count: Column, section_count: Column,
                   extracted: Column | None = None) -> Column:
    """Quality and relevance of a cleaned document: accept, review or reject."""
    ok = F.lit(True) if extracted is None else extracted

    def measured(low: Column) -> Column:
        flags = {
            "sufficient_length": content_length >= 500,
            "reasonable_length": content_length <= 1_000_000,
            "good_word_count": word_count >= 100,
            "has_sections": section_count > 0,
            "no_exclusion_patterns": ~contains_any(low, vocab.CONTENT_EXCLUSIONS),
        }
        relevance = presence_score(low, [t.lower() for t in vocab.ESSENTIAL_TERMS])
        return F.struct(F.when(ok, total(f.cast("int") for f in flags.values())).otherwise(0).alias("quality"),
                        F.when(ok, relevance).otherwise(0).alias("relevance"),
                        *[f.alias(name) for name, f in flags.items()])

    def verdict(m: Column) -> Column:
        accept = (m["quality"] >= 4) & (m["relevance"] >= 2)
        review = (m["quality"] >= 3) & (m["relevance"] >= 1)
        reason = (
            F.when(~ok, "Extraction failed")
            .when(accept, F.concat(F.lit("High quality content with "), m["relevance"].cast("string"),
                                   F.lit(" relevant terms")))
            .when(review, "Moderate quality, needs review")
            .otherwise("Low quality or irrelevant content")
        )
        names = ("sufficient_length", "reasonable_length", "good_word_count", "has_sections", "no_exclusion_patterns")
        return F.struct(
            m["quality"].alias("quality_score"), m["relevance"].alias("relevance_score"),
            F.when(accept, "accept").when(review, "review").otherwise("reject").alias("recommendation"),
            reason.alias("reason"), *[m[n].alias(n) for n in names])

    return let(F.lower(text), lambda low: let(measured(low), verdict))


def size_gate(url: Column, content_type: Column, size: Column, min_bytes: int = vocab.SIZE_MIN_BYTES,
              max_bytes: int = vocab.SIZE_MAX_BYTES) -> Column:
    """Null when a fetched file may be kept, else why not."""
    kind = F.coalesce(F.lower(content_type), F.lit(""))
    shown = size.cast("string")
    return (
        F.when(~kind.contains("pdf") & ~F.lower(url).endswith(".pdf"),
               F.concat(F.lit("Not a PDF file (content-type: "), kind, F.lit(")")))
        .when(size < min_bytes, F.concat(F.lit("File too small ("), shown, F.lit(" bytes)")))
        .when(size > max_bytes, F.concat(F.lit("File too large ("), shown, F.lit(" bytes)")))
    )


def confidence_fields(payer: Column, policy_type: Column, effective: Column, filing_days: Column,
                      prior_auth: Column, requirements: Column) -> Column:
    """Share of the fields that were found, weighted; decimals keep the sum exact."""
    def part(condition: Column, weight: str) -> Column:
        return F.when(condition, F.lit(weight).cast("decimal(3,2)")).otherwise(F.lit("0").cast("decimal(3,2)"))
    score = (
        part(F.coalesce(payer, F.lit("Unknown")) != "Unknown", "0.25")
        + part(F.coalesce(policy_type, F.lit("general")) != "general", "0.20")
        + part(F.coalesce(effective, F.lit("")) != "", "0.15")
        + part(F.coalesce(filing_days, F.lit(0)) != 0, "0.15")
        + part(prior_auth.isNotNull(), "0.10")
        + part(F.size(requirements) >= 3, "0.15")
    )
    return score.cast("double")


def needs_fallback(confidence: Column, threshold: float = 0.75, enabled: bool = True) -> Column:
    return F.lit(enabled) & (confidence < threshold)


# --- rules ----------------------------------------------------------------------

def is_valid_rule(requirement: Column, context: Column) -> Column:
    n = F.length(requirement)
    digits = n - F.length(F.regexp_replace(requirement, r"\p{Nd}", ""))
    upper = (F.upper(requirement) == requirement) & (F.lower(requirement) != requirement)
    return ((n >= 10) & ~(upper & (n > 30)) & (digits <= n * F.lit(0.5))
            & contains_any(F.lower(context), vocab.MEANINGFUL_WORDS))


def rule_confidence(sentence: Column, rule_type: Column) -> Column:
    def part(condition: Column, weight: str) -> Column:
        return F.when(condition, F.lit(weight).cast("decimal(3,2)")).otherwise(F.lit("0").cast("decimal(3,2)"))
    full_stops = F.length(sentence) - F.length(F.replace(sentence, F.lit("."), F.lit("")))
    long_enough = sentence.rlike(rx(r"^\s*(?:\S+\s+){8,}\S"))
    score = (
        F.lit("0.50").cast("decimal(3,2)")
        + part(contains_any(F.lower(sentence), vocab.MODAL_WORDS), "0.20")
        + part(sentence.rlike(rx(r"\d+\s+(?:days?|months?|years?)")), "0.15")
        + part((full_stops == 1) & long_enough, "0.10")
        + part((rule_type == "timely_filing") & sentence.rlike(rx(r"\d")), "0.10")
    )
    return F.least(score, F.lit("1.00").cast("decimal(3,2)")).cast("double")


# --- questions and citations ------------------------------------------------------

def question_payer(question: Column, payers: Sequence[tuple[str, Sequence[str]]] = vocab.QUESTION_PAYERS) -> Column:
    low = F.lower(question)
    return first_hit((contains_any(low, terms), name) for name, terms in payers)


def question_scope(question: Column, scopes: Sequence[tuple[str, Sequence[str]]] = vocab.QUESTION_SCOPES) -> Column:
    low = F.lower(question)
    return first_hit((contains_any(low, terms), name) for name, terms in scopes)


def console_filter(choice: Column) -> Column:
    """struct(column, value) for a typed filter word, null when none applies."""
    low = F.lower(choice)
    return F.coalesce(*[F.when(low.contains(term), F.struct(F.lit(c).alias("column"), F.lit(v).alias("value")))
                        for term, c, v in vocab.CONSOLE_FILTERS])


def source_url(source: Column, pdf: Column, portal: Column, filename: Column,
               store_base: str | None = None, api_base: str = "") -> Column:
    """First known address of a cited document."""
    named = nullif_empty(filename)
    stored = F.concat(F.lit(f"{store_base}/"), named) if store_base else F.lit(None).cast("string")
    return F.coalesce(nullif_empty(source), nullif_empty(pdf), nullif_empty(portal), stored,
                      F.concat(F.lit(f"{api_base}/pdfs/"), named), F.lit(""))


def source_title(payer: Column, title: Column) -> Column:
    return F.coalesce(nullif_empty(strip(F.concat_ws(" · ", nullif_empty(payer), nullif_empty(title)))),
                      F.lit("Policy rule"))


def manual_title(payer: Column, policy_type: Column) -> Column:
    named = F.concat(payer, F.lit(" "), F.initcap(F.replace(policy_type, F.lit("_"), F.lit(" "))), F.lit(" Policy"))
    return F.when(policy_type == "general", F.concat(payer, F.lit(" Provider Manual"))).otherwise(named)


def manual_summary(payer: Column, policy_type: Column, sections: Column) -> Column:
    base = F.when(policy_type == "general", F.concat(payer, F.lit(" provider manual"))).otherwise(
        F.concat(payer, F.lit(" "), policy_type, F.lit(" policy")))
    covering = F.when(F.size(sections) > 0, F.concat(F.lit(" covering "), F.array_join(sections, ", ")))
    return F.concat(base, F.coalesce(covering, F.lit("")))


def title_of(text: Column) -> Column:
    return extract_title(text)
