"""Identifiers, dates, rules and sections taken from text, Column to Column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from policylake import vocab
from policylake.functions.score import any_of, contains_any, first_hit
from policylake.functions.text import (
    LINE_BREAK, WS, head, let, lines, nullif_empty, rx, strip, words,
)

START_MARK, GROUP_MARK = "\x01", "\x02"


def first_match(text: Column, pattern: str, group: int = 1, **flags: bool) -> Column:
    """Group of the first match, null when there is none."""
    return nullif_empty(F.regexp_extract(text, rx(pattern, **flags), group))


def all_matches(text: Column, pattern: str, group: int = 1, **flags: bool) -> Column:
    return F.regexp_extract_all(text, F.lit(rx(pattern, **flags)), F.lit(group))


def first_of(items: Column) -> Column:
    return F.get(items, F.lit(0))


MATCHES = "array<struct<start:int,match:string,captured:string>>"


def without_marks(text: Column) -> Column:
    """Text free of the two control marks that ``matches_with_offsets`` uses."""
    marked = text.contains(START_MARK) | text.contains(GROUP_MARK)
    return F.when(marked, F.translate(text, START_MARK + GROUP_MARK, "  ")).otherwise(text)


def matches_with_offsets(clean: Column, pattern: str, group: int = 1, **flags: bool) -> Column:
    """array<struct<start, match, captured>> of all non-overlapping matches, 0-based starts.

    Each match is fenced with control marks and the text is cut there, so odd
    pieces are matches and the lengths before them give the offsets. ``clean``
    is free of the marks.
    """
    captured = f"${group}" if group else ""
    fenced = F.regexp_replace(clean, rx(pattern, **flags),
                              f"{START_MARK}$0{GROUP_MARK}{captured}{START_MARK}")

    def collect(pieces: Column) -> Column:
        # Running position, one entry per piece: only the part before GROUP_MARK is text.
        def step(state: Column, piece: Column) -> Column:
            plain = F.substring_index(piece, GROUP_MARK, 1)
            entry = F.struct(state["pos"].alias("start"), plain.alias("match"),
                             F.substring_index(piece, GROUP_MARK, -1).alias("captured"))
            return F.struct(
                (state["pos"] + F.length(plain)).alias("pos"),
                F.when(piece.contains(GROUP_MARK), F.concat(state["out"], F.array(entry)))
                .otherwise(state["out"]).alias("out"),
            )
        start = F.struct(F.lit(0).alias("pos"), F.array().cast(MATCHES).alias("out"))
        return F.aggregate(pieces, start, step, lambda state: state["out"])

    return let(F.split(fenced, START_MARK, -1), lambda pieces: F.when(F.size(pieces) > 1, collect(pieces)).otherwise(
        F.array().cast(MATCHES)))


# --- identifiers -------------------------------------------------------------------

def explicit_id(text: Column, patterns: Sequence[str] = vocab.POLICY_ID_PATTERNS) -> Column:
    """The first pattern, in list order, that matches anywhere."""
    return F.coalesce(*[first_match(text, p, ignore_case=True) for p in patterns])


def supersedes(text: Column, patterns: Sequence[str] = vocab.SUPERSEDES_PATTERNS) -> Column:
    """Sorted distinct ids named as replaced; capitals that follow are taken along."""
    spans = F.concat(*[all_matches(text, p) for p in patterns])
    ids = F.flatten(F.transform(spans, lambda s: F.regexp_extract_all(s, F.lit(r"[A-Z0-9\-]+"), F.lit(0))))
    return F.array_sort(F.array_distinct(ids))


def json_string(text: Column) -> Column:
    """Quoted JSON string with ASCII escapes."""
    escaped = text
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"),
                       ("\b", "\\b"), ("\f", "\\f")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))

    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    def escape(char: Column) -> Column:
        code = F.ascii(char)
        high = F.lit(0xD800) + F.shiftright(code - F.lit(0x10000), 10)
        low = F.lit(0xDC00) + ((code - F.lit(0x10000)).bitwiseAND(F.lit(0x3FF)))
        return (F.when((code >= 32) & (code < 127), char)
                .when(code < 0x10000, unit(code))
                .otherwise(F.concat(unit(high), unit(low))))

    chars = F.filter(F.split(escaped, ""), lambda c: c != "")
    wide = F.array_join(F.transform(chars, escape), "")
    # Nearly all strings are printable ASCII with nothing to escape.
    shown = F.when(text.rlike(r"""[^ !#-\[\]-~]"""), F.when(escaped.rlike(r"[^ -~]"), wide).otherwise(escaped)).otherwise(text)
    return F.concat(F.lit('"'), shown, F.lit('"'))


def content_key(policy_type: Column, payer: Column, procedures: Column, requirements: Column) -> Column:
    """The canonical JSON text the content hash is taken over."""
    def array_text(items: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(items), json_string), ", "), F.lit("]"))
    empty = F.lit("")
    return F.concat(
        F.lit('{"payer": '), json_string(F.coalesce(payer, empty)),
        F.lit(', "policy_type": '), json_string(F.coalesce(policy_type, empty)),
        F.lit(', "procedures": '), array_text(procedures),
        F.lit(', "requirements": '), array_text(requirements), F.lit("}"),
    )


def content_hash16(policy_type: Column, payer: Column, procedures: Column, requirements: Column) -> Column:
    return F.left(F.sha2(content_key(policy_type, payer, procedures, requirements), 256), F.lit(16))


# --- dates -----------------------------------------------------------------------

def parse_date(text: Column) -> Column:
    """Date from the first of ten layouts that fits, else null."""
    flat = F.initcap(strip(F.regexp_replace(text, f"{WS}+", " ")))

    def by(layout: str) -> Column:
        parsed = F.try_to_date(flat, layout)
        if "yyyy" in layout:
            return parsed
        # Two-digit years from the pivot on belong to the last century.
        late = F.year(parsed) % 100 >= vocab.TWO_DIGIT_YEAR_PIVOT
        return F.when(late, F.add_months(parsed, -1200)).otherwise(parsed)

    def any_by(layouts: list[str]) -> Column:
        return F.coalesce(*[by(f) for f in layouts])

    slash, dash = (flat.contains(mark) for mark in "/-")
    named = [f for f in vocab.DATE_FORMATS if "MMM" in f]
    numeric = [f for f in vocab.DATE_FORMATS if f not in named]
    return (
        F.when(slash, any_by([f for f in numeric if "/" in f]))
        .when(dash, any_by([f for f in numeric if "-" in f]))
        .otherwise(any_by(named))
    )


def policy_dates(text: Column, patterns: Sequence[tuple[str, str]] = vocab.POLICY_DATE_PATTERNS) -> Column:
    """struct(effective, end, document, supersedes)_date: first parsable match of each kind."""
    def earliest(pattern: str) -> Column:
        found = F.transform(all_matches(text, pattern, ignore_case=True), parse_date)
        return first_of(F.filter(found, lambda d: d.isNotNull()))
    kinds = list(dict.fromkeys(kind for kind, _ in patterns))
    return F.struct(*[
        F.coalesce(*[earliest(p) for k, p in patterns if k == kind]).alias(f"{kind}_date") for kind in kinds
    ])


def raw_dates_hybrid(text: Column) -> Column:
    """struct(effective, expiration), unparsed. A second expiry match fills an empty effective date."""
    by_kind = {
        kind: F.concat(*[all_matches(text, p, ignore_case=True)
                         for k, p in vocab.HYBRID_DATE_PATTERNS if k == kind])
        for kind in ("effective", "expiration")
    }
    return F.struct(
        F.coalesce(first_of(by_kind["effective"]), F.get(by_kind["expiration"], F.lit(1))).alias("effective"),
        first_of(by_kind["expiration"]).alias("expiration"),
    )


def raw_dates_strict(text: Column) -> Column:
    low = F.lower(text)
    return F.struct(*[
        F.coalesce(*[first_match(low, p) for p in patterns]).alias(f"{kind}_date")
        for kind, patterns in vocab.STRICT_DATE_PATTERNS.items()
    ])


def effective_date_text(text: Column, chars: int | None = None) -> Column:
    """First effective date in long-month form, as written."""
    return first_match(head(text, chars), vocab.MINING_DATE_PATTERN, ignore_case=True)


def timely_filing_days(text: Column) -> Column:
    low = F.lower(text)
    def days(pattern: str, months: bool) -> Column:
        n = F.regexp_extract(low, rx(pattern, dotall=True), 1).try_cast("int")
        return F.when(n < 50, n * 30).otherwise(n) if months else n
    return F.coalesce(*[days(p, m) for p, m in vocab.FILING_PATTERNS])


def all_requirements(text: Column) -> Column:
    """Bullet lines without their bullets."""
    bullets = F.filter(F.transform(F.split(text, LINE_BREAK), strip), lambda s: s.rlike(rx(r"^[-•*]\s+")))
    return F.transform(bullets, lambda s: strip(F.ltrim(s, F.lit("-•* "))))


def key_requirements(text: Column, max_items: int | None = None) -> Column:
    found = all_requirements(text)
    return found if max_items is None else F.slice(found, 1, max_items)


# --- rules ------------------------------------------------------------------------

RULE_TYPE = "array<struct<ord:int,rule_type:string,start:int,matched:string,captured:string>>"


def folded(text: Column) -> Column:
    """Lower-case text in which every letter a pattern takes for an ASCII one without regard to case is that letter."""
    low = F.lower(text)
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, "\u017f\u0131\u0307", "si"))


def rule_matches(text: Column, patterns: Sequence[tuple[str, str]], needs: Sequence[tuple[str | tuple[str, ...], ...]],
                 grouped: bool, **flags: bool) -> Column:
    """All matches of all patterns, in pattern order, with their offsets.

    ``captured`` is the first group, or the whole match where a pattern has none.
    ``needs`` names words no match can do without, or tuples of words of which it
    needs one; a pattern only runs over a text that has them.
    """
    def of_pattern(t: Column, order: int, rule_type: str, pattern: str) -> Column:
        has_group = grouped and "(" in pattern.replace("(?:", "")
        found = F.transform(matches_with_offsets(t["clean"], pattern, 1 if has_group else 0, **flags), lambda m: F.struct(
            F.lit(order).alias("ord"), F.lit(rule_type).alias("rule_type"), m["start"].alias("start"),
            m["match"].alias("matched"), m["captured" if has_group else "match"].alias("captured")))
        possible = reduce(lambda a, b: a & b, [
            contains_any(t["low"], (w,) if isinstance(w, str) else w) for w in needs[order]], F.lit(True))
        return F.when(possible, found.cast(RULE_TYPE)).otherwise(F.array().cast(RULE_TYPE))

    both = F.struct(without_marks(text).alias("clean"), folded(text).alias("low"))
    return let(both, lambda t: F.concat(*[of_pattern(t, i, k, p) for i, (k, p) in enumerate(patterns)]))


def rules_with_window(text: Column, patterns: Sequence[tuple[str, str]] = vocab.WINDOW_RULES,
                      context: int = vocab.WINDOW_CONTEXT,
                      needs: Sequence[tuple[str, ...]] = vocab.WINDOW_NEEDS) -> Column:
    """Matches with up to ``context`` characters on either side."""
    def widen(m: Column) -> Column:
        start = F.greatest(m["start"] - F.lit(context), F.lit(0))
        end = m["start"] + F.length(m["matched"]) + F.lit(context)
        around = strip(F.substring(text, start + F.lit(1), end - start))
        return F.struct(m["ord"].alias("ord"), m["rule_type"].alias("policy_type"), m["start"].alias("start"),
                        m["matched"].alias("matched_text"), around.alias("context"))
    return F.transform(rule_matches(text, patterns, needs, grouped=False, ignore_case=True), widen)


def sentence_at(text: Column, start: Column) -> Column:
    """Text between the full stops around a position."""
    before, after = F.substring(text, F.lit(1), start), F.substring(text, start + F.lit(1), F.length(text))
    stop = F.when(after.contains("."), F.lit(".")).otherwise(F.lit(""))
    return strip(F.concat(F.substring_index(before, ".", -1), F.substring_index(after, ".", 1), stop))


def rules_in_sentence(text: Column, patterns: Sequence[tuple[str, str]] = vocab.SENTENCE_RULES,
                      numeric_as_sentence: bool = True,
                      needs: Sequence[tuple[str | tuple[str, ...], ...]] = vocab.SENTENCE_NEEDS) -> Column:
    """Matches with their sentence; sentences under 20 characters are left out.

    A bare number can never pass for a requirement, so by default the sentence
    stands in for it; ``numeric_as_sentence=False`` keeps the number.
    """
    def describe(m: Column) -> Column:
        def finish(sentence: Column) -> Column:
            requirement = strip(m["captured"])
            if numeric_as_sentence:
                requirement = F.when(requirement.rlike(r"^\p{Nd}+$"), sentence).otherwise(requirement)
            return F.struct(m["ord"].alias("ord"), m["rule_type"].alias("rule_type"), m["start"].alias("start"),
                            requirement.alias("requirement"), sentence.alias("full_context"),
                            m["matched"].alias("source_text"))
        return let(sentence_at(text, m["start"]), finish)
    found = F.transform(rule_matches(text, patterns, needs, grouped=True, ignore_case=True, multiline=True), describe)
    return F.filter(found, lambda r: F.length(r["full_context"]) >= 20)


def sentence_pieces(text: Column) -> Column:
    return F.filter(F.split(text, r"[.!?]\n", -1), lambda s: F.length(s) >= 20)


def first_rule_type(piece: Column, rules: Sequence[tuple[str, str]] = vocab.FIRST_MATCH_RULES) -> Column:
    return first_hit((piece.rlike(rx(p, ignore_case=True)), name) for name, p in rules)


def rules_first_match(text: Column, max_chars: int | None = None) -> Column:
    """array<struct<pos, type, text, confidence>>: each sentence under its first matching type."""
    typed = F.transform(sentence_pieces(text), lambda s, i: F.struct(
        i.alias("pos"), first_rule_type(s).alias("type"), head(strip(s), max_chars).alias("text"),
        F.lit(vocab.FIRST_MATCH_CONFIDENCE).alias("confidence")))
    return F.filter(typed, lambda r: r["type"].isNotNull())


# --- sections ---------------------------------------------------------------------

def content_sections(text: Column, min_chars: int = 100) -> Column:
    """array<struct<section, items>> of passages running to the next header or the end."""
    def passages(phrases: Sequence[str]) -> Column:
        found = F.concat(*[
            F.regexp_extract_all(text, F.lit(rx(rf"{p}.*?(?={vocab.SECTION_END}|\z)", ignore_case=True, dotall=True)),
                                 F.lit(0)) for p in phrases])
        return F.filter(F.transform(found, strip), lambda s: F.length(s) > min_chars)
    named = F.array(*[F.struct(F.lit(name).alias("section"), passages(phrases).alias("items"))
                      for name, phrases in vocab.CONTENT_SECTIONS.items()])
    return F.filter(named, lambda s: F.size(s["items"]) > 0)


def _windows(text: Column, section: str, window: int, min_chars: int) -> Column:
    """array<struct<line, n_lines, body>> of a section's windows; texts that name it nowhere aren't split."""
    headers, indicators = vocab.MANUAL_SECTIONS[section]
    named = dict.fromkeys(headers + indicators)
    # A term that holds another one finds nothing more.
    terms = [t for t in named if not any(o != t and o in t for o in named)]

    def windows(all_lines: Column, low: Column) -> Column:
        at = F.filter(F.transform(low, lambda s, i: F.when(contains_any(s, terms), i)), lambda i: i.isNotNull())
        found = F.transform(at, lambda i: let(
            F.slice(all_lines, i + F.lit(1), F.lit(window)),
            lambda w: F.struct(i.alias("line"), F.size(w).alias("n_lines"), F.array_join(w, "\n").alias("body"))))
        return F.filter(found, lambda w: F.length(w["body"]) > min_chars)

    none = F.array().cast("array<struct<line:int,n_lines:int,body:string>>")

    def of(lowered: Column) -> Column:
        split = let(lines(text), lambda al: let(lines(lowered), lambda low: windows(al, low)))
        return F.when(contains_any(lowered, terms), split).when(lowered.isNotNull(), none)
    return let(F.lower(text), of)


def section_windows(text: Column, section: str, window: int = vocab.WINDOW_LINES,
                    min_chars: int = vocab.WINDOW_MIN_CHARS) -> Column:
    """array<struct<line, n_lines, n_chars>>: a window starts at each line naming the section."""
    return F.transform(_windows(text, section, window, min_chars), lambda w: F.struct(
        w["line"].alias("line"), w["n_lines"].alias("n_lines"), F.length(w["body"]).alias("n_chars")))


def section_text(text: Column, section: str, budget: int | None = None,
                 window: int = vocab.WINDOW_LINES, min_chars: int = vocab.WINDOW_MIN_CHARS) -> Column:
    """Evidence for a section: its windows one after another, up to ``budget`` characters if one is given.

    Every window is longer than ``min_chars``, so only the first
    ``budget / min_chars`` of them can reach the result.
    """
    found = _windows(text, section, window, min_chars)
    if budget is not None:
        found = F.slice(found, 1, budget // min_chars + 1)
    joined = F.array_join(F.transform(found, lambda w: w["body"]), "\n\n")
    return let(head(joined, budget), nullif_empty)


def section_headers(text: Column, max_items: int | None = None) -> Column:
    """Header lines by position (capitals, SECTION/CHAPTER n, numbered)."""
    def of_pattern(order: int, pattern: str) -> Column:
        return F.transform(matches_with_offsets(without_marks(text), pattern, multiline=True), lambda m: F.struct(
            m["start"].alias("start"), F.lit(order).alias("ord"), strip(m["captured"]).alias("title")))
    found = F.concat(*[of_pattern(i, p) for i, p in enumerate(vocab.SECTION_HEADER_PATTERNS)])
    fitting = F.filter(found, lambda h: (F.length(h["title"]) > 10) & (F.length(h["title"]) < 100))
    titles = F.transform(F.array_sort(fitting), lambda h: h["title"])
    return titles if max_items is None else F.slice(titles, 1, max_items)


# --- model output ----------------------------------------------------------------

def clean_model_json(text: Column) -> Column:
    """Cut a model reply down to its JSON object."""
    plain = strip(F.regexp_replace(text, r"```json|```", ""))
    plain = F.when(F.instr(plain, "{") > 1, F.substring(plain, F.instr(plain, "{"), F.length(plain))).otherwise(plain)
    return F.regexp_replace(plain, r"\}[^}]*\z", "}")


def has_keys(json_text: Column, keys: Sequence[str]) -> Column:
    """All keys present, null values allowed; false for anything but an object."""
    present = F.json_object_keys(json_text)
    missing = F.array_except(F.array(*[F.lit(k) for k in keys]), present)
    return F.coalesce(F.size(missing) == 0, F.lit(False))


def valid_policy_json(json_text: Column) -> Column:
    return has_keys(json_text, vocab.POLICY_JSON_KEYS)


def policy_json(json_text: Column) -> Column:
    """Struct of the policy keys; a ``supersedes`` that is no list becomes an empty one."""
    schema = ", ".join(f"{k} {'array<string>' if k == 'supersedes' else 'string'}" for k in vocab.POLICY_JSON_KEYS)
    listed = F.get_json_object(json_text, "$.supersedes").startswith("[")
    fields = [
        (F.when(listed, F.from_json(json_text, schema)[k]).otherwise(F.array().cast("array<string>"))
         if k == "supersedes" else F.get_json_object(json_text, f"$.{k}")).alias(k)
        for k in vocab.POLICY_JSON_KEYS
    ]
    return F.when(valid_policy_json(json_text), F.struct(*fields))


def json_has_key(json_text: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(json_text), key), F.lit(False))


def overlay(base: Column, json_text: Column, key: str) -> Column:
    """Model value for a key when the reply has the key, even if null; else the rule value."""
    return F.when(json_has_key(json_text, key), F.get_json_object(json_text, f"$.{key}")).otherwise(base)


def default_key(json_text: Column, key: str, default: Column) -> Column:
    """Value of a key, or the default where the key is absent (a null stays null)."""
    return F.when(json_has_key(json_text, key), F.get_json_object(json_text, f"$.{key}")).otherwise(default)


def valid_section(fields: dict[str, Column], section: str) -> Column:
    """Enough content: a requirement or procedure for prior authorization, else two items."""
    if section == "prior_authorization":
        return (F.size(fields["requirements"]) > 0) | (F.size(fields["procedures"]) > 0)
    sizes = [F.size(fields[f]) for f in vocab.SECTION_FIELDS[section]]
    return sum(sizes[1:], sizes[0]) >= 2


def section_fields(json_text: Column, section: str) -> Column:
    """Struct of the section's list fields, all empty unless the reply is complete and valid."""
    names = vocab.SECTION_FIELDS[section]
    parsed = F.from_json(json_text, ", ".join(f"{n} array<string>" for n in names))
    lists = has_keys(json_text, names)
    for n in names:
        lists = lists & F.get_json_object(json_text, f"$.{n}").startswith("[")

    def checked(p: Column) -> Column:
        ok = F.coalesce(lists & valid_section({n: p[n] for n in names}, section), F.lit(False))
        return let(ok, lambda good: F.struct(*[
            F.when(good, p[n]).otherwise(F.array().cast("array<string>")).alias(n) for n in names]))

    return let(parsed, checked)


def validate_deadlines(deadlines: Column, source: Column) -> Column:
    """Keep deadlines without numbers and those with a number the source names as days."""
    low = F.lower(source)
    def supported(n: Column) -> Column:
        return any_of(low.contains(F.concat(n, F.lit(tail)))
                      for tail in (" day", " calendar day", " business day", "-day"))
    def keep(item: Column) -> Column:
        numbers = F.regexp_extract_all(item, F.lit(rx(r"\b(\d+)\b")), F.lit(1))
        return (F.size(numbers) == 0) | F.exists(numbers, supported)
    return F.filter(deadlines, keep)


def word_set(text: Column) -> Column:
    """Sorted distinct words of the lower-cased text."""
    return F.array_sort(F.array_distinct(words(F.lower(text))))
