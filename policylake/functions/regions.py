"""State detection and coverage scope, Column to Column.

The state list is fixed (54 entries), so it travels as literals inside the
expression and needs no join.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from policylake import vocab
from policylake.functions.text import let, rx

CODES = tuple(vocab.STATES)


def code_array() -> Column:
    return F.array(*[F.lit(c) for c in CODES])


def _named(condition) -> Column:
    """Codes of the states whose name satisfies ``condition``."""
    return F.array_compact(F.array(*[F.when(condition(name), F.lit(code)) for code, name in vocab.STATES.items()]))


def regions_from_url(url: Column, patterns: tuple[str, ...] = vocab.REGION_URL_PATTERNS) -> Column:
    """Sorted state codes named in a URL, by code pattern or by full name."""
    found = F.concat(*[F.regexp_extract_all(url, F.lit(rx(p)), F.lit(1)) for p in patterns])
    by_code = F.array_intersect(F.transform(found, F.upper), code_array())
    by_name = let(F.translate(F.upper(url), "-_", ""), lambda squeezed: _named(
        lambda name: squeezed.contains(name.upper().replace(" ", ""))))
    return F.array_sort(F.array_union(by_code, by_name))


def regions_from_content(text: Column, case_sensitive: bool = False,
                         patterns: tuple[tuple[str, str], ...] = vocab.REGION_TEXT_PATTERNS) -> Column:
    """Sorted state codes named in a text.

    Codes are looked for in lower case, so ordinary words such as 'in' count;
    ``case_sensitive`` asks for capitals.
    """
    def found(low: Column) -> Column:
        # Two-letter words first, then those that are codes.
        pairs = F.regexp_extract_all(text if case_sensitive else low, F.lit(rx(r"\b[A-Za-z]{2}\b")), F.lit(0))
        shown = pairs if case_sensitive else F.transform(F.array_distinct(pairs), F.upper)
        codes = F.array_intersect(shown, code_array())
        by_name = _named(lambda name: low.contains(name.lower()))
        if case_sensitive:
            return F.array_sort(F.array_union(codes, by_name))
        captured = F.concat(*[
            F.when(low.contains(word), F.regexp_extract_all(text, F.lit(rx(p, ignore_case=True)), F.lit(1)))
            .otherwise(F.array().cast("array<string>")) for p, word in patterns])
        by_pattern = F.array_intersect(F.transform(captured, F.upper), code_array())
        return F.array_sort(F.array_union(F.array_union(codes, by_name), by_pattern))

    return let(F.lower(text), found)


def region_scope(count: Column) -> Column:
    return (F.when(count == 0, "National/Unspecified").when(count == 1, "State-Specific")
            .when(count <= 5, "Multi-State").otherwise("National"))


def state_name(code: Column) -> Column:
    pairs = [F.lit(x) for item in vocab.STATES.items() for x in item]
    return F.element_at(F.create_map(*pairs), code)


def coverage_grade(score: Column) -> Column:
    graded = F.lit(vocab.LAST_GRADE)
    for floor, name in reversed(vocab.COVERAGE_GRADES):
        graded = F.when(score >= floor, name).otherwise(graded)
    return graded
