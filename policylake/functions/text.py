"""Text cleaning and normalisation, Column to Column.

Patterns are written once for every engine: ``WS`` and ``WORD`` spell out the
Unicode whitespace and word classes, because the short forms are ASCII-only in
some regex dialects. ``rx`` adds the flags that make the Java dialect agree with
Unicode-aware patterns where only newline ends a line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from policylake import vocab

WS = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
LINE_BREAK = r"\r\n|[\n-\r\x1c-\x1e\x85\x{2028}\x{2029}]"
SPACE_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def rx(pattern: str, *, ignore_case: bool = False, dotall: bool = False, multiline: bool = False) -> str:
    flags = "Ud" + ("i" if ignore_case else "") + ("s" if dotall else "") + ("m" if multiline else "")
    return f"(?{flags}){pattern}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    An expression captured by a lambda would be evaluated again for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACE_CHARS))


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(text, f"{WS}+", " ")


def drop_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}_\t-\r\x1c-\x1f\x85\p{Z}]", "")


def nullif_empty(text: Column) -> Column:
    return F.when(text != "", text)


def head(text: Column, chars: int | None) -> Column:
    """Evidence window: the first ``chars`` characters, or the whole text."""
    return text if chars is None else F.substring(text, 1, chars)


def words(text: Column) -> Column:
    """Whitespace-separated words; none for blank text."""
    return F.filter(F.split(text, f"{WS}+"), lambda w: w != "")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def normalize_for_hash(text: Column) -> Column:
    # Whitespace is collapsed before punctuation goes, so a lone mark leaves two blanks.
    return drop_punctuation(collapse_space(strip(F.lower(text))))


def content_hash(text: Column) -> Column:
    return F.md5(normalize_for_hash(text))


def similarity_text(text: Column, stop_words: tuple[str, ...] = vocab.STOP_WORDS) -> Column:
    """Lower-case text without punctuation and stop words (their blanks stay)."""
    flat = drop_punctuation(collapse_space(F.lower(text)))
    stop = f"(?<!{WORD})(?:{'|'.join(stop_words)})(?!{WORD})"
    return strip(F.regexp_replace(flat, stop, ""))


def clean_noise(text: Column, patterns: tuple[str, ...] = vocab.NOISE_PATTERNS,
                keep_newlines: bool = True) -> Column:
    """Remove noise patterns and tidy whitespace.

    ``keep_newlines=False`` flattens the text to one line, which leaves the
    line-based steps after it nothing to work on.
    """
    for pattern in patterns:
        text = F.regexp_replace(text, rx(pattern, ignore_case=True), "")
    if not keep_newlines:
        return strip(collapse_space(text))
    text = F.regexp_replace(text, r"[\t\x0b-\r\x1c-\x1f\x85\p{Z}]+", " ")
    return strip(F.regexp_replace(text, f"\n{WS}*\n", "\n\n"))


def clean_pages(pages: Column, max_pages: int | None = None) -> Column:
    """Join page texts, one newline after each, with length and word count."""
    used = pages if max_pages is None else F.slice(pages, 1, max_pages)
    joined = F.array_join(F.transform(used, lambda p: F.concat(collapse_space(p), F.lit("\n"))), "")
    return let(joined, lambda t: F.struct(
        t.alias("full_text"),
        F.length(strip(t)).alias("content_length"),
        F.size(words(t)).alias("word_count"),
    ))


# --- line classes -------------------------------------------------------------

def _count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def is_toc_line(line: Column) -> Column:
    low = strip(F.lower(line))
    return (
        low.contains("table of contents")
        | (low == "contents")
        | ((_count_char(line, ".") > 10) & line.rlike(rx(r"\d+\s*$")))
        | line.rlike(rx(r"\.{3,}\s*\d+\s*$"))
    )


def is_table_line(line: Column) -> Column:
    return (_count_char(line, "|") >= 3) | line.rlike(rx(r"^[\s\-|:]+$"))


def is_page_number_line(line: Column) -> Column:
    stripped = strip(line)
    return F.lower(stripped).rlike(rx(r"^page\s+\d+")) | stripped.rlike(rx(r"^\d+(\s+(of|/)\s+\d+)?$"))


def drop_boilerplate_lines(text: Column, repeat: int = 3, skip_after_table: int = 6,
                           min_chars: int = 30) -> Column:
    """Drop contents, page numbers, running heads, tables and short lines.

    One document is one row, so everything happens inside the row: no shuffle.
    """

    def repeated_lines(stripped: Column) -> Column:
        # In sorted order a line seen `repeat` times equals the one `repeat - 1` places on.
        return let(
            F.array_sort(F.filter(stripped, lambda s: F.length(s) > 5)),
            lambda s: F.array_distinct(F.filter(s, lambda x, i: F.get(s, i + F.lit(repeat - 1)) == x)),
        )

    def surviving(all_lines: Column, repeated: Column) -> Column:
        return F.filter(all_lines, lambda x: (
            (x["s"] != "")
            & ~is_toc_line(x["line"])
            & ~is_page_number_line(x["line"])
            & ~F.array_contains(repeated, x["s"])
        ))

    def after_tables(flagged: Column) -> Column:
        def keep(x: Column, i: Column) -> Column:
            before = F.slice(flagged, F.greatest(i - F.lit(skip_after_table - 1), F.lit(1)),
                             F.least(i, F.lit(skip_after_table)))
            return ~x["t"] & (F.length(x["s"]) >= min_chars) & ~F.exists(before, lambda y: y["t"])
        return F.filter(flagged, keep)

    items = F.transform(lines(text), lambda x: F.struct(x.alias("line"), strip(x).alias("s")))
    kept = let(items, lambda all_lines: let(
        repeated_lines(F.transform(all_lines, lambda x: x["s"])),
        lambda repeated: let(
            F.transform(surviving(all_lines, repeated), lambda x: F.struct(
                x["line"].alias("line"), x["s"].alias("s"), is_table_line(x["line"]).alias("t"))),
            after_tables,
        ),
    ))
    return F.array_join(F.transform(kept, lambda x: x["line"]), "\n")


# --- titles, names ------------------------------------------------------------

def extract_title(text: Column, max_chars: int | None = None) -> Column:
    first = F.regexp_extract(strip(text), r"^[^\n-\r\x1c-\x1e\x85\x{2028}\x{2029}]*", 0)
    return strip(first) if max_chars is None else F.substring(strip(first), 1, max_chars)


def url_path(url: Column) -> Column:
    """Path part of an absolute or relative URL."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def sanitize_filename(url: Column) -> Column:
    """File name of a URL's path: always .pdf, odd characters replaced."""
    name = basename(url_path(url))
    name = F.when(name.endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))
    return F.regexp_replace(name, r"[^\p{L}\p{N}_\-.]", "_")


def blob_name(url: Column, payer: Column, at: Column) -> Column:
    """payer/yyyy-MM/name_yyyyMMdd_HHmmss.pdf for a document fetched at ``at``."""
    name = basename(url)
    name = F.when(name.endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))
    name = F.regexp_replace(name, r"[^\p{L}\p{N}._\-]", "")
    base = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.concat(payer, F.lit("/"), F.date_format(at, "yyyy-MM"), F.lit("/"), base, F.lit("_"),
                    F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(".pdf"))


def payer_from_path(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).otherwise("unknown")


def source_domain(url: Column) -> Column:
    return F.when(url.contains("://"), F.get(F.split(url, "/"), F.lit(2))).otherwise("unknown")
