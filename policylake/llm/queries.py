"""The registered queries of the training-text operators, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from policylake.functions.text import let
from policylake.llm import (
    conversations, decontaminate, html_layout, jaccard, line_dedup, mixing, periodic, pii, quality_model, quality_rules,
    substring_dedup, topk, urls)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, urls.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict", "pattern")


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in which a passage of the benchmark is found, with the item and the place."""
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of Jaccard similarity 0.85 or more on 4-word shingles."""
    linked = jaccard.jaccard_groups(read(spark, sf_dir, "documents"), words=4, percent=85)
    sets = linked.withColumn("c", F.coalesce("group", "node"))
    least = sets.where("node is not null").groupBy("c").agg(F.min("doc_id").alias("least"))
    return sets.join(least, "c", "left").select(
        "doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


@query
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and visible text of every page."""
    pages = read(spark, sf_dir, "pages").select("page_id", "html")
    return html_layout.extract_text(pages).select("page_id", "title", "text")


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return quality_rules.judged(read(spark, sf_dir, "documents")).select(
        "doc_id", *quality_rules.STATS, "base_failed", "kept", "distance")


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learned from the labelled rows that are not held out."""
    docs = read(spark, sf_dir, "documents")
    model = quality_model.fit(docs, read(spark, sf_dir, "labels"))
    scores = quality_model.scored(docs.select("doc_id", "text", "n_chars"), model)
    return scores.select("doc_id", quality_model.held_out(F.col("doc_id")).alias("held_out"),
                         F.col("quality_score").alias("score"),
                         (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with repeated and nearly repeated lines cut; documents that lose all their words stay, empty."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.with_lines_cut(docs).select(
        "doc_id", "text", "lines_cut", (F.coalesce("lines_left_worded", F.lit(1)) == 0).alias("emptied"))


@query
def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat an earlier string of 100 bytes."""
    cut = substring_dedup.without_repeats(read(spark, sf_dir, "documents"))
    return cut.select(
        F.col("doc").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in the mixture of all sources."""
    return mixing.mix_sources(read(spark, sf_dir, "documents")).select(
        "doc_id", "source", "mix_block", "mix_slot", "mix_offset")


def _url_sql() -> str:
    place = "host || path"
    fits = [(r, a, "regexp_matches(%s, '^(?:[^/]*\\.)?%s')" % (place, r.replace(".", "\\.")))
            for r, a in sorted(urls.SITE_RULES, key=lambda x: (-len(x[0]), x[0]))]
    loose = [(p, a, "regexp_matches(translate(%s, '%s', '%s'), '%s')" % (
        place, urls._UPPER, urls._LOWER, p.strip("*").replace(".", "\\.").replace("^", "(?:[^a-z0-9]|^|$)")))
        for p, a in urls.PATTERNS]
    rule = "case " + " ".join(f"when {c} then '{r}'" for r, _, c in fits) + " end"
    # Of patterns of one length the greater string wins, as in the operator.
    loose.sort(key=lambda x: (len(x[0]), x[1] == urls.BLOCK, x[0]), reverse=True)
    pattern = "case " + " ".join(f"when {c} then '{p}'" for p, _, c in loose) + " end"
    actions = {**dict(urls.SITE_RULES), **dict(urls.PATTERNS)}
    verdict = "case coalesce(rule, pattern) " + " ".join(f"when '{r}' then '{a}'" for r, a in actions.items()) + \
        f" else '{urls.ALLOW}' end"
    return rf"""
with parts as (select page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{urls._UPPER}', '{urls._LOWER}') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
site as (select *, {rule} as rule from parts),
both_kinds as (select *, case when rule is null then {pattern} end as pattern from site)
select page_id, host, path, rule, {verdict} as verdict, pattern from both_kinds"""


ORACLES["op1_url_filters"] = _url_sql()


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.span_digest(read(spark, sf_dir, "documents"))


# --- structure repair: damaged conversations -----------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with the faults that the hash of conversation and turn deals out: a fifth and a twentieth of them."""
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    dealt = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"),
                        (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20).alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return dealt.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    rows = read(spark, sf_dir, "conversations")
    found = conversations.repair(damaged(rows))
    known = found.digests().select(F.col("key").alias("k"), "digest")
    report = found.report.join(known, F.col("key").eqNullSafe(F.col("k"))).drop("k")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return rows.select("conv_id").distinct().join(report, F.col("conv_id").eqNullSafe(F.col("key")), "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


# --- periodic runs: texts with planted loops -------------------------------------------

def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the words of every text; in a tenth of the texts, by the hash of the id, those from one place on loop."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    split = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))

    def loop(w: Column) -> Column:
        n, g = F.size(w), F.floor(F.col("h") / 10)

        def placed(at: Column) -> Column:
            a, p = at["a"], at["p"]
            return F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int"))))

        start = (g % F.greatest(n, F.lit(1))).alias("a")
        return F.when(n > 0, let(let(start, lambda a: F.struct(
            a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("p"))), placed)).otherwise(w)

    return split.select("doc_id", F.when(F.col("h") % 10 == 0, F.array_join(let(words, loop), " ")).otherwise(F.col("text")).alias("text"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, a tenth of which loop."""
    found = periodic.with_periodic_runs(looped(read(spark, sf_dir, "documents")))
    longest = F.expr("reduce(runs, cast(null as struct<start: long, length: long, period: long>), (best, r) -> "
                     "case when best is null or r.length * best.period > best.length * r.period then r else best end)")
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", F.col("top.start").alias("start"), F.col("top.length").alias("length"), F.col("top.period").alias("period"),
        F.expr("1000 * top.length div top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query
def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest by inner product of every fiftieth vector."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = read(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull() & finite).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("embedding"))
    return topk.top_k(rows, F.col("vec_id") % 50 == 0, 5).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLES["op13_exact_topk"] = """
with whole as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
    from whole q join whole c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as place from scored)
select query_id, cast(place as integer) as rank, vec_id, score from ranked where place <= 5"""
