"""Policy identity, versions, supersession and archiving, DataFrame to DataFrame.

Policies are rows with ``policy_id, payer_name, policy_type, effective_date,
end_date, crawl_timestamp, source_pdf, confidence_score`` and whatever else the
caller carries. ``as_of`` is always explicit, so a run can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policylake import vocab
from policylake.functions import extract as E
from policylake.functions.score import detect_policy_type


def policy_identity(docs: DataFrame, text: str = "text") -> DataFrame:
    """Identity, dates, supersession and confidence for documents.

    Needs ``payer_name`` and the text; ``policy_type``, ``procedures`` and
    ``requirements`` are taken from the text when the caller has none.
    """
    have = set(docs.columns)
    body = F.col(text)
    typed = docs if "policy_type" in have else docs.withColumn("policy_type", detect_policy_type(body))
    requirements = F.col("requirements") if "requirements" in have else E.all_requirements(body)
    procedures = F.col("procedures") if "procedures" in have else F.array().cast("array<string>")
    found = typed.select(
        "*",
        E.explicit_id(body).alias("explicit_id"),
        E.policy_dates(body).alias("_dates"),
        E.supersedes(body).alias("_supersedes"),
        E.content_hash16(F.col("policy_type"), F.col("payer_name"), procedures, requirements).alias("policy_hash"),
    )
    confidence = (
        F.when(F.col("explicit_id").isNotNull(), F.lit(str(vocab.CONFIDENCE_EXPLICIT)).cast("decimal(5,4)"))
        .otherwise(F.lit(str(vocab.CONFIDENCE_HASH)).cast("decimal(5,4)"))
    )
    undated = F.when(F.col("_dates.effective_date").isNull(),
                     F.lit(str(vocab.CONFIDENCE_UNDATED_FACTOR)).cast("decimal(5,4)")).otherwise(
                         F.lit("1").cast("decimal(5,4)"))
    return found.select(
        *docs.columns,
        *([] if "policy_type" in have else ["policy_type"]),
        "explicit_id", "policy_hash",
        F.concat("payer_name", F.lit("_"), F.coalesce("explicit_id", "policy_hash")).alias("policy_id"),
        *[F.col(f"_dates.{kind}_date").alias(f"{kind}_date")
          for kind in dict.fromkeys(k for k, _ in vocab.POLICY_DATE_PATTERNS)],
        F.when(F.size("_supersedes") > 0, F.col("_supersedes")).alias("supersedes"),
        (confidence * undated).cast("double").alias("confidence_score"),
    )


def is_current(as_of: Column, effective: Column = None, end: Column = None, crawled: Column = None) -> Column:
    """Valid on a day: started, not ended, and if undated crawled within two years."""
    effective = F.col("effective_date") if effective is None else effective
    end = F.col("end_date") if end is None else end
    crawled = F.col("crawl_timestamp") if crawled is None else crawled
    fresh = crawled >= F.date_sub(as_of, vocab.UNDATED_VALID_DAYS)
    return F.when(effective.isNull(), fresh).otherwise(
        (effective <= as_of) & F.coalesce(end >= as_of, F.lit(True)))


def first_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key.

    Spark cuts each map partition to ``n`` rows per key before the shuffle
    (window group limit), so a key that holds a third of the rows costs its
    reducer ``n`` rows per map task.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return first_n_per_key(df, keys, order, 1)


def newest_first(tie: str = "source_pdf") -> list[Column]:
    return [F.desc_nulls_last("effective_date"), F.desc("crawl_timestamp"), F.asc(tie)]


def current_versions(policies: DataFrame, as_of: str, tie: str = "source_pdf") -> DataFrame:
    """The newest valid version per policy; policies without one are absent."""
    valid = policies.where(is_current(F.lit(as_of).cast("date")))
    return first_per_key(valid, ["policy_id"], newest_first(tie))


def expired_policies(policies: DataFrame, as_of: str) -> DataFrame:
    """All versions of the policies that have no current version."""
    alive = policies.where(is_current(F.lit(as_of).cast("date"))).select("policy_id").distinct()
    return policies.join(alive, "policy_id", "left_anti")


def cleanup_stats(policies: DataFrame, as_of: str) -> DataFrame:
    """One row: totals, current, archived, low-confidence and current policies per payer."""
    day = F.lit(as_of).cast("date")
    alive = is_current(day)
    rank = F.struct(F.coalesce("effective_date", F.lit("0001-01-01").cast("date")), "crawl_timestamp")
    per_policy = policies.groupBy("payer_name", "policy_id").agg(
        F.count("*").alias("versions"),
        F.max(alive).alias("alive"),
        F.max_by("confidence_score", F.when(alive, rank)).alias("confidence"))
    per_payer = per_policy.groupBy("payer_name").agg(
        F.sum("versions").alias("versions"),
        F.sum(F.col("alive").cast("int")).alias("current"),
        F.sum(F.when(F.col("alive"), 0).otherwise(F.col("versions"))).alias("archived"),
        F.sum((F.col("alive") & (F.col("confidence") < vocab.LOW_CONFIDENCE)).cast("int")).alias("low"))
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("payer_name", "current"))))
    return per_payer.agg(
        F.sum("versions").alias("total_policies_processed"),
        F.sum("current").alias("current_policies"),
        F.sum("archived").alias("archived_policies"),
        F.sum("low").alias("low_confidence_policies"),
        F.map_filter(counts, lambda _, n: n > 0).alias("policies_by_payer"),
    ).withColumn("cleanup_date", day)


def last_write_per_key(df: DataFrame, keys: list[str], written_at: str, tie: str) -> DataFrame:
    """What an overwriting store holds in the end: the last row written per key."""
    return first_per_key(df, keys, [F.desc(written_at), F.desc(tie)])


#: Levels of the tree of days, which holds every day that a date can be.
DAY_LEVELS = 22


def policies_as_of(policies: DataFrame, dates: DataFrame, date: str = "as_of") -> DataFrame:
    """Dated policies valid on each of the given days.

    A range join by way of dyadic intervals: a policy's days are cut into the fewest aligned stretches of 1, 2, 4, ...
    days, at most two of a length, and a day lies in one stretch of each length. So a policy meets a day once, at a key of its
    own length and place: a year in which all policies are valid is spread over its stretches.
    """
    def number(day: Column) -> Column:
        return F.datediff(day.cast("date"), F.lit("0001-01-01").cast("date")).cast("long")

    ends = F.coalesce(number(F.col("end_date")) + 1, F.lit(1 << DAY_LEVELS).cast("long"))
    bounded = policies.where("effective_date is not null").withColumns({"_from": number(F.col("effective_date")), "_to": ends}).where("_from < _to")
    # At level k stretches have 2 ** k days; a is the first that starts on or after the first day, z the first that ends after the last.
    levels = bounded.select(*policies.columns, F.inline(F.expr(
        "transform(sequence(0, cast(log2(_to - _from) as int)), k -> struct(k as _level, shiftright(_from + shiftleft(1L, k) - 1, k) as _a, "
        "shiftright(_to, k) as _z))"))).where("_a < _z and (_a % 2 = 1 or _z % 2 = 1)")
    spans = levels.withColumn("_node", F.explode(F.array(F.expr("if(_a % 2 = 1, _a, null)"), F.expr("if(_z % 2 = 1, _z - 1, null)")))).where(
        "_node is not null").drop("_a", "_z")
    days = dates.withColumn("_day", number(F.col(date))).select(
        *dates.columns, F.inline(F.expr(f"transform(sequence(0, {DAY_LEVELS}), k -> struct(k as _level, shiftright(_day, k) as _node))")))
    return spans.join(days, ["_level", "_node"]).drop("_level", "_node")


# --- supersession -------------------------------------------------------------------

def remove_replaced(active: DataFrame, new: DataFrame, as_of: str) -> DataFrame:
    """Active policies left after a batch of new ones.

    A policy goes when a new one of the same payer and type, but another id,
    finds it expired or starts after its end. That needs only the two latest
    starting ids per payer and type, not the pairs.
    """
    keys = ["payer_name", "policy_type"]
    floor = F.lit("0001-01-01").cast("date")
    per_id = new.groupBy(*keys, "policy_id").agg(
        F.max(F.coalesce("effective_date", floor)).alias("eff"))
    best = per_id.groupBy(*keys).agg(F.max(F.struct("eff", "policy_id")).alias("best"))
    # Latest start among the other ids.
    other = (
        per_id.join(best, keys).where(F.col("policy_id") != F.col("best.policy_id"))
        .groupBy(*keys).agg(F.max("eff").alias("other_eff"))
    )
    newest = best.join(other, keys, "left").select(
        *keys, F.col("best.policy_id").alias("best_id"), F.col("best.eff").alias("best_eff"), "other_eff")
    rival = F.when(F.col("policy_id") == F.col("best_id"), F.col("other_eff")).otherwise(F.col("best_eff"))
    replaced = rival.isNotNull() & (
        (F.col("end_date") < F.lit(as_of).cast("date")) | (F.col("end_date") < rival))
    return active.join(newest, keys, "left").where(~F.coalesce(replaced, F.lit(False))).select(*active.columns)


def replay_arrivals(policies: DataFrame, as_of: str, arrival: str = "crawl_timestamp",
                    tie: str = "source_pdf", period: str = "day") -> DataFrame:
    """What is left when policies arrive one by one, each replacing what came before.

    A store keeps the last write per id. That row goes when something of its
    payer and type arrives later and finds it expired or starts after its end;
    everything later has another id. The latest later start is a suffix maximum,
    taken over whole periods first and inside the row's own period second, so no
    task sorts a payer's whole history.
    """
    keys = ["payer_name", "policy_type"]
    rows = policies.select("*", F.date_trunc(period, arrival).alias("_period"), F.coalesce(
        "effective_date", F.lit("0001-01-01").cast("date")).alias("_eff"))
    to_end = (1, Window.unboundedFollowing)
    inside = Window.partitionBy(*keys, "_period").orderBy(arrival, tie).rowsBetween(*to_end)
    later_periods = Window.partitionBy(*keys).orderBy("_period").rowsBetween(*to_end)
    per_period = rows.groupBy(*keys, "_period").agg(F.max("_eff").alias("_eff")).select(
        *keys, "_period", F.max("_eff").over(later_periods).alias("_later"))
    ranked = rows.withColumn("_inside", F.max("_eff").over(inside)).join(per_period, [*keys, "_period"])
    rival = F.greatest("_inside", "_later")
    gone = (F.col("end_date") < F.lit(as_of).cast("date")) | (F.col("end_date") < rival)
    last = last_write_per_key(ranked, ["payer_name", "policy_id"], arrival, tie)
    return last.where(~F.coalesce(rival.isNotNull() & gone, F.lit(False))).select(*policies.columns)


def supersession_edges(policies: DataFrame) -> DataFrame:
    """(policy_id, superseded_id) pairs that exist within one payer."""
    named = policies.where(F.col("supersedes").isNotNull()).select(
        "payer_name", "policy_id", F.explode("supersedes").alias("explicit_id")).distinct()
    known = policies.where(F.col("explicit_id").isNotNull()).select(
        "payer_name", "explicit_id", F.col("policy_id").alias("superseded_id")).distinct()
    return named.join(known, ["payer_name", "explicit_id"]).where(
        F.col("policy_id") != F.col("superseded_id")).select("payer_name", "policy_id", "superseded_id")


def drop_superseded(policies: DataFrame) -> DataFrame:
    """Policies no other policy of the payer names as superseded."""
    gone = supersession_edges(policies).select(F.col("superseded_id").alias("policy_id")).distinct()
    return policies.join(gone, "policy_id", "left_anti")


def change_feed(old: DataFrame, new: DataFrame, key: str = "policy_id", content: str = "policy_hash") -> DataFrame:
    """Keys added, removed or changed between two states, one row per key."""
    joined = old.select(key, F.col(content).alias("old_hash"), F.lit(True).alias("_o")).join(
        new.select(key, F.col(content).alias("new_hash"), F.lit(True).alias("_n")), key, "full_outer")
    change = (F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed")
              .when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "changed"))
    return joined.select(key, change.alias("change"), "old_hash", "new_hash").where("change is not null")
