"""Personal data: base patterns, and further spans by weak supervision.

Candidates are the matches of the base patterns and of looser or stricter ones (a phone or card that runs into a
following number, spelled-out addresses, numbers without a country code). Five labelers vote on each, +1, -1 or 0:

* regex: the strict form of its kind, with check digits;
* gazetteer: known top-level domains, country codes, issuer prefixes, unroutable networks;
* nearby words that name the kind, nearby words that name another kind of number;
* the characters the span touches.

Expectation-maximisation over the counts of vote patterns, kind by kind, estimates every labeler's reliability and
the probability of each pattern (two classes, votes independent given the class). A logistic span classifier is then
trained on those probabilities with the votes and the span's shape; spans it accepts are added where no valid base
span of their kind lies. Base spans always stay.

The main path is DataFrame functions only. Matches become rows with the length of the text before them, and a window
per text and kind turns lengths into places, so a text may hold any number of matches. What comes to the driver is the
table of distinct patterns, bounded by 4 kinds x 3^5 votes x 25 shapes, whatever the input. Patterns use possessive
repeats, so long runs neither backtrack nor recurse.

Defined cases: null text is empty; rows equal in id and text are counted as one and give equal rows; without candidates
all spans are empty; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from policylake.llm._links import stored

KINDS = ("email", "ip", "card", "phone")

# The base patterns in possessive form; a run that failed at its start is not tried again from its middle.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MORE = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+"
             r"(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}+){1,8}",
    "card": r"(?<![0-9])(?:[0-9]{16}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
_MAY = {"email": r"@|\[at\]|\(at\)", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}",
        "phone": r"\+[0-9]|[0-9][\x20.-][0-9]{4}"}

# Gazetteers and context words.
TOP_DOMAINS = "com org net edu gov mil int info io co de fr es it nl uk us ca ch at be pl se no fi dk pt ie eu br mx ar jp in au"
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91"
NAMED = {
    "email": "mail email e-mail contact write courriel correo kontakt",
    "ip": "ip address host server client addr adresse servidor",
    "card": "card visa mastercard amex credit carte karte tarjeta paid",
    "phone": "phone tel call mobile cell fax telephone telefon telefono portable",
}
OTHER_NUMBER = "version isbn order invoice section chapter token hash sha checksum serial build doi"
_PARTS = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit of 16 to 19 digits is right."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(
        i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    total = F.aggregate(doubled, F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0)))
    return F.when(F.length(digits).between(16, 19), total % 10 == 0).otherwise(F.lit(False))


def base_valid(kind: Column, match: Column) -> Column:
    """Whether a match of a base pattern is a base span."""
    n = F.length(_digits(match))
    return F.when(kind == "email", F.lit(True)).when(kind == "ip", match.rlike(rf"\A{_PARTS}(?:\.{_PARTS}){{3}}\z")) \
        .when(kind == "card", _luhn(_digits(match))).otherwise(n.between(8, 15))


def _matches(text: Column, kind: str, pattern: str, base: bool) -> Column:
    """Array of (kind, base, n, gap, match, left, right) of the matches of one pattern; gap: code points since the last."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), 0)
    pieces = F.split(text, pattern, -1)
    both = F.struct(found.alias("m"), pieces.alias("p"))
    rows = F.transform(F.array(both), lambda b: F.transform(b["m"], lambda m, i: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), F.lit(base).alias("base"), i.alias("n"),
        F.length(F.get(b["p"], i)).alias("gap"), m.alias("match"),
        F.right(F.get(b["p"], i), F.lit(40)).alias("left"), F.left(F.get(b["p"], i + 1), F.lit(20)).alias("right"))))
    return F.when(text.rlike(_MAY[kind]), F.get(rows, F.lit(0)))


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, kind, base, start, end, match, left, right): every match in every text; base: a valid base span."""
    plain = docs.select(F.xxhash64(key, text).alias("row"), F.col(text).alias("t")).where(F.col("t").rlike(r"[0-9@]|at[)\]]"))
    lists = [_matches(F.col("t"), k, p, True) for k, p in BASE.items()] + \
        [_matches(F.col("t"), k, p, False) for k, p in MORE.items()]
    none = F.expr("cast(array() as array<struct<kind:int,base:boolean,n:int,gap:int,match:string,left:string,right:string>>)")
    rows = plain.select("row", F.explode(F.concat(*(F.coalesce(x, none) for x in lists))).alias("c")).select("row", "c.*") \
        .dropDuplicates(["row", "kind", "base", "n"])
    before = Window.partitionBy("row", "kind", "base").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("match")).over(before)
    placed = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))
    name = F.element_at(F.array(*(F.lit(k) for k in KINDS)), F.col("kind") + 1)
    return placed.select("row", "kind", (F.col("base") & base_valid(name, F.col("match"))).alias("base"), "start", "end",
                         "match", "left", "right")


def _any_word(words: str) -> str:
    return r"(?i)(?<![\p{L}])(?:" + "|".join(words.split()) + r")(?![\p{L}])"


def votes(spans: DataFrame) -> DataFrame:
    """Adds the votes v0 to v4 of the labelers, and the shape of the span."""
    kind, match, digits = F.col("kind"), F.col("match"), _digits(F.col("match"))
    n = F.length(digits)

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, 1).when(no, -1).otherwise(0)

    def by_kind(*each: Column) -> Column:
        return F.when(kind == 0, each[0]).when(kind == 1, each[1]).when(kind == 2, each[2]).otherwise(each[3])

    form = by_kind(
        match.rlike(r"(?i)\A[a-z0-9][a-z0-9._%+-]*+(?:@|\x20?[(\[]at[)\]]\x20?)[a-z0-9-]++.*[a-z]{2,}\z"),
        match.rlike(rf"\A{_PARTS}(?:\.{_PARTS}){{3}}\z") & ~match.rlike(r"(?:\A|\.)0[0-9]"),
        _luhn(digits) & ~match.rlike(r"[0-9]{17}"),
        n.between(8, 15) & match.rlike(r"\A(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20.-]{1,2}[0-9]{2,4}){2,4}\z"))
    domains = "|".join(TOP_DOMAINS.split())
    known = by_kind(
        match.rlike(rf"(?i)\.\x20?(?:{domains})\z"), ~match.rlike(r"\A(?:0|127|255)\."),
        digits.rlike(r"\A(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"),
        match.rlike(r"\A\+(?:" + "|".join(COUNTRY_CODES.split()) + r")(?![0-9]{4})") | match.rlike(r"\A\(?[2-9][0-9]{2}"))
    unknown = by_kind(
        ~match.rlike(r"\.[A-Za-z]{2,}\z"), match.rlike(r"\A(?:0|127|255)\."), digits.rlike(r"\A[0789]"), match.rlike(r"\A\+?0"))
    near = F.concat_ws(" ", "left", "right")
    named = by_kind(*(F.col("left").rlike(_any_word(NAMED[k])) for k in KINDS))
    touches = F.col("left").rlike(r"[\p{L}\p{N}_=#\"'/]\z") | F.col("right").rlike(r"\A[\p{L}\p{N}_#\"'/]")
    return spans.select(
        "*", vote(form, ~form).alias("v0"), vote(known, unknown).alias("v1"), vote(named, F.lit(False)).alias("v2"),
        vote(F.lit(False), near.rlike(_any_word(OTHER_NUMBER))).alias("v3"), vote(~touches, touches).alias("v4"),
        F.least(F.floor(n / 4), F.lit(4)).cast("int").alias("digits"), F.least(F.floor(F.length("match") / 8), F.lit(4)).cast("int").alias("size"))


VOTES = ("v0", "v1", "v2", "v3", "v4")


def reliabilities(patterns: Sequence[Row], rounds: int = 30) -> dict[tuple[int, ...], float]:
    """Probability that a span of each (kind, votes) is personal data, by expectation-maximisation over the counts."""
    out = {}
    for kind in range(len(KINDS)):
        rows = [r for r in patterns if r.kind == kind]
        if not rows:
            continue
        v = np.array([[r[x] for x in VOTES] for r in rows])
        n = np.array([r.n for r in rows], float)
        p = 1 / (1 + np.exp(-v.sum(1).astype(float)))  # begins with the majority
        for _ in range(rounds):
            prior = ((n * p).sum() + 1) / (n.sum() + 2)
            margin = np.full(len(rows), np.log(prior / (1 - prior)))
            for k in range(len(VOTES)):
                for value in (-1, 0, 1):
                    at = v[:, k] == value
                    # Two votes of each class are assumed beforehand: a labeler is better than chance at first.
                    yes = ((n * p)[at].sum() + 1 + 0.5 * value) / ((n * p).sum() + 3)
                    no = ((n * (1 - p))[at].sum() + 1 - 0.5 * value) / ((n * (1 - p)).sum() + 3)
                    margin[at] += np.log(yes / no)
            p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        out |= {(kind, *map(int, x)): float(y) for x, y in zip(v, p)}
    return out


def _inputs(kind: int, row: Row | dict) -> list[float]:
    """Features of the span classifier: kind, votes, votes by kind, shape."""
    one = [float(kind == k) for k in range(len(KINDS))]
    vs = [float(row[x]) for x in VOTES]
    return one + vs + [a * b for a in one for b in vs] + [float(row["digits"]), float(row["size"])]


def span_weights(patterns: Sequence[Row], steps: int = 300) -> list[float]:
    """Logistic weights, trained on the probabilities of the vote patterns; patterns weigh by the log of their counts."""
    folded: dict[tuple, int] = {}
    for r in patterns:
        k = (r.kind, *(r[x] for x in VOTES))
        folded[k] = folded.get(k, 0) + r.n
    truth = reliabilities([Row(kind=k[0], n=n, **dict(zip(VOTES, k[1:]))) for k, n in sorted(folded.items())])
    width = len(_inputs(0, dict.fromkeys([*VOTES, "digits", "size"], 0)))
    if not patterns:
        return [0.0] * width
    x = np.array([_inputs(r.kind, r.asDict()) for r in patterns])
    y = np.array([truth[(r.kind, *(r[k] for k in VOTES))] for r in patterns])
    n = np.log1p([r.n for r in patterns])
    w = np.zeros(width)
    seen = np.full(width, 1e-6)
    for _ in range(steps):
        slope = (x * (n * (1 / (1 + np.exp(-x @ w)) - y))[:, None]).sum(0) / n.sum() + 1e-4 * w
        seen += slope * slope
        w -= 0.5 * slope / np.sqrt(seen)
    return w.tolist()


def personal_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", accept: float = 0.5) -> DataFrame:
    """(row, kind, start, end, base, match, score): all base spans, and the spans the classifier adds."""
    voted = stored(votes(candidates(docs, key, text)), "candidates")
    shape = ["kind", *VOTES, "digits", "size"]
    patterns = voted.groupBy(*shape).agg(F.count(F.lit(1)).alias("n")).orderBy(*shape).collect()
    weights = span_weights(patterns)
    one = [(F.col("kind") == k).cast("double") for k in range(len(KINDS))]
    vs = [F.col(v).cast("double") for v in VOTES]
    inputs = one + vs + [a * b for a in one for b in vs] + [F.col("digits").cast("double"), F.col("size").cast("double")]
    margin = sum((x * F.lit(w) for x, w in zip(inputs, weights)), F.lit(0.0))
    scored = voted.withColumn("score", 1 / (1 + F.exp(-margin)))
    # A match that two patterns share is one span; of spans that overlap a valid base span only that one stays.
    spans = scored.groupBy("row", "kind", "start", "end").agg(
        F.max("base").alias("base"), F.max("score").alias("score"), F.first("match").alias("match")) \
        .where(F.col("base") | (F.col("score") > accept))
    order = Window.partitionBy("row", "kind").orderBy("start", "end")
    ended = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(ended, F.lit(-1)) <= F.col("start")) & (F.coalesce(begun, F.col("end")) >= F.col("end"))
    alone = spans.withColumn("free", free).where(F.col("base") | F.col("free")).drop("free")
    # Of added spans that overlap each other the first stays.
    last = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return alone.withColumn("last", last).where(F.col("base") | (F.coalesce("last", F.lit(-1)) <= F.col("start"))) \
        .select("row", "kind", "start", "end", "base", "match", "score")


def span_digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): one row per row of ``docs``."""
    spans = personal_spans(docs, key, text)
    per_row = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end", "base"))).alias("l"))
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    told = f"x -> concat_ws(':', {names}[x.kind], x.start, x.end)"
    digests = per_row.select(
        "row", *(F.expr(f"size(filter(l, x -> x.base and x.kind = {i}))").cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.expr(f"array_join(transform(filter(l, x -> x.base), {told}), ',')").alias("base_spans"),
        F.expr(f"array_join(transform(l, {told}), ',')").alias("spans"))
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(key, text).alias("row"))
    return rows.join(digests, "row", "left").select(
        "doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.coalesce("base_spans", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"))
