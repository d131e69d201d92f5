"""Policy, masking, reports, decision cache: relational plans over spans and decisions.

Items are rows with an id, an account and text; findings are arrays of spans. Actions are ordered allow <
mask < quarantine, and every rule can only raise an action. A failed scan (null spans or status error)
is quarantined. Policies are small literal tables, joined as broadcast maps; decisions are keyed by
content hash and versions, and hold no text.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quietspan.functions.text import suspicious
from quietspan.operators.spans import card_spans, iban_scan, mask

ACTIONS = ("allow", "mask", "quarantine")
MASK_AT, QUARANTINE_AT = 0.25, 0.70
# Purposes, strictest first.
PURPOSES = {"unspecified": 0, "scheduling": 1, "finance_admin": 1}


@dataclass(frozen=True)
class Policy:
    version: str = "1"
    actions: dict[str, str] = field(default_factory=lambda: {"credit_card": "mask", "iban": "mask", "steuer_idnr": "mask", "secret": "quarantine"})
    default: str = "quarantine"
    #: Quarantine an item with at least this many findings.
    many: int = 1 << 30


def severity(action: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ACTIONS)), action).cast("int") - 1


def action_of(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ACTIONS)), level + 1)


def decide(spans: Column, policy: Policy, defects: Column | None = None, anomalies: Column | None = None) -> Column:
    """The strictest action that any finding, defect or suspicion asks for; a null list of spans is a failed scan."""
    rules = F.create_map(*[F.lit(x) for d, a in policy.actions.items() for x in (d, ACTIONS.index(a))])
    levels = F.transform(spans, lambda s: F.coalesce(F.try_element_at(rules, s["detector"]), F.lit(ACTIONS.index(policy.default))))
    level = F.coalesce(F.array_max(levels), F.lit(0))
    top = F.lit(len(ACTIONS) - 1)
    level = F.when(F.size(spans) >= policy.many, top).otherwise(level)
    if defects is not None:
        level = F.when(F.size(defects) > 0, top).otherwise(level)
    if anomalies is not None:
        level = F.when(F.exists(anomalies, suspicious), top).otherwise(level)
    return action_of(F.when(spans.isNull(), top).otherwise(level))


def decide_by_confidence(confidence: Column) -> Column:
    """Findings of a statistical layer: mask from 0.25, quarantine from 0.70; no confidence is quarantined."""
    return F.when(confidence.isNull() | F.isnan(confidence) | (confidence >= QUARANTINE_AT), "quarantine").when(confidence >= MASK_AT, "mask").otherwise("allow")


def with_decision(items: DataFrame, policy: Policy, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """``items`` plus action, output (text, masked text, or null where withheld) and categories."""
    spans = F.col(spans_col)
    out = items.withColumn("action", decide(spans, policy))
    shown = F.when(F.col("action") == "allow", F.col(text_col)).when(F.col("action") == "mask", mask(F.col(text_col), spans))
    categories = F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["detector"])))
    return out.withColumns({"output": shown, "categories": categories})


def with_verdicts(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Items with their action raised by the verdicts (item_id, topic, confidence) of a topic layer, one per item at most.

    A verdict can only raise an action. A missing one, or one without topic or confidence, has failed and quarantines.
    """
    joined = items.join(verdicts.select("item_id", "topic", "confidence"), "item_id", "left")
    asked = F.when(F.col("topic").isNull(), "quarantine").when(F.col("topic") == "none", "allow").otherwise(decide_by_confidence(F.col("confidence")))
    return joined.withColumn("action", action_of(F.greatest(severity(F.col("action")), severity(asked)))).drop("topic", "confidence")


def notices(items: DataFrame) -> DataFrame:
    """Withheld items (item_id, sender, subject, action, categories) as metadata: the sender's domain, and the subject only where its own scan ends without a finding."""
    subject = F.coalesce("subject", F.lit(""))
    scan = iban_scan(subject)
    clean = (scan["status"] == "ok") & (F.size(scan["spans"]) == 0) & (F.size(card_spans(subject)) == 0)
    domain = F.lower(F.regexp_extract("sender", r"@([^@>\s]++)", 1))
    return items.where("action <> 'allow'").select("item_id", domain.alias("sender_domain"), F.when(clean, F.col("subject")).alias("subject"), "categories")


def simulate(items: DataFrame, now: Column, days: int, policy: Policy, *by: str) -> DataFrame:
    """Counts of what ``policy`` would have done to the items (at, text, spans) of the last ``days``; nothing is written."""
    return withheld_counts(with_decision(retain(items, "at", now, days), policy), *by)


def progress(items: DataFrame, decided: DataFrame, *by: str) -> DataFrame:
    """How many items there are and how many have a decision (item_id), so that partial results can be told from whole ones."""
    known = decided.select("item_id").distinct().withColumn("__known", F.lit(True))
    counted = items.join(known, "item_id", "left").groupBy(*by).agg(F.count("*").alias("total"), F.count("__known").alias("scanned"))
    return counted.withColumn("complete", F.col("scanned") == F.col("total"))


def attachment_action(attachments: Column) -> Column:
    """The action that a message's attachments (array of structs with a boolean ``scanned``) ask for: one that could not be scanned withholds the whole message."""
    return F.when(F.exists(attachments, lambda a: ~F.coalesce(a["scanned"], F.lit(False))), "quarantine").otherwise("allow")


def narrow(purpose: Column, level: Column) -> Column:
    """An action level under a stated purpose: never looser than unspecified, and an unknown purpose is unspecified."""
    allowed = F.create_map(*[F.lit(x) for p, n in PURPOSES.items() for x in (p, n)])
    extra = F.coalesce(F.try_element_at(allowed, F.coalesce(purpose, F.lit("unspecified"))), F.lit(0))
    return F.least(level + F.when(level > 0, extra).otherwise(0), F.lit(len(ACTIONS) - 1))


def withheld_counts(decisions: DataFrame, *by: str) -> DataFrame:
    """The default report: counts only."""
    return decisions.groupBy(*by, "action").agg(F.count("*").alias("n"))


def report(decisions: DataFrame, mode: str = "counts_only", detail: str = "coarse") -> DataFrame:
    """``out_of_band`` tells nothing, ``counts_only`` how many, ``in_band`` which items and (coarse or fine) why; never text."""
    held = decisions.where("action <> 'allow'")
    if mode == "out_of_band":
        return held.limit(0).select("action")
    if mode == "counts_only":
        return withheld_counts(held)
    if mode != "in_band" or detail not in ("coarse", "fine"):
        raise ValueError("no such report")
    why = F.when(F.size("categories") > 0, "sensitive").otherwise("failed_scan") if detail == "coarse" else F.array_join("categories", ",")
    return held.select("item_id", "action", why.alias("reason"))


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def cache_key(items: DataFrame, policy: Policy, detector_version: str, text_col: str = "text") -> DataFrame:
    return items.withColumns({"item_hash": content_hash(F.col(text_col)), "policy_version": F.lit(policy.version), "detector_version": F.lit(detector_version)})


CACHE_KEY = ["item_hash", "policy_version", "detector_version"]


def fresh(cache: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Cached decisions that are not older than ``days``, one per key (the latest)."""
    latest = Window.partitionBy(*CACHE_KEY).orderBy(F.col("at").desc())
    return cache.where(F.col("at") >= now - F.expr(f"interval {days} days")).withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n")


def misses(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Items that have to be scanned."""
    return items.join(cache, CACHE_KEY, "left_anti")


def hits(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Items with their cached action."""
    return items.join(cache.select(*CACHE_KEY, "action"), CACHE_KEY)


def shadow_diff(old: DataFrame, new: DataFrame, key: str = "item_id") -> DataFrame:
    """Changed decisions of two policies by transition; an item that only one has shows as null."""
    both = old.select(key, F.col("action").alias("old_action")).join(new.select(key, F.col("action").alias("new_action")), key, "full")
    return both.where(~F.col("old_action").eqNullSafe(F.col("new_action"))).groupBy("old_action", "new_action").agg(F.count("*").alias("n"))


def retain(rows: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    return rows.where(F.col(at) >= now - F.expr(f"interval {days} days"))


def truncate(rows: DataFrame, order: list[Column], limit: int = 25) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` rows, and one row that says how many there were and whether some are missing."""
    return rows.orderBy(*order).limit(limit), rows.agg(F.count("*").alias("total"), (F.count("*") > limit).alias("truncated"))


def hmac_ref(value: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a provider id, in SQL functions."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in block).hex()))
    inner = F.sha2(F.concat(pad(0x36), F.encode(value, "utf-8")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def scoped(rows: DataFrame, account_id: str) -> DataFrame:
    """Rows of one account; every entity carries its account."""
    return rows.where(F.col("account_id") == account_id)


def matching_rules(items: DataFrame, rules: DataFrame, value: str = "sender") -> DataFrame:
    """Items with the strictest action of the glob rules (pattern, action) that match; ``rules`` is a policy table of 10,000 rows at most, more of them fail."""
    like = F.regexp_replace(F.regexp_replace("pattern", r"([\\%_])", r"\\$1"), r"\*", "%")
    globs = [(r.glob, r.action) for r in rules.select(like.alias("glob"), "action").limit(10_001).collect()]
    if len(globs) > 10_000:
        raise ValueError("over 10,000 rules")
    level = F.lit(0)
    for glob, action in globs:
        level = F.greatest(level, F.when(F.lower(value).like(glob.lower()), ACTIONS.index(action)).otherwise(0))
    return items.withColumn("action", action_of(level))
