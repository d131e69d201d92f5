"""Checks of a corpus of cases with expectations: each gives the rows that break a rule.

A case has an id, normalised text, raw source, spans, an action, strings that must not leak, strings that
normalisation strips, and anomalies (expected and found). All checks are joins and expressions; a sound
corpus gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietspan.functions import patterns as P
from quietspan.functions.text import collapse_separators

# The schema of an expectation file.
EXPECTATION = {
    "type": "object",
    "required": ["expected_spans", "expected_action", "must_not_appear_in_output", "notes"],
    "additionalProperties": False,
    "properties": {
        "expected_spans": {
            "type": "array",
            "items": {
                "type": "object",
                "required": ["detector", "start", "end", "text"],
                "additionalProperties": False,
                "properties": {
                    "detector": {"type": "string", "enum": ["credit_card", "iban", "steuer_idnr", "secret", "ssn", "versicherungsnummer"]},
                    "start": {"type": "integer", "minimum": 0},
                    "end": {"type": "integer", "exclusiveMinimum": 0},
                    "text": {"type": "string", "minLength": 1},
                },
            },
        },
        "expected_action": {"type": "string", "enum": ["allow", "mask", "quarantine"]},
        "must_not_appear_in_output": {"type": "array", "items": {"type": "string", "minLength": 1}},
        "expected_stripped": {"type": "array", "items": {"type": "string", "minLength": 1}},
        "expected_anomalies": {"type": "array", "items": {"type": "string", "minLength": 1}},
        "notes": {"type": "string", "minLength": 1},
    },
}
_KINDS = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING", "integer": "^BIGINT", "number": "^(BIGINT|DECIMAL|DOUBLE)", "boolean": "^BOOLEAN"}


def _none() -> Column:
    return F.array().cast("array<string>")


def _if(broken: Column, path: Column, rule: str) -> Column:
    return F.when(broken, F.array(F.concat(path, F.lit(f": {rule}")))).otherwise(_none())


def _check(value: Column, path: Column, schema: dict) -> Column:
    parts = []
    as_kind = lambda kind: F.variant_get(value, "$", kind)
    if "enum" in schema:
        parts.append(_if(~as_kind("string").isin(schema["enum"]), path, "enum"))
    if "minLength" in schema:
        parts.append(_if(F.length(as_kind("string")) < schema["minLength"], path, "minLength"))
    if "minimum" in schema:
        parts.append(_if(as_kind("double") < schema["minimum"], path, "minimum"))
    if "exclusiveMinimum" in schema:
        parts.append(_if(as_kind("double") <= schema["exclusiveMinimum"], path, "exclusiveMinimum"))
    child = lambda name: F.variant_get(value, f"$['{name}']", "variant")
    inside = lambda name: F.concat(path, F.lit(f".{name}"))
    parts += [_if(child(name).isNull(), inside(name), "required") for name in schema.get("required", ())]
    for name, sub in schema.get("properties", {}).items():
        parts.append(F.when(child(name).isNotNull(), _check(child(name), inside(name), sub)).otherwise(_none()))
    if schema.get("additionalProperties") is False:
        other = F.filter(F.json_object_keys(F.to_json(value)), lambda k: ~k.isin(list(schema["properties"])))
        parts.append(F.transform(other, lambda k: F.concat(path, F.lit("."), k, F.lit(": additionalProperties"))))
    if "items" in schema:
        parts.append(F.flatten(F.transform(as_kind("array<variant>"), lambda x, i: _check(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), schema["items"]))))
    fine = F.schema_of_variant(value).rlike(_KINDS[schema["type"]])
    return F.when(F.coalesce(fine, F.lit(False)), F.concat(_none(), *parts)).otherwise(F.array(F.concat(path, F.lit(": type"))))


def schema_violations(json: Column, schema: dict) -> Column:
    """``path: rule`` for each violation of a JSON text. Rules: type, required, properties, additionalProperties, items, enum, minimum, exclusiveMinimum, minLength."""
    return _check(F.try_parse_json(json), F.lit("$"), schema)


def consistency(cases: DataFrame) -> DataFrame:
    """(case_id, rule) for each rule that a case breaks."""
    text, spans = F.col("text"), F.col("spans")
    sound = lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(text))
    cut = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])
    same = lambda a, b: F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))
    rules = {
        "span_bounds": F.exists(spans, lambda s: ~sound(s)),
        "span_text": F.exists(spans, lambda s: sound(s) & (cut(s) != s["text"])),
        "allow_with_spans": (F.col("action") == "allow") & (F.size(spans) > 0),
        "leak_absent": F.exists("leaks", lambda x: ~F.contains(text, x)),
        "stripped_not_in_source": F.exists("stripped", lambda x: ~F.contains(F.col("source"), x)),
        "stripped_survived": F.exists("stripped", lambda x: F.contains(text, x)),
        "anomalies_differ": F.col("anomalies").isNotNull() & ~same(F.col("anomalies"), F.col("found_anomalies")),
    }
    return cases.select("case_id", F.explode(F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules.items()]))).alias("rule"))


def unlisted(cases: DataFrame) -> DataFrame:
    """(case_id, span_text) of spans that the case's leak list does not name."""
    return cases.select("case_id", "leaks", F.explode("spans").alias("s")).where(~F.array_contains("leaks", F.col("s.text"))).select("case_id", F.col("s.text").alias("span_text"))


def identifier_tokens(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token): identifier-shaped parts of a text, with separators between digits removed, line feeds too."""
    found = F.regexp_extract_all(collapse_separators(F.col(text_col), True), F.lit("(?iU)" + P.IDENTIFIER_SHAPE), F.lit(0))
    return rows.select(id_col, F.explode(found).alias("token"))


def undeclared(tokens: DataFrame, allowed: DataFrame) -> DataFrame:
    """Tokens that the allow list (token) does not hold."""
    return tokens.join(allowed, "token", "left_anti")


def sweep(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Spans that only one side has, as often as it has them more: side is ``missing`` or ``unexpected``."""
    columns = ["case_id", "detector", "start", "end", "text"]
    found, expected = found.select(*columns), expected.select(*columns)
    return expected.exceptAll(found).withColumn("side", F.lit("missing")).unionByName(found.exceptAll(expected).withColumn("side", F.lit("unexpected")))


def floors(rows: DataFrame, least: dict[str, int]) -> DataFrame:
    """(detector, n, enough): how many rows exercise each detector, against the least number asked for."""
    wanted = rows.sparkSession.createDataFrame(list(least.items()), "detector string, least int")
    counts = rows.groupBy("detector").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return F.broadcast(wanted).join(counts, "detector", "left").select("detector", n.alias("n"), (n >= F.col("least")).alias("enough"))
