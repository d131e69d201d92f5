"""Detectors: text to spans (detector, start, end, text), offsets in code points, end exclusive.

Offsets come from the lengths of the parts between matches (``regexp_instr`` counts UTF-16 units).
Everything is a Column expression, row by row, without a shuffle; texts without enough digits cost one
regular expression. Work grows with the square of the matches of one text, not with the table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quietspan.functions import patterns as P
from quietspan.functions.checksums import luhn, mod11_10, mod97, nhs, pension
from quietspan.functions.text import collapse_separators

SPAN = "struct<detector:string,start:int,end:int,text:string>"
NONE = f"cast(array() as array<{SPAN}>)"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def located(text: Column, pattern: str) -> Column:
    """Array of (start, text) of all matches, left to right. A match is never empty."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    step = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, m: F.struct(F.length(b).alias("skip"), m.alias("text")))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,text:string>>)").alias("out"))
    return F.aggregate(
        step,
        start,
        lambda s, x: F.struct(
            (s["at"] + x["skip"] + F.length(x["text"])).alias("at"),
            F.concat(s["out"], F.array(F.struct((s["at"] + x["skip"]).alias("start"), x["text"].alias("text")))).alias("out"),
        ),
        lambda s: s["out"],
    )


def digit_runs(text: Column) -> Column:
    """Maximal runs of digits and separators, from a digit to a digit: array of (start, text)."""
    return located(text, P.DIGIT_RUN)


def disjoint(spans: Column) -> Column:
    """Longest first (then leftmost), those that overlap a kept one go; what stays is in order of start."""
    ranked = F.array_sort(spans, lambda a, b: F.when(_size(a) != _size(b), _size(b) - _size(a)).otherwise(a["start"] - b["start"]))
    kept = F.aggregate(
        ranked,
        F.expr(NONE),
        lambda acc, x: F.when(F.exists(acc, lambda k: (x["start"] < k["end"]) & (k["start"] < x["end"])), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return F.array_sort(kept, lambda a, b: a["start"] - b["start"])


def _size(s: Column) -> Column:
    return s["end"] - s["start"]


def _span(detector: str, start: Column, text: Column) -> Column:
    return F.struct(F.lit(detector).alias("detector"), start.cast("int").alias("start"), (start + F.length(text)).cast("int").alias("end"), text.alias("text"))


def _run_windows(run: Column) -> Column:
    """Sequences of whole digit groups of one run with 13 to 19 digits that pass Luhn."""

    def tried(g: Column, x: Column) -> Column:
        text = F.substring(run["text"], g["start"] + 1, x["start"] + F.length(x["text"]) - g["start"])
        return let(text, lambda t: F.struct((run["start"] + g["start"]).alias("at"), t.alias("text"), F.regexp_replace(t, r"\P{Nd}++", "").alias("digits")))

    def of_first(groups: Column):
        def windows(g: Column, i: Column) -> Column:
            texts = F.transform(F.slice(groups, i + 1, F.lit(19)), lambda x: tried(g, x))
            fit = F.filter(texts, lambda t: F.when(F.length(t["digits"]).between(13, 19), luhn(t["digits"])).otherwise(False))
            return F.transform(fit, lambda t: _span("credit_card", t["at"], t["text"]))

        return F.flatten(F.transform(groups, windows))

    return let(located(run["text"], r"\p{Nd}++"), of_first)


def card_spans(text: Column) -> Column:
    """Payment cards: 13 to 19 digits in whole groups that pass Luhn, in a run of digits and separators on one line; no issuer table."""
    found = F.flatten(F.transform(located(text, P.LONG_RUN), _run_windows))
    return F.when(text.isNull(), None).when(text.rlike(P.LONG_RUN), disjoint(found)).otherwise(F.expr(NONE))


_ANCHOR = "[A-Za-z]{2}[0-9]{2}"


def _iban_at(text: Column, anchor: Column) -> Column:
    """(start, text, state) for one anchor: ``no``, ``valid`` or ``error`` (letter-adjacent separators)."""
    lengths = F.create_map(*[x for c, n in P.IBAN_LENGTH.items() for x in (F.lit(c), F.lit(n))])
    before = F.when(anchor["start"] > 0, F.substring(text, anchor["start"], 1)).otherwise("")

    def with_length(length: Column) -> Column:
        shape = F.concat(F.lit(f"^[A-Za-z]{{2}}[0-9]{{2}}(?:{P.SEPARATOR}{{0,3}}+[A-Za-z0-9]){{"), (length - 4).cast("string"), F.lit("}(?![A-Za-z0-9])"))
        body = F.call_function("regexp_extract", F.substring(text, anchor["start"] + 1, 137), shape, F.lit(0))

        def judged(b: Column) -> Column:
            plain = F.upper(collapse_separators(b))
            state = F.when(b == "", "no").when(F.length(plain) != length, "error").when(mod97(plain), "valid").otherwise("no")
            return F.struct(anchor["start"].alias("start"), b.alias("text"), state.alias("state"))

        return let(F.when(length.isNotNull() & ~before.rlike("[A-Za-z0-9]"), body).otherwise(""), judged)

    return let(F.try_element_at(lengths, F.upper(F.substring(anchor["text"], 1, 2))), with_length)


def iban_scan(text: Column) -> Column:
    """Struct of status (``ok`` or ``error``) and spans. A failed scan has null spans, never an empty list."""
    failed = F.struct(F.lit("error").alias("status"), F.lit(None).cast(f"array<{SPAN}>").alias("spans"))

    def judged(tried: Column) -> Column:
        spans = disjoint(F.transform(F.filter(tried, lambda t: t["state"] == "valid"), lambda t: _span("iban", t["start"], t["text"])))
        return F.when(F.exists(tried, lambda t: t["state"] == "error"), failed).otherwise(F.struct(F.lit("ok").alias("status"), spans.alias("spans")))

    found = let(F.transform(located(text, _ANCHOR), lambda a: _iban_at(text, a)), judged)
    clean = F.struct(F.lit("ok").alias("status"), F.expr(NONE).alias("spans"))
    return F.when(text.isNull(), failed).when(~text.rlike(_ANCHOR), clean).otherwise(found)


def iban_spans(text: Column) -> Column:
    return iban_scan(text)["spans"]


def tax_id_spans(text: Column) -> Column:
    """German tax ids: eleven digits standing alone whose check digit holds."""
    found = F.filter(located(text, r"(?<![0-9A-Za-z])[1-9][0-9]{10}(?![0-9A-Za-z])"), lambda m: mod11_10(m["text"]))
    return F.transform(found, lambda m: _span("steuer_idnr", m["start"], m["text"]))


_ALONE = ("(?<![0-9A-Za-z])", "(?![0-9A-Za-z])")


def ssn_spans(text: Column) -> Column:
    """United States social security numbers, written with hyphens; numbers never issued are none."""
    found = located(text, r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])")
    return F.transform(found, lambda m: _span("ssn", m["start"], m["text"]))


def nhs_spans(text: Column) -> Column:
    """British health service numbers, in one piece or as 3, 3 and 4 digits."""
    found = located(text, _ALONE[0] + "[0-9]{3} ?[0-9]{3} ?[0-9]{4}" + _ALONE[1])
    return F.transform(F.filter(found, lambda m: nhs(F.replace(m["text"], F.lit(" "), F.lit("")))), lambda m: _span("nhs", m["start"], m["text"]))


def pension_spans(text: Column) -> Column:
    """German pension insurance numbers: area, day, month and year of birth, letter, serial, check digit."""
    found = located(text, _ALONE[0] + "[0-9]{2}(?:0[1-9]|[12][0-9]|3[01])(?:0[1-9]|1[0-2])[0-9]{2}[A-Z][0-9]{3}" + _ALONE[1])
    return F.transform(F.filter(found, lambda m: pension(m["text"])), lambda m: _span("versicherungsnummer", m["start"], m["text"]))


def secret_spans(text: Column) -> Column:
    """Credentials of well-known shapes."""
    return F.transform(located(text, "|".join(P.SECRETS)), lambda m: _span("secret", m["start"], m["text"]))


def residue_windows(text: Column, claimed: Column) -> Column:
    """Parts of over-long unseparated digit runs that no claimed span overlaps, with an issuer's prefix and length and a valid check digit."""

    def of_issuer(run: Column, prefix: str, n: int) -> Column:
        starts = F.sequence(F.lit(0), F.length(run["text"]) - n)
        parts = F.transform(starts, lambda i: F.struct(i.alias("at"), F.substring(run["text"], i + 1, F.lit(n)).alias("text")))
        return F.filter(parts, lambda p: F.when(p["text"].rlike(f"^(?:{prefix})"), luhn(p["text"])).otherwise(False))

    def of_run(run: Column) -> Column:
        tried = [of_issuer(run, prefix, n) for prefix, lengths in P.ISSUERS for n in lengths]
        return F.transform(F.concat(*tried), lambda p: _span("credit_card", run["start"] + p["at"], p["text"]))

    long = located(text, "[0-9]{20,}+")
    free = F.filter(long, lambda r: ~F.exists(claimed, lambda s: (s["start"] < r["start"] + F.length(r["text"])) & (r["start"] < s["end"])))
    return F.flatten(F.transform(free, of_run))


def residue_spans(text: Column, claimed: Column) -> Column:
    """The disjoint ones of ``residue_windows``, longest first. An opt-in: a few windows of any long number pass by chance."""
    return disjoint(residue_windows(text, claimed))


#: Detectors by id, for queries over several of them.
DETECTORS = {"credit_card": card_spans, "iban": iban_spans, "steuer_idnr": tax_id_spans, "ssn": ssn_spans, "nhs": nhs_spans, "versicherungsnummer": pension_spans, "secret": secret_spans}


def merge_spans(*arrays: Column) -> Column:
    """Spans of several detectors as one list: distinct, longest first where they overlap, any null list makes null."""
    return disjoint(F.array_distinct(F.concat(*arrays)))


def mask(text: Column, spans: Column) -> Column:
    """Each span becomes ``[DETECTOR_n]``; equal values of one detector share n, numbered by first place."""

    def key(s: Column) -> Column:
        return F.struct(s["detector"].alias("d"), s["text"].alias("t"))

    def label(keys: Column, s: Column) -> Column:
        number = F.array_position(F.filter(keys, lambda k: k["d"] == s["detector"]), key(s))
        return F.concat(F.lit("["), F.upper(s["detector"]), F.lit("_"), number.cast("string"), F.lit("]"))

    def spliced(keys: Column) -> Column:
        return F.aggregate(
            spans,
            F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
            lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), label(keys, s)).alias("out")),
            lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)),
        )

    return F.when(F.size(spans) == 0, text).otherwise(let(F.array_distinct(F.transform(spans, key)), spliced))
