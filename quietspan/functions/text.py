"""Text functions as Column expressions (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quietspan.functions import patterns as P


def line_endings(c: Column) -> Column:
    """CR LF and CR become LF."""
    return F.regexp_replace(c, "\r\n?", "\n")


def strip_zero_width(c: Column) -> Column:
    return F.translate(c, P.ZERO_WIDTH, "")


def collapse_separators(c: Column, across_lines: bool = False) -> Column:
    """Remove separators between two digits; with ``across_lines`` line feeds too."""
    sep = P.SEPARATOR_OR_FEED if across_lines else P.SEPARATOR
    return F.regexp_replace(c, f"(?<=\\p{{Nd}}){sep}++(?=\\p{{Nd}})", "")


def nfc_inert(c: Column) -> Column:
    """True where NFC cannot change the text: no code point from U+0300 on."""
    return ~c.rlike(r"[^\x{0}-\x{2ff}]")


def is_blank(c: Column) -> Column:
    """Only white space in Python's sense, or empty."""
    return ~c.rlike(r"(?U)[^\s\x1c-\x1f]")


def identifier_shaped(c: Column) -> Column:
    return collapse_separators(c).rlike("(?iU)" + P.IDENTIFIER_SHAPE)


def imperative(c: Column) -> Column:
    return c.rlike("(?iU)" + P.IMPERATIVE_SHAPE)


def hidden_style(c: Column) -> Column:
    """Whether an inline style hides its element; white text counts where the style sets no background."""
    white = c.rlike("(?i)" + P.WHITE_TEXT) & ~c.rlike("(?i)" + P.BACKGROUND)
    return c.rlike("(?i)(?:" + P.HIDDEN_STYLE + ")") | white


def suspicious(label: Column) -> Column:
    """Whether an anomaly label is an injection suspicion."""
    return F.array_contains(F.transform(F.array(*map(F.lit, P.SUSPICIONS)), lambda p: F.startswith(label, p)), True)


def defang_links(c: Column) -> Column:
    """Blank the addresses of remote images, and of links that carry a query."""
    images = F.regexp_replace(c, r"(?i)(<img\b[^>]*?\bsrc\s*+=\s*+)(?:\"https?:[^\"]*+\"|'https?:[^']*+')", '$1""')
    return F.regexp_replace(images, r"https?://[^\s\"'<>?]++\?[^\s\"'<>]*+", "[link removed]")


def unfold(c: Column) -> Column:
    """iCalendar: a line feed and one space or tab continue the line."""
    return F.regexp_replace(c, "\n[ \t]", "")


def unescape_ical(c: Column) -> Column:
    """One pass over the escapes of backslash, semicolon, comma and line feed; other escapes stay."""
    hold = "\x00"
    c = F.replace(c, F.lit("\\\\"), F.lit(hold))
    c = F.regexp_replace(c, r"\\[nN]", "\n")
    c = F.regexp_replace(c, r"\\([;,])", "$1")
    return F.replace(c, F.lit(hold), F.lit("\\"))


_CONTENT_LINE = r'(?s)^((?:[^":]++|"[^"]*+")*+):(.*)$'


def content_line(c: Column) -> Column:
    """Struct of name (upper case, before the first semicolon) and value; null without a colon outside quotes."""
    head = F.regexp_extract(c, _CONTENT_LINE, 1)
    name = F.upper(F.trim(F.substring_index(head, ";", 1)))
    return F.when(c.rlike(_CONTENT_LINE), F.struct(name.alias("name"), F.regexp_extract(c, _CONTENT_LINE, 2).alias("value")))


def mail_shape(raw: Column) -> Column:
    """Null where bytes may be mail, else why not: ``blank``, ``other_format``, ``no_mail_headers``."""
    head = F.substring(raw, 1, P.HEADER_BYTES)
    text = F.decode(head, "iso-8859-1")
    start = F.lower(F.regexp_replace(text, "^(?:ï»¿)?[ \t\n\r\x0b\f]*+", ""))
    other = [F.startswith(start, F.lit(s.decode("latin-1").lower())) for s in P.NOT_MAIL]
    block = F.regexp_replace(text, "(?s)\r?\n\r?\n.*+", "")
    names = F.transform(F.regexp_extract_all(block, F.lit(r"(?md)^([!-9;-~]++):"), F.lit(1)), lambda n: F.lower(n))
    any_other = other[0]
    for o in other[1:]:
        any_other = any_other | o
    return (
        F.when(raw.isNull() | ~F.decode(raw, "iso-8859-1").rlike(r"[^ \t\n\r\x0b\f]"), "blank")
        .when(any_other, "other_format")
        .when(~F.arrays_overlap(names, F.array(*map(F.lit, P.MAIL_HEADERS))), "no_mail_headers")
    )


def ical_shape(raw: Column) -> Column:
    """Null where bytes may be a calendar, else ``blank`` or ``not_icalendar``."""
    text = F.decode(F.substring(raw, 1, P.HEADER_BYTES), "iso-8859-1")
    start = F.regexp_replace(text, "^(?:ï»¿)?[ \t\n\r\x0b\f]*+", "")
    return F.when(raw.isNull() | ~text.rlike(r"[^ \t\n\r\x0b\f]"), "blank").when(~F.lower(start).startswith("begin:vcalendar"), "not_icalendar")
