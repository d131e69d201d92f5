"""Plain Python statements of the rules, to hold the Column expressions against."""

import re
import unicodedata

from quietspan.functions import patterns as P


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = unicodedata.decimal(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def choose(found):
    kept = []
    for s in sorted(found, key=lambda s: (s[0] - s[1], s[0])):
        if all(s[1] <= k[0] or k[1] <= s[0] for k in kept):
            kept.append(s)
    return sorted(kept)


def cards(text):
    sep, found = f"[{P.SEPARATOR_CLASS_PY}]", []
    for run in re.finditer(rf"\d+(?:{sep}+\d+)*", text):
        groups = [(run.start() + g.start(), run.start() + g.end()) for g in re.finditer(r"\d+", run[0])]
        for i in range(len(groups)):
            for j in range(i, len(groups)):
                a, b = groups[i][0], groups[j][1]
                digits = "".join(c for c in text[a:b] if c.isdecimal())
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found.append((a, b))
    return choose(found)


def mod97(account):
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def ibans(text):
    """Spans, or None where the scan fails."""
    sep, found = f"[{P.SEPARATOR_CLASS_PY}]", []
    for m in re.finditer("[A-Za-z]{2}[0-9]{2}", text):
        size = P.IBAN_LENGTH.get(m[0][:2].upper())
        if size is None or re.search("[A-Za-z0-9]", text[max(0, m.start() - 1) : m.start()]):
            continue
        body = re.compile(rf"[A-Za-z]{{2}}[0-9]{{2}}(?:{sep}{{0,3}}[A-Za-z0-9]){{{size - 4}}}(?![A-Za-z0-9])").match(text, m.start())
        if body:
            plain = re.sub(rf"(?<=\d){sep}+(?=\d)", "", body[0]).upper()
            if len(plain) != size:
                return None
            if mod97(plain):
                found.append(body.span())
    return choose(found)
