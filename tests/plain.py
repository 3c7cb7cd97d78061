"""Plain Python versions of the operators, one document at a time, to check results against."""

import re

from veilframe.functions import fixed_values as fv


def luhn(value):
    digits = [int(c) for c in value if c in "0123456789"]
    doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0, len(digits)


def iban(value):
    clean = "".join(value.split()).upper()
    if len(clean) < 5 or not re.fullmatch("[A-Z0-9]+", clean):
        return False
    return int("".join(str(int(c, 36)) for c in clean[4:] + clean[:4])) % 97 == 1


def fiscal_code(value):
    code = value.upper()
    if len(code) != 16:
        return False
    odd = dict(zip("0123456789", fv.FISCAL_ODD_DIGITS))
    odd.update(zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", fv.FISCAL_ODD_LETTERS))
    even = {c: i % 10 if c.isdigit() else ord(c) - 65 for i, c in enumerate("0123456789")}
    even.update({c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZ")})
    total = sum((even if i % 2 else odd).get(c, 0) for i, c in enumerate(code[:15]))
    return chr(65 + total % 26) == code[15]


def passes(type_, value):
    if type_ == "CARD":
        good, n = luhn(value)
        return good and n >= 13
    if type_ == "PIVA":
        good, n = luhn(value)
        return good and n == 11
    return {"IBAN": iban, "CF": fiscal_code}.get(type_, lambda v: True)(value)


COMPILED = [(t, c, re.compile(p, re.IGNORECASE)) for t, c, p in fv.PATTERNS]


def spans(text, threshold=0.7, types=None):
    found = []
    for ord_, (type_, confidence, pattern) in enumerate(COMPILED):
        if confidence < threshold or (types and type_ not in types):
            continue
        group = "v" if "v" in pattern.groupindex else 0
        for m in pattern.finditer(text):
            if passes(type_, m[group]):
                found.append((*m.span(group), m[group], type_, confidence, "rule", ord_))
    return found


def resolve(found):
    sources = {}
    for s in found:
        sources.setdefault((s[0], s[1], s[3]), set()).add(s[5])
    raised = [
        (*s[:4], min(0.99, s[4] + 0.05), *s[5:]) if len(sources[s[0], s[1], s[3]]) > 1 else s
        for s in found
    ]
    kept, last = [], -1
    for s in sorted(raised, key=lambda s: (s[0], s[0] - s[1], -s[4], s[6])):
        if s[0] >= last:
            kept.append(s)
            last = s[1]
    return kept


def anonymise(text, entities):
    tokens, counts, mapping, out, end = {}, {}, {}, [], len(text)
    for start, stop, value, type_, *_ in sorted(entities, reverse=True):
        key = value.strip().lower()
        if key not in tokens:
            counts[type_] = counts.get(type_, 0) + 1
            tokens[key] = "[%s_%03d]" % (type_, counts[type_])
        mapping[tokens[key]] = value
        out += [text[stop:end], tokens[key]]
        end = start
    return "".join([*out, text[:end]][::-1]), mapping


TOKEN = re.compile(fv.TOKEN_PATTERN, re.IGNORECASE)


def restore(text, mapping):
    upper = {k.upper(): v for k, v in mapping.items()}
    return TOKEN.sub(lambda m: upper.get(m[0].upper(), m[0]), text)


def check_anonymised(text, mapping):
    upper = {k.upper() for k in mapping}
    errors = [fv.LEAK_ERROR % v[:30] for v in mapping.values() if v in text]
    return errors + [fv.UNKNOWN_TOKEN_ERROR % t for t in TOKEN.findall(text) if t.upper() not in upper]


def check_restored(text, mapping):
    upper = {k.upper() for k in mapping}
    return [
        (fv.LEFT_TOKEN_ERROR if t.upper() in upper else fv.INVENTED_TOKEN_ERROR) % t
        for t in TOKEN.findall(text)
    ]


def chunks(text, limit):
    if len(text) <= limit:
        return [text]
    out, rest = [], text
    upper_token = re.compile(fv.CHUNK_TOKEN_PATTERN)
    while len(rest) > limit:
        across = [m.start() for m in upper_token.finditer(rest[:limit + 16])
                  if m.start() < limit < m.end()]
        cuts = across + [rest[:limit].rfind(mark) for mark in ("\n\n", ". ", " ")] + [limit]
        cut = next(c for c in cuts if c > 0)
        out.append(rest[:cut].rstrip())
        rest = rest[cut:].lstrip()
    return [c for c in [*out, rest] if c]
