"""Turn the pattern table into Java regular expressions that scan fast.

Java's own ``\\b``, ``\\w`` and ``\\s`` depend on flags and on the JDK release, so they are
written out: a word character is a letter, a number or ``_``.  Long lists of labels are
grouped by their first letters, which accepts the same text in the same order of choice but
spares trying every label at every character.
"""

from __future__ import annotations

import functools
import itertools
import re

SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"\p{L}\p{N}_"
NOT_AFTER_WORD = f"(?<!(?-iu:[{WORD}]))"
EDGE = f"(?-iu:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
VALUE = "(?P<v>"
# So many letters of a label say which patterns are tried at it.
LETTERS = 5

# A leading \b needs only a look back when what follows must start with a word character.
_SIMPLE_START = re.compile(r"\\b(?!\[[^\]]*[.%+])")
# Such a start may be a digit only, one class, or a grouped word list.
_DIGIT_START = re.compile(r"\\b(?:\(\?(?:-i)?:)*(?:[0-9]|\[0-9\])")
_CLASS_START = re.compile(r"\\b(\(\?-i:)?\[([^\]\\]+)\]")
_GROUPED_START = re.compile(r"\\b\(\?:\[\w\]")
_CLASS_GROUP = re.compile(r"\\b\(\?:\[([^\]\\]+)\]\{[1-9]")
_LETTER_START = re.compile(r"\\b[A-Za-z](?![?*{])")
# A run of one class up to a character that is not in it, and a look back before a class or a sign.
_RUN_START = re.compile(r"\\b\[([^\]]+)\](\{[0-9]+,[0-9]+\})@")
_LOOK_BACK = re.compile(r"\(\?<!(?:\\d|\[[^\]]+\])\)(?:\(\?:)?(?:(\\\+)|\[([^\]\\]+)\])")
_PLAIN_LETTER = re.compile(r"[^\W\d_](?![?*+{])")


def _closing(pattern: str, start: int) -> int:
    """Index of the parenthesis that closes the group opened at ``start``."""
    depth, in_class, i = 0, False, start
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                return i
        i += 1
    raise ValueError(f"unbalanced group in {pattern!r}")


def alternatives(body: str) -> list[str]:
    """Split at the top-level bars."""
    parts, begin, i, in_class = [], 0, 0, False
    while i < len(body):
        c = body[i]
        if c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            i = _closing(body, i)
        elif c == "|":
            parts.append(body[begin:i])
            begin = i + 1
        i += 1
    return [*parts, body[begin:]]


def grouped(choices: list[str]) -> str:
    """Join alternatives, those with the same first letter under one branch.

    Choices that start with different letters exclude each other, so only the order within
    a letter matters and that order is kept.  The letter becomes a class, which is the
    fastest thing to test.
    """
    if len(choices) < 3 or not all(_PLAIN_LETTER.match(c) for c in choices):
        return "|".join(choices)
    by_letter: dict[str, list[str]] = {}
    for choice in choices:
        by_letter.setdefault(choice[0].lower(), []).append(choice[1:])
    return "|".join(
        f"[{letter}]" + (rests[0] if len(rests) == 1 else f"(?:{grouped(rests)})")
        for letter, rests in by_letter.items()
    )


def label_head(pattern: str) -> tuple[list[str], str] | None:
    """The labels of a label-then-value pattern and what stands between label and value."""
    head, value, _ = pattern.partition(VALUE)
    if not value or not head.startswith("(?:"):
        return None
    end = _closing(head, 0)
    return alternatives(head[3:end]), head[end + 1:]


def stems(label: str) -> list[str]:
    """The longest stretch of letters that every match of the label holds, in lower case.

    A class in the stretch gives one stem per member.
    """
    runs: list[list[str]] = [[]]
    i = 0
    while i < len(label):
        if label[i] == "(":
            end = _closing(label, i) + 1
            options = ""
        elif label[i] == "[":
            end = label.index("]", i) + 1
            options = label[i + 1:end - 1]
        elif label[i] == "\\":
            end, options = i + 2, ""
        else:
            end, options = i + 1, label[i]
        if label[end:end + 1] in ("?", "+", "*"):
            end, options = end + 1, ""
        if options:
            runs[-1].append(options.lower())
        else:
            runs.append([])
        i = end
    return ["".join(choice) for choice in itertools.product(*max(runs, key=len))]


@functools.cache
def label_stems(pattern: str) -> list[str]:
    """Stems of which every match of a label pattern holds one; none for other patterns."""
    found = label_head(pattern)
    if found is None:
        return []
    every = sorted({stem for label in found[0] for stem in stems(label)}, key=len)
    return [s for i, s in enumerate(every) if not any(short in s for short in every[:i])]


@functools.cache
def with_grouped_words(pattern: str) -> str:
    """Group the word list that the pattern starts with, if it does."""
    begin = 2 if pattern.startswith(r"\b(?:") else 0
    if not pattern.startswith("(?:", begin):
        return pattern
    end = _closing(pattern, begin)
    words = alternatives(pattern[begin + 3:end])
    return f"{pattern[:begin]}(?:{grouped(words)}{pattern[end:]}"


@functools.cache
def _cased() -> list[str]:
    """All characters that may equal a Latin letter when case is ignored."""
    return [c for c in map(chr, range(0x2200)) if c.lower() != c or c.upper() != c]


@functools.cache
def case_variants(c: str) -> str:
    """The other characters that equal ``c`` when case is ignored."""
    if not c.isalpha():
        return ""
    same = re.compile(re.escape(c), re.IGNORECASE)
    return "".join(v for v in _cased() if v != c and same.fullmatch(v))


def _as_ranges(characters: set[str]) -> str:
    out, codes = [], sorted(map(ord, characters))
    for _, run in itertools.groupby(enumerate(codes), lambda p: p[1] - p[0]):
        first, *rest = [chr(code) for _, code in run]
        out.append(first if not rest else f"{first}-{rest[-1]}" if len(rest) > 1 else first + rest[0])
    return "".join(out)


def java_class(body: str, ignore_case: bool) -> str:
    """A character class with its case variants written out.

    Java tests ranges slowly when it has to fold case at match time, even for digits.
    """
    out, members, i = [], set(), 0
    while i < len(body):
        c = body[i]
        if c == "\\":
            item, i = body[i:i + 2], i + 2
            out.append({r"\s": SPACE, r"\w": WORD, r"\d": r"\p{Nd}"}.get(item, item))
            continue
        last = body[i + 2] if body[i + 1:i + 2] == "-" and i + 2 < len(body) else c
        out.append(c if last == c else f"{c}-{last}")
        members |= {chr(o) for o in range(ord(c), ord(last) + 1)}
        i += 3 if last != c else 1
    if not ignore_case:
        return f"[{''.join(out)}]"
    variants = {v for m in members for v in case_variants(m)} - members
    return f"(?-iu:[{''.join(out)}{_as_ranges(variants)}])"


def _first_character(pattern: str) -> str:
    """A look ahead at the first character, cheaper than the look back that follows it."""
    if _DIGIT_START.match(pattern):
        return "(?=(?-iu:[0-9]))"
    one_class = _CLASS_START.match(pattern)
    if one_class:
        return f"(?={java_class(one_class[2], not one_class[1])})"
    letters = _GROUPED_START.match(pattern)
    if letters:
        firsts = [w[1] for w in alternatives(pattern[5:_closing(pattern, 2)])]
        return f"(?={java_class(''.join(firsts), True)})"
    one_group = _CLASS_GROUP.match(pattern)
    if one_group and re.match(r"\{[1-9]", pattern[_closing(pattern, 2) + 1:]) and len(alternatives(pattern[5:_closing(pattern, 2)])) == 1:
        return f"(?={java_class(one_group[1], True)})"
    if _LETTER_START.match(pattern):
        return f"(?={java_class(pattern[2], True)})"
    run = _RUN_START.match(pattern)
    if run and "@" not in run[1]:
        # The run ends where the sign is, so giving characters back cannot help; it begins at the edge of a word.
        signs = re.sub(r"A-Z|a-z|0-9|_", "", run[1])
        edge = f"(?:(?<![A-Za-z0-9])|(?=[{signs}]))" if signs else "(?<![A-Za-z0-9])"
        return f"{edge}(?={java_class(run[1], True)}{run[2]}+@)"
    back = _LOOK_BACK.match(pattern)
    if back:
        return f"(?={back[1] or java_class(back[2], True)})"
    if pattern.startswith(r"(?:\+"):
        firsts = {re.match(r"\\\+|[0-9]", a)[0] for a in alternatives(pattern[3:_closing(pattern, 0)])}
        return f"(?=[{''.join(sorted(firsts))}])"
    return ""


def _bare(test: str) -> str:
    """A test that stands before the flags needs none to switch them off."""
    return re.sub(r"\(\?-iu:(\[[^\]]+\])\)", r"\1", test)


@functools.cache
def java_regex(pattern: str, any_case: bool = True) -> str:
    """Rewrite the character classes of ``pattern``; the structure stays as it is.  Before the flags of a pattern that
    scans stand tests of the first character, which most places of a text fail."""
    out, i, ignore_case = [], 0, [any_case]
    before = ""
    if any_case and VALUE not in pattern:
        before = _bare(_first_character(pattern))
        if _SIMPLE_START.match(pattern):
            before, i = before + _bare(NOT_AFTER_WORD), 2
    while i < len(pattern):
        c = pattern[i]
        pair = pattern[i:i + 2]
        if c == "[":
            end = i + 1
            while pattern[end] != "]":
                end += 2 if pattern[end] == "\\" else 1
            out.append(java_class(pattern[i + 1:end], ignore_case[-1]))
            i = end + 1
        elif pair == r"\b":
            out.append(EDGE if i or not _SIMPLE_START.match(pattern) else NOT_AFTER_WORD)
            i += 2
        elif c == "\\":
            classes = {r"\s": rf"(?-iu:[{SPACE}])", r"\d": r"(?-iu:\p{Nd})"}
            out.append(classes.get(pair, pair))
            i += 2
        else:
            if c == "(":
                ignore_case.append(ignore_case[-1] and not pattern.startswith("(?-i:", i))
            elif c == ")":
                ignore_case.pop()
            out.append(c)
            i += 1
    return before + ("(?iu)" if any_case else "") + "".join(out).replace(VALUE, "(?<v>")


@functools.cache
def marking(pattern: str, open_mark: str, close_mark: str) -> tuple[str, str]:
    """A (regex, replacement) pair that puts marks around the entity of every match.

    The text before a named group is kept as group 1, the entity is group 2; nothing but
    zero-width tests may follow the named group and patterns hold no other numbered group.
    """
    regex = java_regex(with_grouped_words(pattern))
    head, named, tail = regex.partition("(?<v>")
    if not named:
        return regex, f"{open_mark}$0{close_mark}"
    flags, body = head[:5], head[5:]
    return f"{flags}({body})({tail}", f"$1{open_mark}$2{close_mark}"


@functools.cache
def label_starts(patterns: tuple[str, ...]) -> str:
    """A zero-width regex for every place of lower-case text where a label of one of the patterns begins; its group 1
    holds the next two characters, its group 2 up to LETTERS - 2 more.  The first two characters are tested before all labels."""
    labels = {label.lower() for pattern in patterns for label in label_head(pattern)[0]}
    every = grouped(sorted(labels, key=lambda x: (-len(x), x)))
    return java_regex(rf"{_first_two(labels)}(?=(?:{every}))", any_case=False) + rf"(?=((?s:..))((?s:.{{0,{LETTERS - 2}}})))"


def _heads(label: str) -> list[str]:
    """The letters that a label begins with, up to LETTERS of them, one string per choice of its classes."""
    found, i = [""], 0
    while i < len(label) and len(found[0]) < LETTERS:
        end = label.index("]", i) + 1 if label[i] == "[" else i + 1
        letters = label[i + 1:end - 1] if label[i] == "[" else label[i]
        if not letters.isalpha() or label[end:end + 1] in ("?", "*", "+", "{"):
            break
        found, i = [head + letter.lower() for head in found for letter in letters], end
    return found


def _first_two(labels: set[str]) -> str:
    """A look ahead that most places fail: first letters of labels, and second ones after those where these are known."""
    heads = [head for label in labels for head in _heads(label)]
    if not all(heads):
        return ""
    loose = {head for head in heads if len(head) == 1}
    known = {head[:2] for head in heads if head[0] not in loose}
    tests = [f"[{''.join(sorted(letters))}]" for letters in ({pair[0] for pair in known}, {pair[1] for pair in known})]
    tests = ["".join(tests)] * bool(known) + [f"[{''.join(sorted(loose))}]"] * bool(loose)
    return f"(?={'|'.join(tests)})"


@functools.cache
def beginnings(pattern: str) -> dict[int, list[str]]:
    """With which letters a label of the pattern begins, by their number; LETTERS at most."""
    by_width: dict[int, set[str]] = {}
    for label in label_head(pattern)[0]:
        for head in _heads(label):
            by_width.setdefault(len(head), set()).add(head)
    return {width: sorted(heads) for width, heads in sorted(by_width.items())}


@functools.cache
def first_letters(pattern: str) -> tuple[list[str], list[str]]:
    """With which two letters a label of the pattern begins, and with which single letter if the second varies."""
    two, one = set(), set()
    for label in label_head(pattern)[0]:
        plain = _PLAIN_LETTER.match(label[1:]) and _PLAIN_LETTER.match(label)
        (two if plain else one).add(label[: 2 if plain else 1].lower())
    return sorted(two), sorted(one)


@functools.cache
def anchored(pattern: str) -> str:
    """The pattern of a label and a value, at the start of its text only; groups 1 and 2 are what stands before the
    value and the value."""
    find, _ = marking(pattern, "", "")
    return f"{find[:5]}^{find[5:]}"
