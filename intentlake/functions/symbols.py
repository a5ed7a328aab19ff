"""Names that source text defines, with their kind and line.

A rule is a pattern for how a definition begins, and where that isn't enough a
test of what follows: the bracket that closes, an arrow, a body. Patterns end at
their line and brackets are paired once for the whole text, so that the time
grows with the text, whatever it holds.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable

from intentlake.functions.outline import STRUCTURED, masked

NAME = r"[^\W\d]\w*"


class Scan:
    """A text without comments and strings, with its brackets paired and its signs listed."""

    def __init__(self, mask: str) -> None:
        self.mask = mask
        self.starts = [0, *(m.end() for m in re.finditer("\n", mask))]
        self.close: dict[int, int] = {}
        self.marks: dict[str, list[int]] = {}
        held: list[int] = []
        for m in re.finditer(r"[()\[\]{}]", mask):
            at, c = m.start(), m[0]
            if c in "([{":
                held.append(at)
            elif held and mask[held[-1]] + c in ("()", "[]", "{}"):
                self.close[held.pop()] = at

    def after(self, signs: str, at: int) -> int:
        """Place of the first of `signs` at or behind `at`, or the end."""
        if signs not in self.marks:
            self.marks[signs] = [m.start() for m in re.finditer(f"[{re.escape(signs)}]", self.mask)]
        places = self.marks[signs]
        k = bisect_left(places, at)
        return places[k] if k < len(places) else len(self.mask)


Test = Callable[[Scan, re.Match], bool]
ARROW = re.compile(r"\s*(?::[^=\n{]+)?=>")
FUNCTION_VALUE = re.compile(rf"(?:async\b\s*)?(?:function\b|(?:{NAME}\s*)=>|(?=\())")
NOT_NAMES = frozenset("if for while switch return sizeof catch else do case new throw defined function with constructor".split())
NO_DECLARATION = re.compile(r"\s*(?:return|else|typedef|goto|case|new|throw|delete|await|yield|in|of)\b")


def function_value(scan: Scan, m: re.Match) -> bool:
    """A function or arrow follows."""
    value = FUNCTION_VALUE.match(scan.mask, m.end())
    if not value:
        return False
    if not scan.mask.startswith("(", value.end()):
        return True
    close = scan.close.get(value.end())
    return close is not None and bool(ARROW.match(scan.mask, close + 1))


def no_function_value(scan: Scan, m: re.Match) -> bool:
    return not function_value(scan, m)


def followed(tail: str, within: str = "") -> Test:
    """The bracket that the match ends with is closed, has none of `within` inside, and `tail` follows."""
    pattern = re.compile(tail, re.MULTILINE)

    def test(scan: Scan, m: re.Match) -> bool:
        if m[1] in NOT_NAMES or NO_DECLARATION.match(m[0]):
            return False
        close = scan.close.get(m.end() - 1)
        return close is not None and not (within and scan.after(within, m.end()) < close) and bool(pattern.match(scan.mask, close + 1))

    return test


def assigned(scan: Scan, m: re.Match) -> bool:
    """An equals sign follows before the item ends."""
    at = scan.after("=;{", m.end())
    return scan.mask.startswith("=", at)


LAST_NAME = re.compile(rf"({NAME})\s*\Z")


def named_type(scan: Scan, m: re.Match) -> tuple[str, int] | None:
    """The name before the semicolon that ends a typedef, its body skipped."""
    at = scan.after(";{", m.end())
    while scan.mask.startswith("{", at) and at in scan.close:
        at = scan.after(";{", scan.close[at])
    low = max(m.end(), at - 200)
    name = LAST_NAME.search(scan.mask[low:at]) if scan.mask.startswith(";", at) else None
    return (name[1], low + name.start(1)) if name else None


def _compiled(*rules: tuple) -> list[tuple[re.Pattern, str, Test | None]]:
    return [(re.compile(r[0], re.MULTILINE), r[1], r[2] if len(r) > 2 else None) for r in rules]


_MODIFIERS = r"(?:(?:public|private|protected|static|readonly|override|async|get|set|abstract|final|synchronized|native|default|strictfp)[ \t]+)*"
_JS = (
    (rf"\bclass\s+(?!extends\b)({NAME})", "class"),
    (rf"\bfunction\b\s*(?:\*\s*)?({NAME})\s*[(<]", "function"),
    (rf"\b(?:const|let|var)\s+({NAME})[ \t]*(?::[^=\n]+)?=(?!=)\s*", "function", function_value),
    (rf"(?:^|[;{{}}\s])(?:{NAME}\.)*({NAME})[ \t]*=(?!=)\s*", "function", function_value),
    (rf"[{{,]\s*({NAME})[ \t]*:\s*", "function", function_value),
    (rf"^[ \t]+{_MODIFIERS}[*#]{{0,2}}({NAME})[ \t]*(?:<[^>\n]*>)?\(", "method", followed(r"\s*(?::[^{;\n]+)?\{")),
    (rf"^[ \t]*(?:module\.)?exports\.({NAME})[ \t]*=(?!=)\s*", "constant", no_function_value),
)
_C = (
    (rf"\b(?:struct|union)\s+({NAME})\s*\{{", "class"),
    (rf"\bunion\s+({NAME})[ \t]+\w", "class"),
    (rf"^[\w:<>,*&~ \t]*[ \t*&]({NAME})[ \t]*\(", "function", followed(r"\s*(?:const\s*)?(?:;|\{|$)", ";{}")),
    (r"\btypedef\b", "type", named_type),
    (rf"\benum\s+(?:class\s+)?({NAME})", "type"),
)
RULES: dict[str, list[tuple[re.Pattern, str, Test | None]]] = {
    "rust": _compiled(
        (rf"\b(?:struct|enum)\s+({NAME})", "class"),
        (rf"\bunion\s+({NAME})\s*[{{<]", "class"),
        (rf"\btype\s+({NAME})", "class", assigned),
        (rf"\bfn\s+({NAME})", "function"),
        (rf"\btrait\s+({NAME})", "interface"),
        (rf"\bmod\s+({NAME})", "module"),
        (rf"\bmacro_rules!\s*({NAME})", "macro"),
    ),
    "python": _compiled((rf"^({NAME})[ \t]*(?::[^=\n]+)?=(?!=)", "constant"), (rf"\bclass\s+({NAME})\s*[(:\[]", "class"), (rf"\bdef\s+({NAME})\s*[(\[]", "function")),
    "javascript": _compiled(*_JS),
    "typescript": _compiled(
        *_JS,
        (rf"\bfunction\s+({NAME})[^{{;\n]*;", "function"),
        (rf"^[ \t]+{_MODIFIERS}({NAME})\??[ \t]*(?:<[^>\n]*>)?\(", "method", followed(r"[ \t]*:\s*[^{;\n=]+;")),
        (rf"\babstract[ \t]+(?!class\b)(?:\w+[ \t]+){{0,5}}?({NAME})[ \t]*\(", "method"),
        (rf"\b(?:module|namespace)\s+({NAME})\s*[{{.]", "module"),
        (rf"\binterface\s+({NAME})", "interface"),
    ),
    "go": _compiled((rf"^func\s+({NAME})\s*[(\[]", "function"), (rf"^func\s*\([^)\n]*\)\s*({NAME})\s*\(", "method"), (rf"^[ \t]*type\s+({NAME})\s", "type"), (rf"^\t({NAME})\s+(?:struct|interface)\s*\{{", "type")),
    "java": _compiled(
        (rf"\bclass\s+({NAME})", "class"),
        (rf"\binterface\s+({NAME})", "interface"),
        (rf"^[ \t]*(?:@[\w.]+(?:\([^()\n]*\))?[ \t]*)*(?:[\w.<>\[\],?&]+[ \t]*)?[\w.<>\[\],?& \t]*[ \t>\]]({NAME})[ \t]*\(", "method", followed(r"\s*(?:throws\s+[\w., ]+)?\s*[;{]", ";{}")),
    ),
    "c": _compiled(*_C),
    "cpp": _compiled(*_C, (rf"\bclass\s+({NAME})\s*(?:final\s*)?[:{{]", "class"), (rf"(?<![\w:])(?:{NAME}::)+(~?{NAME})\s*\(", "method")),
    "ruby": _compiled(
        (rf"\bdef\s+(?:self\.|{NAME}\.)?({NAME}[?!=]?)", "method"),
        (rf"^[ \t]*alias\s+:?({NAME}[?!=]?)", "method"),
        (rf"^[ \t]*class\s+(?:{NAME}::)*({NAME})", "class"),
        (rf"^[ \t]*class\s*<<\s*({NAME})", "class"),
        (rf"^[ \t]*module\s+(?:{NAME}::)*({NAME})", "module"),
    ),
    "php": _compiled(
        (r"\bnamespace\s+([\w\\]+)", "module"),
        (rf"\b(?:interface|trait)\s+({NAME})", "interface"),
        (rf"^[ \t]*(?:(?:abstract|final|readonly)\s+)*class\s+({NAME})", "class"),
        (rf"\b(?:public|protected|private|var|static)\s+(?:readonly\s+)?(?:\??[\w\\|]+\s+)?\$({NAME})", "field"),
        (rf"\bfunction\s+(?:&\s*)?({NAME})\s*\(", "function"),
    ),
    "swift": _compiled(
        (rf"\b(?:class|struct|enum|extension|actor)\s+(?!func\b|var\b)({NAME})", "class"),
        (rf"\bprotocol\s+({NAME})", "interface"),
        (rf"\bfunc\s+({NAME})", "function"),
        (rf"^[ \t]*(?:[\w@()]+[ \t]+)*(?:let|var)[ \t]+({NAME})", "property"),
    ),
}
#: Languages in which functions inside of these count as methods.
OWNERS = {"rust": re.compile(r"^[ \t]*(?:unsafe[ \t]+)?(?:pub(?:\([^)\n]*\))?[ \t]+)?(?:impl|trait)\b", re.MULTILINE), "swift": re.compile(r"\b(?:class|struct|enum|extension|protocol|actor)\s+\w")}


def extract_symbols(source: str | None, language: str | None) -> list[tuple[str, str, int]]:
    """(name, kind, line) of the definitions, in order; none for a language without rules, or a null source."""
    rules = RULES.get(language or "")
    if not rules or not source:
        return []
    scan = Scan(masked(source, language))
    inside = _owned(scan, OWNERS[language]) if language in OWNERS else lambda at: False
    found: dict[int, tuple[str, str]] = {}
    for pattern, kind, test in rules:
        for m in pattern.finditer(scan.mask):
            if test is named_type:
                named = named_type(scan, m)
                if named:
                    found.setdefault(named[1], (named[0], kind))
                continue
            if test and not test(scan, m):
                continue
            if kind == "property" and not inside(m.start(1)):
                continue
            found.setdefault(m.start(1), (m[1], "method" if kind == "function" and inside(m.start(1)) else kind))
    return [(name, kind, bisect_right(scan.starts, at)) for at, (name, kind) in sorted(found.items())]


def _owned(scan: Scan, opener: re.Pattern) -> Callable[[int], bool]:
    """Whether a place lies between the braces of a block that owns methods; blocks inside of one add nothing."""
    begins, ends = [], []
    for m in opener.finditer(scan.mask):
        at = scan.after(";{", m.end())
        if not scan.mask.startswith("{", at):
            continue
        end = scan.close.get(at, len(scan.mask))
        if not ends or at >= ends[-1]:
            begins.append(at)
            ends.append(end)

    def inside(at: int) -> bool:
        k = bisect_right(begins, at) - 1
        return k >= 0 and at < ends[k]

    return inside


assert set(RULES) == STRUCTURED
