"""JSON and TOML."""

from __future__ import annotations

import re

from intentlake.llm.syntax.base import END, ERROR, LINE, NAME, NUMBER, STRING, Kinds, Parser, SyntaxIssue

JSON_STRING = r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[\da-fA-F]{4}))*"'
PUNCTUATION = {c: c for c in "{}[]:,=."}


class JsonKinds(Kinds):
    def __missing__(self, token: str) -> str:
        if token[0] == "-" and len(token) > 1:
            return NUMBER if self.number.fullmatch(token) else ERROR
        kind = super().__missing__(token)
        return ERROR if kind == NAME else kind


class JsonParser(Parser):
    pattern = re.compile(rf"[ \t\r\n]*({JSON_STRING}|[{{}}\[\]:,]|-?\d(?:[eE][+-]|[\w.])*|[A-Za-z]+|\S)", re.DOTALL)
    kinds = JsonKinds(PUNCTUATION | {"true": NUMBER, "false": NUMBER, "null": NUMBER}, r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?", '"', ())
    #: Flat lists and objects are remembered whole.
    flat = re.compile(r"[^][}{]*[]}]")

    def unit(self) -> None:
        self.value()
        if self.k[self.i] != END:
            self.fail("expected the end of the text")

    def value(self) -> None:
        """One value; the brackets that are open lie on a stack of our own."""
        held: list[tuple[str, re.Match | None]] = []
        while True:
            c = self.k[self.i]
            if c in (STRING, NUMBER):
                self.i += 1
            elif c in "[{":
                quick = self.flat.match(self.k, self.i + 1)
                if quick and c + quick[0] in self.known:
                    self.i = quick.end()
                else:
                    self.i += 1
                    if not self.eat("]" if c == "[" else "}"):
                        held.append((c, quick))
                        self.key(c)
                        continue
            else:
                self.fail("expected a value")
            while held:  # behind a value
                c, quick = held[-1]
                if self.eat(","):
                    self.key(c)
                    break
                self.need("]" if c == "[" else "}", "a closing bracket")
                if quick and self.i == quick.end() and len(quick[0]) < 10_000:
                    self.known.add(c + quick[0])
                held.pop()
            else:
                return

    def key(self, bracket: str) -> None:
        if bracket == "{":
            self.need(STRING, "a key")
            self.need(":", ":")


TOML_VALUE = (
    r"[+-]?(?:inf|nan)|true|false|0x[\da-fA-F]+(?:_[\da-fA-F]+)*|0o[0-7]+(?:_[0-7]+)*|0b[01]+(?:_[01]+)*"
    r"|\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d:\d\d(?:\.\d+)?"
    r"|[+-]?(?:0|[1-9]\d*(?:_\d+)*)(?:\.\d+(?:_\d+)*)?(?:[eE][+-]?\d+(?:_\d+)*)?"
)
BARE = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*")
VALUE = re.compile(TOML_VALUE)


class TomlKinds(Kinds):
    """Bare words are names, told from values only where they stand."""

    def __missing__(self, token: str) -> str:
        if token[0] == "#":
            return ""
        if token[0] in "\"'":
            return STRING if len(token) > 1 and token[-1] == token[0] else ERROR
        key, value = bool(BARE.fullmatch(token)), bool(VALUE.fullmatch(token))
        kind = "k" if key and value else NAME if key else NUMBER if value else ERROR
        if len(self) > 100_000:
            self.clear()
            self.update(self.words)
        self[token] = kind
        return kind


class TomlParser(Parser):
    """Kinds: a a key only, 0 a value only, k either, strings either, line ends kept."""

    pattern = re.compile(
        r'[ \t\r]*("""(?:[^\\]|\\.)*?"""|\'\'\'.*?\'\'\'|"(?:[^"\\\n]|\\.)*"|\'[^\'\n]*\'|\#[^\n]*|\n\s*|[\[\]{}=,]|\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d[\d:.Zz+-]*)?|[^\s\[\]{}=,#"\']+|\S)', re.DOTALL
    )
    kinds = TomlKinds(PUNCTUATION | {"\n": LINE}, r"\d", '"', ("#",))

    line_ends = True

    def start(self, kinds: str) -> None:
        super().start(kinds + LINE)
        self.depth = 0

    def blank(self) -> None:
        while self.eat(LINE):
            pass

    def unit(self) -> None:
        self.blank()
        while self.k[self.i] != END:
            if self.eat("["):
                double = self.eat("[")
                self.key()
                self.need("]", "]")
                if double:
                    self.need("]", "]")
            else:
                self.key()
                self.need("=", "=")
                self.value()
            self.need(LINE, "the end of the line")
            self.blank()

    def recover(self, e, began: int) -> None:
        super().recover(e, began)
        while self.k[self.i] not in LINE + END:
            self.i += 1

    def key(self) -> None:
        while True:
            if self.k[self.i] not in (NAME, STRING, "k"):
                self.fail("expected a key")
            self.i += 1
            if self.k[self.i] not in (".", STRING, NAME) or self.k[self.i] == "=":
                return
            self.eat(".")

    def value(self) -> None:
        c = self.k[self.i]
        if c in (STRING, NUMBER, "k"):
            self.i += 1
        elif c == "[":
            self.i += 1
            self.blank()
            while not self.eat("]"):
                self.value()
                self.blank()
                if not self.eat(","):
                    self.need("]", "]")
                    return
                self.blank()
        elif c == "{":
            self.i += 1
            if self.eat("}"):
                return
            while True:
                self.key()
                self.need("=", "=")
                self.value()
                if not self.eat(","):
                    break
            self.need("}", "}")
        else:
            self.fail("expected a value")


def repeated_keys(tokens: list[str]) -> list[SyntaxIssue]:
    """Keys and tables that a TOML text, valid otherwise, defines twice."""
    issues: list[SyntaxIssue] = []
    seen: dict[tuple[str, ...], str] = {}
    current: tuple[str, ...] = ()
    line: list[str] = []
    depth = first = place = 0

    def path(parts: list[str]) -> tuple[str, ...]:
        names: list[str] = []
        for t in parts:
            names += [t[1:-1]] if t[0] in "\"'" else [x for x in t.split(".") if x]
        return tuple(names)

    def define(names: tuple[str, ...], kind: str, begin: int) -> None:
        """`kind` is value, table or array; what leads there becomes a table without a header of its own."""
        for i in range(begin, len(names)):
            if seen.setdefault(names[:i], "open") == "value":
                issues.append(SyntaxIssue(first, "a value is no table"))
                return
        held = seen.get(names)
        if held and (held, kind) not in {("open", "table"), ("array", "array")}:
            issues.append(SyntaxIssue(first, "defined twice"))
        seen[names] = kind

    for t in [*tokens, "\n"]:
        place += t[0] != "#" and t[0] != "\n"
        if t[0] == "#":
            continue
        if t[0] != "\n" or depth:
            if not line:
                first = place - 1
            depth += (t in "[{") - (t in "]}") if len(t) == 1 else 0
            line.append(t)
            continue
        if line and line[0] == "[":
            double = len(line) > 1 and line[1] == "["
            current = path([x for x in line if x not in "[]"])
            if double:
                for names in [n for n in seen if len(n) > len(current) and n[: len(current)] == current]:
                    del seen[names]
            define(current, "array" if double else "table", 1)
        elif line:
            define(current + path(line[: line.index("=")]), "value", len(current) + 1)
        line = []
    return issues
