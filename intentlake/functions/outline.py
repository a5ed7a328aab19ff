"""Outlines of source text: a tree of statements and blocks, from brackets, keywords or indents.

Only what chunking and symbols need is read: where items begin and end, which
are comments, and which have a body. The text need not be valid.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

#: Languages whose structure is read; all others are split as plain text.
BRACES = frozenset({"rust", "javascript", "typescript", "go", "java", "c", "cpp", "php", "swift"})
STRUCTURED = BRACES | {"python", "ruby"}
#: Languages in which a line end may close a statement.
LINE_ENDED = frozenset({"javascript", "typescript", "go", "swift"})
#: Languages in which a brace after an assignment opens a value, not a body.
VALUES = frozenset({"javascript", "typescript", "c", "cpp", "java", "php", "rust"})


@dataclass(slots=True)
class Node:
    """Characters [start, end) of one item; comments and items with a body know their kind and children."""

    start: int
    end: int
    kind: str = "item"
    children: list[Node] = field(default_factory=list)


STRING = r"\"(?:[^\"\\\n]|\\(?:.|\n))*\"?|'(?:[^'\\\n]|\\.)*'?"
LEXERS = {
    "python": re.compile(r"(?P<string>(?:\"\"\"(?:[^\\]|\\.)*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\.)*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\(?:.|\n))*\"?|'(?:[^'\\\n]|\\(?:.|\n))*'?))|(?P<comment>#[^\n]*)|(?P<mark>[()\[\]{}\n])", re.DOTALL),
    "ruby": re.compile(rf"(?P<string>{STRING})|(?P<comment>#[^\n]*|^=begin\b.*?(?:^=end[^\n]*|\Z))|(?P<mark>\n)", re.DOTALL | re.MULTILINE),
    "rust": re.compile(r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>b?r(?P<h>#*)\".*?(?:\"(?P=h)|\Z)|\"(?:[^\"\\]|\\.)*\"?|'(?:[^'\\\n]|\\[^\n]+?)')|(?P<mark>[(){}\[\];\n])", re.DOTALL),
    "go": re.compile(rf"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>`[^`]*`?|{STRING})|(?P<mark>[(){{}}\[\];\n])", re.DOTALL),
    "script": re.compile(rf"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>`(?:[^`\\]|\\.)*`?|{STRING})|(?P<mark>[(){{}}\[\];\n])", re.DOTALL),
    "php": re.compile(rf"(?P<comment>//[^\n]*|\#(?!\[)[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>{STRING})|(?P<mark>[(){{}}\[\];\n])", re.DOTALL),
    "braces": re.compile(rf"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"\"\".*?(?:\"\"\"|\Z)|{STRING})|(?P<mark>[(){{}}\[\];\n]|^[ \t]*\#[^\n]*)", re.DOTALL | re.MULTILINE),
}


def lexer(language: str) -> re.Pattern:
    return LEXERS.get({"javascript": "script", "typescript": "script"}.get(language, language), LEXERS["braces"])


def masked(source: str, language: str) -> str:
    """The text with comments and the insides of strings blanked, of the same length and lines."""

    def blank(m: re.Match) -> str:
        if m.lastgroup == "mark" or m["mark"]:
            return m[0]
        return re.sub(r"[^\n]", " ", m[0])

    return lexer(language).sub(blank, source)


def outline(source: str, language: str) -> list[Node]:
    """Top-level items and comments, in order."""
    if language == "python":
        return _python(source)
    if language == "ruby":
        return _ruby(source)
    return _Braces(source, language).items()


@dataclass(slots=True)
class _Block:
    """A block that is being read: where its inside and its brace begin, its items, and the item at hand."""

    position: int
    begin: int = 0
    nodes: list[Node] = field(default_factory=list)
    start: int | None = None
    bodies: list[Node] = field(default_factory=list)
    depth: int = 0


class _Braces:
    GOES_ON = re.compile(r"\s*(?:else\b|catch\b|finally\b|while\b\s*\(|[,.)\];?=])|[ \t]*(?:[-+*%<>&|:]|/(?![/*]))")
    OPEN_LINE = re.compile(r"(?:[,({\[=+\-*/%&|<>?:.]|=>|->|&&|\|\|)\s*\Z")
    ASSIGNED = re.compile(r"(?:=|=>|\breturn|\()\s*\Z")
    INK = re.compile(r"\S")
    CONTINUES = re.compile(r"\s*(?:[.)\]}?:&|+*%=<>,]|/(?![/*])|else\b|catch\b|finally\b|\{)")

    def __init__(self, source: str, language: str) -> None:
        self.source, self.language = source, language
        self.tokens = [(m.start(), m.end(), "comment" if m["comment"] else "string" if m["string"] else m["mark"]) for m in lexer(language).finditer(source)]

    def items(self) -> list[Node]:
        """All top-level items; blocks inside of blocks are held on a stack of our own."""
        held = [_Block(0)]
        for s, e, kind in self.tokens:
            block = held[-1]
            if block.start is None:
                block.start = self._text_before(block.position, s)
            if kind == "comment" and block.start is None:
                block.nodes.append(Node(s, e, "comment"))
            elif kind.lstrip().startswith("#") and len(kind) > 1:
                if block.start is None or not block.depth:
                    self._close(block, s)
                    block.nodes.append(Node(s + len(kind) - len(kind.lstrip()), e))
            elif kind == "}":
                if len(held) > 1:
                    self._close(block, s)
                    held.pop()
                    self._take(held[-1], Node(block.begin, e, "block", block.nodes))
                    continue
                self._close(block, s)  # a brace too many
            elif kind == ";":
                if not block.depth and block.start is not None:
                    self._close(block, e)
            elif kind == "\n":
                if not block.depth and block.start is not None and self.language in LINE_ENDED:
                    if not self.OPEN_LINE.search(self.source[max(block.start, s - 80) : s]) and not self.CONTINUES.match(self.source, e):
                        self._close(block, s)
            else:
                block.start = s if block.start is None else block.start
                if kind in "([":
                    block.depth += 1
                elif kind in ")]":
                    block.depth = max(0, block.depth - 1)
                elif kind == "{":
                    held.append(_Block(e, s))
                    continue
            block.position = e
        while True:
            block, end = held.pop(), len(self.source)
            if block.start is None:
                block.start = self._text_before(block.position, end)
            self._close(block, end)
            if not held:
                return block.nodes
            self._take(held[-1], Node(block.begin, end, "block", block.nodes))

    def _take(self, block: _Block, inner: Node) -> None:
        """Put a closed block into the item around it, and close that if it doesn't go on."""
        block.position = inner.end
        if not block.depth:
            block.bodies.append(inner)
            if not self.GOES_ON.match(self.source, inner.end) and not self._value(block.start, inner.start):
                self._close(block, inner.end)

    def _text_before(self, position: int, to: int) -> int | None:
        m = self.INK.search(self.source, position, to)
        return m.start() if m else None

    def _close(self, block: _Block, end: int) -> None:
        if block.start is not None:
            start, bodies = block.start, block.bodies
            end = start + len(self.source[start:end].rstrip())
            if end > start:
                children = []
                if bodies:
                    head = self.source[start : bodies[0].start].rstrip()
                    if head:
                        children.append(Node(start, start + len(head), "head"))
                    children += bodies
                block.nodes.append(Node(start, end, "item", children))
        block.start, block.bodies = None, []

    def _value(self, start: int, brace: int) -> bool:
        """Whether the brace opens a value, after which the statement goes on to its semicolon or line end."""
        return self.language in VALUES and bool(self.ASSIGNED.search(self.source[max(start, brace - 80) : brace]))


def _python(source: str) -> list[Node]:
    """Statements by logical lines and indents; a header's block is its body."""
    lines: list[tuple[int, int, int, str]] = []  # indent, start, end, kind
    depth, begin, seen = 0, 0, None

    def end_line(at: int) -> None:
        nonlocal seen
        if seen is not None:
            start, kind = seen
            end = start + len(source[start:at].rstrip())
            indent = len(source[source.rfind("\n", 0, start) + 1 : start].expandtabs(8))
            lines.append((indent, start, end, kind))
        seen = None

    position = 0
    for m in lexer("python").finditer(source):
        if seen is None:
            gap = source[position : m.start()]
            bare = gap.lstrip(" \t\r\f\\\n")
            if bare:
                seen = (m.start() - len(bare), "item")
        mark = m["mark"]
        if m["comment"]:
            seen = seen or (m.start(), "comment")
        elif m["string"]:
            seen = seen or (m.start(), "item")
        elif mark == "\n":
            if not depth and not source.endswith("\\", 0, m.start()):
                end_line(m.start())
        else:
            seen = seen or (m.start(), "item")
            depth = depth + 1 if mark in "([{" else max(0, depth - 1)
        position = m.end()
    if seen is None and source[position:].strip():
        gap = source[position:]
        seen = (position + len(gap) - len(gap.lstrip()), "item")
    end_line(len(source))
    return _nest(lines, lambda start, end: source[start:end].rstrip().endswith(":"))


CLAUSE = ("elif", "else", "except", "finally")


def _nest(lines: list[tuple[int, int, int, str]], opens) -> list[Node]:
    root: list[Node] = []
    stack: list[tuple[int, list[Node]]] = [(-1, root)]
    for indent, start, end, kind in lines:
        while len(stack) > 1 and indent <= stack[-1][0]:
            stack.pop()
        into = stack[-1][1]
        node = Node(start, end, kind)
        into.append(node)
        if kind == "item" and opens(start, end):
            body = Node(end, end, "block")
            node.children = [Node(start, end, "head"), body]
            stack.append((indent, body.children))
    _stretch(root)
    return root


def _stretch(root: list[Node]) -> None:
    """A parent reaches to the end of its last child; children are done before their parents."""
    order = list(root)
    for node in order:  # grows while it is read
        order.extend(node.children)
    for node in reversed(order):
        if node.kind == "block" and node.children:
            node.start = node.children[0].start
        node.end = max([node.end, *(child.end for child in node.children)])


RUBY_OPEN = re.compile(r"^\s*(?:class|module|def|if|unless|while|until|for|case|begin)\b|\bdo\b\s*(?:\|[^|]*\|)?\s*$|=\s*(?:if|case|begin|unless)\b")
RUBY_INLINE = re.compile(r"\bend\b[\s.)]*$|^\s*def\s+[^=]*\)\s*=\s|^\s*def\s+\w+[?!]?\s*=\s")


def _ruby(source: str) -> list[Node]:
    """Statements by lines; what a keyword opens lasts to its end."""
    mask = masked(source, "ruby")
    begins = [0, *(m.end() for m in re.finditer("\n", source))]
    comments = set()
    for m in lexer("ruby").finditer(source):
        line = bisect_right(begins, m.start()) - 1 if m["comment"] else -1
        if line >= 0 and not mask[begins[line] : m.start()].strip():
            comments.add(line)
    root: list[Node] = []
    stack: list[tuple[Node | None, list[Node]]] = [(None, root)]
    offset = 0
    for number, (raw, line) in enumerate(zip(source.split("\n"), mask.split("\n"), strict=True)):
        start, end = offset + len(raw) - len(raw.lstrip()), offset + len(raw.rstrip())
        offset += len(raw) + 1
        if start >= end:
            continue
        into = stack[-1][1]
        if number in comments:
            into.append(Node(start, end, "comment"))
        elif re.match(r"\s*end\b", line) and len(stack) > 1:
            node = stack.pop()[0]
            node.end = end
        elif RUBY_OPEN.search(line) and not RUBY_INLINE.search(line):
            body = Node(end, end, "block")
            node = Node(start, end, "item", [Node(start, end, "head"), body])
            into.append(node)
            stack.append((node, body.children))
        else:
            into.append(Node(start, end))
    _stretch(root)
    return root
