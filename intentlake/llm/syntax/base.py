"""Lexing to kinds and the frame of the recursive-descent parsers.

A text is lexed to a string with one character per token, its kind: two
statements with the same kinds are parsed alike, whatever their names and
values. Parsers work on that string, and remember the kinds of statements that
a rule has accepted as a whole, so that it descends into each shape once.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass
from itertools import accumulate

BRACKET = re.compile(r"[()\[\]{}]")
#: Calls that a rule may nest for each token. Calls between Python functions take heap, not stack, so the bound only has to be high enough.
CALLS = 40
NAME, NUMBER, STRING, ERROR, END, LINE = "a", "0", '"', "\x00", "\x03", "\n"
#: Shapes remembered by one parser, and kinds of words by one lexer; beyond, the memory starts afresh.
MEMORY = 200_000


class Failure(Exception):
    """A syntax error at a token."""

    def __init__(self, at: int, why: str) -> None:
        super().__init__(why)
        self.at, self.why = at, why


class Kinds(dict):
    """Kind of each token text. Names, numbers and operators are looked up, strings and comments told by how they begin."""

    def __init__(self, words: dict[str, str], number: str, quotes: str, comments: tuple[str, ...], name: str = r"[^\W\d]\w*", line_in_comment: bool = False) -> None:
        super().__init__(words)
        self.words, self.quotes, self.comments, self.line_in_comment = words, quotes, comments, line_in_comment
        self.number, self.name = re.compile(number), re.compile(name)

    def __missing__(self, token: str) -> str:
        if self.comments and token.startswith(self.comments):
            return LINE if self.line_in_comment and "\n" in token else ""
        first = token[0]
        if first in self.quotes and len(token) > 1:
            return STRING
        if first.isdigit() or first == "." and len(token) > 1 and token[1].isdigit():
            kind = NUMBER if self.number.fullmatch(token) else ERROR
        elif self.name.fullmatch(token):
            kind = NAME
        elif len(token) > 1 and token[-1] in self.quotes:
            return STRING
        else:
            return ERROR
        if len(self) > MEMORY:
            self.clear()
            self.update(self.words)
        self[token] = kind
        return kind


class Alphabet:
    """Characters for the keywords and operators of one language; one-character operators stand for themselves."""

    def __init__(self, keywords: str, operators: str) -> None:
        self.of: dict[str, str] = {}
        for i, op in enumerate(operators.split()):
            self.of[op] = op if len(op) == 1 else chr(0xE000 + i)
        for i, word in enumerate(keywords.split()):
            self.of[word] = chr(0xE200 + i)

    def __call__(self, *texts: str) -> str:
        return "".join(self.of[t] for text in texts for t in text.split())


@dataclass(frozen=True)
class SyntaxIssue:
    token: int
    why: str


class Parser:
    """Frame: tokens, expectations, precedence climbing, panic-mode recovery.

    A language gives its binary operators (kind to precedence), right-binding
    ones, prefix operators, and methods for operands and statements.
    """

    binary: dict[str, int] = {}
    right: frozenset[str] = frozenset()
    prefix: frozenset[str] = frozenset()
    #: Whether line ends are tokens.
    line_ends = False
    #: A simple statement: up to the next semicolon, without braces; longer ones are read anew each time.
    simple = re.compile(r"[^;{}]{0,400};")

    def __init__(self) -> None:
        self.known: set = set()

    def start(self, kinds: str) -> None:
        self.k = kinds + END * 4
        self.i = 0
        self.issues: list[SyntaxIssue] = []
        self.closers: dict[int, int] | None = None

    # tokens

    def fail(self, why: str) -> None:
        raise Failure(self.i, why)

    def eat(self, kind: str) -> bool:
        if self.k[self.i] == kind:
            self.i += 1
            return True
        return False

    def need(self, kind: str, what: str) -> None:
        if self.k[self.i] != kind:
            self.fail(f"expected {what}")
        self.i += 1

    def closing(self, at: int) -> int:
        """Place of the bracket that closes the one at `at`, or -1; all brackets are paired once."""
        if self.closers is None:
            self.closers = {}
            held: list[int] = []
            for m in BRACKET.finditer(self.k):
                if m[0] in "([{":
                    held.append(m.start())
                elif held:
                    self.closers[held.pop()] = m.start()
        return self.closers.get(at, -1)

    def tree(self) -> None:
        """Skip one bracketed group, its brackets paired."""
        pairs = {"(": ")", "[": "]", "{": "}"}
        stack = []
        while True:
            c = self.k[self.i]
            if c in pairs:
                stack.append(pairs[c])
            elif c in ")]}":
                if not stack or stack.pop() != c:
                    self.fail("unpaired bracket")
            elif c == END or c == ERROR:
                self.fail("bracket never closed")
            self.i += 1
            if not stack:
                return

    def attempt(self, rule) -> bool:
        """Parse by `rule`; on failure stay where we were."""
        at = self.i
        try:
            rule()
            return True
        except Failure:
            self.i = at
            return False

    # expressions

    def expression(self, least: int = 0) -> None:
        """Precedence climbing: an operand, then operators that bind at least as strongly as `least`."""
        self.unary()
        self.operators(least)

    def operators(self, least: int) -> None:
        while True:
            op = self.k[self.i]
            precedence = self.binary.get(op)
            if precedence is None or precedence < least:
                return
            self.i += 1
            self.after_operator(op)
            self.expression(precedence if op in self.right else precedence + 1)

    def after_operator(self, op: str) -> None:
        """For operators of several tokens."""

    def unary(self) -> None:
        while self.k[self.i] in self.prefix:
            self.i += 1
        self.operand()

    def operand(self) -> None:
        raise NotImplementedError

    def comma_list(self, rule, close: str, what: str, trailing: bool = True) -> None:
        """Items up to the closing bracket, which is taken too."""
        while not self.eat(close):
            rule()
            if not self.eat(","):
                self.need(close, what)
                return
            if self.k[self.i] == close and not trailing:
                self.fail("nothing after the comma")

    # statements

    def statements(self, rule, close: str) -> None:
        """Statements up to `close` (not taken), with recovery after each error."""
        while self.k[self.i] != close:
            if self.k[self.i] == END:
                self.fail("the text ends inside a block")
            at = self.i
            quick = self.simple.match(self.k, at)
            # what stands in a function need not be valid in a class or file
            shape = (rule.__name__, quick[0]) if quick else None
            if shape in self.known:
                self.i = quick.end()
                continue
            issues = len(self.issues)
            try:
                rule()
            except Failure as e:
                self.recover(e, at)
                continue
            if quick and self.i == quick.end() and len(self.issues) == issues:
                if len(self.known) > MEMORY:
                    self.known.clear()
                self.known.add(shape)

    def recover(self, e: Failure, began: int) -> None:
        """Panic mode: note the error, skip to behind the next semicolon or before a brace on our level."""
        self.issues.append(SyntaxIssue(e.at, e.why))
        self.i = max(e.at, began)
        depth = 0
        while True:
            c = self.k[self.i]
            if c == END:
                return
            if c == "{":
                depth += 1
            elif c == "}":
                if not depth:
                    if self.i == began:
                        self.i += 1
                    return
                depth -= 1
            elif c == ";" and not depth:
                self.i += 1
                return
            self.i += 1

    def unit(self) -> None:
        raise NotImplementedError

    @staticmethod
    def deepen(kinds: str) -> None:
        """Let the rules call each other as deeply as the text may be nested."""
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000 + CALLS * len(kinds)))

    def parse(self, kinds: str) -> list[SyntaxIssue]:
        self.deepen(kinds)
        self.start(kinds)
        while True:
            at = self.i
            try:
                self.unit()
                break
            except Failure as e:
                self.recover(e, at)
                if self.k[self.i] == END:
                    break
                if self.i == at:
                    self.i += 1
        return sorted(set(self.issues), key=lambda x: (x.token, x.why))


def without_lines(kinds: str) -> tuple[str, frozenset[int]]:
    """Kinds without line ends, and the places of tokens that follow a line end."""
    parts = kinds.split(LINE)
    return "".join(parts), frozenset(accumulate(map(len, parts)))
