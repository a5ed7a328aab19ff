"""Python: logical lines by precedence climbing, blocks by their indents."""

from __future__ import annotations

import re

from intentlake.llm.syntax.base import END, MEMORY, NAME, NUMBER, STRING, Alphabet, Failure, Kinds, Parser, SyntaxIssue
from intentlake.llm.syntax.cfamily import binary_levels

P = Alphabet(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "( ) { } [ ] ; , . : = + - * / % < > & | ^ ~ @ == != <= >= ** // << >> -> := ... += -= *= /= //= %= @= &= |= ^= >>= <<= **=",
)

#: Strings with fields in which the same quotes stand again.
NESTED = "|".join(rf"(?:[fF][rR]?|[rR][fF]){q}(?:[^{q}\\\n{{]|\\.|\{{\{{|\{{(?:[^{{}}{q}\n]|{q}[^{q}\n]*{q}|\{{[^{{}}\n]*\}})*\}})*{q}(?!{q})" for q in "'\"")
NO_TARGET = frozenset(P("not lambda True False None if else await yield for := { + - ~"))
#: Kinds of names that are keywords where a line begins with them.
SOFT = {"match": "\ue3f0", "case": "\ue3f1"}


class PythonParser(Parser):
    pattern = re.compile(
        rf"[ \t\f\r]*({NESTED}|(?:[rR][bBfF]?|[bBfF][rR]?|[uU])?(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\(?:\r\n|.))*\"|'(?:[^'\\\n]|\\(?:\r\n|.))*')|[^\W\d]\w*|\n[ \t\f]*|\.\.\.|\.?\d(?:[eE][+-]\d|(?!(?:if|else|and|or|in|is|not|for)\b)\w|\.(?!\.))*|[(){{}};,\[\].]|\#[^\n]*|\\\r?\n|\*\*=|//=|<<=|>>=|\*\*|//|->|:=|<<|>>|[=!<>+\-*/%&|^@]=|\S)",
        re.DOTALL,
    )
    kinds = Kinds(
        P.of | {"...": NUMBER},
        r"0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:0(?:_?0)*|[1-9](?:_?\d)*)|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d+)?[jJ]?|\d(?:_?\d)*\.(?:[eE][+-]?\d+)?[jJ]?|\d(?:_?\d)*[eE][+-]?\d+[jJ]?|\d(?:_?\d)*[jJ])",
        "\"'",
        ("#", "\\\n", "\\\r\n"),
    )
    augmented = frozenset(P("+= -= *= /= //= %= @= &= |= ^= >>= <<= **="))
    binary = binary_levels(P, "or", "and", "not", "in is == != < > <= >=", "|", "^", "&", "<< >>", "+ -", "* / // % @") | {P.of["**"]: 12}
    right = frozenset(P("**"))

    def __init__(self) -> None:
        super().__init__()
        self.lines: dict[str, str] = {}

    # blocks

    def parse_tokens(self, tokens: list[str]) -> list[SyntaxIssue]:
        """Issues of the token texts; the place is that of the first token of the logical line."""
        kinds, logical, current, depth, indent, first = self.kinds, [], [], 0, "", 0
        for at, t in enumerate(tokens):
            if t[0] == "\n":
                if not depth:
                    if current:
                        logical.append((indent, "".join(current), first))
                        current = []
                    indent = t[1:]
                continue
            c = kinds[t]
            if not c:
                continue
            if not current:
                first = at
                c = SOFT.get(t, c)
            if c in "([{":
                depth += 1
            elif c in ")]}" and depth:
                depth -= 1
            current.append(c)
        if current:
            logical.append((indent, "".join(current), first))
        return self.blocks(logical)

    def blocks(self, logical: list[tuple[str, str, int]]) -> list[SyntaxIssue]:
        issues: list[SyntaxIssue] = []
        # each level: its width, what an open chain of clauses still needs or allows, whether it is a match body
        levels: list[list] = [[0, "", False]]
        opened = ""
        for indent, kinds, at in logical:
            width = len(indent.expandtabs(8))
            if opened:
                if width > levels[-1][0]:
                    levels.append([width, "", opened == "match"])
                else:
                    issues.append(SyntaxIssue(at, "expected an indented block"))
            elif width > levels[-1][0]:
                issues.append(SyntaxIssue(at, "unexpected indent"))
                levels.append([width, "", False])
            while width < levels[-1][0]:
                if levels.pop()[1] == "try":
                    issues.append(SyntaxIssue(at, "expected except or finally"))
            if width != levels[-1][0]:
                issues.append(SyntaxIssue(at, "the indent matches no outer level"))
                levels.append([width, "any", False])
            what = self.lines.get(kinds)
            if what is None:
                what = self.line(kinds)
                if len(self.lines) > MEMORY:
                    self.lines.clear()
                self.lines[kinds] = what
            if what.startswith("!"):
                issues.append(SyntaxIssue(at, what[1:]))
                opened = "" if not kinds.endswith(":") else "recovered"
                levels[-1][1] = "any"
                continue
            inline, _, head = what.rpartition(" ")
            chain = levels[-1][1]
            allowed = {"elif": ("if",), "else": ("if", "loop", "except"), "except": ("try", "except"), "finally": ("try", "except", "tryelse")}.get(head)
            if allowed and chain != "any" and chain not in allowed:
                issues.append(SyntaxIssue(at, f"{head} without its statement"))
            elif not allowed and chain == "try":
                issues.append(SyntaxIssue(at, "expected except or finally"))
            if head == "case" and not levels[-1][2] or levels[-1][2] and head != "case":
                issues.append(SyntaxIssue(at, "case belongs into match"))
            levels[-1][1] = {"if": "if", "elif": "if", "for": "loop", "while": "loop", "try": "try", "except": "except"}.get(head, "tryelse" if head == "else" and chain == "except" else "any" if chain == "any" and allowed else "")
            opened = "" if inline or head == "simple" else head
        at = logical[-1][2] if logical else 0
        if opened and opened != "recovered":
            issues.append(SyntaxIssue(at, "expected an indented block"))
        if any(level[1] == "try" for level in levels):
            issues.append(SyntaxIssue(at, "expected except or finally"))
        return issues

    def line(self, kinds: str) -> str:
        """'simple', the keyword of a header, 'inline ' and the keyword, or '!' and an error."""
        self.deepen(kinds)
        self.start(kinds)
        try:
            return self.logical_line()
        except Failure as e:
            return "!" + e.why

    def logical_line(self) -> str:
        c = self.k[self.i]
        if c in SOFT.values():
            # match and case are names elsewhere
            plain = NAME + self.k[1:]
            self.k = plain if c == SOFT["match"] else plain.replace(P("as") + NAME, "")
            if self.attempt(self.match_header if c == SOFT["match"] else self.case_header):
                return self.soft
            self.k, self.i, c = plain, 0, NAME
        if c == "@":
            self.i += 1
            self.named()
            self.finish()
            return "simple"
        if c == P("async"):
            self.i += 1
            c = self.k[self.i]
            if c not in P("def for with"):
                self.fail("expected def, for or with")
        head = ""
        if c in P("if elif while"):
            head = next(w for w in ("if", "elif", "while") if P(w) == c)
            self.i += 1
            self.named()
        elif c in P("else try finally"):
            head = next(w for w in ("else", "try", "finally") if P(w) == c)
            self.i += 1
        elif c == P("for"):
            head = "for"
            self.i += 1
            self.targets()
            self.need(P("in"), "in")
            self.star_expressions()
        elif c == P("with"):
            head = "with"
            self.i += 1
            if not (self.k[self.i] == "(" and self.attempt(self.grouped_items)):
                self.item()
                while self.eat(","):
                    self.item()
        elif c == P("except"):
            head = "except"
            self.i += 1
            self.eat("*")
            if self.k[self.i] != ":":
                self.star_expressions()
                if self.eat(P("as")):
                    self.need(NAME, "a name")
        elif c == P("def"):
            head = "def"
            self.i += 1
            self.need(NAME, "a name")
            self.type_parameters()
            self.need("(", "(")
            self.parameters(")", True)
            self.need(")", ")")
            if self.eat(P("->")):
                self.star_expressions()
        elif c == P("class"):
            head = "class"
            self.i += 1
            self.need(NAME, "a name")
            self.type_parameters()
            if self.eat("("):
                self.arguments()
        if not head:
            self.simple_statements()
            return "simple"
        self.need(":", ":")
        if self.k[self.i] == END:
            return head
        self.simple_statements()
        return "inline " + head

    soft = ""

    def match_header(self) -> None:
        self.i += 1
        self.star_expressions()
        self.need(":", ":")
        self.finish()
        self.soft = "match"

    def case_header(self) -> None:
        """A pattern is read as the expression it looks like, its captures left out."""
        self.i += 1
        self.guarded = True
        try:
            self.star_expressions()
        finally:
            self.guarded = False
        if self.eat(P("if")):
            self.named()
        self.need(":", ":")
        self.soft = "case"
        if self.k[self.i] != END:
            self.simple_statements()
            self.soft = "inline case"

    def finish(self) -> None:
        if self.k[self.i] != END:
            self.fail("expected the end of the line")

    def type_parameters(self) -> None:
        if self.k[self.i] == "[":
            self.tree()

    def item(self) -> None:
        self.test()
        if self.eat(P("as")):
            self.target()

    def grouped_items(self) -> None:
        self.need("(", "(")
        self.comma_list(self.item, ")", ")")
        if self.k[self.i] != ":":
            self.fail("no group")

    # simple statements

    def simple_statements(self) -> None:
        while True:
            self.simple_statement()
            if not self.eat(";"):
                break
            if self.k[self.i] == END:
                return
        self.finish()

    def simple_statement(self) -> None:
        c = self.k[self.i]
        if c in P("pass break continue"):
            self.i += 1
        elif c == P("return"):
            self.i += 1
            if self.k[self.i] not in ";" + END:
                self.star_expressions()
        elif c == P("raise"):
            self.i += 1
            if self.k[self.i] not in ";" + END:
                self.test()
                if self.eat(P("from")):
                    self.test()
        elif c in P("global nonlocal"):
            self.i += 1
            self.need(NAME, "a name")
            while self.eat(","):
                self.need(NAME, "a name")
        elif c == P("del"):
            self.i += 1
            while self.k[self.i] not in ";" + END:
                at = self.i
                self.target()
                self.assignable(at)
                if not self.eat(","):
                    break
            if self.k[self.i - 1] == c:
                self.fail("expected a target")
        elif c == P("assert"):
            self.i += 1
            self.test()
            if self.eat(","):
                self.test()
        elif c == P("import"):
            self.i += 1
            self.dotted_as()
            while self.eat(","):
                self.dotted_as()
        elif c == P("from"):
            self.i += 1
            dots = False
            while self.k[self.i] == "." or self.k[self.i] == NUMBER:
                self.i += 1
                dots = True
            if not (dots and self.k[self.i] == P("import")):
                self.dotted()
            self.need(P("import"), "import")
            if self.eat("*"):
                return
            if self.eat("("):
                if self.k[self.i] == ")":
                    self.fail("expected a name")
                self.comma_list(self.name_as, ")", ")")
            else:
                self.name_as()
                while self.eat(","):
                    self.name_as()
        elif c == NAME and self.k[self.i + 1] == NAME and self.k[self.i + 2] in "[=":  # a type alias
            self.i += 2
            self.type_parameters()
            self.need("=", "=")
            self.test()
        else:
            at = self.i
            self.star_expressions()
            c = self.k[self.i]
            if c == ":":
                self.assignable(at, True)
                self.i += 1
                self.test()
                if self.eat("="):
                    self.star_expressions()
            elif c in self.augmented:
                self.assignable(at, True)
                self.i += 1
                self.star_expressions()
            else:
                while self.k[self.i] == "=":
                    self.assignable(at)
                    self.i += 1
                    at = self.i
                    self.star_expressions()

    def assignable(self, at: int, single: bool = False) -> None:
        """Whether what began at `at` may stand left of =; calls, constants and operations may not, nor several where one is meant."""
        parts, depth = [[]], 0
        for k in self.k[at : self.i]:
            depth -= k in ")]}"
            if not depth and k == ",":
                parts.append([])
            elif not depth and k not in ")]}":
                parts[-1].append(k)
            depth += k in "([{"
        if single and len(parts) > 1:
            self.fail("cannot assign to several here")
        for part in parts if parts[-1] else parts[:-1]:
            part = part[1:] if part[:1] == ["*"] and not single else part
            last = part[-1] if part else END
            if not (last in (NAME, "[") or part == ["("]) or any(c in self.binary or c in NO_TARGET for c in part):
                self.fail("cannot assign to this")

    def dotted(self) -> None:
        self.need(NAME, "a name")
        while self.eat("."):
            self.need(NAME, "a name")

    def dotted_as(self) -> None:
        self.dotted()
        if self.eat(P("as")):
            self.need(NAME, "a name")

    def name_as(self) -> None:
        self.need(NAME, "a name")
        if self.eat(P("as")):
            self.need(NAME, "a name")

    # expressions

    def target(self) -> None:
        self.eat("*")
        self.expression(5)

    def targets(self) -> None:
        self.target()
        while self.eat(","):
            if self.k[self.i] in "=;:" + END + P("in"):
                return
            self.target()

    def star_expressions(self) -> None:
        while True:
            self.star_named()
            if not self.eat(","):
                return
            if self.k[self.i] in ")]}=:;" + END + P("as if") or self.k[self.i] in self.augmented:
                return

    def star_named(self) -> None:
        if self.eat("*"):
            self.expression(5)
        elif self.k[self.i] == P("yield"):
            self.i += 1
            if self.eat(P("from")):
                self.test()
            elif self.k[self.i] not in ")]=;" + END:
                self.star_expressions()
        else:
            self.named()

    def named(self) -> None:
        self.test()
        if self.eat(P(":=")):
            self.test()

    def test(self) -> None:
        if self.eat(P("lambda")):
            self.parameters(":", False)
            self.need(":", ":")
            self.test()
            return
        self.expression(1)
        if self.k[self.i] == P("if") and not self.guarded:
            self.i += 1
            self.expression(1)
            self.need(P("else"), "else")
            self.test()

    guarded = False

    def operators(self, least: int) -> None:
        while True:
            op = self.k[self.i]
            precedence = self.binary.get(op)
            if precedence is None or precedence < least:
                return
            self.i += 1
            if op == P("not"):
                self.need(P("in"), "in")
                precedence = 4
            elif op == P("is"):
                self.eat(P("not"))
            if precedence == 12:
                self.expression(11)
            else:
                self.expression(precedence + 1)

    def expression(self, least: int = 0) -> None:
        if self.k[self.i] == P("not"):
            if least > 3:
                self.fail("expected an operand")
            self.i += 1
            self.expression(3)
        else:
            self.unary()
        self.operators(least)

    def unary(self) -> None:
        if self.k[self.i] in "+-~":
            while self.k[self.i] in "+-~":
                self.i += 1
            self.unary()
            if self.k[self.i] == P("**"):
                self.operators(12)
            return
        self.eat(P("await"))
        self.operand()

    def operand(self) -> None:
        c = self.k[self.i]
        if c == NAME or c == NUMBER or c in P("True False None"):
            self.i += 1
        elif c == STRING:
            while self.eat(STRING):
                pass
        elif c == "(":
            self.i += 1
            if not self.eat(")"):
                self.star_named()
                if self.k[self.i] in P("for async"):
                    self.comprehension()
                elif self.k[self.i] == ",":
                    while self.eat(","):
                        if self.k[self.i] == ")":
                            break
                        self.star_named()
                self.need(")", ")")
        elif c == "[":
            self.i += 1
            if not self.eat("]"):
                self.star_named()
                if self.k[self.i] in P("for async"):
                    self.comprehension()
                else:
                    while self.eat(","):
                        if self.k[self.i] == "]":
                            break
                        self.star_named()
                self.need("]", "]")
        elif c == "{":
            self.i += 1
            first = True
            while not self.eat("}"):
                if self.eat(P("**")):
                    self.expression(5)
                else:
                    self.star_named()
                    if self.eat(":"):
                        self.test()
                    if first and self.k[self.i] in P("for async"):
                        self.comprehension()
                        self.need("}", "}")
                        break
                first = False
                if not self.eat(","):
                    self.need("}", "}")
                    break
        else:
            self.fail("expected an expression")
        self.postfix()

    def comprehension(self) -> None:
        while self.k[self.i] in P("for async"):
            self.eat(P("async"))
            self.need(P("for"), "for")
            self.targets()
            self.need(P("in"), "in")
            self.expression(1)
            if self.k[self.i] == P("if"):
                at = self.i
                if self.attempt(self.ternary_rest):
                    continue
                self.i = at
            while self.eat(P("if")):
                self.expression(1)
                if self.eat(P(":=")):
                    self.expression(1)

    def ternary_rest(self) -> None:
        self.need(P("if"), "if")
        self.expression(1)
        self.need(P("else"), "else")
        self.test()

    def arguments(self) -> None:
        """Arguments up to the bracket: none by its place behind a named one, no * behind **, a bare comprehension alone."""
        named = unpacked = False
        number = 0
        while not self.eat(")"):
            number += 1
            if self.eat(P("**")):
                unpacked = True
                self.test()
            elif self.eat("*"):
                if unpacked:
                    self.fail("* behind **")
                self.test()
            else:
                at = self.i
                self.named()
                if self.k[self.i] == "=":
                    if self.i - at != 1 or self.k[at] != NAME:
                        self.fail("expected the name of an argument")
                    self.i += 1
                    named = True
                    self.test()
                elif named or unpacked:
                    self.fail("an argument without a name behind one with a name")
                elif self.k[self.i] in P("for async"):
                    if number > 1:
                        self.fail("a comprehension among arguments needs brackets")
                    self.comprehension()
                    if self.eat(",") and self.k[self.i] != ")":
                        self.fail("a comprehension among arguments needs brackets")
                    continue
            if not self.eat(","):
                self.need(")", ")")
                return

    def parameters(self, close: str, annotated: bool) -> None:
        while self.k[self.i] != close:
            if self.eat("/"):
                pass
            elif self.eat("*") or self.eat(P("**")):
                if self.eat(NAME) and annotated and self.eat(":"):
                    self.eat("*")
                    self.test()
            else:
                self.need(NAME, "a parameter")
                if annotated and self.eat(":"):
                    self.test()
                if self.eat("="):
                    self.test()
            if not self.eat(","):
                return

    def subscript(self) -> None:
        if self.k[self.i] not in ":,]":
            self.star_named()
        while self.eat(":"):
            if self.k[self.i] not in ":,]":
                self.test()

    def postfix(self) -> None:
        while True:
            c = self.k[self.i]
            if c == "(":
                self.i += 1
                self.arguments()
            elif c == "[":
                self.i += 1
                if self.k[self.i] == "]":
                    self.fail("expected a subscript")
                self.comma_list(self.subscript, "]", "]")
            elif c == ".":
                self.i += 1
                self.need(NAME, "an attribute")
            else:
                return

