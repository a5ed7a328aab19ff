"""Go."""

from __future__ import annotations

import re

from intentlake.llm.syntax.base import END, LINE, NAME, NUMBER, STRING, Alphabet, Kinds, Parser
from intentlake.llm.syntax.cfamily import binary_levels

G = Alphabet(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "( ) { } [ ] ; , . : ? = + - * / % < > ! & | ^ ~ @ # $ == != <= >= && || << >> &^ <- ++ -- ... := += -= *= /= %= &= |= ^= <<= >>= &^=",
)
#: After these a line end closes the statement.
CLOSERS = frozenset(NAME + NUMBER + STRING + ")]}" + G("++ -- return break continue fallthrough"))


class GoParser(Parser):
    line_ends = True
    pattern = re.compile(
        r"[^\S\n]*([^\W\d]\w*|\n\s*|[(){};,\[\]]|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\[^\n'][^'\n]*|\\')'|//[^\n]*|/\*.*?\*/|\.?\d(?:[eEpP][+-]|[\w.])*|<<=|>>=|&\^=|\.\.\.|:=|<-|&\^|\+\+|--|&&|\|\||<<|>>|[=!<>+\-*/%&|^]=|\S)", re.DOTALL
    )
    kinds = Kinds(
        G.of, r"(?:0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO]?[0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?", "\"'`", ("//", "/*"), line_in_comment=True
    )
    assign = frozenset(G("= := += -= *= /= %= &= |= ^= <<= >>= &^="))
    binary = binary_levels(G, "||", "&&", "== != < > <= >=", "+ - | ^", "* / % << >> & &^")
    prefix = frozenset(G("+ - ! ^ * & <- ~"))

    def start(self, kinds: str) -> None:
        plain = "".join(line + ";" if line and line[-1] in CLOSERS else line for line in (kinds + LINE).split(LINE))
        super().start(plain)
        self.no_literal = False
        self.packaged = False

    def semicolon(self) -> None:
        if self.k[self.i] not in ")}":
            self.need(";", "; or a new line")

    def unit(self) -> None:
        if not self.packaged:
            self.packaged = True
            self.need(G("package"), "package")
            self.need(NAME, "a name")
            self.need(";", "; or a new line")
        self.statements(self.top, END)

    def top(self) -> None:
        if self.eat(";"):
            return
        c = self.k[self.i]
        if c == G("import"):
            self.i += 1
            self.group(self.import_)
        elif c == G("func"):
            self.i += 1
            if self.k[self.i] == "(":
                self.parameters()
            self.need(NAME, "a name")
            if self.k[self.i] == "[":
                self.tree()
            self.signature()
            if self.k[self.i] == "{":
                self.block()
        elif not self.declaration():
            self.fail("expected a declaration")
        self.semicolon()

    def group(self, rule) -> None:
        if self.eat("("):
            while not self.eat(")"):
                rule()
                if not self.eat(";"):
                    self.need(")", ")")
                    return
        else:
            rule()

    def import_(self) -> None:
        if self.k[self.i] in NAME + ".":
            self.i += 1
        self.need(STRING, "a path")

    def declaration(self) -> bool:
        c = self.k[self.i]
        if c == G("type"):
            self.i += 1
            self.group(self.type_spec)
        elif c == G("var"):
            self.i += 1
            self.group(self.value_spec)
        elif c == G("const"):
            self.i += 1
            self.group(self.value_spec)
        else:
            return False
        return True

    def type_spec(self) -> None:
        self.need(NAME, "a name")
        if self.k[self.i] == "[" and self.k[self.i + 1] == NAME and self.k[self.i + 2] not in "]":
            self.tree()
        self.eat("=")
        self.type()

    def value_spec(self) -> None:
        self.need(NAME, "a name")
        while self.eat(","):
            self.need(NAME, "a name")
        if self.k[self.i] not in "=;)":
            self.type()
        if self.eat("="):
            self.expressions()

    # types

    def type(self) -> None:
        c = self.k[self.i]
        if c == NAME:
            self.i += 1
            if self.eat("."):
                self.need(NAME, "a name")
            if self.k[self.i] == "[" and self.k[self.i + 1] != "]":
                self.i += 1
                self.comma_list(self.type, "]", "]")
        elif c == "*":
            self.i += 1
            self.type()
        elif c == "(":
            self.i += 1
            self.type()
            self.need(")", ")")
        elif c == "[":
            self.i += 1
            if not self.eat(G("...")) and self.k[self.i] != "]":
                self.expression()
            self.need("]", "]")
            self.type()
        elif c == G("map"):
            self.i += 1
            self.need("[", "[")
            self.type()
            self.need("]", "]")
            self.type()
        elif c == G("chan") or c == G("<-"):
            self.eat(G("<-"))
            self.need(G("chan"), "chan")
            self.eat(G("<-"))
            self.type()
        elif c == G("func"):
            self.i += 1
            self.signature()
        elif c == G("struct"):
            self.i += 1
            self.need("{", "{")
            while not self.eat("}"):
                self.field()
                if not self.eat(";"):
                    self.need("}", "}")
                    break
        elif c == G("interface"):
            self.i += 1
            self.need("{", "{")
            while not self.eat("}"):
                if self.k[self.i] == NAME and self.k[self.i + 1] == "(":
                    self.i += 1
                    self.signature()
                else:
                    self.union()
                if not self.eat(";"):
                    self.need("}", "}")
                    break
        else:
            self.fail("expected a type")

    def union(self) -> None:
        while True:
            self.eat("~")
            self.type()
            if not self.eat("|"):
                return

    def field(self) -> None:
        if self.k[self.i] == "*" or self.k[self.i] == NAME and self.k[self.i + 1] in ";." + STRING + "}":
            self.type()
        else:
            self.need(NAME, "a field")
            while self.eat(","):
                self.need(NAME, "a field")
            self.type()
        self.eat(STRING)

    def parameters(self) -> None:
        self.need("(", "(")
        self.comma_list(self.parameter, ")", ")")

    def parameter(self) -> None:
        if self.k[self.i] == NAME and self.k[self.i + 1] not in ",).[":
            self.i += 1
        elif self.k[self.i] == NAME and self.k[self.i + 1] == "[":
            at = self.i
            self.i += 1
            if self.attempt(self.type):
                if self.k[self.i] in ",)":
                    return
            self.i = at
        self.eat(G("..."))
        self.type()

    def signature(self) -> None:
        self.parameters()
        if self.k[self.i] == "(":
            self.parameters()
        elif self.k[self.i] in "*[" + NAME or self.k[self.i] in G("map chan func struct interface <-"):
            self.type()

    # statements

    def block(self) -> None:
        self.need("{", "{")
        saved, self.no_literal = self.no_literal, False
        self.statements(self.statement, "}")
        self.no_literal = saved
        self.i += 1

    def statement(self) -> None:
        if self.eat(";"):
            return
        c = self.k[self.i]
        if c == G("if"):
            self.if_()
        elif c == G("for"):
            self.for_()
        elif c == G("switch"):
            self.i += 1
            self.header()
            self.cases(self.expressions_or_types)
        elif c == G("select"):
            self.i += 1
            self.cases(self.simple_statement)
        elif c == "{":
            self.block()
        elif c == G("return"):
            self.i += 1
            if self.k[self.i] not in ";}":
                self.expressions()
        elif c in G("break continue goto"):
            self.i += 1
            self.eat(NAME)
        elif c == G("fallthrough"):
            self.i += 1
        elif c in G("go defer"):
            self.i += 1
            self.expression()
            if self.k[self.i - 1] != ")":
                self.fail("expected a call")
        elif c == NAME and self.k[self.i + 1] == ":":
            self.i += 2
            if self.k[self.i] != "}":
                self.statement()
            return
        elif not self.declaration():
            self.simple_statement()
        self.semicolon()

    def simple_statement(self) -> None:
        if self.eat(G("range")):
            self.expression()
            return
        self.expressions()
        c = self.k[self.i]
        if c in self.assign:
            self.i += 1
            if self.eat(G("range")):
                self.expression()
            else:
                self.expressions()
        elif c in G("++ --"):
            self.i += 1
        elif c == G("<-"):
            self.i += 1
            self.expression()

    def header(self) -> None:
        saved, self.no_literal = self.no_literal, True
        if self.k[self.i] != "{":
            if self.k[self.i] != ";":
                self.simple_statement()
            while self.eat(";"):
                if self.k[self.i] not in ";{":
                    self.simple_statement()
        self.no_literal = saved

    def if_(self) -> None:
        self.i += 1
        if self.k[self.i] == "{":
            self.fail("expected a condition")
        self.header()
        if self.k[self.i - 1] == ";":
            self.fail("expected a condition")
        self.block()
        if self.eat(G("else")):
            if self.k[self.i] == G("if"):
                self.if_()
            else:
                self.block()

    def for_(self) -> None:
        self.i += 1
        self.header()
        self.block()

    def cases(self, rule) -> None:
        self.need("{", "{")
        saved, self.no_literal = self.no_literal, False
        while not self.eat("}"):
            if not self.eat(G("default")):
                self.need(G("case"), "case")
                rule()
            self.need(":", ":")
            while self.k[self.i] not in "}" + G("case default"):
                if self.k[self.i] == END:
                    self.fail("the text ends inside a switch")
                self.statement()
        self.no_literal = saved

    # expressions

    def expressions_or_types(self) -> None:
        self.expressions()

    def expressions(self) -> None:
        self.expression()
        while self.eat(","):
            self.expression()

    def operand(self) -> None:
        c = self.k[self.i]
        if c == NAME:
            self.i += 1
            if self.k[self.i] == "{" and not self.no_literal:
                self.literal()
        elif c in (NUMBER, STRING):
            self.i += 1
        elif c == "(":
            self.i += 1
            saved, self.no_literal = self.no_literal, False
            if not self.attempt(lambda: (self.expression(), self.need(")", ")"))):
                self.type()
                self.need(")", ")")
            self.no_literal = saved
        elif c == G("func"):
            self.i += 1
            self.signature()
            if self.k[self.i] == "{":
                self.block()
        elif c == "[" or c in G("map struct chan interface"):
            self.type()
            if self.k[self.i] == "{":
                self.literal()
        else:
            self.fail("expected an expression")
        self.postfix()

    def literal(self) -> None:
        self.need("{", "{")
        saved, self.no_literal = self.no_literal, False
        self.comma_list(self.element, "}", "}")
        self.no_literal = saved

    def element(self) -> None:
        for _ in range(2):
            if self.k[self.i] == "{":
                self.literal()
            else:
                self.expression()
            if not self.eat(":"):
                return

    def argument(self) -> None:
        if not self.attempt(self.expression):
            self.type()
        self.eat(G("..."))

    def postfix(self) -> None:
        while True:
            c = self.k[self.i]
            if c == "(":
                self.i += 1
                saved, self.no_literal = self.no_literal, False
                self.comma_list(self.argument, ")", ")")
                self.no_literal = saved
            elif c == "[":
                self.i += 1
                saved, self.no_literal = self.no_literal, False
                while self.k[self.i] != "]":
                    if self.k[self.i] in ":,":
                        self.i += 1
                    else:
                        self.argument()
                        if self.k[self.i] not in ":,]":
                            self.fail("expected ]")
                self.i += 1
                self.no_literal = saved
                if self.k[self.i] == "{" and not self.no_literal and self.k[self.i - 2] == NAME:
                    self.literal()
            elif c == ".":
                self.i += 1
                if self.eat("("):
                    if not self.eat(G("type")):
                        self.type()
                    self.need(")", ")")
                else:
                    self.need(NAME, "a member")
                    if self.k[self.i] == "{" and not self.no_literal:
                        self.literal()
            else:
                return
