"""JavaScript and TypeScript, read as modules."""

from __future__ import annotations

import re

from intentlake.llm.syntax.base import END, NAME, NUMBER, STRING, Alphabet, Kinds, Parser, without_lines
from intentlake.llm.syntax.cfamily import binary_levels

S = Alphabet(
    "await break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield let static async of get set as from",
    "( ) { } [ ] ; , . : ? = + - * / % < > ! & | ^ ~ @ # == === != !== <= >= && || ?? ++ -- ** << ... => ?. += -= *= /= %= **= &= |= ^= <<= &&= ||= ??=",
)
#: Words that are names wherever a name may stand.
SOFT = S("let static async of get set as from")
NAMES = frozenset(NAME + SOFT)
WORDS = frozenset(NAME + "".join(c for t, c in S.of.items() if t.isalpha()))
REGEX = r"(?:(?<=[(,=:\[!&|?{};\n>+*])|(?<=[(,=:\[!&|?{};>+*] )|(?<=return )|(?<=typeof ))/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
TEMPLATE = r"`(?:[^`\\$]|\\.|\$(?!\{)|\$\{(?:[^{}`]|`[^`]*`|\{(?:[^{}]|\{[^{}]*\})*\})*\})*`"


class ScriptParser(Parser):
    typed = False
    line_ends = True
    pattern = re.compile(
        rf"[^\S\n]*([^\W\d][\w$]*|\n\s*|[(){{}};,\[\]]|\"(?:[^\"\\\n]|\\(?:\r\n|.))*\"|'(?:[^'\\\n]|\\(?:\r\n|.))*'|{TEMPLATE}|//[^\n]*|/\*.*?\*/|\A\#![^\n]*|{REGEX}|\.?\d(?:[eE][+-]|[\w.])*|\#?[^\W\d]?[\w$]*[$][\w$]*|\#[^\W\d][\w$]*|===|!==|\*\*=|&&=|\|\|=|\?\?=|<<=|\.\.\.|=>|\?\.(?!\d)|\?\?|&&|\|\||\+\+|--|\*\*|[=!<>+\-*/%&|^]=|<<|\S)",
        re.DOTALL,
    )
    kinds = Kinds(
        S.of | {"<!--": "\x00"},
        r"0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?|\d[\d_]*n",
        "\"'`/",
        ("//", "/*", "#!"),
        r"#?[^\W\d][\w$]*|#?\w*\$[\w$]*",
        line_in_comment=True,
    )
    assign = frozenset(S("= += -= *= /= %= **= &= |= ^= <<= &&= ||= ??="))
    binary = binary_levels(S, "??", "||", "&&", "|", "^", "&", "== != === !==", "< > <= >= instanceof in", "<<", "+ -", "* / %", "**")
    right = frozenset(S("**"))
    prefix = frozenset(S("+ - ! ~ ++ -- typeof void delete await"))

    def start(self, kinds: str) -> None:
        plain, self.after_line = without_lines(kinds)
        super().start(plain)
        self.no_in = False
        self.functions = self.loops = self.switches = 0

    def statements(self, rule, close: str) -> None:
        self.remember()
        super().statements(rule, close)
        self.remember()

    def __init__(self) -> None:
        super().__init__()
        self.memory: dict[tuple[bool, bool, bool], set] = {}

    def remember(self) -> None:
        """What a function, a loop or a switch may hold besides (return, continue, break) is remembered apart."""
        self.known = self.memory.setdefault((self.functions > 0, self.loops > 0, self.switches > 0), set())

    def repeated_statement(self) -> None:
        self.loops += 1
        try:
            self.statement()
        finally:
            self.loops -= 1
            self.remember()

    def newline(self) -> bool:
        return self.i in self.after_line

    def end_statement(self) -> None:
        c = self.k[self.i]
        if c == ";":
            self.i += 1
        elif c != "}" and c != END and not self.newline():
            self.fail("expected ; or a new line")

    def name(self) -> None:
        if self.k[self.i] not in NAMES:
            self.fail("expected a name")
        self.i += 1

    def word(self) -> None:
        if self.k[self.i] not in WORDS:
            self.fail("expected a name")
        self.i += 1

    # types are filled in by TypeScript

    def annotation(self) -> None:
        pass

    def type_parameters(self) -> None:
        pass

    def unit(self) -> None:
        self.functions = 0
        self.statements(self.module_item, END)

    def module_item(self) -> None:
        c = self.k[self.i]
        if c == S("import") and self.k[self.i + 1] not in "(.":
            self.import_statement()
        elif c == S("export"):
            self.export_statement()
        else:
            self.statement()

    def module_name(self) -> None:
        if self.k[self.i] in WORDS:
            self.i += 1
        else:
            self.need(STRING, "a name")

    def named(self) -> None:
        if self.typed and self.k[self.i] == NAME and self.k[self.i + 1] in WORDS and self.k[self.i + 1] != S("as"):
            self.i += 1  # type
        self.module_name()
        if self.eat(S("as")):
            self.module_name()

    def source(self) -> None:
        self.need(S("from"), "from")
        self.need(STRING, "a module name")
        if self.k[self.i] == S("with") and self.k[self.i + 1] == "{":
            self.i += 1
            self.tree()

    def import_statement(self) -> None:
        self.i += 1
        if self.eat(STRING):
            self.end_statement()
            return
        if self.typed and self.k[self.i] == NAME and (self.k[self.i + 1] in "{*" or self.k[self.i + 1] in NAMES and self.k[self.i + 1] != S("from") or self.k[self.i + 1 : self.i + 3] == S("from from")):
            self.i += 1  # type
        if self.k[self.i] in NAMES:
            self.i += 1
            if self.typed and self.eat("="):
                self.assignment()
                self.end_statement()
                return
            if not self.eat(","):
                self.source()
                self.end_statement()
                return
        if self.eat("*"):
            self.need(S("as"), "as")
            self.name()
        else:
            self.need("{", "{")
            self.comma_list(self.named, "}", "}")
        self.source()
        self.end_statement()

    def export_statement(self) -> None:
        self.i += 1
        c = self.k[self.i]
        if c == S("default"):
            self.i += 1
            if self.k[self.i] == S("function") or self.k[self.i] == S("async") and self.k[self.i + 1] == S("function"):
                self.function(named=False, signature=True)
            elif self.k[self.i] == S("class") or self.k[self.i] == "@":
                self.class_(named=False)
            elif self.typed and self.k[self.i] == NAME and (self.k[self.i + 1] in NAMES or self.k[self.i + 1] == S("class")):
                self.statement()
            else:
                self.assignment()
                self.end_statement()
        elif c == "*":
            self.i += 1
            if self.eat(S("as")):
                self.module_name()
            self.source()
            self.end_statement()
        elif c == "{" or self.typed and c == NAME and self.k[self.i + 1] in "{*":
            if c == NAME:
                self.i += 1
            if self.eat("*"):
                self.source()
            else:
                self.need("{", "{")
                self.comma_list(self.named, "}", "}")
                if self.k[self.i] == S("from"):
                    self.source()
            self.end_statement()
        elif c in S("const let var function class async") or c == "@" or self.typed and (c == NAME or c in S("enum import")):
            if self.typed and c == S("import"):
                self.import_statement()
            else:
                at = self.i
                self.statement()
                if c == NAME and self.k[at + 1] in ".(=":
                    self.i = at
                    self.fail("expected a declaration to export")
        elif self.typed and c == "=":
            self.i += 1
            self.assignment()
            self.end_statement()
        else:
            self.fail("expected a declaration to export")

    # statements

    def block(self) -> None:
        self.need("{", "{")
        self.statements(self.statement, "}")
        self.i += 1

    def body(self) -> None:
        saved, self.loops, self.switches = (self.loops, self.switches), 0, 0
        self.functions += 1
        try:
            self.block()
        finally:
            self.functions -= 1
            self.loops, self.switches = saved
            self.remember()

    def parenthesis(self) -> None:
        self.need("(", "(")
        self.comma_expression()
        self.need(")", ")")

    def is_let(self) -> bool:
        return self.k[self.i] == S("let") and (self.k[self.i + 1] in NAMES or self.k[self.i + 1] in "[{")

    def statement(self) -> None:
        c = self.k[self.i]
        if c == "{":
            self.block()
        elif c == ";":
            self.i += 1
        elif c in S("const var") or self.is_let():
            if self.typed and c == S("const") and self.k[self.i + 1] == S("enum"):
                self.i += 1
                self.statement()
                return
            self.variables()
            self.end_statement()
        elif c == S("function") or c == S("async") and self.k[self.i + 1] == S("function") and self.i + 1 not in self.after_line:
            self.function(named=True, signature=True)
        elif c == S("class") or c == "@":
            self.class_(named=True)
        elif c == S("if"):
            self.i += 1
            self.parenthesis()
            self.statement()
            if self.eat(S("else")):
                self.statement()
        elif c == S("for"):
            self.for_()
        elif c == S("while"):
            self.i += 1
            self.parenthesis()
            self.repeated_statement()
        elif c == S("do"):
            self.i += 1
            self.repeated_statement()
            self.need(S("while"), "while")
            self.parenthesis()
            self.eat(";")
        elif c == S("return"):
            if not self.functions:
                self.fail("return outside of a function")
            self.i += 1
            if self.k[self.i] not in ";}" + END and not self.newline():
                self.comma_expression()
            self.end_statement()
        elif c == S("throw"):
            self.i += 1
            if self.newline():
                self.fail("expected an expression")
            self.comma_expression()
            self.end_statement()
        elif c in S("break continue"):
            self.i += 1
            if self.k[self.i] in NAMES and not self.newline():
                self.i += 1
            elif not self.loops and not (c == S("break") and self.switches):
                self.fail("outside of a loop")
            self.end_statement()
        elif c == S("try"):
            self.i += 1
            self.block()
            handled = False
            if self.eat(S("catch")):
                handled = True
                if self.eat("("):
                    self.binding()
                    self.annotation()
                    self.need(")", ")")
                self.block()
            if self.eat(S("finally")):
                handled = True
                self.block()
            if not handled:
                self.fail("expected catch or finally")
        elif c == S("switch"):
            self.i += 1
            self.parenthesis()
            self.need("{", "{")
            self.switches += 1
            try:
                self.cases()
            finally:
                self.switches -= 1
                self.remember()
        elif c == S("debugger"):
            self.i += 1
            self.end_statement()
        elif c in NAMES and self.k[self.i + 1] == ":":
            self.i += 2
            self.statement()
        elif c == S("import") and self.k[self.i + 1] not in "(.":
            self.fail("import inside of a block")
        else:
            self.comma_expression()
            self.end_statement()

    def cases(self) -> None:
        while not self.eat("}"):
            if not self.eat(S("default")):
                self.need(S("case"), "case")
                self.comma_expression()
            self.need(":", ":")
            while self.k[self.i] not in "}" + S("case default"):
                if self.k[self.i] == END:
                    self.fail("the text ends inside a switch")
                self.statement()

    def variables(self) -> None:
        constant = self.k[self.i] == S("const")
        self.i += 1
        while True:
            pattern = self.k[self.i] in "[{"
            self.binding()
            if self.typed and self.k[self.i] == "!":
                self.i += 1
            self.annotation()
            if self.eat("="):
                self.assignment()
            elif (constant or pattern) and not self.no_in and not self.typed:
                self.fail("expected a value")
            if not self.eat(","):
                return

    def binding(self) -> None:
        c = self.k[self.i]
        if c == "[":
            self.i += 1
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat(S("..."))
                self.binding()
                if self.eat("="):
                    self.assignment()
                if not self.eat(","):
                    self.need("]", "]")
                    return
        elif c == "{":
            self.i += 1
            self.comma_list(self.bound_property, "}", "}")
        else:
            self.name()

    def bound_property(self) -> None:
        if self.eat(S("...")):
            self.binding()
            return
        plain = self.k[self.i] in NAMES
        self.property_name()
        if self.eat(":"):
            self.binding()
        elif not plain:
            self.fail("expected :")
        if self.eat("="):
            self.assignment()

    def for_(self) -> None:
        self.i += 1
        self.eat(S("await"))
        self.need("(", "(")
        saved, self.no_in = self.no_in, True
        try:
            if self.k[self.i] in S("const var") or self.is_let():
                self.variables()
            elif self.k[self.i] != ";":
                self.comma_expression()
        finally:
            self.no_in = saved
        if self.eat(S("of")):
            self.assignment()
        elif self.eat(S("in")):
            self.comma_expression()
        else:
            self.need(";", ";")
            if self.k[self.i] != ";":
                self.comma_expression()
            self.need(";", ";")
            if self.k[self.i] != ")":
                self.comma_expression()
        self.need(")", ")")
        self.repeated_statement()

    def function(self, named: bool, signature: bool = False) -> None:
        self.eat(S("async"))
        self.need(S("function"), "function")
        self.eat("*")
        if self.k[self.i] in NAMES or self.k[self.i] in S("await yield"):
            self.i += 1
        elif named:
            self.fail("expected a name")
        self.function_rest(signature)

    def function_rest(self, signature: bool = False) -> None:
        self.type_parameters()
        self.parameters()
        self.annotation()
        if signature and self.typed and self.k[self.i] != "{":
            self.end_statement()
        else:
            saved, self.no_in = self.no_in, False
            self.body()
            self.no_in = saved

    def parameters(self) -> None:
        self.need("(", "(")
        self.comma_list(self.parameter, ")", ")")

    def parameter(self) -> None:
        while self.k[self.i] == "@":
            self.decorator()
        if self.typed:
            while self.k[self.i] == NAME and (self.k[self.i + 1] in NAMES or self.k[self.i + 1] in "[{"):
                self.i += 1  # public, readonly and the like
            if self.k[self.i] == S("this"):
                self.i += 1
                self.annotation()
                return
        self.eat(S("..."))
        self.binding()
        if self.typed:
            self.eat("?")
        self.annotation()
        if self.eat("="):
            self.assignment()

    def decorator(self) -> None:
        self.i += 1
        if self.k[self.i] == "(":
            self.tree()
            return
        self.name()
        while self.eat("."):
            self.word()
        if self.k[self.i] == "(":
            self.tree()

    def class_(self, named: bool) -> None:
        while self.k[self.i] == "@":
            self.decorator()
        if self.typed and self.k[self.i] == NAME:
            self.i += 1  # abstract
        self.need(S("class"), "class")
        if self.k[self.i] in NAMES and not (self.typed and self.k[self.i] == NAME and self.k[self.i + 1] == NAME):
            self.i += 1
        elif named:
            self.fail("expected a name")
        self.type_parameters()
        if self.eat(S("extends")):
            self.unary()
            self.type_arguments()
        if self.typed and self.k[self.i] == NAME:
            self.implements()
        self.need("{", "{")
        saved, self.no_in = self.no_in, False
        self.statements(self.member, "}")
        self.no_in = saved
        self.i += 1

    def implements(self) -> None:
        pass

    def type_arguments(self) -> None:
        pass

    def member(self) -> None:
        if self.eat(";"):
            return
        while self.k[self.i] == "@":
            self.decorator()
        ends = "(=;}" + (":?!<" if self.typed else "")
        if self.k[self.i] == S("static") and self.k[self.i + 1] == "{":
            self.i += 1
            self.body()
            return
        while (self.k[self.i] in S("static async get set") or self.typed and self.k[self.i] == NAME) and self.k[self.i + 1] not in ends and (self.k[self.i + 1] in WORDS or self.k[self.i + 1] in "[*" + STRING + NUMBER) and (self.i + 1 not in self.after_line or self.typed):
            self.i += 1
        self.eat("*")
        if self.typed and self.k[self.i] == "[" and self.k[self.i + 1] in NAMES and self.k[self.i + 2] == ":":
            self.tree()
        else:
            self.property_name()
        if self.typed and self.k[self.i] in "?!":
            self.i += 1
        if self.k[self.i] in "(<":
            self.function_rest(signature=True)
            return
        self.annotation()
        if self.eat("="):
            self.functions += 1
            self.assignment()
            self.functions -= 1
        self.end_statement()

    def property_name(self) -> None:
        c = self.k[self.i]
        if c == "[":
            self.i += 1
            self.assignment()
            self.need("]", "]")
        elif c in WORDS or c in (STRING, NUMBER):
            self.i += 1
        else:
            self.fail("expected a property")

    # expressions

    def comma_expression(self) -> None:
        self.assignment()
        while self.eat(","):
            self.assignment()

    def arrow_body(self) -> None:
        saved, self.no_in = self.no_in, False
        if self.k[self.i] == "{":
            self.body()
        else:
            self.no_in = saved
            self.assignment()
        self.no_in = saved

    def arrow(self) -> None:
        """async? (parameters) => or async? name =>; fails if there is none."""
        if self.k[self.i] == S("async") and self.k[self.i + 1] not in S("=>"):
            self.i += 1
        if self.k[self.i] in NAMES:
            self.i += 1
        else:
            self.type_parameters()
            self.parameters()
            self.annotation()
        self.need(S("=>"), "=>")

    def assignment(self) -> None:
        c = self.k[self.i]
        if c in NAMES:
            n = self.k[self.i + 1]
            if (n == S("=>") or c == S("async") and (n in NAMES or n == "(" or n == "<" and self.typed) and self.k[self.i + 2] != END) and self.attempt(self.arrow):
                self.arrow_body()
                return
        elif c == "(" or c == "<" and self.typed:
            close = self.closing(self.i) if c == "(" else 0
            if close >= 0 and (c == "<" or self.k[close + 1] == S("=>") or self.typed and self.k[close + 1] == ":") and self.attempt(self.arrow):
                self.arrow_body()
                return
        elif c == S("yield"):
            self.i += 1
            if self.newline() or self.k[self.i] in ")]};,:" + END:
                return
            self.eat("*")
            self.assignment()
            return
        self.conditional()
        if self.k[self.i] in self.assign or self.k[self.i] == ">" and self.k[self.i + 1] in S(">=") + ">":
            at = self.i
            while self.k[self.i] == ">":
                self.i += 1
            if at == self.i or self.k[self.i] == S(">="):
                self.i += 1
                self.assignment()
            else:
                self.i = at

    def conditional(self) -> None:
        self.expression(1)
        if self.eat("?"):
            saved, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = saved
            self.need(":", ":")
            self.assignment()

    def operators(self, least: int) -> None:
        while True:
            op = self.k[self.i]
            if self.typed and op == S("as") and not self.newline() or self.typed and op == NAME and not self.newline() and self.k[self.i + 1] in NAMES:
                self.i += 1
                if not self.eat(S("const")):
                    self.type()
                continue
            precedence = self.binary.get(op)
            if precedence is None or precedence < least or op == S("in") and self.no_in:
                return
            if op == ">" and (self.k[self.i + 1] == S(">=") or self.k[self.i + 1 : self.i + 3] == ">" + S(">=")):
                return
            self.i += 1
            if op == ">" and self.eat(">"):
                self.eat(">")
            self.expression(precedence if op in self.right else precedence + 1)

    def operand(self) -> None:
        c = self.k[self.i]
        if c in NAMES:
            if c == S("async") and self.k[self.i + 1] == S("function") and self.i + 1 not in self.after_line:
                self.function(named=False)
            else:
                self.i += 1
        elif c in (NUMBER, STRING) or c in S("this super null true false"):
            self.i += 1
        elif c == "(":
            self.i += 1
            saved, self.no_in = self.no_in, False
            self.comma_expression()
            self.no_in = saved
            self.need(")", ")")
        elif c == "[":
            self.i += 1
            saved, self.no_in = self.no_in, False
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat(S("..."))
                self.assignment()
                if not self.eat(","):
                    self.need("]", "]")
                    break
            self.no_in = saved
        elif c == "{":
            self.i += 1
            saved, self.no_in = self.no_in, False
            self.comma_list(self.property, "}", "}")
            self.no_in = saved
        elif c == S("function"):
            self.function(named=False)
        elif c == S("class") or c == "@":
            self.class_(named=False)
        elif c == S("new"):
            self.i += 1
            if self.eat("."):
                if not self.functions:
                    self.fail("new.target outside of a function")
                self.word()
            else:
                self.operand_without_call()
                self.type_arguments()
                if self.eat("("):
                    self.comma_list(self.argument, ")", ")")
        elif c == S("import"):
            self.i += 1
            if self.eat("."):
                self.word()
            elif self.k[self.i] != "(":
                self.fail("expected (")
        elif c == "<" and self.typed:
            self.i += 1
            self.type()
            self.need(">", ">")
            self.unary()
            return
        else:
            self.fail("expected an expression")
        self.postfix()

    def operand_without_call(self) -> None:
        c = self.k[self.i]
        if c == S("new"):
            self.operand()
            return
        if c == "(":
            self.parenthesis()
        elif c == S("class"):
            self.class_(named=False)
        elif c == S("function"):
            self.function(named=False)
        elif c in NAMES or c in S("this super import"):
            self.i += 1
        else:
            self.fail("expected a class")
        while True:
            if self.eat("."):
                self.word()
            elif self.eat("["):
                self.comma_expression()
                self.need("]", "]")
            else:
                return

    def property(self) -> None:
        if self.eat(S("...")):
            self.assignment()
            return
        while self.k[self.i] in S("async get set") and (self.k[self.i + 1] in WORDS or self.k[self.i + 1] in "[*" + STRING + NUMBER):
            self.i += 1
        star = self.eat("*")
        plain = self.k[self.i] in NAMES
        self.property_name()
        if self.k[self.i] in "(<":
            self.function_rest()
        elif self.eat(":"):
            self.assignment()
        elif plain and not star:
            if self.eat("="):
                self.assignment()
        else:
            self.fail("expected :")

    def argument(self) -> None:
        self.eat(S("..."))
        self.assignment()

    def postfix(self) -> None:
        while True:
            c = self.k[self.i]
            if c == "(":
                self.i += 1
                saved, self.no_in = self.no_in, False
                self.comma_list(self.argument, ")", ")")
                self.no_in = saved
            elif c == "[":
                self.i += 1
                saved, self.no_in = self.no_in, False
                self.comma_expression()
                self.no_in = saved
                self.need("]", "]")
            elif c == ".":
                self.i += 1
                self.word()
            elif c == S("?."):
                self.i += 1
                if self.k[self.i] not in "([":
                    self.word()
            elif c == STRING and not self.newline():
                self.i += 1  # a tagged template
            elif c in S("++ --") and not self.newline():
                last, before = self.k[self.i - 1], self.k[self.i - 2] if self.i > 1 else END
                if before not in ("." + S("?.")) and (last in (NUMBER, STRING, "}") or last in S("this null true false super")):
                    self.fail("cannot count this up or down")
                self.i += 1
                return
            elif self.typed and c == "!" and not self.newline():
                self.i += 1
            elif self.typed and c == "<" and self.attempt(self.call_types):
                pass
            else:
                return

    def call_types(self) -> None:
        self.type_arguments()
        if self.k[self.i] not in "(" + STRING:
            self.fail("no call")

    def type(self) -> None:
        pass


class TypeScriptParser(ScriptParser):
    typed = True

    def annotation(self) -> None:
        if self.eat(":"):
            if self.k[self.i] in NAMES and self.k[self.i + 1] in (NAME,) and self.i + 1 not in self.after_line and self.k[self.i + 2] in NAMES:
                self.i += 1  # asserts
            self.type()
            if self.k[self.i] == NAME and not self.newline():
                self.i += 1  # is
                self.type()

    def type_parameters(self) -> None:
        if not self.eat("<"):
            return
        while not self.eat(">"):
            while self.k[self.i] in S("const in") or self.k[self.i] == NAME and self.k[self.i + 1] in NAMES:
                self.i += 1
            self.name()
            if self.eat(S("extends")):
                self.type()
            if self.eat("="):
                self.type()
            if not self.eat(","):
                self.need(">", ">")
                return

    def type_arguments(self) -> None:
        if self.eat("<"):
            while not self.eat(">"):
                self.type()
                if not self.eat(","):
                    self.need(">", ">")
                    return

    def implements(self) -> None:
        self.i += 1
        self.type()
        while self.eat(","):
            self.type()

    def type(self) -> None:
        if self.k[self.i] in "(<" + S("new") or self.k[self.i] == NAME and self.k[self.i + 1] == S("new"):
            if self.attempt(self.function_type):
                return
        if self.k[self.i] in "|&":
            self.i += 1
        self.type_operand()
        while self.k[self.i] in "|&":
            self.i += 1
            self.type_operand()
        if self.k[self.i] == S("extends") and not self.newline():
            self.i += 1
            self.type()
            if self.eat("?"):
                self.type()
                self.need(":", ":")
                self.type()

    def function_type(self) -> None:
        self.eat(NAME)
        self.eat(S("new"))
        self.type_parameters()
        self.parameters()
        self.need(S("=>"), "=>")
        self.type()
        if self.k[self.i] == NAME and not self.newline():
            self.i += 1
            self.type()

    def type_operand(self) -> None:
        c = self.k[self.i]
        if c == NAME and self.k[self.i + 1] in NAME + S("typeof") and self.i + 1 not in self.after_line:
            self.i += 1  # keyof, readonly, infer, unique
            self.type_operand()
            return
        if c in NAMES or c in S("this void null true false const"):
            self.i += 1
            while self.k[self.i] == "." and self.k[self.i + 1] in WORDS:
                self.i += 2
            if self.k[self.i] == "<" and not self.newline():
                self.type_arguments()
        elif c == S("typeof"):
            self.i += 1
            if self.eat(S("import")):
                self.tree()
            else:
                self.name()
            while self.eat("."):
                self.word()
            self.type_arguments()
        elif c == S("import"):
            self.i += 1
            self.tree()
            while self.eat("."):
                self.word()
            self.type_arguments()
        elif c in (STRING, NUMBER):
            self.i += 1
        elif c == "-":
            self.i += 1
            self.need(NUMBER, "a number")
        elif c == "(":
            self.i += 1
            self.type()
            self.need(")", ")")
        elif c == "[":
            self.i += 1
            self.comma_list(self.tuple_item, "]", "]")
        elif c == "{":
            self.type_body()
        else:
            self.fail("expected a type")
        while self.k[self.i] == "[" and not self.newline():
            self.i += 1
            self.comma_list(self.tuple_item, "]", "]")

    def tuple_item(self) -> None:
        self.eat(S("..."))
        if self.k[self.i] in NAMES and (self.k[self.i + 1] == ":" or self.k[self.i + 1 : self.i + 3] == "?:"):
            self.i += 1
            self.eat("?")
            self.i += 1
        self.type()
        self.eat("?")

    def type_body(self) -> None:
        self.need("{", "{")
        while not self.eat("}"):
            self.type_member()
            if not (self.eat(";") or self.eat(",")) and self.k[self.i] != "}" and not self.newline():
                self.fail("expected ; in a type")

    def type_member(self) -> None:
        while self.k[self.i] in "+-":
            self.i += 1
        while (self.k[self.i] == NAME or self.k[self.i] in S("get set")) and (self.k[self.i + 1] in WORDS or self.k[self.i + 1] in "[" + STRING):
            self.i += 1
        if self.k[self.i] in "(<" or self.k[self.i] == S("new") and self.k[self.i + 1] in "(<":
            self.eat(S("new"))
            self.type_parameters()
            self.parameters()
            self.annotation()
            return
        if self.k[self.i] == "[" and self.k[self.i + 1] in NAMES and self.k[self.i + 2] in ":" + S("in"):
            self.tree()
        else:
            self.property_name()
        while self.k[self.i] in "+-?":
            self.i += 1
        if self.k[self.i] in "(<":
            self.type_parameters()
            self.parameters()
        self.annotation()

    def statement(self) -> None:
        c = self.k[self.i]
        n = self.k[self.i + 1]
        if c == S("enum"):
            self.i += 1
            self.name()
            self.need("{", "{")
            self.comma_list(self.enumerator, "}", "}")
        elif c == NAME and self.i + 1 not in self.after_line and (n in S("class enum function const var let async") or n == NAME or n == STRING or n in SOFT):
            after = self.k[self.i + 2]
            if n in S("class enum function const var async") or n == S("let"):
                self.i += 1  # abstract, declare
                self.statement()
            elif after == "=" or after == "<" and self.k[self.closing_angle(self.i + 2) + 1] == "=":  # a type alias
                self.i += 2
                self.type_parameters()
                self.need("=", "=")
                self.type()
                self.end_statement()
            elif after in "{<" or after == S("extends"):  # an interface, or a namespace
                self.i += 2
                self.type_parameters()
                if self.eat(S("extends")):
                    self.type()
                    while self.eat(","):
                        self.type()
                at = self.i
                if not self.attempt(self.type_body):
                    self.i = at
                    self.need("{", "{")
                    self.statements(self.module_item, "}")
                    self.i += 1
            elif after == ".":
                self.i += 2
                while self.eat("."):
                    self.name()
                self.need("{", "{")
                self.statements(self.module_item, "}")
                self.i += 1
            elif n == STRING and after == "{":
                self.i += 2
                self.need("{", "{")
                self.statements(self.module_item, "}")
                self.i += 1
            elif n == NAME and (after in NAMES or after in "{") or n == NAME and self.k[self.i + 2] == STRING:
                self.i += 1  # declare before interface, type, namespace
                self.statement()
            else:
                super().statement()
        else:
            super().statement()

    def closing_angle(self, at: int) -> int:
        depth = 0
        for i in range(at, min(at + 400, len(self.k))):
            if self.k[i] == "<":
                depth += 1
            elif self.k[i] == ">":
                depth -= 1
                if not depth:
                    return i
        return at

    def enumerator(self) -> None:
        self.property_name()
        if self.eat("="):
            self.assignment()
