"""C and Java."""

from __future__ import annotations

import re

from intentlake.llm.syntax.base import END, NAME, NUMBER, STRING, Alphabet, Failure, Kinds, Parser

OPERATORS = "( ) { } [ ] ; , . : ? = + - * / % < > ! & | ^ ~ @ # == != <= >= && || ++ -- -> << ... += -= *= /= %= &= |= ^= <<= :: ->* $"
C_STRING = r'(?:[uUL]|u8)?"(?:[^"\\\n]|\\(?:.|\n))*"|(?:[uUL])?\'(?:[^\'\\\n]|\\.)+\''
PUNCTUATION = r"<<=|\.\.\.|->|\+\+|--|&&|\|\||[=!<>+\-*/%&|^]=|<<|::|[^\s\w]"
C_NUMBER = r"(?:0[xX][\da-fA-F_]+(?:\.[\da-fA-F]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[uUlLfFdD]{0,3}"


def binary_levels(alphabet: Alphabet, *levels: str) -> dict[str, int]:
    """Precedences, the first level the weakest."""
    return {alphabet.of[op]: n for n, level in enumerate(levels, 1) for op in level.split()}


C = Alphabet(
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Atomic _Noreturn _Static_assert _Alignas _Alignof _Generic _Thread_local __attribute__ __inline __restrict",
    OPERATORS,
)


class CParser(Parser):
    pattern = re.compile(
        rf"\s*([^\W\d]\w*(?!\w|[\"'])|[(){{}};,\[\]]|{C_STRING}|(?<!\S)\#(?:[^\n\\]|\\\r?\n|\\.)*|//(?:[^\n\\]|\\\r?\n|\\.)*|/\*.*?\*/|\.?\d(?:[eEpP][+-]|[\w.])*|{PUNCTUATION}|\w+|\S)", re.DOTALL
    )
    kinds = Kinds(C.of, C_NUMBER, "\"'", ("//", "/*", "#"))
    assign = frozenset(C("= += -= *= /= %= &= |= ^= <<="))
    binary = binary_levels(C, "||", "&&", "|", "^", "&", "== !=", "< > <= >=", "<<", "+ -", "* / %")
    prefix = frozenset(C("+ - ! ~ * & ++ --"))
    storage = frozenset(C("auto register static extern typedef inline const volatile restrict _Noreturn _Atomic _Thread_local __inline __restrict"))
    base_types = frozenset(C("char double float int long short signed unsigned void _Bool"))
    starts_type = storage | base_types | frozenset(C("struct union enum"))

    def after_operator(self, op: str) -> None:
        if op == ">" and self.k[self.i] == ">":  # lexed one by one for the sake of Java's type arguments
            self.i += 1

    # types and declarators

    def attributes(self) -> None:
        while self.eat(C("__attribute__")) or self.eat(C("_Alignas")):
            if self.k[self.i] != "(":
                self.fail("expected ( after an attribute")
            self.tree()

    def specifiers(self) -> None:
        seen = False
        while True:
            self.attributes()
            c = self.k[self.i]
            if c in self.storage:
                self.i += 1
            elif c in self.base_types:
                self.i += 1
                seen = True
            elif c in C("struct union enum"):
                self.aggregate(c == C("enum"))
                seen = True
            elif c == NAME and not seen:
                self.i += 1
                seen = True
            else:
                break
        if not seen:
            self.fail("expected a type")

    def aggregate(self, is_enum: bool) -> None:
        self.i += 1
        self.attributes()
        named = self.eat(NAME)
        if self.eat("{"):
            if is_enum:
                self.comma_list(self.enumerator, "}", "}")
            else:
                self.statements(self.field, "}")
                self.i += 1
            self.attributes()
        elif not named:
            self.fail("expected a name or {")

    def enumerator(self) -> None:
        self.need(NAME, "a name")
        if self.eat("="):
            self.conditional()

    def field(self) -> None:
        if self.eat(";"):
            return
        self.specifiers()
        while self.k[self.i] != ";":
            if self.k[self.i] != ":":
                self.declarator(False)
            if self.eat(":"):
                self.conditional()
            if not self.eat(","):
                break
        self.need(";", ";")

    def declarator(self, abstract: bool) -> None:
        while self.k[self.i] in C("* ^"):
            self.i += 1
            while self.k[self.i] in self.storage:
                self.i += 1
        self.attributes()
        c = self.k[self.i]
        if c == NAME:
            self.i += 1
        elif c == "(" and (not abstract or self.k[self.i + 1] in "*(^"):
            self.i += 1
            self.declarator(abstract)
            self.need(")", ")")
        elif not abstract:
            self.fail("expected a name")
        while True:
            if self.eat("("):
                self.comma_list(self.parameter, ")", ")", trailing=False)
            elif self.eat("["):
                while self.k[self.i] in self.storage:
                    self.i += 1
                if self.k[self.i] != "]":
                    self.assignment()
                self.need("]", "]")
            else:
                break
        self.attributes()

    def parameter(self) -> None:
        if not self.eat(C("...")):
            self.specifiers()
            self.declarator(True)

    def type_name(self) -> None:
        self.specifiers()
        self.declarator(True)

    def initializer(self) -> None:
        if self.eat("{"):
            self.comma_list(self.element, "}", "}")
        else:
            self.assignment()

    def element(self) -> None:
        while self.k[self.i] in ".[":
            if self.eat("."):
                self.need(NAME, "a field")
            else:
                self.i += 1
                self.conditional()
                self.need("]", "]")
            if self.k[self.i] not in ".[":
                self.need("=", "=")
                break
        self.initializer()

    def declaration(self, top: bool = False) -> None:
        self.specifiers()
        if self.eat(";"):
            return
        first = True
        while True:
            at = self.i
            self.declarator(False)
            if first and top and self.k[self.i] == "{":
                if self.k[self.i - 1] != ")" or self.i - at < 3:
                    self.fail("expected a parameter list before the body")
                self.block()
                return
            first = False
            if self.eat("="):
                self.initializer()
            if not self.eat(","):
                break
        self.need(";", ";")

    # statements

    def unit(self) -> None:
        self.statements(self.external, END)

    def external(self) -> None:
        if self.eat(";"):
            return
        if self.k[self.i] == C("extern") and self.k[self.i + 1] == STRING:
            self.i += 2
            if self.eat("{"):
                self.statements(self.external, "}")
                self.i += 1
                return
        if self.eat(C("_Static_assert")):
            self.tree()
            self.need(";", ";")
            return
        self.declaration(top=True)

    def block(self) -> None:
        self.need("{", "{")
        self.statements(self.statement, "}")
        self.i += 1

    def parenthesis(self) -> None:
        self.need("(", "(")
        self.comma_expression()
        self.need(")", ")")

    def starts_declaration(self) -> bool:
        c = self.k[self.i]
        if c in self.starts_type:
            return True
        if c != NAME:
            return False
        j = self.i + 1
        while self.k[j] == "*":
            j += 1
        return self.k[j] == NAME and (j == self.i + 1 or self.k[j + 1] in "=;,[")

    def statement(self) -> None:
        c = self.k[self.i]
        if c == "{":
            self.block()
        elif c == ";":
            self.i += 1
        elif c == C("if"):
            self.i += 1
            self.parenthesis()
            self.statement()
            if self.eat(C("else")):
                self.statement()
        elif c == C("while") or c == C("switch"):
            self.i += 1
            self.parenthesis()
            self.statement()
        elif c == C("do"):
            self.i += 1
            self.statement()
            self.need(C("while"), "while")
            self.parenthesis()
            self.need(";", ";")
        elif c == C("for"):
            self.i += 1
            self.need("(", "(")
            if self.starts_declaration():
                self.declaration()
            else:
                if self.k[self.i] != ";":
                    self.comma_expression()
                self.need(";", ";")
            if self.k[self.i] != ";":
                self.comma_expression()
            self.need(";", ";")
            if self.k[self.i] != ")":
                self.comma_expression()
            self.need(")", ")")
            self.statement()
        elif c == C("case"):
            self.i += 1
            self.conditional()
            if self.eat(C("...")):
                self.conditional()
            self.need(":", ":")
        elif c == C("default"):
            self.i += 1
            self.need(":", ":")
        elif c == C("return"):
            self.i += 1
            if self.k[self.i] != ";":
                self.comma_expression()
            self.need(";", ";")
        elif c in C("break continue"):
            self.i += 1
            self.need(";", ";")
        elif c == C("goto"):
            self.i += 1
            self.need(NAME, "a label")
            self.need(";", ";")
        elif c == NAME and self.k[self.i + 1] == ":":
            self.i += 2
        elif self.starts_declaration():
            self.declaration()
        else:
            self.comma_expression()
            self.need(";", ";")

    # expressions

    def comma_expression(self) -> None:
        self.assignment()
        while self.eat(","):
            self.assignment()

    def assignment(self) -> None:
        self.conditional()
        while self.k[self.i] in self.assign:
            self.i += 1
            self.conditional()

    def conditional(self) -> None:
        self.expression(1)
        if self.eat("?"):
            if self.k[self.i] != ":":
                self.comma_expression()
            self.need(":", ":")
            self.assignment()

    def is_cast(self) -> bool:
        c = self.k[self.i + 1]
        if c in self.starts_type:
            return True
        if c != NAME:
            return False
        j = self.i + 2
        while self.k[j] == "*":
            j += 1
        return self.k[j] == ")" and (self.k[j + 1] in (NAME, NUMBER, STRING) or self.k[j + 1] in "(!~{" + C("sizeof") and j > self.i + 2 or self.k[j + 1] in "!~{")

    def operand(self) -> None:
        c = self.k[self.i]
        if c == NAME or c == NUMBER:
            self.i += 1
        elif c == STRING:
            while self.k[self.i] in (STRING, NAME):
                self.i += 1
        elif c == "(":
            if self.is_cast():
                self.i += 1
                self.type_name()
                self.need(")", ")")
                if self.k[self.i] == "{":
                    self.initializer()
                else:
                    self.unary()
                    return
            elif self.k[self.i + 1] == "{":
                self.tree()
            else:
                self.parenthesis()
        elif c in C("sizeof _Alignof"):
            self.i += 1
            if self.k[self.i] == "(" and self.is_cast():
                self.tree()
            else:
                self.unary()
            return
        elif c == C("_Generic"):
            self.i += 1
            self.tree()
        else:
            self.fail("expected an expression")
        self.postfix()

    def postfix(self) -> None:
        while True:
            c = self.k[self.i]
            if c == "(":
                self.i += 1
                self.comma_list(self.assignment, ")", ")", trailing=False)
            elif c == "[":
                self.i += 1
                self.comma_expression()
                self.need("]", "]")
            elif c == "." or c == C("->"):
                self.i += 1
                self.need(NAME, "a field")
            elif c in C("++ --"):
                self.i += 1
            else:
                return


J = Alphabet(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for if goto implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null",
    OPERATORS,
)


class JavaParser(CParser):
    pattern = re.compile(
        r"\s*([^\W\d][\w$]*|[(){};,\[\]]|\"\"\"(?:[^\\]|\\.)*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\u+[\da-fA-F]{4}|\\[0-7]{1,3}|\\.)'|//[^\n]*|/\*.*?\*/|\.?\d(?:[eEpP][+-]|[\w.])*|" + PUNCTUATION + r"|\$[\w$]*|\S)", re.DOTALL
    )
    kinds = Kinds(J.of, C_NUMBER, "\"'", ("//", "/*"), r"[^\W\d][\w$]*|\$[\w$]+")
    assign = frozenset(J("= += -= *= /= %= &= |= ^= <<="))
    binary = binary_levels(J, "||", "&&", "|", "^", "&", "== !=", "< > <= >= instanceof", "<<", "+ -", "* / %")
    prefix = frozenset(J("+ - ! ~ ++ --"))
    primitives = frozenset(J("boolean byte char double float int long short"))
    modifiers = frozenset(J("abstract final native private protected public static strictfp synchronized transient volatile default"))

    def after_operator(self, op: str) -> None:
        if op == ">" and self.eat(">"):
            self.eat(">")

    def operators(self, least: int) -> None:
        while True:
            op = self.k[self.i]
            precedence = self.binary.get(op)
            if precedence is None or precedence < least:
                return
            if op == ">" and (self.k[self.i + 1] == J(">=") or self.k[self.i + 1 : self.i + 3] == ">" + J(">=")):  # >>= and >>>=
                return
            self.i += 1
            if op == J("instanceof"):
                self.eat(J("final"))
                self.type()
                if self.k[self.i] == "(":
                    self.tree()
                self.eat(NAME)
                continue
            self.after_operator(op)
            self.expression(precedence + 1)

    # types

    def qualified(self) -> None:
        self.need(NAME, "a name")
        while self.k[self.i] == "." and self.k[self.i + 1] == NAME:
            self.i += 2

    def type_arguments(self) -> None:
        self.need("<", "<")
        while not self.eat(">"):
            self.annotations()
            if self.eat("?"):
                if self.k[self.i] in J("extends super"):
                    self.i += 1
                    self.type()
            else:
                self.type()
            while self.eat("&"):
                self.type()
            if not self.eat(","):
                self.need(">", ">")
                return

    def type_parameters(self) -> None:
        self.need("<", "<")
        while not self.eat(">"):
            self.annotations()
            self.need(NAME, "a type parameter")
            if self.eat(J("extends")):
                self.type()
                while self.eat("&"):
                    self.type()
            if not self.eat(","):
                self.need(">", ">")
                return

    def type(self) -> None:
        self.annotations()
        if self.k[self.i] in self.primitives or self.k[self.i] == J("void"):
            self.i += 1
        else:
            self.need(NAME, "a type")
            while True:
                if self.k[self.i] == "<":
                    self.type_arguments()
                if self.k[self.i] == "." and self.k[self.i + 1] == NAME:
                    self.i += 2
                else:
                    break
        self.dimensions()

    def dimensions(self) -> None:
        while self.k[self.i] == "[" and self.k[self.i + 1] == "]":
            self.i += 2

    def annotations(self) -> None:
        while self.k[self.i] == "@" and self.k[self.i + 1] == NAME:
            self.i += 1
            self.qualified()
            if self.k[self.i] == "(":
                self.tree()

    def modifier_list(self) -> None:
        while True:
            self.annotations()
            c = self.k[self.i]
            if c in self.modifiers and not (c == J("default") and self.k[self.i + 1] in ":" + J("->")):
                self.i += 1
            elif c == NAME and self.k[self.i + 1] in J("class interface"):  # sealed
                self.i += 1
            elif c == NAME and self.k[self.i + 1] == "-" and self.k[self.i + 2] == NAME and self.k[self.i + 3] in J("class interface public abstract static"):  # non-sealed
                self.i += 3
            else:
                return

    # declarations

    def unit(self) -> None:
        self.statements(self.external, END)

    def external(self) -> None:
        if self.eat(";"):
            return
        if self.k[self.i] == J("import"):
            self.i += 1
            self.eat(J("static"))
            self.qualified()
            if self.eat("."):
                self.need("*", "*")
            self.need(";", ";")
            return
        self.modifier_list()
        if self.eat(J("package")):
            self.qualified()
            self.need(";", ";")
            return
        if not self.type_declaration():
            self.fail("expected a class, interface, enum or record")

    def type_declaration(self) -> bool:
        c = self.k[self.i]
        if c == J("class") or c == J("interface") or c == "@" and self.k[self.i + 1] == J("interface"):
            self.i += 2 if c == "@" else 1
            self.need(NAME, "a name")
            if self.k[self.i] == "<":
                self.type_parameters()
            self.heritage()
            self.class_body()
        elif c == J("enum"):
            self.i += 1
            self.need(NAME, "a name")
            self.heritage()
            self.enum_body()
        elif c == NAME and self.k[self.i + 1] == NAME and self.k[self.i + 2] in "(<" and self.is_record():
            self.i += 2
            if self.k[self.i] == "<":
                self.type_parameters()
            self.need("(", "(")
            self.comma_list(self.parameter, ")", ")", trailing=False)
            self.heritage()
            self.class_body()
        else:
            return False
        return True

    def is_record(self) -> bool:
        close = self.k.find("(", self.i)
        close = self.closing(close) if close >= 0 else -1
        return close > 0 and (self.k[close + 1] == "{" or self.k[close + 1] == J("implements"))

    def heritage(self) -> None:
        while self.k[self.i] in J("extends implements") or self.k[self.i] == NAME:
            self.i += 1
            self.type()
            while self.eat(","):
                self.type()

    def class_body(self) -> None:
        self.need("{", "{")
        self.statements(self.member, "}")
        self.i += 1

    def enum_body(self) -> None:
        self.need("{", "{")
        while self.k[self.i] not in ";}":
            self.annotations()
            self.need(NAME, "a constant")
            if self.eat("("):
                self.comma_list(self.assignment, ")", ")", trailing=False)
            if self.k[self.i] == "{":
                self.class_body()
            if not self.eat(","):
                break
        if self.eat(";"):
            self.statements(self.member, "}")
        self.need("}", "}")

    def member(self) -> None:
        if self.eat(";"):
            return
        if self.k[self.i] == "{" or self.k[self.i] == J("static") and self.k[self.i + 1] == "{":
            self.eat(J("static"))
            self.block()
            return
        self.modifier_list()
        if self.type_declaration():
            return
        if self.k[self.i] == "<":
            self.type_parameters()
        if self.k[self.i] == NAME and self.k[self.i + 1] in "({":  # a constructor
            self.i += 1
            if self.k[self.i] == "{":
                self.block()
                return
            self.method_rest()
            return
        self.type()
        self.need(NAME, "a name")
        if self.k[self.i] == "(":
            self.method_rest()
        else:
            self.variables()
            self.need(";", ";")

    def method_rest(self) -> None:
        self.need("(", "(")
        self.comma_list(self.parameter, ")", ")", trailing=False)
        self.dimensions()
        if self.eat(J("throws")):
            self.type()
            while self.eat(","):
                self.type()
        if self.eat(J("default")):
            self.assignment()
        if not self.eat(";"):
            self.block()

    def parameter(self) -> None:
        self.modifier_list()
        self.type()
        self.annotations()
        self.eat(J("..."))
        if not self.eat(J("this")):
            self.need(NAME, "a parameter")
        self.dimensions()

    def variables(self) -> None:
        """After the first name."""
        while True:
            self.dimensions()
            if self.eat("="):
                self.initializer()
            if not self.eat(","):
                return
            self.need(NAME, "a name")

    def initializer(self) -> None:
        if self.eat("{"):
            self.comma_list(self.initializer, "}", "}")
        else:
            self.assignment()

    # statements

    def local(self) -> None:
        self.modifier_list()
        self.type()
        self.need(NAME, "a name")
        self.variables()

    def starts_declaration(self) -> bool:
        c = self.k[self.i]
        if c in self.modifiers and c != J("synchronized") or c == "@":
            return True
        if c in self.primitives:
            return self.k[self.i + 1] == NAME or self.k[self.i + 1] == "["
        if c != NAME:
            return False
        if self.k[self.i + 1] == NAME:
            return True
        if self.k[self.i + 1] not in "<.[":
            return False
        at = self.i
        try:
            self.type()
            return self.k[self.i] == NAME
        except Failure:
            return False
        finally:
            self.i = at

    def statement(self) -> None:
        c = self.k[self.i]
        if c == J("for"):
            self.i += 1
            self.need("(", "(")
            if self.starts_declaration():
                self.local()
                if self.eat(":"):
                    self.assignment()
                    self.need(")", ")")
                    self.statement()
                    return
            elif self.k[self.i] != ";":
                self.comma_expression()
            self.need(";", ";")
            if self.k[self.i] != ";":
                self.assignment()
            self.need(";", ";")
            if self.k[self.i] != ")":
                self.comma_expression()
            self.need(")", ")")
            self.statement()
        elif c == "{":
            self.block()
        elif c == ";":
            self.i += 1
        elif c == J("if"):
            self.i += 1
            self.parenthesis()
            self.statement()
            if self.eat(J("else")):
                self.statement()
        elif c == J("while"):
            self.i += 1
            self.parenthesis()
            self.statement()
        elif c == J("do"):
            self.i += 1
            self.statement()
            self.need(J("while"), "while")
            self.parenthesis()
            self.need(";", ";")
        elif c == J("switch"):
            self.switch()
            if self.k[self.i] == ".":
                self.postfix()
                self.need(";", ";")
        elif c == J("try"):
            self.i += 1
            resources = self.eat("(")
            while resources and not self.eat(")"):
                if self.starts_declaration():
                    self.local()
                else:
                    self.assignment()
                if not self.eat(";"):
                    self.need(")", ")")
                    break
            self.block()
            handled = resources
            while self.eat(J("catch")):
                self.need("(", "(")
                self.modifier_list()
                self.type()
                while self.eat("|"):
                    self.type()
                self.need(NAME, "a name")
                self.need(")", ")")
                self.block()
                handled = True
            if self.eat(J("finally")):
                self.block()
                handled = True
            if not handled:
                self.fail("expected catch or finally")
        elif c == J("synchronized") and self.k[self.i + 1] == "(":
            self.i += 1
            self.parenthesis()
            self.block()
        elif c == J("return") or c == J("throw"):
            self.i += 1
            if self.k[self.i] != ";" or c == J("throw"):
                self.assignment()
            self.need(";", ";")
        elif c in J("break continue"):
            self.i += 1
            self.eat(NAME)
            self.need(";", ";")
        elif c == J("assert"):
            self.i += 1
            self.assignment()
            if self.eat(":"):
                self.assignment()
            self.need(";", ";")
        elif c == NAME and self.k[self.i + 1] == ":":
            self.i += 2
            self.statement()
        elif c in J("class interface enum abstract"):
            self.modifier_list()
            self.type_declaration() or self.fail("expected a class")
        elif self.starts_declaration():
            at = self.i
            self.modifier_list()
            if not self.type_declaration():
                self.i = at
                self.local()
                self.need(";", ";")
        elif c == NAME and self.k[self.i + 1] in (NAME, NUMBER, STRING):  # yield
            self.i += 1
            self.assignment()
            self.need(";", ";")
        else:
            at = self.i
            self.assignment()
            changes = self.k[self.i - 1] in ")" + J("++ --") or self.k[at] in J("++ -- new") or self.assigned
            if not changes:
                self.i = at
                self.fail("not a statement")
            self.need(";", ";")

    def switch(self) -> None:
        self.i += 1
        self.parenthesis()
        self.need("{", "{")
        while not self.eat("}"):
            if self.eat(J("default")):
                pass
            else:
                self.need(J("case"), "case")
                while True:
                    if self.eat(J("default")):
                        pass
                    elif self.starts_declaration() or self.k[self.i] == NAME and self.k[self.i + 1] == "(":
                        self.type()
                        if self.k[self.i] == "(":
                            self.tree()
                        self.eat(NAME)
                        if self.eat(NAME):  # when
                            self.conditional()
                    else:
                        self.conditional_value()
                    if not self.eat(","):
                        break
            if self.eat(J("->")):
                if self.k[self.i] == "{":
                    self.block()
                elif self.k[self.i] == J("throw"):
                    self.statement()
                else:
                    self.assignment()
                    self.need(";", ";")
                continue
            self.need(":", ":")
            while self.k[self.i] not in "}" + J("case") and not (self.k[self.i] == J("default")):
                if self.k[self.i] == END:
                    self.fail("the text ends inside a switch")
                self.statement()

    def conditional_value(self) -> None:
        self.expression(1)

    # expressions

    assigned = False

    def assignment(self) -> None:
        self.assigned = False
        self.conditional()
        while True:
            if self.k[self.i] in self.assign:
                self.i += 1
            elif self.k[self.i : self.i + 2] == ">" + J(">="):
                self.i += 2
            elif self.k[self.i : self.i + 3] == ">>" + J(">="):
                self.i += 3
            else:
                return
            self.conditional()
            self.assigned = True

    def lambda_body(self) -> None:
        if self.k[self.i] == "{":
            self.block()
        else:
            self.assignment()

    def operand(self) -> None:
        c = self.k[self.i]
        if c == NAME:
            if self.k[self.i + 1] == J("->"):
                self.i += 2
                self.lambda_body()
                return
            if self.k[self.i + 1] in "<[" and self.attempt(self.typed_reference):
                self.postfix()
                return
            self.i += 1
        elif c in (NUMBER, STRING) or c in J("this super true false null"):
            self.i += 1
        elif c == "(":
            close = self.closing(self.i)
            if close > 0 and self.k[close + 1] == J("->"):
                self.i += 1
                if self.k[self.i] == NAME and self.k[self.i + 1] in ",)":
                    self.comma_list(lambda: self.need(NAME, "a parameter"), ")", ")", trailing=False)
                else:
                    self.comma_list(self.parameter, ")", ")", trailing=False)
                self.i += 1
                self.lambda_body()
                return
            if self.attempt(self.cast):
                self.unary()
                return
            self.i += 1
            self.assignment()
            self.need(")", ")")
        elif c == J("new"):
            self.i += 1
            self.creation()
        elif c == J("switch"):
            self.switch()
        elif c in self.primitives or c == J("void"):
            self.type()
            if self.k[self.i] not in "." + J("::"):
                self.fail("expected .class")
        else:
            self.fail("expected an expression")
        self.postfix()

    def typed_reference(self) -> None:
        """Type<Args>::name, Type[]::new or Type[].class"""
        self.type()
        if self.k[self.i] != J("::") and not (self.k[self.i] == "." and self.k[self.i + 1] == J("class")):
            self.fail("no reference")

    def cast(self) -> None:
        self.i += 1
        primitive = self.k[self.i] in self.primitives
        self.type()
        while self.eat("&"):
            self.type()
        self.need(")", ")")
        c = self.k[self.i]
        if not (c in (NAME, NUMBER, STRING) or c in "(!~" + J("this super true false null new switch") or primitive and c in J("+ - ++ --") or c in self.primitives):
            self.fail("no cast")

    def creation(self) -> None:
        self.annotations()
        if self.k[self.i] in self.primitives:
            self.i += 1
        else:
            self.need(NAME, "a type")
            while True:
                if self.k[self.i] == "<":
                    self.type_arguments()
                if self.k[self.i] == "." and self.k[self.i + 1] == NAME:
                    self.i += 2
                else:
                    break
        if self.eat("("):
            self.comma_list(self.assignment, ")", ")", trailing=False)
            if self.k[self.i] == "{":
                self.class_body()
            return
        if self.k[self.i] != "[":
            self.fail("expected ( or [")
        sized = False
        while self.eat("["):
            if self.k[self.i] != "]":
                self.assignment()
                sized = True
            self.need("]", "]")
        if not sized:
            self.need("{", "{")
            self.comma_list(self.initializer, "}", "}")

    def postfix(self) -> None:
        while True:
            c = self.k[self.i]
            if c == "(":
                self.i += 1
                self.comma_list(self.assignment, ")", ")", trailing=False)
            elif c == "[":
                self.i += 1
                self.assignment()
                self.need("]", "]")
            elif c == ".":
                self.i += 1
                if self.k[self.i] == "<":
                    self.type_arguments()
                if self.eat(J("new")):
                    self.creation()
                elif self.k[self.i] in J("class this super"):
                    self.i += 1
                else:
                    self.need(NAME, "a member")
            elif c == J("::"):
                self.i += 1
                if self.k[self.i] == "<":
                    self.type_arguments()
                if not self.eat(J("new")):
                    self.need(NAME, "a method")
            elif c in J("++ --"):
                self.i += 1
            else:
                return
