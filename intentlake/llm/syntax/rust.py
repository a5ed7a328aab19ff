"""Rust."""

from __future__ import annotations

import re

from intentlake.llm.syntax.base import END, NAME, NUMBER, STRING, Alphabet, Kinds, Parser
from intentlake.llm.syntax.cfamily import binary_levels

R = Alphabet(
    "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn union macro_rules _ lifetime",
    "( ) { } [ ] ; , . : ? = + - * / % < > ! & | ^ ~ @ # $ == != <= >= && || << :: -> => .. ..= ... += -= *= /= %= &= |= ^= <<=",
)
LIFE = R("lifetime")
NAMES = frozenset(NAME + R("union macro_rules"))
PATHS = frozenset(NAME + R("union macro_rules self Self super crate"))


class RustKinds(Kinds):
    def __missing__(self, token: str) -> str:
        if token[0] == "'" and (len(token) < 3 or token[-1] != "'"):
            return LIFE
        if token[-1] == "#" and '"' in token:
            return STRING
        if token.startswith("r#") and token[-1] not in '"#':
            return NAME
        return super().__missing__(token)


class RustParser(Parser):
    pattern = re.compile(
        r"\s*((?!b?r#*\"|b[\"']|c\")(?:r\#)?[^\W\d]\w*|[(){};,\[\]]|[bc]?\"(?:[^\"\\]|\\.)*\"|[bc]?r\"[^\"]*\"|[bc]?r\#\"(?:.*?)\"\#|[bc]?r\#\#\"(?:.*?)\"\#\#|b?'(?:[^'\\\n]|\\u\{[\da-fA-F_]+\}|\\x..|\\.)'|'[^\W\d]\w*|//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*.*?\*/)*\*/|\d[\w]*(?:\.\d\w*|(?<=[eE])[+-]\d+|\.(?![.\w]))*|\.\.=|\.\.\.|<<=|::|->|=>|\.\.|&&|\|\||[=!<>+\-*/%&|^]=|<<|\S)",
        re.DOTALL,
    )
    kinds = RustKinds(
        R.of | {"lifetime": NAME},
        r"(?:0x[\da-fA-F_]+|0o[0-7_]+|0b[01_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:_*(?:[iu](?:8|16|32|64|128|size)|f32|f64))?",
        "\"'",
        ("//", "/*"),
    )
    assign = frozenset(R("= += -= *= /= %= &= |= ^= <<="))
    binary = binary_levels(R, ".. ..=", "||", "&&", "== != < > <= >=", "|", "^", "&", "<<", "+ -", "* / %", "as")
    literals = frozenset(NUMBER + STRING + R("true false"))

    def start(self, kinds: str) -> None:
        super().start(kinds)
        self.no_struct = False

    # items

    def unit(self) -> None:
        self.statements(self.item_or_fail, END)

    def item_or_fail(self) -> None:
        if self.eat(";"):
            return
        if not self.item():
            self.fail("expected an item")

    def attributes(self) -> None:
        while self.k[self.i] == "#" and (self.k[self.i + 1] == "[" or self.k[self.i + 1 : self.i + 3] == "!["):
            self.i += 1
            self.eat("!")
            self.tree()

    def item(self) -> bool:
        at = self.i
        self.attributes()
        if self.i > at and self.k[self.i] in "}" + END and self.k[at + 1] == "!":
            return True
        if self.eat(R("pub")) and self.k[self.i] == "(" and self.k[self.i + 1] in R("crate super self in"):
            self.tree()
        if self.k[self.i] == NAME and self.k[self.i + 1] in R("fn unsafe impl trait type const"):
            self.i += 1  # default, auto
        c = self.k[self.i]
        n = self.k[self.i + 1]
        if c == R("use"):
            self.i += 1
            self.use_tree()
            self.need(";", ";")
        elif c == R("mod") or c == R("unsafe") and n == R("mod"):
            self.eat(R("unsafe"))
            self.i += 1
            self.need(NAME, "a name")
            if not self.eat(";"):
                self.need("{", "{")
                self.statements(self.item_or_fail, "}")
                self.i += 1
        elif c == R("fn") or c in R("const async unsafe extern") and (n in R("fn async unsafe extern") or n == STRING and self.k[self.i + 2] == R("fn")) and not (c == R("extern") and n == STRING and self.k[self.i + 2] == "{"):
            self.function()
        elif c == R("struct") or c == R("union") and n == NAME and self.k[self.i + 2] in "{<":
            self.i += 1
            self.need(NAME, "a name")
            self.generics()
            self.where()
            if self.eat("("):
                self.comma_list(self.tuple_field, ")", ")")
                self.where()
                self.need(";", ";")
            elif not self.eat(";"):
                self.need("{", "{ or ;")
                self.comma_list(self.field, "}", "}")
        elif c == R("enum"):
            self.i += 1
            self.need(NAME, "a name")
            self.generics()
            self.where()
            self.need("{", "{")
            self.comma_list(self.variant, "}", "}")
        elif c == R("trait") or c == R("unsafe") and n == R("trait"):
            self.eat(R("unsafe"))
            self.i += 1
            self.need(NAME, "a name")
            self.generics()
            if self.eat(":"):
                self.bounds()
            self.where()
            self.need("{", "{")
            self.statements(self.associated, "}")
            self.i += 1
        elif c == R("impl") or c == R("unsafe") and n == R("impl"):
            self.eat(R("unsafe"))
            self.i += 1
            if self.k[self.i] == "<" and self.k[self.i + 1] in ">#" + NAME + LIFE + R("const"):
                self.generics()
            self.eat("!")
            self.type()
            if self.eat(R("for")):
                self.type()
            self.where()
            self.need("{", "{")
            self.statements(self.associated, "}")
            self.i += 1
        elif c == R("type"):
            self.i += 1
            self.need(NAME, "a name")
            self.generics()
            if self.eat(":"):
                self.bounds()
            self.where()
            if self.eat("="):
                self.type()
            self.where()
            self.need(";", ";")
        elif c in R("const static") and (n in NAMES or n in R("mut _")):
            self.i += 1
            self.eat(R("mut"))
            if not self.eat(R("_")):
                self.need(NAME, "a name")
            self.need(":", ":")
            self.type()
            if self.eat("="):
                self.value()
            self.need(";", ";")
        elif c == R("extern"):
            self.i += 1
            if self.eat(R("crate")):
                self.i += 1
                if self.eat(R("as")):
                    self.i += 1
                self.need(";", ";")
            else:
                self.eat(STRING)
                self.need("{", "{")
                self.statements(self.associated, "}")
                self.i += 1
        elif c == R("macro_rules") and n == "!":
            self.i += 2
            self.need(NAME, "a name")
            brace = self.k[self.i] == "{"
            self.tree()
            if not brace:
                self.need(";", ";")
        elif c in PATHS and (n == "!" or n == R("::")) and self.at_macro():
            while self.k[self.i] != "!":
                self.i += 1
            self.i += 1
            if self.k[self.i] not in "([{":
                self.fail("expected the macro's arguments")
            brace = self.k[self.i] == "{"
            self.tree()
            if not brace:
                self.need(";", ";")
        else:
            if self.i > at:
                self.fail("expected an item")
            return False
        return True

    def at_macro(self) -> bool:
        j = self.i
        while self.k[j] in PATHS and self.k[j + 1] == R("::"):
            j += 2
        return self.k[j] in PATHS and self.k[j + 1] == "!" and self.k[j + 2] in "([{"

    def associated(self) -> None:
        if not self.item():
            self.fail("expected a member")

    def use_tree(self) -> None:
        self.eat(R("::"))
        while True:
            if self.eat("{"):
                self.comma_list(self.use_tree, "}", "}")
                return
            if self.eat("*"):
                return
            if self.k[self.i] not in PATHS:
                self.fail("expected a path")
            self.i += 1
            if not self.eat(R("::")):
                break
        if self.eat(R("as")) and not self.eat(R("_")):
            self.need(NAME, "a name")

    def function(self) -> None:
        while self.k[self.i] != R("fn"):
            self.i += 1
        self.i += 1
        self.need(NAME, "a name")
        self.generics()
        self.need("(", "(")
        self.comma_list(self.parameter, ")", ")")
        if self.eat(R("->")):
            self.type()
        self.where()
        if not self.eat(";"):
            self.block()

    def parameter(self) -> None:
        self.attributes()
        at = self.i
        if self.eat("&"):
            self.eat(LIFE)
        self.eat(R("mut"))
        if self.eat(R("self")):
            if self.eat(":"):
                self.type()
            return
        self.i = at
        if self.eat(R("...")):
            return
        self.pattern_()
        self.need(":", ":")
        if not self.eat(R("...")):
            self.type()

    def tuple_field(self) -> None:
        self.attributes()
        if self.eat(R("pub")) and self.k[self.i] == "(" and self.k[self.i + 1] in R("crate super self in"):
            self.tree()
        self.type()

    def field(self) -> None:
        self.attributes()
        if self.eat(R("pub")) and self.k[self.i] == "(":
            self.tree()
        self.need(NAME, "a field")
        self.need(":", ":")
        self.type()

    def variant(self) -> None:
        self.attributes()
        self.need(NAME, "a variant")
        if self.eat("("):
            self.comma_list(self.tuple_field, ")", ")")
        elif self.eat("{"):
            self.comma_list(self.field, "}", "}")
        if self.eat("="):
            self.value()

    def generics(self) -> None:
        if not self.eat("<"):
            return
        while not self.eat(">"):
            self.attributes()
            if self.eat(R("const")):
                self.need(NAME, "a name")
                self.need(":", ":")
                self.type()
                if self.eat("="):
                    self.unary()
            else:
                if not self.eat(LIFE):
                    self.need(NAME, "a parameter")
                if self.eat(":"):
                    self.bounds()
                if self.eat("="):
                    self.type()
            if not self.eat(","):
                self.need(">", ">")
                return

    def bounds(self) -> None:
        while True:
            if self.k[self.i] in ",>={;)" or self.k[self.i] == R("where"):
                return
            if not self.eat(LIFE):
                self.bound()
            if not self.eat("+"):
                return

    def bound(self) -> None:
        if self.eat("("):
            self.bound()
            self.need(")", ")")
            return
        if self.eat("?"):
            pass
        elif self.eat("~"):
            self.need(R("const"), "const")
        self.for_lifetimes()
        self.path_type()

    def for_lifetimes(self) -> None:
        if self.k[self.i] == R("for") and self.k[self.i + 1] == "<":
            self.i += 1
            self.generics()

    def where(self) -> None:
        if not self.eat(R("where")):
            return
        while self.k[self.i] not in "{;=":
            if not self.eat(LIFE):
                self.for_lifetimes()
                self.type()
            self.need(":", ":")
            self.bounds()
            if not self.eat(","):
                return

    # types

    def type(self) -> None:
        c = self.k[self.i]
        if c == "&" or c == R("&&"):
            self.i += 1
            self.eat(LIFE)
            self.eat(R("mut"))
            self.type()
        elif c == "*":
            self.i += 1
            if not self.eat(R("const")):
                self.need(R("mut"), "const or mut")
            self.type()
        elif c == "[":
            self.i += 1
            self.type()
            if self.eat(";"):
                self.value()
            self.need("]", "]")
        elif c == "(":
            self.i += 1
            self.comma_list(self.type_with_bounds, ")", ")")
        elif c == "!" or c == R("_"):
            self.i += 1
        elif c in R("impl dyn"):
            self.i += 1
            self.bounds()
        elif c in R("fn unsafe extern for"):
            self.for_lifetimes()
            self.eat(R("unsafe"))
            if self.eat(R("extern")):
                self.eat(STRING)
            if self.eat(R("fn")):
                self.need("(", "(")
                self.comma_list(self.fn_argument, ")", ")")
                if self.eat(R("->")):
                    self.type()
            else:
                self.path_type()
        else:
            self.path_type()
            if self.k[self.i] == "!" and self.k[self.i + 1] in "([{":
                self.i += 1
                self.tree()

    def type_with_bounds(self) -> None:
        self.type()
        while self.eat("+"):
            if not self.eat(LIFE):
                self.bound()

    def fn_argument(self) -> None:
        if self.k[self.i] in NAMES | {R("_")} and self.k[self.i + 1] == ":":
            self.i += 2
        if not self.eat(R("...")):
            self.type()

    def path_type(self) -> None:
        if self.k[self.i] == "<":
            self.qualified()
        else:
            self.eat(R("::"))
            self.segment()
        while self.k[self.i] == R("::"):
            self.i += 1
            self.segment()

    def qualified(self) -> None:
        self.need("<", "<")
        self.type()
        if self.eat(R("as")):
            self.path_type()
        self.need(">", ">")

    def segment(self) -> None:
        if self.k[self.i] not in PATHS:
            self.fail("expected a type")
        self.i += 1
        if self.k[self.i] == "<":
            self.type_arguments()
        elif self.k[self.i] == R("::") and self.k[self.i + 1] == "<":
            self.i += 1
            self.type_arguments()
        elif self.k[self.i] == "(":
            self.i += 1
            self.comma_list(self.type, ")", ")")
            if self.eat(R("->")):
                self.type()

    def type_arguments(self) -> None:
        self.need("<", "<")
        while not self.eat(">"):
            if self.eat(LIFE):
                pass
            elif self.k[self.i] in self.literals or self.k[self.i] == "-":
                self.eat("-")
                self.i += 1
            elif self.k[self.i] == "{":
                self.block()
            else:
                self.type()
                if self.eat("="):
                    self.type()
                elif self.eat(":"):
                    self.bounds()
                while self.eat("+"):
                    if not self.eat(LIFE):
                        self.bound()
            if not self.eat(","):
                self.need(">", ">")
                return

    # patterns

    def pattern_(self) -> None:
        self.eat("|")
        self.one_pattern()
        while self.eat("|"):
            self.one_pattern()

    def one_pattern(self) -> None:
        c = self.k[self.i]
        if c == R("_"):
            self.i += 1
        elif c in "&" + R("&&"):
            self.i += 1
            self.eat(R("mut"))
            self.one_pattern()
        elif c in R("ref mut"):
            self.eat(R("ref"))
            self.eat(R("mut"))
            self.need(NAME, "a name")
            if self.eat("@"):
                self.one_pattern()
        elif c == "(":
            self.i += 1
            self.comma_list(self.pattern_, ")", ")")
        elif c == "[":
            self.i += 1
            self.comma_list(self.pattern_, "]", "]")
        elif c in R(".. ..="):
            self.i += 1
            if self.k[self.i] in self.literals or self.k[self.i] == "-":
                self.range_end()
        elif c in self.literals or c == "-":
            self.range_end()
            self.maybe_range()
        elif c in PATHS or c in "<" + R("::"):
            simple = c in NAMES
            self.expression_path()
            if self.k[self.i] == "!" and self.k[self.i + 1] in "([{":
                self.i += 1
                self.tree()
            elif self.eat("("):
                self.comma_list(self.pattern_, ")", ")")
            elif self.k[self.i] == "{":
                self.i += 1
                self.comma_list(self.field_pattern, "}", "}")
            elif simple and self.eat("@"):
                self.one_pattern()
            else:
                self.maybe_range()
        elif c == R("const"):
            self.i += 1
            self.block()
        else:
            self.fail("expected a pattern")

    def range_end(self) -> None:
        self.eat("-")
        if self.k[self.i] in self.literals:
            self.i += 1
        else:
            self.expression_path()

    def maybe_range(self) -> None:
        if self.k[self.i] in R(".. ..= ..."):
            self.i += 1
            if self.k[self.i] in self.literals or self.k[self.i] in PATHS or self.k[self.i] == "-":
                self.range_end()

    def field_pattern(self) -> None:
        self.attributes()
        if self.eat(R("..")):
            return
        self.eat(R("ref"))
        self.eat(R("mut"))
        if not self.eat(NUMBER):
            self.need(NAME, "a field")
        if self.eat(":"):
            self.pattern_()

    # statements

    def block(self) -> None:
        self.need("{", "{")
        saved, self.no_struct = self.no_struct, False
        self.statements(self.statement, "}")
        self.no_struct = saved
        self.i += 1

    blocks = frozenset(R("if match while loop for unsafe") + "{" + LIFE)

    def statement(self) -> None:
        if self.eat(";"):
            return
        c = self.k[self.i]
        if c == "#":
            self.attributes()
            c = self.k[self.i]
        if c == R("let"):
            self.i += 1
            self.pattern_()
            if self.eat(":"):
                self.type()
            if self.eat("="):
                self.value()
                if self.eat(R("else")):
                    self.block()
            self.need(";", ";")
            return
        if c in R("use fn struct enum trait impl mod static type pub extern macro_rules") or c in R("const async unsafe") and self.k[self.i + 1] not in "{" + R("move |") and self.k[self.i + 1] != "|":
            if self.item():
                return
        if c in self.blocks or c in R("async const") and self.k[self.i + 1] == "{":
            at = self.i
            self.operand_only()
            if self.k[self.i] in ".?":
                self.postfix()
                self.operators(1)
            elif self.eat(";"):
                return
            elif self.k[at] == "{" or self.k[self.i] == "}" or self.k[self.i] not in self.binary or self.k[self.i] in "*&-|<":
                return
            else:
                self.operators(1)
        else:
            macro = c in PATHS and self.at_macro()
            self.value()
            if macro and self.k[self.i - 1] == "}":
                return
        if self.k[self.i] != "}":
            self.need(";", ";")

    # expressions

    def value(self) -> None:
        self.expression(1)
        if self.k[self.i] in self.assign:
            self.i += 1
            self.value()
        elif self.k[self.i] == ">" and self.k[self.i + 1] == R(">="):
            self.i += 2
            self.value()

    def condition(self) -> None:
        saved, self.no_struct = self.no_struct, True
        self.value()
        self.no_struct = saved

    def operators(self, least: int) -> None:
        while True:
            op = self.k[self.i]
            precedence = self.binary.get(op)
            if precedence is None or precedence < least:
                return
            if op == ">" and self.k[self.i + 1] == R(">="):
                return
            self.i += 1
            if op == R("as"):
                self.type()
                continue
            if op == ">":
                self.eat(">")
            if op in R(".. ..=") and (self.k[self.i] in ")]};," + END + R("=>") or self.k[self.i] == "{" and self.no_struct):
                continue
            self.expression(precedence + 1)

    def unary(self) -> None:
        while True:
            c = self.k[self.i]
            if c in "-!*":
                self.i += 1
            elif c in "&" + R("&&"):
                self.i += 1
                if self.k[self.i] == NAME and self.k[self.i + 1] in R("const mut") and self.k[self.i + 2] not in ".":
                    self.i += 1
                if not self.eat(R("mut")) and self.k[self.i - 1] == NAME:
                    self.eat(R("const"))
            elif c in R(".. ..="):
                self.i += 1
                if self.k[self.i] in ")]};," + R("=>") or self.k[self.i] == "{" and self.no_struct:
                    return
                self.expression(2)
                return
            else:
                break
        self.operand()

    def operand(self) -> None:
        if self.operand_only():
            self.postfix()

    def operand_only(self) -> bool:
        """One operand; False if nothing may be appended to it."""
        c = self.k[self.i]
        if c in PATHS or c in "<" + R("::"):
            self.expression_path()
            if self.k[self.i] == "!" and self.k[self.i + 1] in "([{":
                self.i += 1
                self.tree()
            elif self.k[self.i] == "{" and not self.no_struct:
                self.i += 1
                self.comma_list(self.field_value, "}", "}")
        elif c in self.literals:
            self.i += 1
        elif c == "(":
            self.i += 1
            saved, self.no_struct = self.no_struct, False
            self.comma_list(self.value, ")", ")")
            self.no_struct = saved
        elif c == "[":
            self.i += 1
            saved, self.no_struct = self.no_struct, False
            if not self.eat("]"):
                self.value()
                if self.eat(";"):
                    self.value()
                    self.need("]", "]")
                elif self.eat(","):
                    self.comma_list(self.value, "]", "]")
                else:
                    self.need("]", "]")
            self.no_struct = saved
        elif c == "{":
            self.block()
        elif c == R("if"):
            self.i += 1
            self.condition()
            self.block()
            if self.eat(R("else")):
                if self.k[self.i] == R("if"):
                    self.operand_only()
                else:
                    self.block()
        elif c == R("let"):
            self.i += 1
            self.pattern_()
            self.need("=", "=")
            self.expression(4)
            return False
        elif c == R("match"):
            self.i += 1
            self.condition()
            self.need("{", "{")
            saved, self.no_struct = self.no_struct, False
            while not self.eat("}"):
                self.arm()
            self.no_struct = saved
        elif c == R("while"):
            self.i += 1
            self.condition()
            self.block()
        elif c == R("loop"):
            self.i += 1
            self.block()
        elif c == R("for"):
            self.i += 1
            self.pattern_()
            self.need(R("in"), "in")
            self.condition()
            self.block()
        elif c == LIFE:
            self.i += 1
            self.need(":", ":")
            self.operand_only()
        elif c in R("unsafe const async") and (self.k[self.i + 1] == "{" or self.k[self.i + 1 : self.i + 3] == R("move") + "{"):
            self.i += 1
            self.eat(R("move"))
            self.block()
        elif c in "|" + R("|| move async static"):
            self.eat(R("static"))
            self.eat(R("async"))
            self.eat(R("move"))
            if not self.eat(R("||")):
                self.need("|", "|")
                while not self.eat("|"):
                    self.attributes()
                    self.one_pattern()
                    if self.eat(":"):
                        self.type()
                    if not self.eat(","):
                        self.need("|", "|")
                        break
            if self.eat(R("->")):
                self.type()
                self.block()
            else:
                self.value()
            return False
        elif c in R("break return continue"):
            self.i += 1
            self.eat(LIFE)
            if c != R("continue") and self.k[self.i] not in ")]};," + END + R("=> else") and not (self.k[self.i] == "{" and self.no_struct):
                self.value()
            return False
        else:
            self.fail("expected an expression")
        return True

    def arm(self) -> None:
        self.attributes()
        self.pattern_()
        if self.eat(R("if")):
            self.value()
        self.need(R("=>"), "=>")
        block = self.k[self.i] == "{"
        if block:
            self.block()
            if self.k[self.i] in ".?":
                self.postfix()
                self.operators(1)
                block = False
        else:
            self.value()
        if not self.eat(",") and self.k[self.i] != "}" and not block:
            self.fail("expected , after the arm")

    def field_value(self) -> None:
        self.attributes()
        if self.eat(R("..")):
            if self.k[self.i] != "}":
                self.value()
            return
        if not self.eat(NUMBER):
            self.need(NAME, "a field")
        if self.eat(":"):
            self.value()

    def expression_path(self) -> None:
        if self.k[self.i] == "<":
            self.qualified()
        else:
            self.eat(R("::"))
            if self.k[self.i] not in PATHS:
                self.fail("expected a name")
            self.i += 1
        while self.k[self.i] == R("::"):
            self.i += 1
            if self.k[self.i] == "<":
                self.type_arguments()
            elif self.k[self.i] in PATHS:
                self.i += 1
            else:
                self.fail("expected a name")

    def postfix(self) -> None:
        while True:
            c = self.k[self.i]
            if c == "(":
                self.i += 1
                saved, self.no_struct = self.no_struct, False
                self.comma_list(self.value, ")", ")")
                self.no_struct = saved
            elif c == "[":
                self.i += 1
                saved, self.no_struct = self.no_struct, False
                self.value()
                self.need("]", "]")
                self.no_struct = saved
            elif c == "?":
                self.i += 1
            elif c == ".":
                self.i += 1
                if self.eat(NUMBER) or self.eat(R("await")):
                    continue
                self.need(NAME, "a member")
                if self.k[self.i] == R("::"):
                    self.i += 1
                    self.type_arguments()
            else:
                return
