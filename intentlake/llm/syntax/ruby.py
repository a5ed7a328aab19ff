"""Ruby."""

from __future__ import annotations

import re

from intentlake.llm.syntax.base import END, LINE, NAME, NUMBER, STRING, Alphabet, Kinds, Parser
from intentlake.llm.syntax.cfamily import binary_levels

B = Alphabet(
    "BEGIN END alias and begin break case class def defined? do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield label",
    "( ) { } [ ] ; , . : ? = + - * / % < > ! & | ^ ~ ** == != === =~ !~ <= >= <=> && || << >> .. ... :: -> => &. += -= *= /= %= **= &&= ||= &= |= ^= <<= >>=",
)
LABEL = B("label")
NEST = r"(?:[^{}\"\\]|\\.|\"(?:[^\"\\]|\\.)*\"|\{(?:[^{}]|\{[^{}]*\})*\})*"
TEXT = rf"\"(?:[^\"\\#]|\\.|\#(?!\{{)|\#\{{{NEST}\}})*\""
PERCENT = r"%[wWiIqQrsx]?(?:\((?:[^()\\]|\\.|\([^()]*\))*\)|\[(?:[^\[\]\\]|\\.|\[[^\[\]]*\])*\]|\{(?:[^{}\\]|\\.|\{[^{}]*\})*\}|<[^<>]*>|\|[^|]*\||![^!]*!)"
REGEX = r"(?:(?<=[(,=\[!&|?{};\n~])|(?<=[(,=\[!&|?{};~] )|(?<=if )|(?<=when )|(?<=unless )|(?<=and ))/(?:[^/\\\n]|\\.)+/[imxounse]*"
HEREDOC = re.compile(r"<<([~-]?)(['\"`]?)([A-Z_]\w*)\2([^\n]*)\n(.*?\n)??([ \t]*)\3(?=\n|\Z)", re.DOTALL)
COMMENT = re.compile(r"^=begin\b.*?^=end\b[^\n]*", re.DOTALL | re.MULTILINE)


def prepare(source: str) -> str:
    """Heredocs as plain strings, block comments and what follows __END__ left out."""
    if "=begin" in source:
        source = COMMENT.sub("", source)
    if "__END__" in source:
        source = re.split(r"^__END__$", source, maxsplit=1, flags=re.MULTILINE)[0]
    if "<<" in source:
        source = HEREDOC.sub(lambda m: '""' + m[4], source)
    return source


#: A line goes on after these, and before a leading dot.
GOES_ON = re.compile("([%s])\n+" % re.escape(B(", ( [ { | & + - * / % = . == != === =~ <= >= <=> && || << ** += -= *= /= ||= &&= &. :: => < > ? not and or !")))
LEADING = re.compile("\n+(?=[%s])" % re.escape(B(". &.")))
STARTS_ARGUMENT = frozenset(NAME + NUMBER + STRING + LABEL + B("nil true false self -> defined? not super yield def case"))


class RubyKinds(Kinds):
    def __missing__(self, token: str) -> str:
        first = token[0]
        if first in "%`/" and len(token) > 2 or first == ":" and len(token) > 1 and token != "::":
            return STRING
        if first == "?" and len(token) > 1:
            return STRING
        if token[-1] == ":" and len(token) > 1:
            return LABEL
        return super().__missing__(token)


class RubyParser(Parser):
    line_ends = True
    pattern = re.compile(
        rf"[^\S\n]*((?:[^\W\d]\w*[?!]?|\"[^\"\n]*\"|'[^'\n]*'):(?!:)(?=\s)|defined\?|[^\W\d]\w*(?:[?!](?![=~]))?|\n\s*|[(){{}};,\[\]]|{TEXT}|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`|\#[^\n]*|\\\n|::|:[^\W\d]\w*[?!=]?(?![>=~])|:\"(?:[^\"\\]|\\.)*\"|:(?:\[\]=?|<=>|===?|=~|\*\*|<<|>>|[<>]=?|[+\-*/%!~])(?=[\s,)\]])|{PERCENT}|{REGEX}|\?[^\W\d](?!\w)|@{{1,2}}[^\W\d]\w*|\$(?:\w+|[!@&~_.,/\;:<>\"$?*])|\d(?:[eE][+-]?\d|\.(?=\d)|\w)*|\*\*=|&&=|\|\|=|<<=|>>=|<=>|===|\.\.\.|\*\*|&&|\|\||<<|>>|\.\.|->|=>|&\.|=~|!~|[=!<>+\-*/%&|^]=|\S)",
        re.DOTALL,
    )
    kinds = RubyKinds(
        {k: v for k, v in B.of.items() if k != "label"}, r"0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[ri]{0,2}", "\"'`", ("#", "\\\n"), r"[^\W\d]\w*[?!]?|@{1,2}[^\W\d]\w*|\$.+"
    )
    assign = frozenset(B("= += -= *= /= %= **= &&= ||= &= |= ^= <<= >>="))
    binary = binary_levels(B, ".. ...", "||", "&&", "<=> == === != =~ !~", "< <= > >=", "| ^", "&", "<< >>", "+ -", "* / %", "**")
    right = frozenset(B("**"))
    prefix = frozenset(B("! - + ~ & * **"))
    simple = re.compile(r"[^;{}\n]{0,400}\n")

    def start(self, kinds: str) -> None:
        kinds = LEADING.sub("", GOES_ON.sub(r"\1", kinds))
        super().start(kinds.replace(";", LINE) + LINE)
        self.no_do = False

    def ends(self) -> None:
        while self.eat(LINE):
            pass

    def unit(self) -> None:
        self.body(END)

    def body(self, closers: str) -> None:
        """Statements up to a closer, which stays; with recovery at line ends."""
        saved, self.no_do = self.no_do, False
        while True:
            self.ends()
            c = self.k[self.i]
            if c in closers:
                break
            if c == END:
                self.fail("the text ends inside a block")
            at = self.i
            quick = self.simple.match(self.k, at)
            if quick and quick[0] in self.known:
                self.i = quick.end()
                continue
            self.statement()
            if self.k[self.i] not in LINE + closers:
                self.fail("expected the end of the statement")
            if quick and self.i == quick.end() - 1:
                self.known.add(quick[0])
        self.no_do = saved

    def recover(self, e, began: int) -> None:
        super().recover(e, began)
        while self.k[self.i] not in LINE + END:
            self.i += 1
        self.ends()

    def end(self) -> None:
        self.need(B("end"), "end")

    def statement(self) -> None:
        self.expression_statement()
        while self.k[self.i] in B("if unless while until rescue"):
            self.i += 1
            self.expression_statement()

    def expression_statement(self) -> None:
        self.not_expression()
        while self.k[self.i] in B("and or"):
            self.i += 1
            self.ends()
            self.not_expression()

    def not_expression(self) -> None:
        while self.eat(B("not")):
            pass
        at = self.i
        self.value()
        if self.k[self.i] == "," and self.multiple(at):
            while self.eat(","):
                if self.k[self.i] == "=":
                    break
                self.unary()
            self.need("=", "=")
            self.value()
            while self.eat(","):
                self.value()
        elif self.k[self.i] == B("in") or self.k[self.i] == B("=>"):  # one-line pattern
            self.i += 1
            self.value()

    def multiple(self, at: int) -> bool:
        i, depth = self.i, 0
        while self.k[i] not in LINE + END:
            c = self.k[i]
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
                if depth < 0:
                    return False
            elif c == "=" and not depth:
                return True
            i += 1
        return False

    # expressions

    def value(self) -> None:
        """An expression, with assignment and the ternary operator."""
        self.expression(1)
        c = self.k[self.i]
        if c == "?":
            self.i += 1
            self.ends()
            if self.k[self.i] == LABEL:
                self.i += 1  # a ? b: c
            else:
                self.value()
                self.ends()
                if self.k[self.i] == STRING:
                    self.i += 1  # a ? b :c
                    return
                self.need(":", ":")
            self.ends()
            self.value()
        elif c in self.assign:
            self.i += 1
            self.ends()
            self.value()
            while c == "=" and self.k[self.i] == "," and not self.listed:
                self.i += 1
                self.value()
            if self.k[self.i] == B("rescue"):
                self.i += 1
                self.value()

    listed = 0

    def operators(self, least: int) -> None:
        while True:
            op = self.k[self.i]
            precedence = self.binary.get(op)
            if precedence is None or precedence < least:
                return
            self.i += 1
            if op in B(".. ...") and self.k[self.i] in ")]" + LINE + B("then"):
                return
            self.ends()
            self.expression(precedence if op in self.right else precedence + 1)

    def argument(self) -> None:
        if self.eat(LABEL):
            if self.k[self.i] in ",)]}" + LINE:
                return
            self.ends()
            self.value()
            return
        if self.k[self.i] in B("* ** &") and self.k[self.i + 1] in ",)":
            self.i += 1
            return
        self.value()
        if self.eat(B("=>")):
            self.ends()
            self.value()

    def arguments(self, close: str) -> None:
        self.listed += 1
        saved, self.no_do = self.no_do, False
        self.ends()
        while not self.eat(close):
            self.argument()
            if self.k[self.i] in B("if unless") and close == ")":
                self.fail("expected )")
            self.ends()
            if not self.eat(","):
                self.need(close, "a closing bracket")
                break
            self.ends()
        self.no_do = saved
        self.listed -= 1

    def command_arguments(self) -> None:
        self.listed += 1
        self.argument()
        while self.eat(","):
            self.ends()
            self.argument()
        self.listed -= 1

    def then(self) -> None:
        self.ends()
        self.eat(B("then"))

    def operand(self) -> None:
        c = self.k[self.i]
        if c == NAME:
            self.i += 1
            if self.k[self.i] in STARTS_ARGUMENT:
                self.command_arguments()
                self.block()
        elif c == NUMBER or c in B("nil true false self redo retry"):
            self.i += 1
        elif c == STRING:
            while self.eat(STRING):
                pass
        elif c == "[":
            self.i += 1
            self.arguments("]")
        elif c == "{":
            self.i += 1
            self.arguments("}")
        elif c == "(":
            self.i += 1
            listed, self.listed = self.listed, 0
            self.body(")")
            self.listed = listed
            self.i += 1
        elif c == B("->"):
            self.i += 1
            if self.k[self.i] == "(":
                self.tree()
            else:
                while self.k[self.i] in NAME + "," + "*&=" + NUMBER:
                    self.i += 1
            if not self.block(required=True):
                self.fail("expected a block")
        elif c in B("if unless"):
            self.i += 1
            self.condition()
            self.then()
            self.body(B("elsif else end"))
            while self.eat(B("elsif")):
                self.condition()
                self.then()
                self.body(B("elsif else end"))
            if self.eat(B("else")):
                self.body(B("end"))
            self.end()
        elif c in B("while until"):
            self.i += 1
            self.condition()
            self.eat(B("do"))
            self.body(B("end"))
            self.end()
        elif c == B("for"):
            self.i += 1
            self.need(NAME, "a name")
            while self.eat(","):
                self.need(NAME, "a name")
            self.need(B("in"), "in")
            self.condition()
            self.eat(B("do"))
            self.body(B("end"))
            self.end()
        elif c == B("case"):
            self.i += 1
            if self.k[self.i] != LINE:
                self.expression_statement()
            self.ends()
            if self.k[self.i] not in B("when in"):
                self.fail("expected when")
            while self.k[self.i] in B("when in"):
                self.i += 1
                self.listed += 1
                self.argument()
                while self.eat(",") or self.eat("|"):
                    self.ends()
                    self.argument()
                if self.k[self.i] in B("if unless"):
                    self.i += 1
                    self.value()
                self.listed -= 1
                self.then()
                self.body(B("when in else end"))
            if self.eat(B("else")):
                self.body(B("end"))
            self.end()
        elif c == B("begin"):
            self.i += 1
            self.rescued()
        elif c == B("def"):
            self.definition()
        elif c == B("class"):
            self.i += 1
            if self.eat(B("<<")):
                self.value()
            else:
                self.constant()
                if self.eat("<"):
                    self.value()
            self.rescued()
        elif c == B("module"):
            self.i += 1
            self.constant()
            self.rescued()
        elif c in B("return break next"):
            self.i += 1
            if self.k[self.i] not in LINE + END + ")}]" + B("if unless while until end and or"):
                self.value()
                while self.eat(","):
                    self.value()
            return
        elif c in B("yield super"):
            self.i += 1
            if self.k[self.i] in STARTS_ARGUMENT or self.k[self.i] == "[":
                self.command_arguments()
                self.block()
        elif c == B("defined?"):
            self.i += 1
            self.unary()
        elif c == B("alias"):
            self.i += 1
            for _ in range(2):
                if self.k[self.i] not in NAME + STRING and self.k[self.i] not in self.binary:
                    self.fail("expected a name")
                self.i += 1
            return
        elif c == B("undef"):
            self.i += 2
            return
        elif c in B("BEGIN END"):
            self.i += 1
            self.need("{", "{")
            self.body("}")
            self.i += 1
        elif c == B("::"):
            self.i += 1
            self.need(NAME, "a name")
        elif c in B(".. ..."):
            self.i += 1
            self.expression(2)
        elif c == B("not"):
            self.i += 1
            self.value()
        else:
            self.fail("expected an expression")
        self.postfix()

    def condition(self) -> None:
        saved, self.no_do = self.no_do, True
        self.expression_statement()
        self.no_do = saved

    def constant(self) -> None:
        self.eat(B("::"))
        self.need(NAME, "a name")
        while self.eat(B("::")):
            self.need(NAME, "a name")

    def rescued(self) -> None:
        """A body up to end, with rescue, else and ensure."""
        closers = B("rescue else ensure end")
        self.body(closers)
        while self.eat(B("rescue")):
            self.listed += 1
            if self.k[self.i] not in LINE + B("then =>"):
                self.value()
                while self.eat(","):
                    self.value()
            self.listed -= 1
            if self.eat(B("=>")):
                self.unary()
            self.then()
            self.body(closers)
        if self.eat(B("else")):
            self.body(B("ensure end"))
        if self.eat(B("ensure")):
            self.body(B("end"))
        self.end()

    def definition(self) -> None:
        self.i += 1
        c = self.k[self.i]
        if c in NAME + B("self") and self.k[self.i + 1] == ".":
            self.i += 2
        c = self.k[self.i]
        if c == LABEL or c in LINE + END + "(){};," or c == NUMBER or c == STRING:
            self.fail("expected a method name")
        self.i += 1
        if c == "[":
            self.need("]", "]")
        if self.k[self.i] == "=" and self.k[self.i + 1] in "(" + NAME and c == NAME:
            self.i += 1
        if self.k[self.i] == "(":
            self.i += 1
            self.parameters(")")
            self.need(")", ")")
        elif self.k[self.i] not in LINE + "=":
            self.parameters(LINE)
        if self.eat("="):
            self.ends()
            self.statement()
            return
        self.rescued()

    def parameters(self, close: str) -> None:
        self.listed += 1
        if close == ")":
            self.ends()
        while self.k[self.i] != close:
            if self.eat(LABEL):
                if self.k[self.i] not in "," + close + LINE:
                    self.value()
            elif self.k[self.i] == "(":
                self.tree()
            else:
                while self.k[self.i] in B("* ** & ..."):
                    self.i += 1
                self.eat(NAME) or self.eat(B("nil"))
                if self.eat("="):
                    self.expression(2 if close == "|" else 1)
            if close == ")":
                self.ends()
            if not self.eat(","):
                break
            self.ends()
        self.listed -= 1
        if self.k[self.i] != close:
            self.fail("expected the end of the parameters")

    def block(self, required: bool = False) -> bool:
        c = self.k[self.i]
        if c == "{":
            close = "}"
        elif c == B("do") and not (self.no_do and not required):
            close = B("end")
        else:
            return False
        self.i += 1
        self.ends()
        if self.eat(B("||")):
            pass
        elif self.eat("|"):
            self.block_parameters()
        listed, self.listed = self.listed, 0
        if close == "}":
            self.body("}")
            self.i += 1
        else:
            self.rescued()
        self.listed = listed
        return True

    def block_parameters(self) -> None:
        self.listed += 1
        while not self.eat("|"):
            if self.eat(LABEL):
                if self.k[self.i] not in ",|":
                    self.expression(8)
            elif self.k[self.i] == "(":
                self.tree()
            else:
                while self.k[self.i] in B("* ** &"):
                    self.i += 1
                self.eat(NAME)
                if self.eat("="):
                    self.expression(8)
            if self.eat(LINE):
                while self.eat(NAME) or self.eat(","):
                    pass
            if not self.eat(","):
                self.need("|", "|")
                break
        self.listed -= 1

    def postfix(self) -> None:
        while True:
            c = self.k[self.i]
            if c == "(":
                self.i += 1
                self.arguments(")")
            elif c == "[":
                self.i += 1
                self.arguments("]")
            elif c in B(". &."):
                self.i += 1
                self.ends()
                if self.k[self.i] == "(":
                    continue
                if self.k[self.i] == LABEL and self.k[self.i - 1] != "(":
                    # a ? b.c: d
                    return
                if self.k[self.i] in LINE + END + ")]}," + NUMBER + STRING:
                    self.fail("expected a method")
                self.i += 1
                if self.k[self.i] in STARTS_ARGUMENT:
                    self.command_arguments()
            elif c == B("::"):
                self.i += 1
                self.need(NAME, "a name")
                if self.k[self.i] == STRING:
                    self.command_arguments()
            elif c == "{" and self.k[self.i - 1] in NAME + ")" + B("super yield") or c == B("do"):
                if not self.block():
                    return
            else:
                return
