"""Tokens and grammar. Statements become small trees; nothing is looked up here.

    select  := SELECT ( * | t.* | count(*) AS n | col [AS n] {, col [AS n]} ) FROM relation [WHERE pred] [LIMIT n]
    relation:= table [[AS] a] { [INNER] JOIN table [[AS] a] [ON col = col] | CROSS JOIN table [[AS] a] }
    pred    := pred AND pred | pred OR pred | ( pred ) | value op value | bool | col
    insert  := INSERT INTO t [(cols)] VALUES (lit, ..), ..      delete := DELETE FROM t [WHERE pred]
    update  := UPDATE t SET col = lit, .. [WHERE pred]          set    := SET x = lit | SET x TO lit      show := SHOW x
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

from tidewater.errors import SyntaxProblem

MOST_BYTES, MOST_DEPTH = 50_000, 1_600

_TOKEN = re.compile(
    r"""\s*(?:(--[^\n]*|/\*.*?\*/)|(?P<hex>[xX]'[0-9a-fA-F]*'|0[xX][0-9a-fA-F]+)|(?P<num>(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<str>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")+")|(?P<param>:\w+)|(?P<word>[^\W\d]\w*)|(?P<op><>|!=|<=|>=|[-+=<>(),.*;]))""",
    re.X | re.S,
)
#: Words that cannot be an alias or a bare column.
RESERVED = set("select from where join inner cross left right full outer natural on using as and or not limit offset order group by having union except intersect values set insert into delete update with distinct case between in is like exists null".split())


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


@dataclass(frozen=True)
class Lit:
    kind: str  # bool, num, str, hex
    text: str


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Col:
    table: str | None
    name: str


@dataclass(frozen=True)
class Cmp:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Logic:
    op: str  # and, or
    left: object
    right: object


@dataclass(frozen=True)
class From:
    table: str
    alias: str
    on: tuple[Col, Col] | None = None


@dataclass(frozen=True)
class Select:
    items: object  # "*", ("*", t), ("count", name) or [(Col, name)]
    relations: tuple[From, ...]
    where: object = None
    limit: int | None = None


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    rows: tuple[tuple[object, ...], ...]


@dataclass(frozen=True)
class Delete:
    table: str
    where: object = None


@dataclass(frozen=True)
class Update:
    table: str
    values: tuple[tuple[str, object], ...]
    where: object = None


@dataclass(frozen=True)
class SetVar:
    name: str
    value: Lit


@dataclass(frozen=True)
class Show:
    name: str


def tokens(sql: str) -> list[Token]:
    if len(sql.encode()) > MOST_BYTES:
        raise SyntaxProblem(f"the statement is longer than {MOST_BYTES} bytes")
    out, at = [], 0
    while at < len(sql) and sql[at:].strip():
        m = _TOKEN.match(sql, at)
        if not m or m.end() == at:
            raise SyntaxProblem(f"unexpected text at {at}: {sql[at : at + 20]!r}")
        if m.lastgroup:
            text = m[m.lastgroup]
            begin = m.start(m.lastgroup)
            if m.lastgroup in ("num", "hex") and m.end() < len(sql) and (sql[m.end()].isalnum() or sql[m.end()] == "_"):
                raise SyntaxProblem(f"bad number at {begin}")
            if m.lastgroup == "word" and sql[m.end() : m.end() + 1] == "'":
                raise SyntaxProblem(f"unsupported literal at {begin}")
            out.append(Token(m.lastgroup, text, begin))
        at = m.end()
    return out


class _Parser:
    def __init__(self, sql: str) -> None:
        self.tokens, self.at, self.depth = tokens(sql), 0, 0

    # -- reading

    def peek(self, ahead: int = 0) -> Token | None:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else None

    def word(self, *words: str) -> bool:
        """Takes these words if they come next."""
        for i, w in enumerate(words):
            t = self.peek(i)
            if not t or t.kind != "word" or t.text.lower() != w:
                return False
        self.at += len(words)
        return True

    def op(self, text: str) -> bool:
        t = self.peek()
        if t and t.kind == "op" and t.text == text:
            self.at += 1
            return True
        return False

    def fail(self, wanted: str) -> SyntaxProblem:
        t = self.peek()
        return SyntaxProblem(f"expected {wanted}, found {t.text!r} at {t.at}" if t else f"expected {wanted}, found the end")

    def need_word(self, word: str) -> None:
        if not self.word(word):
            raise self.fail(word.upper())

    def need_op(self, text: str) -> None:
        if not self.op(text):
            raise self.fail(f"{text!r}")

    def name(self) -> str:
        t = self.peek()
        if t and (t.kind == "quoted" or t.kind == "word" and t.text.lower() not in RESERVED):
            self.at += 1
            return t.text[1:-1].replace('""', '"') if t.kind == "quoted" else t.text
        raise self.fail("a name")

    def dotted(self) -> list[str]:
        parts = [self.name()]
        while self.op("."):
            parts.append(self.name())
        return parts

    # -- expressions

    def column(self) -> Col:
        *table, name = self.dotted()
        return Col(".".join(table) or None, name)

    def literal(self) -> Lit:
        sign = "-" if self.op("-") else "+" if self.op("+") else ""
        t = self.peek()
        if t and t.kind == "num":
            self.at += 1
            return Lit("num", sign.replace("+", "") + t.text)
        if sign:
            raise self.fail("a number")
        if t and t.kind == "str":
            self.at += 1
            return Lit("str", t.text[1:-1].replace("''", "'"))
        if t and t.kind == "hex":
            self.at += 1
            return Lit("hex", t.text if t.text[0] == "0" else "0x" + t.text[2:-1])
        for w in ("true", "false"):
            if self.word(w):
                return Lit("bool", w)
        raise self.fail("a literal")

    def value(self) -> object:
        t = self.peek()
        if t and t.kind == "param":
            self.at += 1
            if t.text != ":sender":
                raise SyntaxProblem(f"unknown parameter {t.text}")
            return Param("sender")
        if t and (t.kind in ("num", "str", "hex") or t.kind == "op" and t.text in "+-" or t.kind == "word" and t.text.lower() in ("true", "false")):
            return self.literal()
        return self.column()

    def factor(self) -> object:
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise SyntaxProblem("the expression is nested too deep")
        try:
            if self.op("("):
                inner = self.predicate()
                self.need_op(")")
                left: object = inner
                if not isinstance(inner, (Lit, Col, Param)):
                    return inner
            else:
                left = self.value()
            t = self.peek()
            if t and t.kind == "op" and t.text in ("=", "<>", "!=", "<", ">", "<=", ">="):
                self.at += 1
                if self.op("("):
                    right = self.value()
                    self.need_op(")")
                else:
                    right = self.value()
                return Cmp("<>" if t.text == "!=" else t.text, left, right)
            return left
        finally:
            self.depth -= 1

    def _chain(self, word: str, part) -> object:
        left, links = part(), 0
        while self.word(word):
            left, links = Logic(word, left, part()), links + 1
            if links > MOST_DEPTH:
                raise SyntaxProblem("the expression is nested too deep")
        return left

    def predicate(self) -> object:
        return self._chain("or", lambda: self._chain("and", self.factor))

    # -- relations

    def aliased(self) -> tuple[str, str]:
        table = ".".join(self.dotted())
        t = self.peek()
        if self.word("as") or t and (t.kind == "quoted" or t.kind == "word" and t.text.lower() not in RESERVED):
            return table, self.name()
        return table, table

    def relations(self) -> tuple[From, ...]:
        out = [From(*self.aliased())]
        while True:
            if self.word("cross", "join"):
                out.append(From(*self.aliased()))
            elif self.word("inner", "join") or self.word("join"):
                table, alias = self.aliased()
                on = None
                if self.word("on"):
                    closed = self.op("(")
                    left = self.column()
                    self.need_op("=")
                    right = self.column()
                    if closed:
                        self.need_op(")")
                    if not left.table or not right.table:
                        raise SyntaxProblem("columns of a join must be qualified")
                    on = (left, right)
                out.append(From(table, alias, on))
            else:
                return tuple(out)

    def where(self) -> object:
        return self.predicate() if self.word("where") else None

    # -- statements

    def select(self) -> Select:
        items: object
        if self.op("*"):
            items = "*"
        else:
            items = []
            while True:
                if self.word("count") and self.op("("):
                    self.need_op("*")
                    self.need_op(")")
                    self.need_word("as")
                    found: object = ("count", self.name())
                else:
                    parts = [self.name()]
                    star = False
                    while self.op("."):
                        if self.op("*"):
                            star = True
                            break
                        parts.append(self.name())
                    if star:
                        found = ("*", ".".join(parts))
                    else:
                        column = Col(".".join(parts[:-1]) or None, parts[-1])
                        found = (column, self.name() if self.word("as") else column.name)
                items.append(found)
                if not self.op(","):
                    break
            if len(items) == 1 and not isinstance(items[0][0], Col):
                items = items[0]
            elif any(not isinstance(i[0], Col) for i in items):
                raise SyntaxProblem("* and count(*) must stand alone")
        self.need_word("from")
        relations = self.relations()
        where = self.where()
        limit = None
        if self.word("limit"):
            t = self.peek()
            if not t or t.kind != "num" or not t.text.isdigit() or int(t.text) >= 1 << 64:
                raise self.fail("a whole number")
            self.at += 1
            limit = int(t.text)
        return Select(items, relations, where, limit)

    def insert(self) -> Insert:
        table = ".".join(self.dotted())
        columns = []
        if self.op("("):
            columns.append(self.name())
            while self.op(","):
                columns.append(self.name())
            self.need_op(")")
        self.need_word("values")
        rows = []
        while True:
            self.need_op("(")
            row = [self.value()]
            while self.op(","):
                row.append(self.value())
            self.need_op(")")
            if any(isinstance(v, Col) for v in row):
                raise SyntaxProblem("only literals can be inserted")
            rows.append(tuple(row))
            if not self.op(","):
                return Insert(table, tuple(columns), tuple(rows))

    def update(self) -> Update:
        table = ".".join(self.dotted())
        self.need_word("set")
        values = []
        while True:
            name = self.name()
            self.need_op("=")
            value = self.value()
            if isinstance(value, Col):
                raise SyntaxProblem("only literals can be assigned")
            values.append((name, value))
            if not self.op(","):
                return Update(table, tuple(values), self.where())

    def statement(self) -> object:
        if self.word("select"):
            found: object = self.select()
        elif self.word("insert", "into"):
            found = self.insert()
        elif self.word("delete", "from"):
            found = Delete(".".join(self.dotted()), self.where())
        elif self.word("update"):
            found = self.update()
        elif self.word("set"):
            name = self.name()
            if not self.op("=") and not self.word("to"):
                raise self.fail("= or TO")
            found = SetVar(name, self.literal())
        elif self.word("show"):
            found = Show(self.name())
        else:
            raise self.fail("a statement")
        self.op(";")
        if self.peek():
            raise self.fail("the end")
        return found


def _check_columns(s: Select) -> Select:
    """In a join all columns must be qualified."""
    if len(s.relations) > 1:
        todo = [s.where] + ([c for c, _ in s.items] if isinstance(s.items, list) else [])
        while todo:
            x = todo.pop()
            if isinstance(x, Col) and not x.table:
                raise SyntaxProblem(f"column {x.name} must be qualified in a join")
            if isinstance(x, (Cmp, Logic)):
                todo += [x.left, x.right]
    return s


def parse(sql: str) -> object:
    """Any statement."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 12 * MOST_DEPTH))  # parentheses take a few frames each, up to MOST_DEPTH
    try:
        found = _Parser(sql).statement()
    finally:
        sys.setrecursionlimit(before)
    return _check_columns(found) if isinstance(found, Select) else found


def parse_subscription(sql: str) -> Select:
    """A live query: a SELECT of whole rows without LIMIT."""
    found = parse(sql)
    if not isinstance(found, Select):
        raise SyntaxProblem("only SELECT can be subscribed to")
    if found.limit is not None:
        raise SyntaxProblem("a live query has no LIMIT")
    if isinstance(found.items, list) or found.items[0] == "count":
        raise SyntaxProblem("a live query returns whole rows of one table")
    return found
