"""What is accepted and refused, and why. Cases are made of types, forms of literals and clauses by rule."""

import itertools
from datetime import datetime, timezone

import pytest
from tidewater.errors import AccessProblem, BindProblem, LimitProblem, QueryError, SyntaxProblem
from tidewater.plans import cost, security
from tidewater.plans import types as K
from tidewater.plans.catalog import Catalog, Index, Table
from tidewater.plans.logical import InsertPlan, bind, bind_subscription
from tidewater.plans.syntax import MOST_BYTES, MOST_DEPTH, parse
from tidewater.plans.types import literal

WHOLE = {f"n_{name.lower()}": K.Type(name) for name in K.INTS}
REAL = {"r_single": K.F32, "r_double": K.F64}
OTHER = {"flag": K.BOOL, "label": K.STRING, "blob": K.BYTES, "owner": K.IDENTITY, "device": K.CONNECTION, "ticket": K.UUID, "sailed": K.TIMESTAMP}
BARE = {"tags": K.array(K.STRING), "spot": K.product(lat=K.F64, lon=K.F64), "took": K.DURATION}  # not comparable
STRANGER = b"\x2a" * 32


@pytest.fixture
def harbour():
    """Ships and berths share column names; berths also have columns of their own."""
    c = Catalog(None)
    c.tables["ship"] = Table("ship", {**WHOLE, **REAL, **OTHER, **BARE})
    c.tables["berth"] = Table("berth", {"pier": K.U16, "n_u32": K.U32, "owner": K.IDENTITY, "blob": K.BYTES, "tags": K.array(K.STRING)})
    c.tables["ledger"] = Table("ledger", {"pier": K.U16}, public=False)
    c.tables["crowded"] = Table("crowded", {"pier": K.U16}, view=True)
    return c


# -- literals: each form in each type

#: Text of a literal, and which types take it: by the value it stands for.
NUMBERS = {"0": 0, "127": 127, "-1": -1, "+7": 7, "200": 200, "4e2": 400, "4E2": 400, "70000": 70_000, "25e-1": 2.5, "0.75": 0.75, ".5": 0.5, "1e39": 10**39, "1e80": 10**80}
TEXTS = {"'plain'": {"String"}, "''": {"String"}, "'it''s'": {"String"}, "'2031-04-05T06:07:08Z'": {"String", "Timestamp"}, "'2031-04-05 06:07:08.25+09:30'": {"String", "Timestamp"}, "'00112233-4455-6677-8899-aabbccddeeff'": {"String", "Uuid"}}
HEXES = {"0xFADE": {"Bytes"}, "X'fade'": {"Bytes"}, "0x" + "5a" * 32: {"Bytes", "Identity"}, "0x" + "5a" * 16: {"Bytes", "ConnectionId"}}


def fits(number, kind: K.Type) -> bool:
    if kind.name in ("F32", "F64"):
        return True
    if kind.name not in K.INTS or number != int(number):
        return False
    signed, bits = K.INTS[kind.name]
    return -(1 << bits - 1) <= number < 1 << bits - 1 if signed else 0 <= number < 1 << bits


CASES = [(c, text, fits(value, k)) for (c, k), (text, value) in itertools.product({**WHOLE, **REAL}.items(), NUMBERS.items())]
# a string takes the text of any literal
CASES += [(c, text, k.name in names or k == K.STRING) for (c, k), (text, names) in itertools.product(OTHER.items(), {**TEXTS, **HEXES}.items()) if k.name in names or text[0] != "'" or k.name not in ("Bytes", "Identity", "ConnectionId")]
CASES += [(c, word, k == K.BOOL) for c, k in {**REAL, **OTHER}.items() for word in ("true", "FALSE")]


@pytest.mark.parametrize("column", [*WHOLE, *REAL, *OTHER])
def test_literals_by_type(harbour, column):
    wrong = []
    for c, text, taken in CASES:
        if c == column:
            try:
                bind_subscription(harbour, f"SELECT * FROM ship WHERE {c} = {text}")
            except BindProblem:
                found = False
            else:
                found = True
            if found != taken:
                wrong.append((text, found))
    assert not wrong


@pytest.mark.parametrize("op", ["=", "<>", "!=", "<", "<=", ">", ">="])
def test_comparisons_take_one_type(harbour, op):
    """Either side may be the literal; columns compare with columns of their own type only."""
    names = {**WHOLE, **REAL, **OTHER}
    for c, k in names.items():
        bind_subscription(harbour, f"SELECT * FROM ship WHERE {c} {op} ship.{c}")
        if k.name in K.INTS:
            bind_subscription(harbour, f"SELECT * FROM ship WHERE 5 {op} {c} AND ({c} {op} 6)")
    for a, b in itertools.pairwise(names):
        with pytest.raises(BindProblem):
            bind_subscription(harbour, f"SELECT * FROM ship WHERE {a} {op} {b}")
    for c in BARE:
        with pytest.raises(BindProblem):
            bind_subscription(harbour, f"SELECT * FROM ship WHERE {c} {op} {c}")
    with pytest.raises(BindProblem):
        bind_subscription(harbour, f"SELECT * FROM ship WHERE 5 {op} 5")


@pytest.mark.parametrize("column", [*WHOLE, *REAL, *OTHER, *BARE])
def test_the_caller_is_an_identity_or_its_bytes(harbour, column):
    sql = f"SELECT * FROM ship WHERE {column} = :sender"
    if column in ("owner", "blob"):
        bind_subscription(harbour, sql)
    else:
        with pytest.raises(BindProblem):
            bind_subscription(harbour, sql)


# -- names

ALIASES = ["ship", "ship AS s", "ship s"]


@pytest.mark.parametrize("source", ALIASES)
def test_scopes(harbour, source):
    """A renamed relation is known by its new name only."""
    name = source.split()[-1]
    bind_subscription(harbour, f"SELECT * FROM {source} WHERE {name}.n_u8 = 1 OR n_u8 = 2")
    bind_subscription(harbour, f"SELECT {name}.* FROM {source}")
    for wrong in ("other.n_u8 = 1", "nothing = 1", f"{name}.nothing = 1", "N_U8 = 1") + (("ship.n_u8 = 1",) if name != "ship" else ()):
        with pytest.raises(BindProblem):
            bind_subscription(harbour, f"SELECT * FROM {source} WHERE {wrong}")
    for wrong in ("SHIP", "nowhere"):
        with pytest.raises(QueryError):
            bind(harbour, f"SELECT * FROM {wrong}")


@pytest.mark.parametrize("on", ["JOIN berth b ON s.n_u32 = b.n_u32", "INNER JOIN berth b ON (b.owner = s.owner)", "JOIN berth b", "CROSS JOIN berth b"])
@pytest.mark.parametrize("where", ["", " WHERE s.r_single > 0.5 AND b.pier <> 3", " WHERE b.owner = :sender"])
def test_joins(harbour, on, where):
    for side in ("s", "b"):
        bind_subscription(harbour, f"SELECT {side}.* FROM ship s {on}{where}")
    assert bind(harbour, f"SELECT s.label, b.pier AS at FROM ship s {on}{where}").columns[1][1] == "at"
    assert bind(harbour, f"SELECT count(*) AS n FROM ship s {on}{where}").count == "n"
    for wrong in ("*", "pier", "s.label, b.tags AS label", "x.*"):  # of which relation; unqualified; twice the name; unknown
        with pytest.raises(QueryError):
            bind(harbour, f"SELECT {wrong} FROM ship s {on}{where}")
    for wrong in (" WHERE pier = 3", " WHERE s.pier = 3"):
        with pytest.raises(QueryError):
            bind(harbour, f"SELECT s.* FROM ship s {on}{wrong}")


def test_joins_need_one_type_and_different_names(harbour):
    for wrong in ("JOIN berth b ON s.n_u16 = b.n_u32", "JOIN berth b ON s.tags = b.tags", "JOIN berth b ON n_u32 = b.n_u32", "JOIN ship s", "JOIN berth b ON s.n_u32 = c.n_u32 JOIN berth c"):
        with pytest.raises(QueryError):
            bind(harbour, f"SELECT s.* FROM ship s {wrong}")


# -- the grammar: a sound statement, and the same with something that is not in the language

SOUND = {
    "star": "SELECT * FROM ship", "columns": "SELECT label, n_u8 AS decks FROM ship", "where": "SELECT * FROM ship WHERE flag = true", "bare": "SELECT * FROM ship WHERE flag AND (true OR flag)", "limit": "SELECT * FROM ship LIMIT 12;",
    "count": "SELECT COUNT(*) AS n FROM ship WHERE n_i64 <> -4", "quoted": 'SELECT "ship"."label" FROM "ship" WHERE "ship"."n_u8" >= 2', "comment": "SELECT * -- all\nFROM ship /* of\nthem */", "dotted": "SELECT a.b.c FROM a.b WHERE a.b.c = 1",
    "insert": "INSERT INTO berth (pier, n_u32) VALUES (1, 2), (3, +4)", "delete": "DELETE FROM berth WHERE pier = 3", "delete all": "DELETE FROM berth", "update": "UPDATE berth SET pier = 4, n_u32 = 9 WHERE owner = :sender", "set": "SET row_limit = 10", "set to": "SET row_limit TO 10", "show": "SHOW row_limit",
}
#: What the language leaves out, as a word for it and a statement that has it.
LEFT_OUT = {
    "no relation": "SELECT 3", "no column": "SELECT FROM ship", "no table": "SELECT * FROM", "nothing": "", "blank": " \n", "open condition": "SELECT * FROM ship WHERE", "open bracket": "SELECT * FROM ship WHERE (flag", "count without a name": "SELECT COUNT(*) FROM ship", "count and column": "SELECT label, COUNT(*) AS n FROM ship", "star and column": "SELECT ship.*, label FROM ship",
    "distinct": "SELECT DISTINCT label FROM ship", "sum": "SELECT SUM(n_u8) AS n FROM ship", "order": "SELECT * FROM ship ORDER BY label", "group": "SELECT label FROM ship GROUP BY label", "having": "SELECT * FROM ship HAVING flag", "offset": "SELECT * FROM ship OFFSET 2", "limit text": "SELECT * FROM ship LIMIT '2'", "limit name": "SELECT * FROM ship LIMIT n", "negative limit": "SELECT * FROM ship LIMIT -2",
    "outer join": "SELECT ship.* FROM ship LEFT JOIN berth ON ship.n_u32 = berth.n_u32", "full join": "SELECT ship.* FROM ship FULL JOIN berth ON ship.n_u32 = berth.n_u32", "natural join": "SELECT ship.* FROM ship NATURAL JOIN berth", "using": "SELECT ship.* FROM ship JOIN berth USING (n_u32)", "theta on": "SELECT ship.* FROM ship JOIN berth ON ship.n_u32 < berth.n_u32", "comma join": "SELECT s.* FROM ship s, berth b",
    "subquery": "SELECT * FROM (SELECT * FROM ship) s", "in": "SELECT * FROM ship WHERE n_u8 IN (4, 5)", "like": "SELECT * FROM ship WHERE label LIKE 'a%'", "between": "SELECT * FROM ship WHERE n_u8 BETWEEN 4 AND 5", "null test": "SELECT * FROM ship WHERE label IS NULL", "not": "SELECT * FROM ship WHERE NOT flag", "sum of terms": "SELECT * FROM ship WHERE n_u8 + 1 = 5", "call": "SELECT * FROM ship WHERE LOWER(label) = 'a'", "case": "SELECT CASE WHEN flag THEN 1 ELSE 2 END FROM ship", "exists": "SELECT * FROM ship WHERE EXISTS (SELECT * FROM berth)",
    "union": "SELECT * FROM ship UNION ALL SELECT * FROM ship", "with": "WITH q AS (SELECT * FROM ship) SELECT * FROM q", "two statements": "SELECT * FROM ship; SELECT * FROM berth", "create": "CREATE TABLE raft (n INT)", "drop": "DROP TABLE ship", "begin": "BEGIN", "bit string": "SELECT * FROM ship WHERE blob = B'01'", "other parameter": "SELECT * FROM ship WHERE owner = :somebody", "position": "SELECT * FROM ship WHERE n_u8 = $1",
    "update of a join": "UPDATE ship JOIN berth ON ship.n_u32 = berth.n_u32 SET n_u8 = 1", "update from": "UPDATE ship SET n_u8 = 1 FROM berth", "update by column": "UPDATE ship SET n_u8 = n_u16", "insert of a query": "INSERT INTO berth SELECT * FROM berth", "insert of a column": "INSERT INTO berth VALUES (pier, 2)", "delete using": "DELETE FROM ship USING berth WHERE flag", "number and letters": "SELECT * FROM ship WHERE n_u8 = 12ab", "join of plain columns": "SELECT s.* FROM ship s JOIN berth b ON n_u32 = pier",
}


@pytest.mark.parametrize("what", SOUND)
def test_grammar(what):
    parse(SOUND[what])
    parse(SOUND[what].replace("SELECT", "select").replace("FROM", "from").replace("WHERE", "Where"))


@pytest.mark.parametrize("what", LEFT_OUT)
def test_what_is_not_in_the_language(what):
    with pytest.raises(SyntaxProblem):
        parse(LEFT_OUT[what])


@pytest.mark.parametrize("what", SOUND)
def test_what_may_be_live(harbour, what):
    """Whole rows of one table without a limit."""
    if what in ("star", "where", "bare", "comment"):
        bind_subscription(harbour, SOUND[what])
    else:
        with pytest.raises(QueryError):
            bind_subscription(harbour, SOUND[what])


def test_limits_of_size():
    deep = lambda n: "SELECT * FROM ship WHERE " + "(" * n + "flag" + ")" * n
    chain = lambda n: "SELECT * FROM ship WHERE " + " OR ".join(["n_u8 = 1"] * n)
    for make, most in ((deep, MOST_DEPTH - 1), (chain, MOST_DEPTH)):
        parse(make(most))
        with pytest.raises(SyntaxProblem):
            parse(make(most + 10))
    base = "SELECT * FROM ship WHERE label = ''"
    parse(base[:-1] + "z" * (MOST_BYTES - len(base)) + "'")
    with pytest.raises(SyntaxProblem):
        parse(base[:-1] + "z" * (MOST_BYTES - len(base) + 1) + "'")


# -- access, changes, variables


def test_private_tables(harbour):
    bind(harbour, "SELECT * FROM ledger")
    with pytest.raises(AccessProblem, match="private"):
        bind(harbour, "SELECT * FROM ledger", caller=STRANGER)


def test_changes(harbour):
    harbour.tables["cargo"] = Table("cargo", {"tons": K.U8, "goods": K.STRING})
    plan = bind(harbour, "INSERT INTO cargo (goods, tons) VALUES (9, 'tea')")  # in the table's order, whatever the names
    assert isinstance(plan, InsertPlan) and [v.value for v in plan.rows[0]] == [9, "tea"]
    rows = {"(9, 'tea')": True, "(9)": False, "(9, 'tea', 1)": False, "('tea', 9)": False, "(9, 9)": False, "('9', 'tea')": False, "(256, 'tea')": False, "(-1, 'tea')": False}
    for row, taken in rows.items():
        for sql in (f"INSERT INTO cargo VALUES {row}", f"INSERT INTO cargo VALUES (1, 'oil'), {row}"):
            if taken:
                bind(harbour, sql)
            else:
                with pytest.raises(QueryError):
                    bind(harbour, sql)
    for wrong in ("UPDATE cargo SET tons = 'x'", "UPDATE cargo SET goods = 3", "UPDATE cargo SET boxes = 3", "UPDATE cargo SET tons = 1, tons = 2", "INSERT INTO cargo (tons) VALUES (1)", "DELETE FROM cargo WHERE boxes = 1", "SET depth = 3", "SHOW depth", "SET row_limit = 'x'"):
        with pytest.raises(QueryError):
            bind(harbour, wrong)
    for wrong in ("DELETE FROM crowded", "INSERT INTO crowded VALUES (1)", "UPDATE crowded SET pier = 1"):
        with pytest.raises(BindProblem, match="view"):
            bind(harbour, wrong)


# -- values


def test_literal_values():
    for t in (K.F32, K.F64):
        assert literal("1.25e2", t) == 125.0
    assert literal("4e38", K.F32) == float("inf") and literal("-4e38", K.F32) == float("-inf") and literal("4e38", K.F64) == 4e38
    assert literal("0x123", K.BYTES) == bytes([0x01, 0x23]) and literal("0x" + "9c" * 32, K.IDENTITY) == b"\x9c" * 32
    assert literal("1999-12-31 23:59:59.987654999-00:30", K.TIMESTAMP) == datetime(2000, 1, 1, 0, 29, 59, 987654, timezone.utc)
    for text, t in (("0x9c", K.IDENTITY), ("ticket", K.UUID), ("1999-12-31", K.TIMESTAMP), ("1999-13-01T00:00:00Z", K.TIMESTAMP), ("0.5", K.U8), ("infinity", K.I16), ("0xzz", K.BYTES)):
        with pytest.raises(BindProblem):
            literal(text, t)
    for t in WHOLE.values():
        signed, bits = K.INTS[t.name]
        edges = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
        for edge, out in zip(edges, (-1, 1), strict=True):
            literal(str(edge), t)
            with pytest.raises(BindProblem):
                literal(str(edge + out), t)


def test_wide_integers_sort_as_bytes():
    for t in (K.I128, K.I256):
        bits = K.INTS[t.name][1]
        values = [-(1 << bits - 1), -(1 << 90), -3, 0, 2, 1 << 77, (1 << bits - 1) - 1]
        stored = [K.wide_bytes(v, t) for v in values]
        assert stored == sorted(stored) and [K.wide_int(b, t) for b in stored] == values


# -- security


def fleet(*rules: str) -> Catalog:
    """Crews see themselves; harbour masters themselves; a voyage is seen by its crew, and by every master."""
    c = Catalog(None)
    for name in ("crew", "master"):
        c.tables[name] = Table(name, {"owner": K.IDENTITY, "voyage_no": K.U64})
    c.tables["voyage"] = Table("voyage", {"voyage_no": K.U64, "miles": K.U64})
    for r in rules or ("SELECT * FROM crew WHERE owner = :sender", "SELECT * FROM master WHERE owner = :sender", "SELECT v.* FROM voyage v JOIN crew w ON v.voyage_no = w.voyage_no", "SELECT voyage.* FROM voyage JOIN master"):
        security.add_rule(c, r)
    return c


def test_security_rewrites():
    c = fleet()
    secured = lambda sql, who=STRANGER: security.secured(c, bind(c, sql), who)
    plain = bind(c, "SELECT * FROM crew")
    assert secured("SELECT * FROM crew", c.owner) == plain == secured("SELECT * FROM crew", None)
    (only,) = secured("SELECT * FROM crew").fragments
    assert len(only.where) == 1
    by_rule = secured("SELECT * FROM voyage WHERE miles > 40").fragments
    assert len(by_rule) == 2 and all(len(f.relations) == 2 and len(f.where) == 2 and f.relations[0] == ("voyage", "voyage") for f in by_rule)
    assert all(alias != table for f in by_rule for alias, table in f.relations[1:])  # fresh names
    assert len(secured("SELECT x.* FROM voyage x JOIN voyage y ON x.miles = y.miles").fragments) == 2 * 2
    assert len(secured("SELECT x.* FROM voyage x JOIN crew y ON x.voyage_no = y.voyage_no").fragments) == 2 * 1


def test_rules_that_are_refused():
    c = fleet("SELECT v.* FROM voyage v JOIN crew w ON v.voyage_no = w.voyage_no", "SELECT w.* FROM crew w JOIN voyage v ON v.voyage_no = w.voyage_no")
    with pytest.raises(BindProblem, match="cyclic"):
        security.secured(c, bind(c, "SELECT * FROM voyage"), STRANGER)
    c.tables["safe"] = Table("safe", {"voyage_no": K.U64}, public=False)
    for wrong in ("SELECT v.* FROM voyage v JOIN safe s ON v.voyage_no = s.voyage_no", "SELECT * FROM safe"):
        with pytest.raises(AccessProblem):
            security.add_rule(c, wrong)
    for wrong in ("SELECT miles FROM voyage", "SELECT count(*) AS n FROM voyage", "SELECT * FROM voyage LIMIT 3"):
        with pytest.raises(QueryError):
            security.add_rule(c, wrong)


# -- estimates


def test_estimates(spark):
    c = Catalog(spark)
    c.add("stop", spark.createDataFrame([(i % 4, i) for i in range(24)], "line bigint, nr bigint"), indexes=[Index(("line",))])
    c.add("line", spark.createDataFrame([(i,) for i in range(6)], "id bigint"), primary_key="id")
    rows = {
        "SELECT * FROM stop": 24, "SELECT * FROM stop WHERE nr = 3": 24, "SELECT * FROM stop WHERE line = 2": 24 // 4, "SELECT * FROM line WHERE id = 2": 1,
        "SELECT stop.* FROM stop JOIN line ON stop.line = line.id": 24, "SELECT line.* FROM line JOIN stop ON stop.line = line.id": 6 * (24 // 4), "SELECT stop.* FROM stop JOIN line": 24 * 6,
    }
    for sql, n in rows.items():
        found = bind(c, sql)
        assert cost.estimate(c, found) == n, sql
        cost.admit(c, found, n)
        cost.admit(c, found, n - 1, exempt=True)
        with pytest.raises(LimitProblem, match=rf"\({n} rows\).*\({n - 1} rows\)"):
            cost.admit(c, found, n - 1)
    kinds = {"SELECT * FROM stop": "sequential", "SELECT * FROM stop WHERE line = 1": "fully_indexed", "SELECT * FROM stop WHERE line = 1 AND nr = 2": "indexed_with_filter", "SELECT stop.* FROM stop JOIN line ON stop.nr = line.id WHERE line.id = 3": "mixed"}
    assert {sql: cost.scan_kind(c, bind(c, sql).fragments[0]) for sql in kinds} == kinds
