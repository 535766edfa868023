"""Results, live deltas, the log, streams, builders, printing."""

import json
import math
import random
from collections import Counter
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tidewater import functions as V
from tidewater.engine import Database
from tidewater.errors import AccessProblem, BindProblem, ConstraintProblem, LimitProblem, QueryError
from tidewater.operators import builder, changes, delta, index, workloads
from tidewater.plans import security
from tidewater.plans import types as K
from tidewater.plans.catalog import Catalog, Index
from tidewater.plans.logical import bind
from tidewater.sources import sinks
from tidewater.streaming import live, log


def bag(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture
def game(spark):
    c = Catalog(spark)
    c.add("inventory", spark.createDataFrame([(1, "health1"), (2, "health2"), (3, "health3")], "inventory_id int, name string"), primary_key="inventory_id")
    c.add("player", spark.createDataFrame([(100, 1), (200, 1), (300, 1)], "entity_id int, inventory_id int"), primary_key="entity_id", indexes=[Index(("inventory_id",))])
    c.add("location", spark.createDataFrame([(100, 0.0, 32.0), (100, 1.0, 31.0)], "entity_id int, x double, z double"), indexes=[Index(("entity_id",))])
    return Database(c)


def test_joins(game):
    near = "location.x > 0 and location.x <= 32 and location.z > 0 and location.z <= 32"
    assert bag(game.sql(f"select player.* from player join location on player.entity_id = location.entity_id where {near}")) == {(100, 1): 1}
    assert bag(game.sql("select player.* from player join location on player.entity_id = location.entity_id")) == {(100, 1): 2}
    assert bag(game.sql(f"select inventory.* from inventory join player on inventory.inventory_id = player.inventory_id join location on player.entity_id = location.entity_id where {near}")) == {(1, "health1"): 1}
    assert game.sql("select count(*) as n from player cross join location").first()[0] == 6
    assert game.sql("select * from player limit 2").count() == 2 and game.sql("select * from player limit 0").count() == 0


def test_a_join_written_out_of_order_is_not_crossed(game):
    df = game.sql("select i.* from inventory i join location l join player p on p.entity_id = l.entity_id where p.inventory_id = i.inventory_id")
    assert bag(df) == {(1, "health1"): 2}
    plan = game.sql("select i.* from inventory i join player p on i.inventory_id = p.inventory_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan


def test_set_semantics_of_changes(game):
    out = game.change("insert into inventory values (3, 'health3'), (4, 'mana'), (4, 'mana')")
    assert out.metrics() == {"inserted": 1, "deleted": 0} and game.catalog.frames["inventory"].count() == 4
    game.change("update inventory set name = 'x', inventory_id = 9 where inventory_id > 1")
    assert bag(game.catalog.frames["inventory"]) == {(1, "health1"): 1, (9, "x"): 1}
    assert game.change("delete from inventory where name = 'x'").metrics() == {"inserted": 0, "deleted": 1}
    assert bag(game.sql("select * from inventory")) == {(1, "health1"): 1}
    with pytest.raises(AccessProblem):
        game.change("delete from inventory", caller=b"\1" * 32)


def test_nulls_and_unique_keys(spark, game):
    game.catalog.add("gaps", spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "k int, v string"), primary_key="k")
    game.change("delete from gaps where v = 'a'")
    assert bag(game.catalog.frames["gaps"]) == {(2, None): 1, (3, "b"): 1}
    game.change("update gaps set v = 'c' where v <> 'x'")
    assert bag(game.catalog.frames["gaps"]) == {(2, None): 1, (3, "c"): 1}
    assert game.change("insert into gaps values (3, 'c')").metrics()["inserted"] == 0
    for sql in ("insert into gaps values (2, 'new')", "insert into gaps values (9, 'x'), (9, 'y')", "update gaps set k = 7", "update gaps set k = 2 where k = 3"):
        with pytest.raises(ConstraintProblem):
            game.change(sql)
    assert bag(game.catalog.frames["gaps"]) == {(2, None): 1, (3, "c"): 1}
    assert game.change("update gaps set k = 5, v = 'z' where k = 3").metrics() == {"updated": 1}


def test_sequences(spark, game):
    game.catalog.add("log", spark.createDataFrame([], "n int, v string"), {"n": K.I32}, primary_key="n", sequence="n")
    game.change("insert into log values (2, 'given')")
    assert bag(game.change("insert into log values (0, 'one')").inserts) == {(1, "one"): 1}
    with pytest.raises(ConstraintProblem):
        game.change("insert into log values (0, 'two')")
    assert bag(game.change("insert into log values (0, 'three')").inserts) == {(3, "three"): 1}
    game.change("delete from log where n = 3")
    assert bag(game.change("insert into log values (0, 'four')").inserts) == {(4, "four"): 1}


def test_many_changes_keep_the_plan_small(game):
    for k in range(10, 21):
        game.change(f"insert into inventory values ({k}, 'n')")
        game.change(f"delete from inventory where inventory_id = {k - 1}")
    assert bag(game.catalog.frames["inventory"]) == {(1, "health1"): 1, (2, "health2"): 1, (3, "health3"): 1, (20, "n"): 1}
    assert len(game.catalog.frames["inventory"]._jdf.queryExecution().analyzed().toString()) < 30_000


def test_row_limit(game):
    game.sql("set row_limit = 2")
    assert game.sql("show row_limit").first()[0] == 2 and game.sql("select * from player").count() == 3
    with pytest.raises(LimitProblem):
        game.sql("select * from player", caller=b"\1" * 32)


def test_violations_and_indexes(game):
    t = game.catalog.tables["player"]
    twice = game.catalog.frames["player"].unionByName(game.catalog.spark.createDataFrame([(100, 2)], "entity_id int, inventory_id int"))
    assert [tuple(r)[0] for r in changes.violations(twice, t).collect()] == ["entity_id"]
    assert index.find(game.catalog, "player", "entity_id", 200).count() == 1
    with pytest.raises(BindProblem):
        index.find(game.catalog, "player", "inventory_id", 1)
    with pytest.raises(BindProblem):
        index.by_index(game.catalog, "player", ("nothing",), 1)
    found = index.scan(game.catalog.frames["location"], ("entity_id", "x"), 100, index.Range(index.excluded(0.0)))
    assert bag(found) == {(100, 1.0, 31.0): 1}
    assert "PushedFilters" in game.catalog.spark.read.parquet("/root/testdata/sf0.001/orders.parquet").where("o_orderkey = 5")._jdf.queryExecution().executedPlan().toString()


def test_secured_rows(spark):
    me, other = b"\1" * 32, b"\2" * 32
    c = Catalog(spark)
    c.add("users", spark.createDataFrame([(bytearray(me), 1), (bytearray(other), 2)], "identity binary, id bigint"), {"identity": K.IDENTITY})
    c.add("admins", spark.createDataFrame([(bytearray(me), 1)], "identity binary, id bigint"), {"identity": K.IDENTITY})
    c.add("player", spark.createDataFrame([(1, 5), (2, 6)], "id bigint, level_num bigint"))
    for r in ("select * from users where identity = :sender", "select * from admins where identity = :sender", "select player.* from player join users u on player.id = u.id", "select player.* from player join admins"):
        security.add_rule(c, r)
    db = Database(c)
    assert bag(db.sql("select * from player", me)) == {(1, 5): 2, (2, 6): 1}  # seen by two rules: twice
    assert bag(db.sql("select * from player", other)) == {(2, 6): 1}
    assert db.sql("select * from player", b"\3" * 32).count() == 0 and db.sql("select * from player").count() == 2
    assert db.sql("select count(*) as n from player", me).first()[0] == 3


def test_builder(game):
    c = game.catalog
    c.add("users", c.spark.createDataFrame([(1, "Alice", True, 30), (2, "BOB", False, 20), (3, "POP", False, 7)], "id int, name string, online boolean, age int"), primary_key="id")
    c.add("person", c.spark.createDataFrame([(1, "Alice"), (2, "BOB"), (2, "again")], "id int, name string"), indexes=[Index(("id",))])
    users, person = builder.table(c, "users"), builder.table(c, "person")
    assert users.sql == 'SELECT * FROM "users"'
    assert users.where(lambda t: t.name.eq("O'Neil")).sql == """SELECT * FROM "users" WHERE ("users"."name" = 'O''Neil')"""
    two = users.where(lambda t: t.id.gt(1)).filter(lambda t: t.id.lt(9))
    assert two.sql == 'SELECT * FROM "users" WHERE (("users"."id" > 1) AND ("users"."id" < 9))' and two.frame().count() == 2
    assert bag(users.where(lambda t: t.online).frame()) == {(1, "Alice", True, 30): 1}
    left = users.left_semijoin(person, lambda a, b: (a.id, b.id))
    assert left.sql == 'SELECT "users".* FROM "users" JOIN "person" ON "users"."id" = "person"."id"'
    assert bag(left.frame()) == {(1, "Alice", True, 30): 1, (2, "BOB", False, 20): 2}
    right = users.where(lambda t: t.age.lte(20)).right_semijoin(person, lambda a, b: (a.id, b.id)).where(lambda t: t.name.ne("again"))
    assert bag(right.frame()) == {(2, "BOB"): 1}
    assert users.where(lambda t: t.age.gte(20).and_(t.online)).matches({"age": 30, "online": True, "id": 1, "name": "x"})
    with pytest.raises(BindProblem):
        users.left_semijoin(users, lambda a, b: (a.id, b.id))
    with pytest.raises(BindProblem):
        users.left_semijoin(person, lambda a, b: (a.name, b.name))
    with pytest.raises(QueryError):
        users.where(lambda t: t.id.eq(1).not_()).frame()
    assert builder.literal_sql(datetime(1970, 1, 1, 0, 0, 0, 1000, timezone.utc)) == "'1970-01-01T00:00:00.001+00:00'" and builder.literal_sql(b"\1\xff") == "0x01ff"


@pytest.mark.parametrize("seed", range(3))
def test_deltas_equal_recomputation(spark, seed):
    """After random transactions: new rows = old rows + inserts - deletes, as bags."""
    rng = random.Random(seed)
    c = Catalog(spark)
    rows = {"r": {(i, rng.randrange(4)) for i in range(8)}, "s": {(i, rng.randrange(4)) for i in range(8)}}
    make = lambda x: spark.createDataFrame(sorted(x), "k int, v int")
    for n in rows:
        c.add(n, make(rows[n]), indexes=[Index(("v",)), Index(("k",))])
    subs = live.Subscriptions(c)
    texts = ["select * from r where v = 1", "select r.* from r join s on r.v = s.v where s.k > 2", "select b.* from r a join r b on a.v = b.v"]
    keys = [subs.subscribe(t)[0] for t in texts]
    for _ in range(3):
        before = [bag(Database(c).sql(t)) for t in texts]
        deltas = {}
        for n in rows:
            gone, came = set(rng.sample(sorted(rows[n]), 3)), {(rng.randrange(20), rng.randrange(4)) for _ in range(3)} - rows[n]
            both = (30, rng.randrange(4))  # inserted and deleted at once
            rows[n] = (rows[n] - gone) | came
            deltas[n] = delta.weighted(make(came | {both}), make(gone | {both}))
        out = subs.apply(deltas)
        for n in rows:
            c.put(n, make(rows[n]))
        for t, key, old in zip(texts, keys, before, strict=True):
            new = Counter(old)
            if key in out:  # else it did not change
                new.update(bag(delta.inserted(out[key])))
                new.subtract(bag(delta.deleted(out[key])))
            assert +new == bag(Database(c).sql(t)), t


def test_subscription_checks(game):
    s = live.Subscriptions(game.catalog)
    a, _ = s.subscribe("select * from player")
    b, _ = s.subscribe("select * from player")
    assert a == b and len(s.active) == 1
    assert s.unsubscribe(a).count() == 3 and len(s.active) == 1
    with pytest.raises(QueryError):
        s.subscribe("select player.* from player join location on player.entity_id = location.entity_id join inventory on inventory.inventory_id = player.inventory_id")
    with pytest.raises(QueryError):
        s.subscribe("select player.* from player join location")
    game.catalog.add("bare", game.catalog.frames["location"])
    with pytest.raises(QueryError, match="index"):
        s.subscribe("select player.* from player join bare on player.entity_id = bare.entity_id")
    game.catalog.tables["location"].event = True
    with pytest.raises(QueryError, match="event"):
        s.subscribe("select player.* from player join location on player.entity_id = location.entity_id")
    assert set(s.subscribe_all()) == {"inventory", "player", "bare"}


def test_cache_counts_references(spark):
    make = lambda x: spark.createDataFrame(x, "a int")
    before = make([(1,), (1,), (2,)])
    change = delta.consolidated(delta.weighted(make([(3,), (3,), (2,)]), make([(1,), (2,), (2,)])))
    assert bag(delta.cache_changes(before, change)) == {(2, "delete"): 1, (3, "insert"): 1}


def test_log(spark, tmp_path):
    make = lambda x: spark.createDataFrame(x, "a int")
    path = str(tmp_path / "log")
    log.append(path, 1, make([(1,), (2,)]), make([]))
    log.append(path, 2, make([(3,)]), make([(1,)]))
    log.append(path, 2, make([(3,)]), make([(1,)]))  # a retry
    log.append(path, 3, make([(1,)]), make([(2,)]))
    entries = spark.read.parquet(path)
    assert [bag(log.replay(entries, n)) for n in (1, 2, 3)] == [{(1,): 1, (2,): 1}, {(2,): 1, (3,): 1}, {(1,): 1, (3,): 1}]
    assert bag(log.replay(entries, truncated_at=2)) == {(1,): 1}


def test_stream(spark, tmp_path):
    c = Catalog(spark)
    for n in ("r", "s"):
        c.add(n, spark.createDataFrame([(1, 1), (2, 2)], "k int, v int"), indexes=[Index(("v",))])
    subs = live.Subscriptions(c)
    key, first = subs.subscribe("select r.* from r join s on r.v = s.v")
    known = bag(first)
    folder = tmp_path / "in"
    folder.mkdir()
    batches = [[("r", 1, (3, 1)), ("s", -1, (2, 2))], [("s", 1, (9, 1)), ("r", -1, (1, 1))]]
    for i, rows in enumerate(batches):
        (folder / f"{i}.json").write_text("\n".join(json.dumps({"_tx": i, "_table": t, "_w": w, "row": json.dumps({"k": k, "v": v})}) for t, w, (k, v) in rows))
    stream = live.LiveStream(subs, str(tmp_path / "out"))
    stream.start(spark, str(folder)).awaitTermination(120)
    for r in stream.changes(spark, key).collect():
        known[(r.k, r.v)] += r._w
    assert +known == bag(Database(c).sql("select r.* from r join s on r.v = s.v")) == {(3, 1): 2}


def test_stream_goes_on_after_a_restart(spark, tmp_path, monkeypatch):
    """Several transactions in a batch, changes that change nothing, a retried batch, compaction; a new process each time."""
    monkeypatch.setattr(live.LiveStream, "COMPACT", 2)
    folder = tmp_path / "in"
    folder.mkdir()
    batches = [[(0, 1, (3, 3)), (1, -1, (1, 1)), (1, 1, (2, 2))], [(2, 1, (2, 2)), (2, -1, (9, 9))], [(4, -1, (3, 3)), (3, 1, (4, 4))], [(5, 1, (1, 1)), (5, -1, (4, 4))]]
    for i, rows in enumerate(batches):
        (folder / f"{i}.json").write_text("\n".join(json.dumps({"_tx": tx, "_table": "r", "_w": w, "row": json.dumps({"k": k, "v": v})}) for tx, w, (k, v) in rows))
    found = []
    for i in range(len(batches)):
        part = tmp_path / "seen"
        part.mkdir(exist_ok=True)
        (part / f"{i}.json").write_text((folder / f"{i}.json").read_text())
        c = Catalog(spark)
        c.add("r", spark.createDataFrame([(1, 1), (2, 2)], "k int, v int"))
        subs = live.Subscriptions(c)
        key, _ = subs.subscribe("select * from r")
        stream = live.LiveStream(subs, str(tmp_path / "out"))
        stream.start(spark, str(part)).awaitTermination(120)
        found.append(bag(c.frames["r"]))
    assert found == [{(2, 2): 1, (3, 3): 1}, {(2, 2): 1, (3, 3): 1}, {(2, 2): 1, (4, 4): 1}, {(1, 1): 1, (2, 2): 1}]
    told = stream.changes(spark, key)
    want = {(0, 1, 3): 1, (1, -1, 1): 1, (3, 1, 4): 1, (4, -1, 3): 1, (5, 1, 1): 1, (5, -1, 4): 1}
    assert bag(told.select("_tx", "_w", "k")) == want and {r.batch for r in told.collect()} == {0, 2, 3}
    again = live.LiveStream(subs, str(tmp_path / "out"))
    again._batch(spark.read.schema(live.STREAM).json(str(folder / "3.json")), 3)
    assert bag(c.frames["r"]) == found[-1] and bag(again.changes(spark, key).select("_tx", "_w", "k")) == want


def test_clients(game):
    s = live.Subscriptions(game.catalog)
    a, b = live.Client(s), live.Client(s)
    assert len(a.subscribe(["select * from *"])) == 3 and [r.count() for r in a.subscribe(["select * from player", "select * from player where entity_id > 100"])] == [3, 2]
    b.subscribe_single(7, "select * from inventory")
    with pytest.raises(QueryError):
        b.subscribe_multi(7, ["select * from player"])
    with pytest.raises(QueryError):
        b.subscribe_multi(8, ["select * from player", "select * from nothing"])
    assert len(s.active) == 3 and b.one_off("select * from player where entity_id = 100").count() == 1
    make = game.catalog.spark.createDataFrame
    out = s.apply({"inventory": delta.weighted(make([(1, "health1"), (5, "rope")], "inventory_id int, name string"), make([], "inventory_id int, name string"))})
    assert a.updates(out) == {} and [bag(d) for d in b.updates(out)[7]] == [{(5, "rope", 1): 1}]
    assert [r.count() for r in b.unsubscribe(7)] == [4] and len(s.active) == 2
    assert s.apply({"player": delta.weighted(make([(100, 1)], "entity_id int, inventory_id int"), make([(9, 9)], "entity_id int, inventory_id int"))}) == {}


def test_scalar_helpers(spark):
    row = lambda *c: spark.range(1).select(*c).first()
    for low, high, step, value, want in ((1, 10, 1, 9, 10), (1, 10, 1, 10, 1), (1, 10, 20, 5, 5), (1, 10, 3, 5, 8), (1, 10, 3, 9, 2), (1, 10, -3, 4, 1), (1, 10, -3, 1, 8)):
        assert row(V.next_in_sequence(F.lit(value), step, low, high))[0] == want
    for last, every, now, want in ((100, 10, 100, 110), (100, 10, 95, 110), (100, -10, 129, 130), (100, 0, 500, 100), (100, 10, 130, 140)):
        assert row(V.next_tick(F.lit(last).cast("long"), F.lit(every).cast("long"), F.lit(now).cast("long")))[0] == want
    at = F.lit("2025-02-10T15:45:30.1234567Z")
    assert tuple(row(V.rfc3339(V.parse_rfc3339(at)), V.duration_text(F.lit(-1500000)), V.iso_duration(F.lit(2500000)))) == ("2025-02-10T15:45:30.123456+00:00", "-1.500000", "PT2.500000S")
    a, b = V.uuid7(1, 1000), V.uuid7(2, 1000)
    assert a < b and a.version == 7 and row(V.uuid_version(V.uuid_bytes(F.lit(str(a)))))[0] == 7


def test_printing(spark):
    others = {"bool": K.BOOL, "str": K.STRING, "bytes": K.BYTES, "i_128": K.I128, "at": K.TIMESTAMP, "took": K.DURATION, "opt": K.option(K.BOOL), "res": K.result(K.BOOL, K.STRING), "action": K.sum_of(inactive=K.UNIT, active=K.UNIT), "pair": K.product(a=K.I8, b=K.I16)}
    schema = T.StructType([T.StructField(n, K.stored(t), True) for n, t in others.items()])
    value = (True, "This", bytearray(b"\1\2"), bytearray(K.wide_bytes(-234434897853, K.I128)), datetime(1970, 1, 1), timedelta(0), True, {"tag": 0, "ok": False, "err": None}, {"tag": 1}, {"a": -25, "b": -3224})
    df = spark.createDataFrame([value], schema)
    lines = sinks.printed(df, others).split("\n")
    cells = [c.strip() for c in lines[2].split(" | ")]
    assert cells == ["true", '"This"', "0x0102", "-234434897853", "1970-01-01T00:00:00+00:00", "+0.000000", "(some = true)", "(ok = false)", "(active = ())", "(a = -25, b = -3224)"]
    assert lines[1].startswith("------+") and [sinks.wire_type(t) for t in (K.U8, K.U64, K.IDENTITY, K.sum_of(a=K.UNIT))] == ["INT2", "NUMERIC", "BYTEA", "ANYENUM"]


def test_unsigned_storage(spark):
    c = Catalog(spark)
    c.add("u", spark.createDataFrame([(Decimal(2**64 - 1), 2**32 - 1), (Decimal(5), 7)], "a decimal(20,0), b bigint"), {"a": K.U64, "b": K.U32})
    assert Database(c).sql("select * from u where a = 18446744073709551615 and b = 4294967295").count() == 1
    with pytest.raises(BindProblem):
        bind(c, "select * from u where b = 4294967296")


def test_workloads(spark):
    n = spark.range(500), spark.range(50), spark.range(50)
    assert workloads.cross_count(*n).first()[0] == 1_250_000
    circles = spark.createDataFrame([(1, 0.0, 0.0, 25), (2, 50.0, 0.0, 1)], "id int, x double, y double, mass int")
    food = spark.createDataFrame([(7, 3.0, 0.0, 1), (8, 5.0, 0.0, 1), (9, 56.0, 0.0, 49), (6, -4.9, 0.0, 0)], "id int, x double, y double, mass int")
    assert bag(workloads.overlaps(circles, food)) == {(1, 7): 1, (2, 9): 1, (1, 6): 1}
    accounts = spark.createDataFrame([(1, 100), (2, 10), (3, 0)], "id int, balance bigint")
    orders = spark.createDataFrame([(1, 2, 60), (1, 3, 40), (2, 3, 11), (3, 3, 5), (1, 9, 0)], "from int, to int, amount bigint")
    assert bag(workloads.transfer(accounts, orders)) == {(1, 0): 1, (2, 70): 1, (3, 40): 1}


def test_overlaps_of_many_and_of_unlike_radii(spark, monkeypatch):
    """One giant makes no cell of everything, one crowded cell no task of everything, and equal things are all there."""
    rng = random.Random(5)

    def things(n, ids):
        rows = [(ids + i, rng.choice([0.0, 1.5, -2.0, 7.0, 31.0]) if i % 3 else rng.uniform(-40, 40), float(rng.randrange(-9, 9)), rng.choice([0, 1, 2, 4, 16, 17, 63, None])) for i in range(n)]
        return [*rows, (ids + n, 100.0, 0.0, 10_000), (ids + n + 1, None, 0.0, 4), (ids + n + 2, float("inf"), 0.0, 4), (ids + n + 3, 1e300, -1e300, 4), (None, 7.0, 0.0, 16)]

    monkeypatch.setattr(workloads, "EQUAL", 40, raising=False)
    for n, m in ((150, 60), (40, 130), (3, 0)):
        a, b = things(n, 0), things(m, 1000) if m else []
        near = lambda c, f: None not in (c[1], f[1]) and math.sqrt((c[1] - f[1]) * (c[1] - f[1]) + (c[2] - f[2]) * (c[2] - f[2])) < max(math.sqrt(c[3] or 0), math.sqrt(f[3] or 0))
        expected = Counter((c[0], f[0]) for c in a for f in b if near(c, f))
        circles, food = (spark.createDataFrame(rows, "id int, x double, y double, mass int") for rows in (a, b))
        assert not b or len(expected) > 500
        assert bag(workloads.overlaps(circles, food)) == expected
        found = workloads.overlaps(circles, food, crowd=4, pairs=200)
        assert bag(found) == expected
        sizes = [r[1] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert not b or len(sizes) > 3 and max(sizes) < sum(expected.values()) / 2


def test_transfers_are_not_sorted(spark):
    """A task of a join with many transfers holds keys of accounts, not the transfers."""
    rng = random.Random(7)
    funds = {i: rng.randrange(400) for i in range(60)}
    orders = [(rng.choice([1, rng.randrange(70)]), rng.choice([2, rng.randrange(70)]), rng.randrange(-1, 9)) for _ in range(3000)] + [(None, 3, 5), (4, None, 1)]
    valid = [o for o in orders if None not in o and o[0] != o[1] and o[2] > 0]
    spent = Counter()
    for f, _, n in valid:
        spent[f] += n
    expected = dict(funds)
    for f, t, n in valid:
        if f in funds and t in funds and funds[f] >= spent[f]:
            expected[f] -= n
            expected[t] += n
    assert expected != funds
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = workloads.transfer(spark.createDataFrame(list(funds.items()), "id int, balance bigint"), spark.createDataFrame(orders, "from int, to int, amount bigint"))
        assert bag(found) == Counter(expected.items())
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    semi = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert semi and all("ShuffledHashJoin" in line for line in semi)
