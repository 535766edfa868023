"""Application workloads that are relational queries at heart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cross_count(*tables: DataFrame) -> DataFrame:
    """Rows of the cross product: the product of the counts, which needs no product."""
    spark = tables[0].sparkSession
    n = F.lit(1).cast("long")
    for t in tables:
        n = n * t.agg(F.count(F.lit(1))).scalar()
    return spark.range(1).select(n.alias("n"))


#: Entries of one side that meet in one task at most, and pairs that are compared in one task on the average.
CROWD, PAIRS = 1 << 13, 1 << 26
#: Equal entries that are gathered at once, on the average at most, before they are cut into lists of at most ``crowd``.
EQUAL = 1 << 20


def _placed(t: DataFrame) -> DataFrame:
    """id, x, y, radius and its class: the least k whose 2^k is no less. What is nowhere overlaps nothing."""
    k = F.ceil(F.least(F.lit(600.0), F.greatest(F.lit(-500.0), F.log2(F.col("r") * (1 + 1e-9)))))  # beyond, squares are 0 or infinite
    t = t.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.sqrt("mass").alias("r"))
    return t.where("abs(x) < double('infinity') AND abs(y) < double('infinity')").withColumn("k", k.cast("int"))


def _lists(t: DataFrame, n: int, crowd: int) -> DataFrame:
    """The n rows of t with equal ones as one: ids, x, y, r, k, at most crowd ids a row."""
    t = t.groupBy("x", "y", "r", "k", F.pmod(F.xxhash64("id"), F.lit(1 + n // EQUAL))).agg(F.collect_list(F.struct("id")).alias("ids"))
    starts = F.sequence(F.lit(1), F.size("ids"), F.lit(crowd))
    parts = F.when(F.size("ids") <= crowd, F.array("ids")).otherwise(F.transform(starts, lambda i: F.slice("ids", i, F.lit(crowd))))
    return t.select(F.explode(parts).alias("ids"), "x", "y", "r", "k")


def _cells(t: DataFrame, own: bool, others: list[int]) -> DataFrame:
    """t's rows in the grids where they meet the other side: grid 2 k + 1 holds pairs whose larger class is the
    second side's (own: t is the second), grid 2 k those whose larger class is the first side's alone."""
    there = F.array(*[F.lit(k) for k in others]).cast("array<int>")
    if own:
        grids = F.concat(F.array(F.col("k") * 2 + 1), F.transform(F.filter(there, lambda k: k > F.col("k")), lambda k: k * 2))
    else:
        grids = F.concat(F.array(F.col("k") * 2), F.transform(F.filter(there, lambda k: k >= F.col("k")), lambda k: k * 2 + 1))
    t = t.withColumn("g", F.explode(grids))
    size = F.pow(F.lit(2.0), F.floor(F.col("g") / 2))
    most = F.lit(9e18)
    return t.withColumns({f"c{v}": F.floor(F.least(most, F.greatest(-most, F.col(v) / size))) for v in "xy"})


def overlaps(circles: DataFrame, food: DataFrame, crowd: int = CROWD, pairs: int = PAIRS) -> DataFrame:
    """Pairs of circle and food nearer than the larger of their radii (root of mass). Both: id, x, y, mass.

    Found by grids, one for each power of two that a radius comes to: a pair meets in that of its larger radius, where it
    can only overlap if its cells touch. The smaller side is entered in all nine cells around; things equal but for their
    ids are compared as one. Where more than crowd entries of a side meet, both are dealt out, so that each part of one
    meets each part of the other; the number of tasks goes by the pairs in touching cells, which like the result grow with the product of both sides.
    """
    spark = circles.sparkSession
    sides = {"circle": _placed(circles), "food": _placed(food)}
    found = {n: t.agg(F.struct(F.count(F.lit(1)).alias("n"), F.collect_set("k").alias("ks")).alias(n)) for n, t in sides.items()}
    found = found["circle"].crossJoin(found["food"]).first()
    first, second = sorted(sides, key=lambda n: -found[n]["n"])
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    keys = ["g", "cx", "cy"]

    def spread(t: DataFrame) -> DataFrame:
        t = t.withColumn("_x", F.explode(around)).withColumn("_y", F.explode(around))
        return t.withColumns({"cx": F.col("cx") + F.col("_x"), "cy": F.col("cy") + F.col("_y")}).drop("_x", "_y")

    def entered(of: Callable[[str], DataFrame]) -> tuple[DataFrame, DataFrame]:
        return _cells(of(first), False, found[second]["ks"]), _cells(of(second), True, found[first]["ks"])

    tasks, crowded = 1, []
    if found[first]["n"] * found[second]["n"] > pairs:
        count = F.count(F.lit(1))
        one, other = entered(sides.get)
        m = spread(other.groupBy(keys).agg(count.alias("m"))).groupBy(keys).agg(F.sum("m").alias("m"))
        cells = one.groupBy(keys).agg(count.alias("n")).join(m, keys)
        parts = [F.ceil(F.col(c) / crowd).cast("int").alias(p) for c, p in (("n", "a"), ("m", "b"))]
        full = F.when((F.col("n") > crowd) | (F.col("m") > crowd), F.struct(*keys, *parts))
        work, crowded = cells.agg(F.sum(F.col("n") * F.col("m").cast("double")), F.collect_list(full)).first()
        tasks = max(1, round((work or 0) / pairs))
    one, other = entered(lambda n: _lists(sides[n], found[n]["n"], crowd))
    if crowded:  # no more cells than entries / crowd
        dealt = F.broadcast(spark.createDataFrame(crowded, "g int, cx long, cy long, a int, b int"))

        def part(t: DataFrame, mine: str, its: str) -> DataFrame:
            t = t.join(dealt, keys, "left").withColumn(mine, F.pmod(F.xxhash64(F.col("ids")[0]["id"]), F.coalesce(mine, F.lit(1))).cast("int"))
            return t.withColumn(its, F.explode(F.sequence(F.lit(0), F.coalesce(its, F.lit(1)) - 1)))

        one, other = part(one, "a", "b"), part(spread(other), "b", "a")
        keys = [*keys, "a", "b"]
    else:
        other = spread(other)
    lists = other.repartition(tasks, *keys).groupBy(keys).agg(F.collect_list(F.struct("ids", "x", "y", "r")).alias("those"))
    met = one.repartition(tasks, *keys).join(lists.hint("shuffle_hash"), keys)
    met = met.select("ids", "x", "y", "r", F.explode("those").alias("o"))
    dx, dy = F.col("x") - F.col("o.x"), F.col("y") - F.col("o.y")
    met = met.where(F.sqrt(dx * dx + dy * dy) < F.greatest("r", "o.r"))
    met = met.select(F.explode("ids").alias(first), F.col("o.ids").alias("those")).select(first, F.explode("those").alias(second))
    return met.select(*[F.col(n)["id"].alias(n) for n in ("circle", "food")])


def moved(positions: DataFrame, velocities: DataFrame, key: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """UPDATE positions SET p = p + v FROM velocities by key; positions without velocity stay."""
    v = velocities.select(F.col(key).alias("_key"), *[F.col(b).alias(f"_{b}") for _, b in pairs])
    joined = positions.join(v, F.col(key) == F.col("_key"), "left")
    new = {a: F.col(a) + F.coalesce(F.col(f"_{b}"), F.lit(0)) for a, b in pairs}
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in positions.columns])


def advanced(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """UPDATE rows SET p = p + v for every row, from its own columns; types stay."""
    kinds = dict(rows.dtypes)
    new = {a: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).cast(kinds[a]) for a, b in pairs}
    return rows.select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns])


def transfer(accounts: DataFrame, orders: DataFrame, key: str = "id", balance: str = "balance") -> DataFrame:
    """Applies transfers (from, to, amount), all at once, that the sender's balance covers in total; a sender who
    cannot pay all sends nothing. Transfers to oneself or of nothing are ignored.

    The transfers pass by hashed keys of accounts and are not sorted, so a task holds accounts of its part and no transfers.
    """
    valid = orders.where("`from` <> `to` and amount > 0")
    spent = valid.groupBy("from").agg(F.sum("amount").alias("spent"))
    able = accounts.select(F.col(key).alias("from"), F.col(balance).alias("_b")).join(spent, "from").where("_b >= spent").select("from")
    known = accounts.select(F.col(key).alias("to"))
    paid = valid.join(able.hint("shuffle_hash"), "from", "left_semi").join(known.hint("shuffle_hash"), "to", "left_semi")
    ends = [F.struct(F.col(k).alias("_k"), d.alias("_d")) for k, d in (("from", -F.col("amount")), ("to", F.col("amount")))]
    net = paid.select(F.inline(F.array(*ends))).groupBy("_k").agg(F.sum("_d").alias("_d"))
    joined = accounts.join(net, F.col(key) == F.col("_k"), "left")
    new: Column = F.col(balance) + F.coalesce("_d", F.lit(0))
    return joined.select(*[(new if c == balance else F.col(c)).alias(c) for c in accounts.columns])


def nested_lookup(outer: DataFrame, outer_column: str, outer_value, inner: DataFrame, inner_key: str, via: str) -> DataFrame:
    """Index probe, then a lookup by key for each row found."""
    return outer.where(F.col(outer_column) == outer_value).join(inner, F.col(via) == F.col(inner_key)).select(*[inner[c] for c in inner.columns])
