"""Near-duplicate classes by ProbMinHash, banding and verification.

Texts are lower-cased and split at white space; their shingles are runs of WORDS words (all words of a
shorter text), weighted by how often they occur. Each shingle is a Poisson process of points in time whose
rate is its weight; each of the M registers keeps the shingle of its earliest point, and a
shingle's process ends once it is later than all registers. Two registers agree with the probability Jaccard
similarity of the weighted sets. BANDS bands of ROWS registers choose candidates; a pair is linked
if its probability Jaccard, computed exactly from both texts, is at least the threshold. Classes are
the connected components of the links.

Scale: texts with the same words are one node, so that groups of copies vanish before the bands. In a
band's bucket all pairs are never listed: in each round (see LEADERS) members are compared with a few leaders of
the bucket, unless they are known to be of one class. The few that then still are outside the largest class of
their bucket are compared with all its other members: signatures first, in blocks of at most PART by PART, and then the texts
of only those members of a block that have a candidate in it. So no candidate pair is dropped, and pairs that must link nothing are not made.

Pairs whose signatures agree in less than LEAST of the registers are not verified: at a similarity of 0.8 that is five
standard deviations off (a chance of 5e-7, where the bands miss 1e-6). With ``least`` 0 every pair that shares a band is verified.

Long texts: shingles are made from parts of CHARS characters, and words longer than LONGEST stand as their digest.

Defined results: a null or empty text, or one of white space only, is a class of its own; rows that agree in id and
text are in one class; class_id is the least id of a class (null if it has none); an empty table gives an
empty result; only the columns named are read, so extra columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm import bloom
from tidewater.llm.common import bounded_batches, discard, few, lean, release, written
from tidewater.llm.components import components
from tidewater.llm.rolling import Sums

WORDS, THRESHOLD = 5, 0.8
ROWS, BANDS = 4, 26
M = ROWS * BANDS
LEAST, LEADERS, PART = 0.6, (1,), 2048
#: Characters, and shingles, worked on at once; characters of a word.
CHARS, SHINGLES, LONGEST = 1 << 19, 1 << 20, 4096
_U = np.uint64


def canonical(text: str | None) -> str:
    words = (text or "").lower().split()
    if text and len(text) > LONGEST and max(map(len, words), default=0) > LONGEST:
        words = [w if len(w) <= LONGEST else hashlib.sha256(w.encode()).hexdigest() for w in words]
    return " ".join(words)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of canonical texts: text, hash and weight of each different shingle, sorted by text and hash. Runs of about
    CHARS characters are worked on at once."""
    parts, start = [], 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop]) <= CHARS):
            size += len(texts[stop]) + 1
            stop += 1
        owner, value, weight = _shingles(texts[start:stop]) if stop > start + 1 or len(texts[start]) <= CHARS else _long(texts[start])
        parts.append((owner + start, value, weight))
        start = stop
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    owner, value, weight = (np.concatenate(c) for c in zip(*parts, strict=True))
    return owner, value, weight


def _long(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of one text from parts of it, each with the first words of the next."""
    values, weights, start = [], [], 0
    while True:
        cut = text.find(" ", start + CHARS)
        end = cut
        for _ in range(WORDS - 1):
            end = text.find(" ", end + 1) if end >= 0 else end
        part = _shingles([text[start:end] if end >= 0 else text[start:]])
        values.append(part[1])
        weights.append(part[2])
        if end < 0:
            break
        start = cut + 1
    value, weight = np.concatenate(values), np.concatenate(weights)
    order = np.argsort(value, kind="stable")
    value = value[order]
    new = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    return np.zeros(len(new), np.int64), value[new], np.add.reduceat(weight[order], new)


def _shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer((" ".join(texts) + " ").encode(), np.uint8)
    lengths = np.array([len(t.encode()) if not t.isascii() else len(t) for t in texts], np.int64)
    begin = np.cumsum(lengths + 1) - lengths - 1
    sums = Sums(data)
    blank = np.flatnonzero(data == 32)  # ends of words, and of empty texts
    if not lengths.all():
        blank = np.setdiff1d(blank, begin[lengths == 0], assume_unique=True)
    start = np.append(0, blank[:-1] + 1) if len(blank) else blank
    if not lengths.all() and len(blank):
        # a word after an empty text starts behind its blank
        text_of = np.searchsorted(begin, blank, side="right") - 1
        start = np.maximum(start, begin[text_of])
    text_of = np.searchsorted(begin, start, side="right") - 1
    words = np.bincount(text_of, minlength=len(texts))
    first = np.cumsum(words) - words
    n = np.where(words > 0, np.maximum(words - WORDS + 1, 1), 0)
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    last = np.minimum(at + WORDS - 1, first[owner] + words[owner] - 1)
    begin_at, stop_at = start[at], blank[last]
    value = sums.part(begin_at, stop_at)
    value ^= (stop_at - begin_at).astype(np.uint64) * _U(0xD6E8FEB86659FD93)
    value = bloom.mixed(value.view(np.int64))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(value, prepend=_U(0)) != 0) | (np.arange(len(owner)) == 0))
    return owner[new], value[new], np.diff(new, append=len(owner)).astype(np.float64)


def signatures(owner: np.ndarray, value: np.ndarray, weight: np.ndarray, texts: int, m: int = M) -> np.ndarray:
    """(texts, m) uint32: ProbMinHash registers; texts without shingles have zeros."""
    best = np.full(texts * m, np.inf)
    kept = np.zeros(texts * m, np.uint64)
    for i in range(0, len(owner), SHINGLES):
        _race(owner[i : i + SHINGLES], value[i : i + SHINGLES], weight[i : i + SHINGLES], best, kept, m)
    return (kept >> _U(32)).astype(np.uint32).reshape(texts, m)


def _race(owner: np.ndarray, value: np.ndarray, weight: np.ndarray, best: np.ndarray, kept: np.ndarray, m: int) -> None:
    """Runs the processes of some shingles against the registers' earliest times so far."""
    time = np.zeros(len(owner))
    round_ = 0
    while len(owner):
        round_ += 1
        draw = bloom.mixed(value.view(np.int64) ^ np.int64(round_ * 0x2545F4914F6CDD1D % (1 << 63)))
        time = time - np.log(((draw >> _U(11)).astype(np.float64) + 0.5) / (1 << 53)) / weight
        at = owner * m + (bloom.mixed(draw.view(np.int64)) % _U(m)).astype(np.int64)
        np.minimum.at(best, at, time)
        won = best[at] == time
        kept[at[won]] = value[won]
        latest = best.reshape(-1, m).max(axis=1)
        live = time < latest[owner]
        owner, value, weight, time = owner[live], value[live], weight[live], time[live]


def bands_of(signature: np.ndarray) -> np.ndarray:
    """(texts, BANDS) int64."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    columns = [np.broadcast_to(np.arange(BANDS), parts.shape[:2]).ravel()] + [parts[:, :, i].astype(np.int64).ravel() for i in range(ROWS)]
    return bloom.mixed(*columns).view(np.int64).reshape(-1, BANDS)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two weighted sets (sorted values, weights)."""
    if a[1].max(initial=1) == 1 == b[1].max(initial=1):  # plain sets: their Jaccard similarity
        every = np.concatenate([a[0], b[0]])
        every.sort()
        n = int((every[1:] == every[:-1]).sum())
        return n / (len(every) - n) if len(every) else 0.0
    both, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    wa, wb = a[1][at_a], b[1][at_b]
    only_a, only_b = a[1].sum() - wa.sum(), b[1].sum() - wb.sum()
    total = 0.0
    pairs, count = np.unique(np.stack([wa, wb], axis=1), axis=0, return_counts=True)
    for (x, y), n in zip(pairs, count, strict=True):
        total += n / (np.maximum(wa / x, wb / y).sum() + only_a / x + only_b / y)
    return float(total)


def _node(text: str, ord: int, tie: int) -> bytes:
    return hashlib.md5(text.encode() if text else f"\0{ord} {tie}".encode()).digest()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ord, tie, texts = (batch.column(i).to_pylist() for i in range(3))
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and size < CHARS:
                size += len(texts[stop] or "")
                stop += 1
            plain = [canonical(t) for t in texts[start:stop]]
            found = signatures(*shingles(plain), len(plain))
            nodes = [_node(t, o, i) for t, o, i in zip(plain, ord[start:stop], tie[start:stop], strict=True)]
            has = pa.array([bool(t) for t in plain])
            yield pa.record_batch([batch.column(0).slice(start, stop - start), batch.column(1).slice(start, stop - start), pa.array(nodes, pa.binary()), has, pa.array([r.tobytes() for r in found], pa.binary()), pa.array(list(bands_of(found)), pa.list_(pa.int64()))], names=["ord", "tie", "node", "has", "signature", "bands"])
            start = stop


def _agree(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs whose signatures agree in least of the registers."""
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, M) for c in ("x", "y"))
            ok = pa.array((x == y).mean(axis=1) >= least)
            yield pa.record_batch([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

    return run


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[bytes, tuple] = OrderedDict()

        def sets(node: bytes, text: str) -> tuple:
            if node not in known:
                known[node] = shingles([text])[1:]
                if len(known) > 64:
                    known.popitem(last=False)
            return known[node]

        for batch in batches:
            ok = [similarity(sets(a, x), sets(b, y)) >= threshold - 1e-12 for a, b, x, y in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "x", "y")], strict=True)]
            yield pa.record_batch([batch.column("a").filter(pa.array(ok, pa.bool_())), batch.column("b").filter(pa.array(ok, pa.bool_()))], names=["a", "b"])

    return run


class _Linker:
    """Candidate nodes with signatures and texts, and the links found so far."""

    def __init__(self, docs: DataFrame, sketches: DataFrame, threshold: float, least: float) -> None:
        self.spark = docs.sparkSession
        self.threshold, self.least = threshold, least
        nodes = sketches.where("has").select("node", "bands").dropDuplicates(["node"])
        each = nodes.select("node", F.explode("bands").alias("band"))
        shared = each.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high").select("band", "size")
        shared = written(shared, "near-buckets")
        self.members = written(each.join(few(shared), "band"), "near-members")
        discard(shared)
        wanted = written(self.members.select("node").distinct(), "near-wanted")
        n = wanted.count()
        # copies go before the shuffle, so that many of one text don't meet in one task
        self.signatures = written(sketches.where("has").select("node", "signature").dropDuplicates(["node"]).join(wanted, "node", "left_semi"), "near-signatures")
        self.texts = self._texts(docs, wanted, n)
        discard(wanted)
        self.links = None
        release(self.spark)

    def _texts(self, docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
        known = self.spark.sparkContext.broadcast(bloom.build(wanted, n))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                plain = [canonical(t) for t in batch.column("text").to_pylist()]
                plain = [t for t in plain if t]
                if not plain:
                    continue
                nodes = [_node(t, 0, 0) for t in plain]
                ok = np.flatnonzero(bloom.holds(known.value, bloom.mixed(*bloom.halves(nodes)))).tolist()
                for i in range(0, len(ok), 1000):
                    yield pa.record_batch([pa.array([nodes[j] for j in ok[i : i + 1000]], pa.binary()), pa.array([plain[j] for j in ok[i : i + 1000]], pa.string())], names=["node", "words"])

        found = docs.select("text").mapInArrow(lean(run), "node binary, words string")
        return written(found.dropDuplicates(["node"]).join(wanted, "node", "left_semi"), "near-texts")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are linked."""
        s = self.signatures
        pairs = pairs.join(s.select(F.col("node").alias("a"), F.col("signature").alias("x")), "a").join(s.select(F.col("node").alias("b"), F.col("signature").alias("y")), "b")
        pairs = written(pairs.mapInArrow(lean(_agree(self.least)), "a binary, b binary"), "near-pairs")
        t = self.texts
        found = pairs.join(t.select(F.col("node").alias("a"), F.col("words").alias("x")), "a").join(t.select(F.col("node").alias("b"), F.col("words").alias("y")), "b")
        links = written(found.mapInArrow(lean(_verify(self.threshold)), "a binary, b binary"), "near-links")
        discard(pairs)
        return links

    def add(self, links: DataFrame) -> None:
        """Adds links (a written table)."""
        if not links.isEmpty():
            before = self.links
            self.links = components(links if before is None else links.unionByName(before))
            discard(before)
        discard(links)

    def labelled(self, members: DataFrame) -> DataFrame:
        """members with label: the least node of the node's class so far."""
        if self.links is None:
            return members.withColumn("label", F.col("node"))
        found = self.links.select(F.col("a").alias("node"), F.col("b").alias("_label"))
        return members.join(found, "node", "left").withColumn("label", F.coalesce("_label", "node")).drop("_label")

    def open(self, members: DataFrame) -> DataFrame:
        """Members, with labels, of the buckets that hold several classes. Written."""
        members = self.labelled(members.drop("label"))
        several = members.groupBy("band").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low <> _high").select("band")
        several = written(several, "near-several")
        out = written(members.join(few(several), "band", "left_semi"), "near-open")
        discard(several)
        return out

    def run(self) -> DataFrame | None:
        """a, b of every node that is not the least of its class, or None; written."""
        members = self.members
        for k, n in enumerate((*LEADERS, None)):
            before = members
            # after a round buckets of two nodes have no other pair
            members = self.open(members if not k else members.where("size > 2"))
            discard(before)
            if members.isEmpty():
                break
            self.add(self._led(members, k, n) if n else self._rest(members))
            release(self.spark)
        discard(members, self.signatures, self.texts)
        return self.links

    def _led(self, members: DataFrame, k: int, n: int) -> DataFrame:
        """Links of members with n leaders of their bucket."""
        drawn = Window.partitionBy("band").orderBy(F.xxhash64("node", F.lit(k)), "node")
        leaders = members.withColumn("place", F.row_number().over(drawn)).where(F.col("place") <= n).select("band", "node", "label").toDF("band", "b", "b_label")
        leaders = written(leaders, "near-leaders")
        pairs = members.join(few(leaders), "band").where("label <> b_label").select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
        links = self.verified(pairs)
        discard(leaders)
        return links

    def _rest(self, members: DataFrame) -> DataFrame:
        """Links of one bucket and different classes: those outside the largest class of the bucket against all. A pair is
        looked at only in the first band that it shares, the likeliest first, and not at all once its two are known to
        be of one class. The members of a bucket are dealt into parts, and those that ask into turns, so that a block holds
        at most about PART of each."""
        counts = members.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
        sizes = counts.groupBy("band").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"))
        parts = lambda n: F.greatest(F.lit(1), F.ceil(n / PART)).cast("int")
        sizes = written(sizes.select("band", F.col("top.label").alias("main"), parts(F.col("all")).alias("parts"), parts(F.col("all") - F.col("top.n")).alias("turns")), "near-sizes")
        full = members.select("band", "node", "label").join(few(sizes), "band").join(self.signatures, "node").withColumn("asks", F.col("label") != F.col("main"))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        mine = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
        columns, alone = ["band", "node", "label", "signature"], (F.col("parts") == 1) & (F.col("turns") == 1)
        one = full.where(alone).select(*columns, F.lit(0).alias("part"), F.lit(0).alias("turn"), F.lit(True).alias("held"), "asks")
        held = full.where(~alone).select(*columns, mine("parts", 0).alias("part"), each("turns").alias("turn"), F.lit(True).alias("held"), F.lit(False).alias("asks"))
        asking = full.where(~alone).where("asks").select(*columns, each("parts").alias("part"), mine("turns", 1).alias("turn"), F.lit(False).alias("held"), F.lit(True).alias("asks"))
        rows = one.unionByName(held).unionByName(asking)
        block = ["band", "part", "turn"]
        kinds = "band bigint, node binary, label binary, signature binary, part int, turn int, held boolean, asks boolean"
        close = written(rows.groupBy(*block).applyInArrow(_close_within(self.least), kinds), "near-close")
        links = written(close.join(self.texts, "node").groupBy(*block).applyInArrow(_links_within(self.threshold, self.least), "a binary, b binary").distinct(), "near-links")
        discard(sizes, close)
        return links


def _candidates(rows: pa.Table, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each row that asks the rows held that may be linked with it, the likeliest first."""
    held, asks = rows["held"].to_numpy(), rows["asks"].to_numpy()
    signature = np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint32).reshape(-1, M)
    bands = bands_of(signature)
    place = int(np.flatnonzero(bands[0] == rows["band"][0].as_py())[0])
    codes: dict[bytes, int] = {}
    label = np.array([codes.setdefault(v, len(codes)) for v in rows["label"].to_pylist()])
    others = np.flatnonzero(held)
    theirs, their_bands = signature[others], bands[others]
    for i in np.flatnonzero(asks).tolist():
        agree = (signature[i] == theirs).mean(axis=1)
        ok = np.flatnonzero((agree >= least) & (label[others] != label[i]))
        ok = ok[(bands[i] == their_bands[ok]).argmax(axis=1) == place]
        yield i, others[ok[np.argsort(-agree[ok], kind="stable")]]


def _close_within(least: float):
    def run(rows: pa.Table) -> pa.Table:
        """The rows of a block that are in some candidate pair of it."""
        keep = np.zeros(len(rows), bool)
        for i, found in _candidates(rows, least):
            if len(found):
                keep[i] = True
                keep[found] = True
        return rows.select(["band", "node", "label", "signature", "part", "turn", "held", "asks"]).filter(pa.array(keep))

    return run


class _Sets:
    """The weighted shingle sets of a block's texts."""

    def __init__(self, texts: list[str]) -> None:
        owner, self.value, self.weight = shingles(texts)
        self.cut = np.searchsorted(owner, np.arange(len(texts) + 1))
        self.plain = np.ones(len(texts), bool)  # every shingle once
        self.plain[owner[self.weight > 1]] = False

    def one(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        here = slice(self.cut[i], self.cut[i + 1])
        return self.value[here], self.weight[here]

    def similarities(self, i: int, others: np.ndarray) -> np.ndarray:
        """Of text i to others: plain sets at once, the rest one by one."""
        out = np.zeros(len(others))
        quick = np.flatnonzero(self.plain[others] & self.plain[i])
        if len(quick):
            mine, begin = self.one(i)[0], self.cut[others[quick]]
            size = self.cut[others[quick] + 1] - begin
            first = np.cumsum(size) - size
            theirs = self.value[np.arange(size.sum()) + np.repeat(begin - first, size)]
            both = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
            shared = np.add.reduceat(both, first, dtype=np.int64)
            out[quick] = shared / (len(mine) + size - shared)
        for n in np.flatnonzero(~(self.plain[others] & self.plain[i])).tolist():
            out[n] = similarity(self.one(i), self.one(int(others[n])))
        return out


def _links_within(threshold: float, least: float):
    def run(rows: pa.Table) -> pa.Table:
        nodes = rows["node"].to_pylist()
        sets = _Sets(rows["words"].to_pylist())
        codes: dict[bytes, int] = {}
        of = np.array([codes.setdefault(v, len(codes)) for v in rows["label"].to_pylist()])  # class of each row so far
        found: list[tuple[bytes, bytes]] = []
        for i, near in _candidates(rows, least):
            near = near[of[near] != of[i]]
            if not len(near):
                continue
            for j in near[sets.similarities(i, near) >= threshold - 1e-12].tolist():
                if of[j] != of[i]:
                    of[of == of[j]] = of[i]
                    found.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.binary()), "b": pa.array([f[1] for f in found], pa.binary())})

    return run


def classes(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, least: float = LEAST) -> DataFrame:
    """ord, tie, id and class_id of every row (ord and tie stand for id and text: see ``keys``). least: share of
    registers in which pairs must agree to be verified; 0 verifies all that share a band."""
    bounded_batches(docs.sparkSession)
    base = keyed(docs, id, text)
    sketches = written(base.mapInArrow(lean(_sketch), "ord bigint, tie bigint, node binary, has boolean, signature binary, bands array<bigint>"), "near-sketches")
    links = _Linker(base, sketches, threshold, least).run()
    rows = sketches.select("ord", "tie", "node")
    if links is not None:
        found = links.select(F.col("a").alias("node"), F.col("b").alias("_label"))
        rows = rows.join(found, "node", "left").select("ord", "tie", F.coalesce("_label", "node").alias("node"))
    none = F.lit(-(1 << 63))
    rows = written(rows, "near-rows")
    discard(sketches, links)
    firsts = rows.groupBy("node").agg(F.min(F.when(F.col("ord") != none, F.col("ord"))).alias("class_id"), F.min(F.struct("ord", "tie")).alias("first"))
    # written, so that a join with a large class is one that AQE splits: it splits none that has an aggregation below it
    return rows.join(few(written(firsts, "near-firsts")), "node").select("ord", "tie", F.when(F.col("ord") != none, F.col("ord")).alias(id), "class_id", "first")


def keys(id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """ord (the id, null as the least number) and tie (a hash of the text)."""
    return F.coalesce(F.col(id).cast("long"), F.lit(-(1 << 63))).alias("ord"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tie")


def keyed(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(*keys(id, text), F.col(text).cast("string").alias("text"))
