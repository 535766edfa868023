"""Removal of every byte that a LENGTH-byte string covers which also starts earlier.

Earlier: in a document with a smaller id (null first; of equal ids by a hash of the text), or in the
same document before. Rows that agree in id and text are one document and get the same result.

Equal windows of LENGTH bytes meet as follows. Each window picks, by content alone, one of its SEED-byte
grams (the leftmost least by hash) as its anchor. So equal windows lie alike around equal anchors. The
windows of one anchor form a context, a stretch of text of 100 to 152 bytes. Anchors that occur once in
the corpus are out. Equal contexts are counted together. Where an anchor has different contexts, they are
laid end to end, and their suffix array (see suffix.py), built by the linear grouping construction, brings
equal windows side by side; each class of equal windows takes the earliest place of its members.
Every occurrence later than that place gives an interval to remove.

Scale: nothing is gathered by document group. Contexts are pre-aggregated, so that copies cost one row
each; anchors with more than HOT contexts are dealt out by the bytes that a few neighbouring
windows share, and where more than CROWD contexts share even these (one common line in ever different
surroundings), window by window: there equal windows are one key, whose earliest place is an aggregate formed before
the shuffle, and no task holds a key's contexts. Suffix arrays have at most about BLOCK symbols each. Exact copies are told by their
digest first. Long texts are worked on in pieces of PIECE bytes. Texts are moved only if they lose something. Filters that spare
shuffles have a bounded size.

Defined results: null text counts as empty; texts shorter than LENGTH lose nothing; an exact copy
of an earlier text of at least LENGTH bytes goes whole; empty tables give empty results; only the columns
named are read, so extra columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import bloom
from tidewater.llm.common import bounded_batches, discard, few, release, written
from tidewater.llm.rolling import Sums
from tidewater.llm.suffix import suffix_arrays

LENGTH, SEED = 100, 48
SPAN = LENGTH - SEED + 1
#: Contexts of an anchor beyond which it is dealt out; windows of a cell then; contexts of a cell's key beyond which
#: that is dealt out; symbols of a suffix array; symbols worked on at once.
HOT, CELL, CROWD, BLOCK, BATCH = 512, 8, 512, 4096, 1 << 18
#: Text bytes per partition of the anchors; bytes of a text worked on at once.
PARTITION, PIECE = 64 << 20, 1 << 20

_U = np.uint64


class Anchors:
    """Anchors of a text (at least LENGTH bytes), or of a piece of one: place at, windows [at + low, at + high], hashes of
    gram and context. base: place of the piece in its text."""

    def __init__(self, data: np.ndarray, base: int = 0) -> None:
        self.base = base
        self.sums = Sums(data)
        n = len(data)
        gram = self.sums.part(np.arange(n - SEED + 1), np.arange(SEED, n + 1))
        gram ^= gram >> _U(29)
        gram *= _U(0xBF58476D1CE4E5B9)
        gram ^= gram >> _U(32)
        least = (gram & _U(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
        width = 1
        while 2 * width <= SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < SPAN:
            rest = SPAN - width
            least = np.minimum(least[:-rest], least[rest:])
        place = (least & _U(0xFFFFFFFF)).astype(np.int64)  # of each window's anchor; never falls
        begin = np.flatnonzero(np.diff(place, prepend=-1))
        self.last = int(begin[-1])  # window at which the last run of windows of one anchor starts
        self.at = place[begin]
        self.low = begin - self.at
        self.high = np.append(begin[1:], len(place)) - 1 - self.at
        self.gram = gram[self.at].view(np.int64)
        shape = ((self.low + 128) * 256 + self.high + 128).astype(np.uint64)
        context = self.hashed(self.at + self.low, self.at + self.high + LENGTH)
        self.context = ((context ^ (shape * _U(0xD6E8FEB86659FD93))) * _U(0x94D049BB133111EB)).view(np.int64)

    def hashed(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return self.sums.part(start, stop)

    def but_last(self) -> Anchors:
        """Without the last run, which goes on in the next piece."""
        self.at, self.low, self.high, self.gram, self.context = (x[:-1] for x in (self.at, self.low, self.high, self.gram, self.context))
        return self


def anchors(data: np.ndarray) -> Iterator[Anchors]:
    """The anchors of a text, piece by piece. A piece starts where a run of windows of one anchor starts, so they are the
    same as those of the whole."""
    start = 0
    while len(data) - start > PIECE + 2 * LENGTH:
        found = Anchors(data[start : start + PIECE + LENGTH], start)
        begin = found.last
        yield found.but_last()
        start += begin
    yield Anchors(data[start:], start)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    for batch in batches:
        for ord, tie, text in zip(batch.column("ord").to_numpy().tolist(), batch.column("tie").to_numpy().tolist(), batch.column("text"), strict=True):
            data = text.as_buffer().to_pybytes()
            yield ord, tie, data, np.frombuffer(data, np.uint8)


def _spots(a: Anchors, pick: np.ndarray) -> np.ndarray:
    """Place and window range in one number that sorts by place."""
    return (a.at[pick] + a.base << 16) + ((a.low[pick] + 128) << 8) + a.high[pick] + 128


def _repeated(texts: DataFrame, partitions: int) -> DataFrame:
    """gram hashes that occur more than once (but for chance, 48 bits and the bucket being compared)."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def packed() -> pa.RecordBatch:
            keys, count = np.unique(np.concatenate(held).view(np.uint64), return_counts=True)
            keys = np.concatenate([keys, keys[count > 1]])  # twice is enough
            bucket = ((keys >> _U(48)) % _U(partitions)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            keys, bucket = keys[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            short = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            return pa.record_batch([pa.array(bucket[cuts], pa.int32()), pa.array([short[a:b].tobytes() for a, b in zip(cuts, np.append(cuts[1:], len(keys)), strict=True)], pa.binary())], names=["bucket", "keys"])

        for *_, data in _texts(batches):
            for a in anchors(data):
                held.append(a.gram)
                size += len(a.gram)
                if size >= 1 << 21:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(b, []).append(keys)
        while held:
            bucket, parts = held.popitem()
            short = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 6)
            wide = np.zeros((len(short), 8), np.uint8)
            wide[:, :6] = short
            keys, count = np.unique(wide.view("<u8").ravel(), return_counts=True)
            keys = keys[count > 1].view(np.int64)
            yield pa.record_batch([pa.array(np.full(len(keys), bucket, np.int64)), pa.array(keys)], names=["bucket", "short"])

    packed = texts.mapInArrow(grams, "bucket int, keys binary")
    return packed.repartition(partitions, "bucket").mapInArrow(twice, "bucket bigint, short bigint")


def _gram_key(gram: np.ndarray, partitions: int) -> np.ndarray:
    g = gram.view(np.uint64)
    return bloom.mixed(((g >> _U(48)) % _U(partitions)).astype(np.int64), (g & _U((1 << 48) - 1)).view(np.int64))


def _occurrences(texts: DataFrame, bitmap, partitions: int) -> DataFrame:
    """gram, context, ord, tie, spot of the anchors whose gram may be repeated."""
    names = ["gram", "context", "ord", "tie", "spot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        join = lambda: pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)
        for ord, tie, _, data in _texts(batches):
            for a in anchors(data):
                pick = np.flatnonzero(bloom.holds(bitmap.value, _gram_key(a.gram, partitions)))
                if len(pick):
                    held.append((a.gram[pick], a.context[pick], np.full(len(pick), ord), np.full(len(pick), tie), _spots(a, pick)))
                    size += len(pick)
                if size >= 1 << 17:
                    yield join()
                    held, size = [], 0
        if held:
            yield join()

    return texts.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _contexts(texts: DataFrame, wanted, hot) -> DataFrame:
    """key, dealt, gram, context, ord, tie, spot, start, bytes: of anchors whose occurrence is wanted; those of hot grams (dealt)
    cell by cell."""
    names = ["key", "gram", "context", "ord", "tie", "spot", "start", "bytes", "dealt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        out = lambda: pa.record_batch([*[pa.array(np.concatenate([np.atleast_1d(r[i]) for r in rows])) for i in range(7)], pa.array([b for r in rows for b in r[7]], pa.binary()), pa.array(np.concatenate([r[8] for r in rows]))], names=names)
        for ord, tie, text, data in _texts(batches):
            for a in anchors(data):
                spots = _spots(a, np.arange(len(a.at)))
                pick = np.flatnonzero(bloom.holds(wanted.value, bloom.mixed(np.full(len(spots), ord), np.full(len(spots), tie), spots)))
                if not len(pick):
                    continue
                many = bloom.holds(hot.value, bloom.mixed(a.gram[pick]))
                for chosen, cells in ((pick[~many], False), (pick[many], True)):
                    if not len(chosen):
                        continue
                    low, high, key = a.low[chosen], a.high[chosen], a.gram[chosen]
                    if cells:
                        first, last = low // CELL, high // CELL
                        n = last - first + 1
                        chosen = np.repeat(chosen, n)
                        cell = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
                        low, high = np.maximum(np.repeat(low, n), cell * CELL), np.minimum(np.repeat(high, n), cell * CELL + CELL - 1)
                        at = a.at[chosen]
                        # what all windows of the cell share
                        core = a.hashed(at + cell * CELL + CELL - 1, at + cell * CELL + LENGTH)
                        key = bloom.mixed(a.gram[chosen], cell, core.view(np.int64)).view(np.int64)
                    begin, stop = a.at[chosen] + low + a.base, a.at[chosen] + high + LENGTH + a.base
                    rows.append((key, a.gram[chosen], a.context[chosen], np.full(len(chosen), ord), np.full(len(chosen), tie), spots[chosen], low, [text[i:j] for i, j in zip(begin.tolist(), stop.tolist(), strict=True)], np.full(len(chosen), cells)))
                    size += len(chosen)
                if size >= 1 << 15:
                    yield out()
                    rows, size = [], 0
        if rows:
            yield out()

    return texts.mapInArrow(run, ", ".join(f"{n} {'binary' if n == 'bytes' else 'boolean' if n == 'dealt' else 'bigint'}" for n in names))


def _single(contexts: DataFrame) -> DataFrame:
    """gram, context, low, high (the same): windows of contexts that an earlier context of their key has, window by
    window; written. Equal windows are one key, so their earliest place is a minimum, formed before the shuffle."""
    names = ["window", "gram", "context", "low", "ord", "tie", "spot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1 << 12):
                part = batch.slice(i, 1 << 12)
                data = part.column("bytes").to_pylist()
                joined = Sums(np.frombuffer(b"".join(data), np.uint8))
                n = np.array([len(x) - LENGTH + 1 for x in data], np.int64)
                row = np.repeat(np.arange(len(data)), n)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                begin = np.cumsum(n + LENGTH - 1) - n - LENGTH + 1
                hashed = joined.part(begin[row] + step, begin[row] + step + LENGTH)
                plain = {c: part.column(c).to_numpy()[row] for c in ("gram", "context", "ord", "tie", "spot", "start")}
                low = plain["start"] + step
                window = bloom.mixed(plain["gram"], low, hashed.view(np.int64)).view(np.int64)
                yield pa.record_batch([pa.array(x) for x in (window, plain["gram"], plain["context"], low, plain["ord"], plain["tie"], plain["spot"])], names=names)

    each = contexts.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))
    first = each.groupBy("window").agg(F.min(F.struct("ord", "tie", "spot", "context")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("window", "first")
    # a filter may have passed further occurrences of a context; that it has its own windows is nothing to remove
    other = F.col("context") != F.col("first.context")
    first = written(first, "repeats-windows")
    out = written(each.join(few(first), "window").where(other).select("gram", "context", "low", F.col("low").alias("high")), "repeats-single")
    discard(first)
    return out


def windows(blocks: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For all windows in blocks of strings: the string (counted over all blocks), the start there, and a class;
    two windows have one class if they are in one block and equal."""
    size = np.array([sum(map(len, b)) + len(b) for b in blocks])
    first = np.cumsum([0] + [len(b) for b in blocks])
    order = np.argsort(size, kind="stable")
    a = classes = 0
    while a < len(order):
        b = max(a + 1, int(np.searchsorted(np.cumsum(size[order[a:]]), BATCH, side="right")) + a)
        taken = order[a:b]
        a = b
        number = np.concatenate([np.arange(first[g], first[g + 1]) for g in taken])
        strings = [s for g in taken for s in blocks[g]]
        # symbol 0 parts the strings of a block
        symbols = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
        lengths = np.array([*map(len, strings)])
        ends = np.cumsum(lengths + 1)
        symbols[ends - 1] = 0
        begins = ends - lengths - 1
        found = suffix_arrays(symbols, np.append(0, np.cumsum(size[taken])))
        string = np.repeat(np.arange(len(strings)), lengths + 1)[found]
        whole = ends[string] - 1 - found >= LENGTH
        found, string = found[whole], string[whole]
        if not len(found):
            continue
        views = np.lib.stride_tricks.sliding_window_view(symbols.astype(np.uint8 if symbols.max() < 256 else np.uint16), LENGTH)
        new = np.ones(len(found), bool)
        for i in range(1, len(found), 1 << 13):
            here = found[i : i + (1 << 13)]
            new[i : i + len(here)] = (views[here] != views[found[i - 1 : i - 1 + len(here)]]).any(axis=1)
        block = np.repeat(np.arange(len(taken)), [len(blocks[g]) for g in taken])[string]
        new[1:] |= block[1:] != block[:-1]
        of = np.cumsum(new) - 1 + classes
        classes = int(of[-1]) + 1
        yield number[string], found - begins[string], of


def _split(items: list[tuple[int, int, bytes]], low: int, high: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Contexts (number, first window, bytes) for one suffix array: large groups are dealt out by the bytes that all
    windows from low to high (by distance from the anchor) share, over ever fewer windows."""
    if high == low or len(items) < 2 or sum(len(x[2]) for x in items) <= BLOCK:
        yield items
        return
    step = max(1, (high - low + 1) // 4)
    for a in range(low, high + 1, step):
        b = min(a + step - 1, high)
        parts: dict[bytes, list[tuple[int, int, bytes]]] = {}
        for i, start, data in items:
            last = start + len(data) - LENGTH
            if start <= b and last >= a:
                from_, to = max(start, a), min(last, b)
                parts.setdefault(data[b - start : a - start + LENGTH], []).append((i, from_, data[from_ - start : to - start + LENGTH]))
        for part in parts.values():
            yield from _split(part, a, b)


def earlier(groups: list[list[int]], place: list[tuple[int, int, int]], context: list[int], low: list[int], data: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """Contexts of anchors, group by group of equal anchors: (i, first, last) for windows of context i that some context
    of its group with an earlier place has too."""
    blocks: list[list[bytes]] = []
    owner: list[int] = []
    lows: list[int] = []
    for group in groups:
        best: dict[tuple[int, int], int] = {}  # a filter may have passed a context more than once
        for i in group:
            k = context[i], low[i]
            if k not in best or place[i] < place[best[k]]:
                best[k] = i
        if len(best) < 2:
            continue
        items = [(i, low[i], data[i]) for i in best.values()]
        for part in _split(items, min(x[1] for x in items), max(x[1] + len(x[2]) - LENGTH for x in items)):
            shared: dict[tuple[int, bytes], int] = {}
            for i, start, found in part:
                k = start, found
                if k not in shared:
                    shared[k] = i
                else:  # equal bytes: all windows of the later one are there before
                    first, last = sorted((i, shared[k]), key=place.__getitem__)
                    shared[k] = first
                    yield last, start, start + len(found) - LENGTH
            if len(shared) > 1:
                blocks.append([k[1] for k in shared])
                owner += shared.values()
                lows += [k[0] for k in shared]
    if not blocks:
        return
    order = sorted(range(len(owner)), key=lambda n: place[owner[n]])
    rank = np.empty(len(owner), np.int64)
    rank[order] = np.arange(len(owner))
    for string, start, of in windows(blocks):
        of = of - of.min()
        least = np.full(of.max() + 1, len(owner), np.int64)
        np.minimum.at(least, of, rank[string])
        late = least[of] < rank[string]
        string, start = string[late], start[late]
        if not len(string):
            continue
        at = np.lexsort((start, string))
        string, start = string[at], start[at]
        cuts = np.flatnonzero((np.diff(string, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1))
        stops = np.append(cuts[1:], len(start)) - 1
        for n, a, b in zip(string[cuts].tolist(), start[cuts].tolist(), start[stops].tolist(), strict=True):
            yield owner[n], lows[n] + a, lows[n] + b


def _ranges(contexts: DataFrame) -> DataFrame:
    """gram, context, low, high: windows of a context that an earlier context has. contexts: sorted by key."""
    names = ["gram", "context", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: int | None = None
        place: list[tuple[int, int, int]] = []
        gram: list[int] = []
        context: list[int] = []
        low: list[int] = []
        data: list[bytes] = []
        groups: list[list[int]] = []
        size = 0

        def solved() -> pa.RecordBatch:
            out = [*earlier(groups, place, context, low, data)]
            return pa.record_batch([pa.array([gram[r[0]] for r in out], pa.int64()), pa.array([context[r[0]] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64())], names=names)

        for batch in batches:
            for key, g, c, ord, tie, spot, start, text in zip(*[batch.column(n).to_pylist() for n in ("key", "gram", "context", "ord", "tie", "spot", "start", "bytes")], strict=True):
                if key != last:
                    if size >= 16 * BATCH:
                        yield solved()
                        for x in (place, gram, context, low, data, groups):
                            x.clear()
                        size = 0
                    groups.append([])
                    last = key
                groups[-1].append(len(place))
                place.append((ord, tie, spot >> 16))
                gram.append(g)
                context.append(c)
                low.append(start)
                data.append(text)
                size += len(text)
        if groups:
            yield solved()

    return contexts.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def intervals(texts: DataFrame, size: int) -> DataFrame:
    """ord, tie, spans: array of start * 2**32 + stop to remove, in any order and overlapping, of the texts that
    lose something. texts: ord, tie, text (binary, at least LENGTH bytes), without copies; size: bytes of all."""
    spark = texts.sparkSession
    share = spark.sparkContext.broadcast
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PARTITION)
    grams = written(_repeated(texts, partitions), "repeats-grams")
    known = share(bloom.build(grams.select("bucket", "short"), grams.count()))
    found = written(_occurrences(texts, known, partitions), "repeats-anchors")
    discard(grams)
    release(spark)
    each = found.groupBy("gram", "context").agg(F.min(F.struct("ord", "tie", "spot")).alias("first"), F.count(F.lit(1)).alias("n"))
    by_gram = each.groupBy("gram").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("total")).where("total > 1")
    groups = written(each.join(by_gram, "gram").select("gram", "context", "first", "n", "contexts"), "repeats-contexts")
    release(spark)
    several = groups.where("contexts > 1")
    wanted = share(bloom.build(several.select("first.ord", "first.tie", "first.spot"), several.count()))
    hot = several.where(F.col("contexts") > HOT).select("gram").distinct()
    hot = share(bloom.build(hot, hot.count()))
    contexts = written(_contexts(texts, wanted, hot), "repeats-bytes")
    crowded = contexts.where("dealt").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("key")
    crowded = written(crowded, "repeats-crowded")
    in_arrays, single = contexts, None
    if not crowded.isEmpty():
        in_arrays = contexts.join(few(crowded), "key", "left_anti")
        single = _single(contexts.where("dealt").join(few(crowded), "key", "left_semi"))
    in_arrays = in_arrays.repartition(partitions, "key").sortWithinPartitions("key")
    arrays = written(_ranges(in_arrays), "repeats-ranges")
    discard(contexts, crowded)
    release(spark)
    ranges = arrays if single is None else arrays.unionByName(single)
    at = F.shiftright("spot", 16)
    packed = lambda low, high: (F.shiftleft(at + low, 32) + (at + high + LENGTH)).alias("span")
    window = lambda shift: F.shiftright("spot", shift).bitwiseAND(F.lit(255)) - 128
    # the first occurrence of a context loses what earlier contexts have, every later one all its windows
    firsts = groups.select("gram", "context", "first.ord", "first.tie", "first.spot").join(ranges, ["gram", "context"]).select("ord", "tie", packed(F.col("low"), F.col("high")))
    copied = groups.where("n > 1").select("gram", "context", "first")
    later = found.join(copied, ["gram", "context"]).where(F.struct("ord", "tie", "spot") > F.col("first")).select("ord", "tie", packed(window(8), window(0)))
    spans = written(firsts.unionByName(later).groupBy("ord", "tie").agg(F.collect_list("span").alias("spans")), "repeats-spans")
    discard(found, groups, arrays, single)
    return spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


RESULT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def remove(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), id: str = "doc_id", text: str = "text", with_kept: bool = False) -> DataFrame:
    """keep and RESULT of every row, and with_kept also kept: the text that stays (a character of which only a part
    stays is left out of it, but counts in the figures and the digest)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    own = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    base = docs.select(*own, F.coalesce(F.col(id).cast("long"), F.lit(-(1 << 63))).alias("ord"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ids = written(base.select("ord", "tie", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")).where(F.col("n_bytes") >= LENGTH), "repeats-ids")
    size = ids.agg(F.sum("n_bytes")).first()[0] or 0
    first = ids.groupBy("digest").agg(F.min(F.struct("ord", "tie")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("_d"), "first")
    first = written(first, "repeats-classes")
    copies = written(ids.join(few(first), F.col("digest") == F.col("_d")).where(F.struct("ord", "tie") > F.col("first")).select("ord", "tie").distinct(), "repeats-copies")
    discard(ids, first)
    marked = few(copies).withColumn("copy", F.lit(True))
    flagged = base.join(marked, ["ord", "tie"], "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    texts = flagged.where(~F.col("copy") & (F.octet_length("text") >= LENGTH)).select("ord", "tie", "text")
    spans = intervals(texts, size)
    losing = spark.sparkContext.broadcast(bloom.build(spans.select("ord", "tie"), spans.count()))

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leaves texts out (but for their digest) where no span can come."""
        for batch in batches:
            column = batch.schema.names.index("text")
            copy = batch.column("copy").to_numpy(zero_copy_only=False)
            open_ = ~copy & bloom.holds(losing.value, bloom.mixed(batch.column("ord").to_numpy(), batch.column("tie").to_numpy()))
            texts, n, digest = [], [], []
            for value, cut, gone in zip(batch.column(column), open_.tolist(), copy.tolist(), strict=True):
                data = value.as_py()
                n.append(len(data))
                digest.append(None if cut else hashlib.sha256(b"" if gone else data).hexdigest())
                texts.append(data if cut or (with_kept and not gone) else None)
            kept = [batch.column(i) for i in range(batch.num_columns) if i != column]
            yield pa.record_batch([*kept, pa.array(texts, pa.binary()), pa.array(n, pa.int64()), pa.array(digest, pa.string())], names=[*[x for x in batch.schema.names if x != "text"], "text", "n_bytes", "digest"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for copy, text, n, digest, found in zip(*[batch.column(c).to_pylist() for c in ("copy", "text", "n_bytes", "digest", "spans")], strict=True):
                if copy:
                    rows.append((n, n, 1, digest, ""))
                    continue
                runs = merged([(s >> 32, s & 0xFFFFFFFF) for s in found or ()])
                if text is not None and (runs or digest is None):
                    edges = [0, *[e for r in runs for e in r], n]
                    text = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    digest = hashlib.sha256(text).hexdigest()
                rows.append((n, sum(b - a for a, b in runs), len(runs), digest, text.decode("utf-8", "ignore") if with_kept else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds[: 4 + with_kept])]
            yield pa.record_batch([*[batch.column(f"_k{i}") for i in range(len(keep))], *columns], names=[*[f"_k{i}" for i in range(len(keep))], *[x.split()[0] for x in RESULT.split(", ")], *["kept"] * with_kept])

    kinds = ", ".join(f"_k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    slim = flagged.select(*[f"_k{i}" for i in range(len(keep))], "ord", "tie", "copy", "text").mapInArrow(trim, f"{kinds}, ord bigint, tie bigint, copy boolean, text binary, n_bytes bigint, digest string")
    out = slim.join(spans, ["ord", "tie"], "left").mapInArrow(cut, f"{kinds}, {RESULT}" + ", kept string" * with_kept)
    for i, c in enumerate(keep):
        out = out.withColumnRenamed(f"_k{i}", c)
    return out
