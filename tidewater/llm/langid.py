"""Language identification: script ranges narrow the candidates of each word, hashed letter trigrams
score it, and Viterbi with a switching penalty labels spans, so that mixed texts keep their parts.

A word is a run of letters and combining marks; its script is that of its first letter. A language is a
candidate for a script in which it has at least SCRIPT_SHARE of its letters. The label of a document is
the language whose spans hold most letters (the first by name of equals); its score is
their share of all letters.

The model is fitted on a sample of whole labelled texts: at most about PER_LANG different texts of every language,
and at least one, chosen by a hash of the text; copies teach once. So it, and what is broadcast (4 x BUCKETS bytes a
language), grows with the number of languages only; the trigrams of texts are counted for LANGS languages at a time. Prediction covers all rows and their whole
texts.

Defined results: a null text or one without letters is ``und`` with score 0; letters only of scripts no
learned language uses give the commonest language with score 0; combining marks alone are no letters; rows without label or text teach
nothing; with nothing to learn from every text is ``und``; repeated rows are predicted alike; an empty
table gives an empty result; only the columns named are read, so extra columns can't clash.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import bounded_batches, lean

#: First and last code point of the blocks of the scripts told apart; other letters are script 1.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
BUCKETS = 1 << 16
#: Labelled texts that each language is learned from, about; languages counted at once in a task; share of a script.
PER_LANG, LANGS, SCRIPT_SHARE = 4000, 64, 0.001
#: Cost of a change of language between words, in nats; additive smoothing of the trigram counts.
SWITCH, SMOOTH = 12.0, 0.5
#: Characters worked on at once; longer texts than LONG are labelled part by part, so that memory is bounded.
CHARS, LONG = 1 << 19, 1 << 21


def _script_table() -> np.ndarray:
    """For each code point 0 (no letter) or the number of its script."""
    names = ["other", *dict.fromkeys(s[0] for s in SCRIPTS)]
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        if unicodedata.category(chr(cp))[0] in "LM":
            table[cp] = 1
    for name, first, last in SCRIPTS:
        block = table[first : last + 1]
        block[block > 0] = names.index(name) + 1
    return table


_TABLE: list[np.ndarray] = []


_MARKS: list[np.ndarray] = []


def marks() -> np.ndarray:
    """Which code points are combining marks."""
    if not _MARKS:
        _MARKS.append(np.array([unicodedata.category(chr(cp))[0] == "M" for cp in range(0x110000)]))
    return _MARKS[0]


def scripts() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_script_table())
    return _TABLE[0]


class Words:
    """The words of many texts laid end to end."""

    def __init__(self, texts: list[str]) -> None:
        lowered = [t.replace("İ", "i").lower() for t in texts]  # no other character's lower case is longer
        self.starts = np.cumsum([1] + [len(t) + 1 for t in lowered])  # of the texts
        cps = np.frombuffer(("\n" + "\n".join(lowered) + "\n\n").encode("utf-32-le", "replace"), np.uint32)
        kind = scripts()[cps]
        letter = kind > 0
        at = np.flatnonzero(letter)
        before, after = letter[at - 1], letter[at + 1]
        self.first = np.flatnonzero(~before)  # of each word, in at
        mixed = cps[at] * np.uint32(0x9E3779B1)
        mixed += np.where(before, cps[at - 1], np.uint32(0)) * np.uint32(0x85EBCA6B)
        mixed ^= np.where(after, cps[at + 1], np.uint32(0)) * np.uint32(0xC2B2AE35)
        mixed ^= mixed >> np.uint32(15)
        self.grams = ((mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(16)).astype(np.intp)
        self.script = kind[at[self.first]]
        self.length = np.diff(self.first, append=len(at))
        #: Letters of each word without its combining marks.
        self.letters = np.add.reduceat(~marks()[cps[at]], self.first, dtype=np.int64) if len(at) else np.zeros(0, np.int64)
        self.begin = at[self.first]
        #: Place of each text's first word.
        self.of_text = np.searchsorted(self.begin, self.starts)


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # (BUCKETS, langs) float32
    candidates: np.ndarray  # (256, langs) bool
    commonest: int

    def word_scores(self, words: Words) -> np.ndarray:
        if not len(words.first):
            return np.zeros((0, len(self.langs)), np.float32)
        out = np.add.reduceat(self.scores[words.grams], words.first, axis=0)
        allowed = self.candidates[words.script]
        known = allowed.any(axis=1)
        out[~known] = 0
        out[known[:, None] & ~allowed] = -1e6
        return out


def viterbi(scores: np.ndarray, bounds: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word; texts are [bounds[i], bounds[i+1])."""
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    first, n = bounds[:-1][order], n[order]
    k = scores.shape[1]
    kind = np.uint8 if k <= 256 else np.uint16 if k <= 65_536 else np.uint32
    labels = np.zeros(len(scores), kind)
    if not len(n) or not n[0] or not k:
        return labels
    back = np.empty((len(scores), k), kind)
    same = np.arange(k, dtype=kind)
    active = np.searchsorted(-n, -np.arange(n[0]), side="left")  # texts with more than t words
    best = scores[first[: active[0]]].astype(np.float64)
    for t in range(1, n[0]):
        a = active[t]
        now = best[:a]
        top = now.argmax(axis=1)
        change = now[np.arange(a), top][:, None] - switch
        moved = change > now
        at = first[:a] + t
        back[at] = np.where(moved, top[:, None], same)
        best[:a] = np.where(moved, change, now) + scores[at]
    state = best.argmax(axis=1)
    for t in range(n[0] - 1, -1, -1):
        a = active[t]
        at = first[:a] + t
        labels[at] = state[:a]
        if t:
            state[:a] = back[at, state[:a]]
    return labels


def _cut(text: str) -> Iterator[tuple[int, str]]:
    """A long text in parts of about LONG characters with their places, cut where a word ends."""
    kind, start = scripts(), 0
    while start < len(text):
        stop = min(start + LONG, len(text))
        while stop < len(text) and stop < start + 2 * LONG and kind[ord(text[stop])]:
            stop += 1
        yield start, text[start:stop]
        start = stop


def _sums(at: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Sums of weights by place, as doubles also where there are none (bincount then gives integers)."""
    return np.bincount(at, weights=weights, minlength=n).astype(np.float64, copy=False)


def _shares(texts: list[str], model: Model, spans: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list]]:
    """Of each text: characters of words by language, of all words, letters, and the spans."""
    words = Words(texts)
    labels = viterbi(model.word_scores(words), words.of_text)
    k = len(model.langs)
    text_of = np.repeat(np.arange(len(texts)), np.diff(words.of_text))
    known = model.candidates[words.script].any(axis=1)
    share = _sums(text_of * k + labels.astype(np.intp), words.length * known, len(texts) * k).reshape(-1, k) if k else np.zeros((len(texts), 0))
    size = _sums(text_of, words.length, len(texts))
    letters = _sums(text_of, words.letters, len(texts))
    parts: list[list] = [[] for _ in texts]
    for i in range(len(texts)) if spans and k else ():
        a, b = words.of_text[i : i + 2]
        here, begin, stop = labels[a:b].astype(np.intp), words.begin[a:b] - words.starts[i], words.begin[a:b] + words.length[a:b] - words.starts[i]
        cut = np.flatnonzero(np.diff(here, prepend=-1))
        last = np.append(cut[1:], b - a) - 1
        parts[i] = [(int(begin[c]), int(stop[e]), model.langs[here[c]]) for c, e in zip(cut, last, strict=True)] if b > a else []
    return share, size, letters, parts


def label(texts: list[str | None], model: Model, spans: bool = False) -> list[tuple]:
    """(lang_pred, score) of each text, and with spans a list of (start, end, lang) in characters."""
    share, size, letters, parts = _shares(["" if t is None or len(t) > LONG else t for t in texts], model, spans)
    for i, t in enumerate(texts):
        for start, part in _cut(t) if t and len(t) > LONG else ():
            found = _shares([part], model, spans)
            share[i] += found[0][0]
            size[i] += found[1][0]
            letters[i] += found[2][0]
            for a, b, lang in found[3][0]:
                if parts[i] and parts[i][-1][2] == lang:
                    parts[i][-1] = (parts[i][-1][0], start + b, lang)
                else:
                    parts[i].append((start + a, start + b, lang))
    out: list[tuple] = []
    for i in range(len(texts)):
        if not share.shape[1] or not letters[i]:
            best: tuple = ("und", 0.0)
        elif not share[i].any():
            best = (model.langs[model.commonest], 0.0)
        else:
            top = int(share[i].argmax())
            best = (model.langs[top], float(share[i][top] / size[i]))
        out.append(best + ((parts[i],) if spans else ()))
    return out


def _pieces(texts: list[str | None], langs: int = 1) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about CHARS characters together (fewer for many languages, each of which a word has a
    score for), with the place of the first."""
    most = max(1 << 12, CHARS * 16 // max(16, langs))
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def _count(langs: list[str]):
    """Counts by language and trigram bucket (and, below zero, by script) of a partition, for which at most LANGS languages
    are held at once; sums over partitions (and parts of one) follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {name: i for i, name in enumerate(langs)}
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def packed() -> Iterator[pa.RecordBatch]:
            for lang, tables in held.items():
                for table, sign in zip(tables, (1, -1), strict=True):
                    columns = np.flatnonzero(table)
                    yield pa.record_batch([pa.array(np.full(len(columns), lang), pa.int32()), pa.array(sign * columns, pa.int32()), pa.array(table[columns], pa.int64())], names=["lang", "feature", "n"])
            held.clear()

        for batch in batches:
            texts, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, piece in _pieces(texts):
                words = Words([t or "" for t in piece])
                text_lang = np.array([place[x] for x in names[start : start + len(piece)]])
                lang = np.repeat(text_lang, np.diff(words.of_text))
                each = np.repeat(lang, words.length)
                for one in np.unique(text_lang).tolist():
                    if one not in held and len(held) >= LANGS:
                        yield from packed()
                    grams, by_script = held.setdefault(one, (np.zeros(BUCKETS, np.int64), np.zeros(256, np.int64)))
                    grams += np.bincount(words.grams[each == one], minlength=BUCKETS)
                    by_script += np.bincount(words.script[lang == one], weights=words.length[lang == one], minlength=256).astype(np.int64)
        yield from packed()

    return run


def fit(docs: DataFrame, per_lang: int = PER_LANG, text: str = "text", lang: str = "lang") -> Model:
    """Learns from the rows that have text and lang."""
    bounded_batches(docs.sparkSession)
    known = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    spot = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    texts = known.groupBy("lang", F.xxhash64("text").alias("hash"), spot.alias("spot")).agg(F.count(F.lit(1)).alias("n"))
    counts = texts.groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"), F.min("spot").alias("least")).collect()  # one row a language
    if not counts:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((256, 0), bool), 0)
    sizes = dict(sorted((r[0], r[1]) for r in counts))
    langs = list(sizes)
    limits = [(r["lang"], max(r["least"] + 1, int(min(1.0, per_lang / r["texts"]) * (1 << 30)))) for r in counts]
    limits = docs.sparkSession.createDataFrame(limits, "_lang string, _limit bigint")
    sample = known.join(F.broadcast(limits), F.col("lang") == F.col("_lang")).where(spot < F.col("_limit")).select("text", "lang").dropDuplicates(["lang", "text"])
    found = sample.mapInArrow(lean(_count(langs)), "lang int, feature int, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    which, feature, n = (found.column(i).to_numpy() for i in range(3))
    grams, by_script = np.zeros((BUCKETS, len(langs)), np.float32), np.zeros((256, len(langs)))
    gram = feature >= 0
    # bucket 0 and script 0 never meet: script 0 stands for no letter
    grams[feature[gram], which[gram]] = n[gram]
    by_script[-feature[~gram], which[~gram]] = n[~gram]
    total = (grams.sum(axis=0, dtype=np.float64) + SMOOTH * BUCKETS).astype(np.float32)
    scores = np.log((grams + np.float32(SMOOTH)) / total)
    letters = by_script.sum(axis=0)
    return Model(langs, scores, (by_script > 0) & (by_script >= SCRIPT_SHARE * letters), int(np.argmax([sizes[x] for x in langs])))


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text", spans: bool = False) -> DataFrame:
    """keep, lang_pred, score, and with spans also spans (array of start, end, lang) of every row."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            for start, piece in _pieces(texts, len(held.value.langs)):
                found = label(piece, held.value, spans)
                columns = [batch.column(c).slice(start, len(piece)) for c in keep] + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                if spans:
                    columns.append(pa.array([[dict(zip(("start", "end", "lang"), s, strict=True)) for s in f[2]] for f in found], span))
                yield pa.record_batch(columns, names=[*keep, "lang_pred", "score", *["spans"] * spans])

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep) + ", lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * spans
    return docs.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(lean(run), schema)
