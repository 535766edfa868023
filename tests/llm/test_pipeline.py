"""The pipeline and the registered queries against plain versions."""

import hashlib
import re
import struct
from collections import Counter

import corpus_pipeline
import duckdb
import pytest
from tidewater.llm import bpe
from tidewater.llm.queries import oracle_sql, queries

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "repeat_removal", "source_mixing", "bpe_encoding"]


def plain(docs):
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of [(doc_id, text, source)]."""
    from tokenizers import Tokenizer

    docs = [d for d in docs if any(c.isalpha() for c in d[1] or "")]
    classes = brute.near([d[:2] for d in docs])
    docs = [d for d in docs if classes[d[0]] == d[0]]
    kept = brute.repeats([d[:2] for d in docs])
    docs = [(i, kept[i][4].decode("utf-8", "ignore"), s) for i, _, s in docs]
    word = re.compile(r"[^\x20\x09-\x0D]+")
    takes = brute.mix([(i, s, len(word.findall(t))) for i, t, s in docs])
    coder, out = Tokenizer.from_file(bpe.public_vocabulary()), []
    for i, t, _ in docs:
        for n in takes[i]:
            if n:
                found = word.findall(t)
                ids = coder.encode(t if n == len(found) else " ".join(found[:n]), add_special_tokens=False).ids
                out.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(coder.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return Counter(out)


def test_pipeline(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == plain(docs)


def test_stages_keep_columns_and_take_anything(spark, tmp_path):
    """Nulls, empty texts, repeated rows, clashing columns; no rows."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, class_id int, ord int, key int"
    long = " ".join(f"wort{i}" for i in range(300))
    data = [(1, long, "de", "a", 1, 0, 0, 0), (1, long, "de", "a", 1, 0, 0, 0), (2, None, None, None, None, 0, 0, 0), (None, long + " x", "de", None, 1, 0, 0, 0), (3, "", "en", "b", 0, 0, 0, 0), (4, "the cat is here", None, "b", 0, 0, 0, 0), (4, "the cat is here", None, "b", 0, 0, 0, 0), (5, "12 34", "en", "b", 0, 0, 0, 0)]
    for rows in (data, []):
        docs = spark.createDataFrame(rows, schema)
        for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            out.write.parquet(str(tmp_path / f"{len(rows)}-{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{len(rows)}-{name}"))
            if n < 4:
                assert docs.columns == list(corpus_pipeline.COLUMNS)
            if rows and name == "language_id":
                assert docs.count() == 5
            if rows and name == "near_dedup":
                assert sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect()) in ([(False, 1), (False, 4)], [(False, 4), (True, 0)])


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    other = con.sql(oracle_sql()[name])
    df = queries()[name](spark, SF).select(*other.columns)
    show = lambda rows: Counter(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert show(df.collect()) == show(other.fetchall())


def test_all_queries_are_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 11))
