"""The pipeline stage by stage, and the queries over the driver's tables."""

import os
import random
from collections import Counter

import duckdb
import numpy as np
import plain
import pytest
from conftest import DATA
from tokenizers import Tokenizer

import corpus_pipeline
from lodestar.llm import queries


def by_row(rows):
    return Counter(str(sorted(r.items())) for r in rows)


def check_stages(spark, docs):
    """Every stage against the plain version, each on what the stage before has really returned."""
    previous = docs
    plain_stages = [plain.quality, plain.near_copies, lambda rows: plain.cut(rows, corpus_pipeline.PASSAGE), plain.mix]
    for (name, stage), plainly in zip(corpus_pipeline.STAGES, [*plain_stages, None], strict=True):
        now = corpus_pipeline.materialize(stage(spark, previous, DATA), "test")
        before = [r.asDict() for r in previous.collect()]
        if plainly:
            assert now.columns == docs.columns, name
            assert by_row(r.asDict() for r in now.collect()) == by_row(plainly(before)), name
        else:
            coder = Tokenizer.from_file(queries.vocabulary_path())
            want = [(r["doc_id"], coder.encode(r["text"] or "", add_special_tokens=False).ids, r["text"] or "") for r in before]
            got = [(r["doc_id"], np.frombuffer(r["tokens"], "<u4").tolist(), r["decoded"]) for r in now.collect()]
            assert sorted(got) == sorted(want)
        previous = now
    return previous


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_stages_on_the_test_tables(spark):
    out = check_stages(spark, spark.read.parquet(f"{DATA}/documents.parquet"))
    whole = corpus_pipeline.run(spark, DATA)
    assert by_row(r.asDict() for r in whole.collect()) == by_row(r.asDict() for r in out.collect())


def test_stages_on_awkward_rows(spark):
    """Nulls, empty and long texts, repeated rows, ties, extra columns whose names clash."""
    r = random.Random(17)
    vocabulary = ["".join(r.choice("aeiouéя") + r.choice("bdklmnrst") for _ in range(1 + i % 4)) for i in range(900)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = prose(60)
    texts = [prose(r.choice([20, 55, 80, 200, 500])) for _ in range(60)]
    texts += [texts[5], texts[6] + " more", f"{prose(70)} {passage} {prose(20)}", f"{prose(90)} {passage}", None, "", " \n ", "x" * 5000, "ab " * 400, prose(20_000), "é" * 300]
    rows = [(i, t, "en" if i % 3 else None, [None, "a", "b", "ü", ""][i % 5], len(t or ""), f"k{i}", i, None) for i, t in enumerate(texts)]
    rows += rows[3:6] + [(500, texts[7], None, "a", 1, "other", 2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `__id` string, `__copy` int, `__tid` binary")
    assert check_stages(spark, docs).count() > 10
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, DATA)
        assert out.count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DATA}/{t}'")
    df = queries.queries()[name](spark, DATA)
    cursor = con.execute(queries.oracle_sql()[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == sorted(df.columns)
    assert sorted(str([r[c] for c in found]) for r in df.collect()) == sorted(str(list(r)) for r in cursor.fetchall())


def test_all_operators_are_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
