"""The pipeline stage by stage against brute force, and what is left without llm."""

import collections
import os
import subprocess
import sys

import numpy as np
from pyspark.sql import functions as F
from test_text_ops import base_spans, contamination, counts_by_hand
from test_web_ops import classes_by_hand

import corpus_pipeline
from ferrylake.llm.common import load, written
from ferrylake.llm.queries import queries, tokenizer_path

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))


def test_stages_equal_brute_force(spark):
    import zlib

    from tokenizers import Tokenizer
    docs = load(spark, SF, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF), f"test-{name}")
        if name != "pack_sequences":
            assert out.columns == docs.columns
        seen[name] = ([r.asDict() for r in docs.collect()], [r.asDict() for r in out.collect()])
        docs = out
    assert [n for n, _ in corpus_pipeline.STAGES] == list(seen)

    before, after = seen["quality_rules"]
    own = set()
    for r in before:
        n, _, symbols, _, repeated = counts_by_hand(r["text"])
        if n >= 10 and 100 * repeated <= 20 * n and 100 * symbols <= 10 * n:
            own.add(r["doc_id"])
    assert {r["doc_id"] for r in after} == own            # no host is bad in this table

    before, after = seen["near_dedup"]
    want = {c for _, c in classes_by_hand([(r["doc_id"], r["text"]) for r in before])}
    assert sorted(r["doc_id"] for r in after) == sorted(want)

    before, after = seen["decontamination"]
    items = [(r.item_id, r.text) for r in load(spark, SF, "benchmark").collect()]
    found = contamination([(r["doc_id"], r["text"]) for r in before], items)
    assert {r["doc_id"] for r in after} == {k[0] for k in found if not k[5]}
    assert any(k[5] for k in found)

    before, after = seen["mask_pii"]
    texts = {r["doc_id"]: r["text"] for r in after}
    assert len(after) == len(before) and any(texts[r["doc_id"]] != r["text"] for r in before)
    for r in before:
        if not base_spans(r["text"]) and "token" not in r["text"] and "password" not in r["text"]:
            assert texts[r["doc_id"]] == r["text"]
        assert not base_spans(texts[r["doc_id"]])
    assert all(r["n_chars"] == len(r["text"]) for r in after)

    before, after = seen["pack_sequences"]
    whole, want = Tokenizer.from_file(tokenizer_path()), collections.Counter()
    for r in before:
        ids = whole.encode(r["text"], add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[s:s + 2048], "<u4").tobytes()
            want[r["doc_id"], k, s, len(part) // 4, zlib.crc32(part)] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
                               for r in after) == want
    total = sum(r["length"] for r in after)
    assert len({r["sequence_id"] for r in after}) <= -(-total // 2048) + 1


def test_stages_take_extra_columns_nulls_and_empty_tables(spark):
    rows = [(1, None, "en", "a", 0, "k"), (None, "x " * 30, None, None, 60, None), (2, "", "en", "a", 0, "k")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES[:4]:
            docs = written(stage(spark, docs, SF), f"edge-{name}")
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
    # the last stage on odd rows, equal ones among them
    odd = rows + [(2, "", "en", "a", 0, "k"), (3, "word " * 5000, "en", "a", 0, "k")]
    out = corpus_pipeline.STAGES[4][1](spark, spark.createDataFrame(odd, schema), SF).collect()
    lengths = collections.Counter((r.doc_id, r.piece, r.length) for r in out)
    assert lengths[1, 0, 1] == 1 and lengths[2, 0, 1] == 2 and lengths[None, 0, 31] == 1
    assert sum(r.length for r in out if r.doc_id == 3) == 5001
    assert corpus_pipeline.STAGES[4][1](spark, spark.createDataFrame([], schema), SF).count() == 0


def test_each_operator_is_registered():
    names = list(queries())
    for n in range(1, 14):
        assert [x for x in names if x.startswith(f"op{n}_")], n


def test_entry_imports_without_the_subpackage(tmp_path):
    """A copy of the repository's Python files without llm registers the other queries."""
    import shutil
    to = str(tmp_path / "repo")
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py",
                                                            "__pycache__", ".pytest_cache"))
    code = ("import __spark_entry__ as e; q = e.queries(); "
            "assert 'pipeline' not in q and not any(x.startswith('op1') for x in q); "
            "assert len(q) > 50 and set(e.oracle_sql()) <= set(q)")
    env = os.environ | {"PYTHONPATH": to, "PYTHONDONTWRITEBYTECODE": "1"}
    subprocess.run([sys.executable, "-c", code], cwd=to, check=True, env=env, timeout=120)


def test_counts_of_documents_survive(spark):
    """Every op over documents returns one row per document."""
    n = load(spark, SF, "documents").count()
    for name in ("op2_decontamination", "op4_pii", "op6_host_quality", "op9_byte_shards"):
        out = queries()[name](spark, SF)
        assert out.agg(F.count(F.lit(1))).first()[0] == n, name
