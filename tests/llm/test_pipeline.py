import importlib.util
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("corpus_pipeline.py is not here", allow_module_level=True)

import corpus_pipeline
from corpusmill.llm import bpe, queries, toxicity

from .test_near_dups import brute as brute_groups
from .test_repeats import brute as brute_repeats
from .test_secrets import brute as brute_secrets

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), queries.CHAIN)
    flagged = {r["doc_id"] for r in toxicity.score(docs, model).where("flagged").collect()}
    state = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns
        got = {r["doc_id"]: r for r in docs.collect()}
        if name == "toxicity":
            assert flagged
            want = {i: t for i, t in state.items() if i not in flagged}
        elif name == "near_dups":
            want = {i: state[i] for i, _, _, kept in brute_groups(list(state.items())) if kept}
        elif name == "repeats":
            removed = {i: n for i, _, n, _ in brute_repeats(list(state.items()))}
            assert set(got) == set(state)
            assert all((got[i]["text"] == t) == (removed[i] == 0) for i, t in state.items())
            assert all(len(got[i]["text"].split()) == len(t.split()) - removed[i] for i, t in state.items())
            want = {i: r["text"] for i, r in got.items()}
        else:
            want = {}
            for i, t in state.items():
                out, at = "", 0
                for a, _, b in brute_secrets(t):
                    if a >= at:
                        out += t[at:a] + "[secret]"
                    at = max(at, b)
                want[i] = out + t[at:]
        state = {i: r["text"] for i, r in got.items()}
        assert state == want
        if name in ("repeats", "secrets"):
            assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    tool = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    assert {i: sum((p for _, p in sorted(x)), []) for i, x in pieces.items()} == {i: [*tool.encode(t), 0] for i, t in state.items()}


def test_edge_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeated rows and other columns with clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars int, digest string, row long, spans string, number int, all string, key0 int, blob string"
    fill = lambda i, t: (i, t, None, "s", 7, "d", 1, "x", 2, "y", 3, "z")
    secret = "my token=abcdef123456 " + " ".join(f"w{k}" for k in range(40))
    rows = [fill(*r) for r in [(1, None), (None, None), (None, "no id at all here"), (2, ""), (3, " \n "), (4, "word " * 60_000), (5, secret), (5, secret), (6, secret + " tail"), (7, "x" * 300_000), (8, "short"), (8, "other text of the same id")]]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None, 0, "t"), (None, 1, 1, "t"), (5, 1, 0, "t"), (5, 1, 0, "t"), (99, 0, 1, "t")], "doc_id long, quality int, toxic int, text string").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
    got = [(r["doc_id"], r["text"], r["n_chars"]) for r in docs.collect()]
    assert sorted((i or 0) for i, *_ in got) == [0, 0, 1, 2, 3, 4, 5, 7, 8]
    told = {i: (t, n) for i, t, n in got}
    # a text that repeats itself goes whole, a near copy went before its words could repeat
    assert told[4] == ("", 0) and told[5][0].startswith("my [secret] w0") and told[1] == (None, None) and told[7][1] == 300_000
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == {i for i, *_ in got}


def test_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
