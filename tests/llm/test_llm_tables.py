"""Mixing, tool calls and the pipeline."""

import json
import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from gridrun.llm import decontaminate, mixing, repetition, secrets, toolcalls

from .test_llm_pairs import brute_classes


def level(sizes, weights):
    """Targets by filling until none is above its cap."""
    total, caps, out, open_ = sum(sizes), [3 * s for s in sizes], [None] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - sum(x for x in out if x is not None)
        share = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / share > caps[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / share
            break
        for i in over:
            out[i] = caps[i]
        open_ -= set(over)
    return out


def test_mixing_against_iterated_filling(docs_of):
    rng = random.Random(1)
    for _ in range(4):
        names = [f"s{i}" for i in range(rng.randrange(1, 9))] + [None]
        rows = [(i, "w " * rng.randrange(1, 40), None, rng.choice(names + names[:2] * 4)) for i in range(80)]
        got = mixing.mix_sources(docs_of(rows), carry=["source"]).collect()
        order = sorted({r[3] for r in rows}, key=lambda s: (s is None, s))
        sizes = [sum(len(r[1].split()) for r in rows if r[3] == s) for s in order]
        want = dict(zip(order, level(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))]), strict=True))
        for s in order:
            mine = [r for r in got if r.source == s]
            assert all(abs(r.target - want[s]) < 1e-6 * want[s] + 1e-9 for r in mine)
            assert abs(sum(r.taken for r in mine) - want[s]) < 1 and all(0 <= r.taken <= 3 * r.size for r in mine)
        assert sorted(map(repr, mixing.mix_sources(docs_of(rows[::-1]), carry=["source"]).collect())) == sorted(map(repr, got))


def test_mixing_awkward(awkward, nothing):
    rows = mixing.mix_sources(awkward.withColumn("size", F.lit("x"))).collect()
    assert len(rows) == 10 and sum(r.size == 0 for r in rows) == 4 and all(r.taken == 0 for r in rows if r.size == 0)
    assert mixing.mix_sources(nothing).count() == 0
    assert {r.taken for r in mixing.mix_sources(awkward.where("size(split(text, ' ')) IS NULL OR text = ''")).collect()} == {0}


def test_mixing_ends_in_equal_rows(docs_of):
    """Equal rows share the rest; rows that differ in their text only don't tie."""
    rows = [(7, "w " * 9, None, "a")] * 10 + [(8, f"{i} " * 5, None, "b") for i in range(20)] + [(9, "w", None, "c")]
    got = mixing.mix_sources(docs_of(rows), carry=["source", "text"]).collect()
    by = {s: [r for r in got if r.source == s] for s in "abc"}
    assert len({r.taken for r in by["a"]}) == 1 and 0 <= by["a"][0].target - sum(r.taken for r in by["a"]) < 10
    assert 0 <= by["b"][0].target - sum(r.taken for r in by["b"]) < 1 and len({r.text for r in by["b"]}) == 20


def test_stages_keep_columns_of_any_name(docs_of, spark, sf):
    docs = docs_of([(1, "a text of some words"), (2, "another text of other words")]).withColumn("_u", F.lit(1)).withColumn("_key", F.lit(2)).withColumn("size", F.lit(3)).withColumn("key", F.lit(4))
    for _, stage in corpus_pipeline.STAGES[1:3]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns and {(r["_u"], r["_key"], r["size"], r["key"]) for r in got.collect()} == {(1, 2, 3, 4)}


def test_tool_calls(spark):
    call = lambda **x: json.dumps({"tool_calls": [x]})
    rows = [
        (1, 0, "assistant", json.dumps({"tool_calls": [{"id": "a", "name": "add", "arguments": {"y": 2, "x": 1}}, {"id": "b", "name": "add", "arguments": '{"x":"é"}', "needs": "a"}]})),
        (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": {"z": 1, "b": [2]}})), (1, 2, "tool", json.dumps({"tool_call_id": "b", "content": "ok"})), (1, 2, "tool", json.dumps({"tool_call_id": "b", "content": "ok"})),
        (1, 3, "tool", json.dumps({"tool_call_id": "nobody", "content": "x"})), (1, 4, "assistant", call(id="c", name="add", arguments="{", needs="b")), (1, 5, "assistant", call(id="d", name="gone", needs="zz")),
        (2, 0, "assistant", call(id="p", name="add", arguments={"x": 1}, needs="q")), (2, 1, "assistant", call(id="q", name="add", arguments={"x": 1}, needs="p")),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.call_id): r for r in toolcalls.format_conversations(table, {"add": {"x": ("integer", True), "y": ("integer", False)}}).collect()}
    assert {k: (r.level, r.n_results, r.valid, r.problems) for k, r in got.items()} == {
        (1, "a"): (0, 1, True, ""), (1, "b"): (1, 2, False, "x is no integer"), (1, "c"): (2, 0, False, "not JSON"), (1, "d"): (0, 0, False, "unknown need; unknown tool"),
        (2, "p"): (-1, 0, False, "cycle"), (2, "q"): (-1, 0, False, "cycle")}
    assert got[1, "a"].json == '{"arguments":{"x":1,"y":2},"id":"a","name":"add","result":"{\\"b\\":[2],\\"z\\":1}"}'
    assert got[1, "b"].json == '{"arguments":{"x":"é"},"id":"b","name":"add","needs":"a","result":"ok"}'


def test_tool_calls_awkward(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", None), (1, 1, "assistant", None), (1, None, "user", "x"), (None, 3, "user", "y"), (None, 3, "user", "y"), (2, 0, None, "z"), (2, 1, "assistant", ""), (3, 0, "system", "s"), (3, 1, "user", "{broken"), (3, 2, "user", "again")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("name", F.lit(1))
    got = {(r.conv_id, r.call_id): (r.level, r.n_results, r.valid) for r in toolcalls.format_conversations(table).collect()}
    assert got == {(1, "0"): (0, 2, False), (None, "3"): (0, 0, True), (3, "0"): (0, 0, True), (3, "1"): (1, 0, True), (3, "2"): (2, 0, True)}
    assert toolcalls.format_conversations(table.limit(0)).count() == 0


def test_long_chain_of_calls(spark):
    rows = [(1, t, "user", f"t{t}") for t in range(300)]
    got = toolcalls.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.level, r.turn) for r in got) == [(t, t) for t in range(300)]


def test_pipeline_stages_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    judged = {r.doc_id for r in repetition.quality_rules(docs).where("kept").collect()}
    classes = brute_classes([(d, rows[d].text) for d in judged])
    single = {d for d in judged if classes[d][0] == d}
    bad = {r.doc_id for r in decontaminate.overlaps(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    want = {d: secrets.redacted(rows[d].text) for d in single - bad}
    step = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, step, sf).write.parquet(str(tmp_path / str(i)))
        step = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert step.columns == docs.columns
        if i == 3:
            assert {r.doc_id: r.text for r in step.collect()} == want and step.count() == len(want)
    mixed = step.collect()
    assert {r.doc_id for r in mixed} <= set(want) and all(r.text == want[r.doc_id] and r.taken > 0 and r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in mixed)


def test_pipeline_awkward(awkward, nothing, spark, sf):
    for docs in (awkward, nothing):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, sf).count() >= 0
