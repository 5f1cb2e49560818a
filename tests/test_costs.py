"""What grows with the data must stay cheap per row: few calls to a stream's state, numbers instead of texts in shuffles, no work for a choice that is none."""

import pandas as pd
import pyarrow as pa
from pyspark.sql import Row, functions as F

from mnemoframe.operators import changes as ch, intake, lexical
from mnemoframe.streaming import state


class _Handle:
    """State of one key that counts the calls."""

    def __init__(self):
        self.values, self.maps, self.calls = {}, {}, []

    def getValueState(self, name, schema):
        handle = self

        class Value:
            def get(self):
                handle.calls.append("get")
                return handle.values.get(name)

            def update(self, value):
                handle.calls.append("update")
                handle.values[name] = value

        return Value()

    def getMapState(self, name, key, value):
        handle = self

        class Map:
            def containsKey(self, k):
                handle.calls.append("containsKey")
                return k in handle.maps

            def updateValue(self, k, v):
                handle.calls.append("updateValue")
                handle.maps[k] = v

        return Map()


def _events(processor, *links):
    rows = [Row(source_ref=s, role=r, arrival=a) for s, r, a in links]
    return [(row["source_ref"], row["event"]) for row in processor.handleInputRows(tuple("trgsxyz"), iter(rows), None)]


def test_a_group_of_a_stream_is_read_and_written_once_a_batch():
    handle, processor = _Handle(), state._Episodes()
    processor.init(handle)
    # in the order of arrival, whatever order they come in
    assert _events(processor, ("b", "agent_act", 2), ("a", "situation", 1), ("a", "situation", 3)) == [("a", "accepted"), ("b", "materialized"), ("a", "accepted")]
    assert sorted(handle.calls) == ["get", "update", "updateValue", "updateValue"]
    handle.calls.clear()
    assert _events(processor, ("c", "situation", 4), ("d", "outcome", 5), ("d", "outcome", 6), ("b", "agent_act", 7)) == [
        ("c", "sealed"), ("d", "requeued"), ("d", "accepted"), ("b", "accepted")]
    assert sorted(handle.calls) == ["containsKey"] * 3 + ["get", "updateValue"]


def test_a_key_of_a_stream_is_written_only_when_it_is_new():
    handle, processor = _Handle(), state._Admit()
    processor.init(handle)
    ask = lambda *rows: [r["status"] for r in processor.handleInputRows(("t", "k"), iter([Row(request_hash=h, arrival=a) for h, a in rows]), None)]
    assert ask(("y", 2), ("x", 1), ("x", 3)) == ["new", "conflict", "replay"]
    assert handle.calls == ["get", "update"]
    assert ask(("x", 4)) == ["replay"]
    assert handle.calls == ["get", "update", "get"]


def test_pairs_go_on_in_the_next_batch():
    handle, processor = _Handle(), state._Pairs()
    processor.init(handle)
    say = lambda *rows: [tuple(r) for r in processor.handleInputRows((7,), iter([Row(role=r, text=t, turn=n) for n, r, t in rows]), None)]
    assert say((2, "user", None), (1, "user", "a")) == []
    assert say((3, "assistant", "b"), (4, "assistant", "c")) == [(7, 0, "a\n\n", "b", ""), (7, 1, "", "c", "assistant_first")]


def test_many_windows_are_decided_in_one_call():
    row = lambda w, n, new, replaces="", holders=(): dict(window_ref=w, change_no=n, kind="recollection", scope="o", new_text=new, old_text="", replaces=replaces, holders=list(holders))
    rows = [row("v", 0, "a"), row("w", 0, "a"), row("w", 1, "a"), row("v", 1, "b", "m@1"), row("w", 2, "c", holders=["m@1"]), row("v", 2, "c", holders=["m@1"])]
    want = {("v", 0): True, ("v", 1): True, ("v", 2): True, ("w", 0): True, ("w", 1): False, ("w", 2): False}
    done = ch._decide(pd.DataFrame(rows))
    assert {(r.window_ref, r.change_no): r.applied for r in done.itertuples()} == want
    batch = pa.RecordBatch.from_pylist([{"window_ref": w, "changes": [{k: v for k, v in r.items() if k != "window_ref"} for r in rows if r["window_ref"] == w]} for w in "vw"])
    got = [x for b in ch._decide_batches(iter([batch])) for x in b.to_pylist()]
    assert {(x["window_ref"], x["change_no"]): x["applied"] for x in got} == want


def test_terms_are_ranked_and_met_as_numbers(spark, monkeypatch):
    q = spark.createDataFrame([("o", "q1", ["x", "y", "z"]), ("p", "q1", ["x"]), (None, "q3", ["x"])], "owner string, q string, terms array<string>")
    t = spark.createDataFrame([("o", "i1", ["x", "y"]), ("o", "i2", ["v", "w"]), ("o", "i3", ["z", "w"]), ("p", "i4", ["y"]), (None, "i5", ["x"])], "owner string, i string, terms array<string>")
    kept = []
    cut = lexical.cut_lineage
    monkeypatch.setattr(lexical, "cut_lineage", lambda df: kept.append(df) or cut(df))
    found = lambda: {(r.owner, r.q, r.i): round(r.score, 6) for r in lexical.best_overlaps(q, t, ["owner"], "q", "i", 2).collect()}
    want = {("o", "q1", "i1"): 0.8, ("o", "q1", "i3"): 0.4}
    assert found() == want
    ranked = [df for df in kept if "pos" in df.columns]
    assert ranked and all(kind != "string" for df in ranked for _, kind in df.dtypes)
    # different terms, also of different owners, with equal codes change nothing
    code = F.xxhash64
    monkeypatch.setattr(lexical.F, "xxhash64", lambda *c: F.pmod(code(*c), F.lit(2)).cast("bigint"))
    assert found() == want


def test_texts_of_an_owner_with_few_memories_are_not_scored(spark, monkeypatch):
    windows = spark.createDataFrame([("few", "w1", "red apple"), ("many", "w2", "red apple"), ("many", "w3", "зима")], "owner string, window string, text string").select(
        "owner", "window", lexical.features("text").alias("features"))
    rows = [("few", "f1", 1, "green pear"), ("few", "f2", 2, "red apple"), ("many", "m1", 1, "red apple"), ("many", "m2", 2, "green pear"), ("many", "m3", 3, "зима"), ("none", "n1", 1, "x")]
    active = spark.createDataFrame(rows, "owner string, version_ref string, created_order int, text string").select(
        "owner", "version_ref", "created_order", lexical.features("text").alias("features"))
    scored = []
    real = lexical.best_overlaps
    monkeypatch.setattr(lexical, "best_overlaps", lambda q, t, *a, **k: scored.append((q, t)) or real(q, t, *a, **k))
    got = {(r.window, r.version_ref) for r in lexical.bounded_targets(windows, active, ["owner"], "window", n=2).collect()}
    assert got == {("w1", "f1"), ("w1", "f2"), ("w2", "m1"), ("w2", "m3"), ("w3", "m3"), ("w3", "m2")}
    assert [{r.owner for r in df.collect()} for df in scored[0]] == [{"many"}, {"many"}]


def test_rounds_read_only_versions_that_changes_concern(spark):
    rows = [("m@1", "old text"), ("m@2", "new text"), ("m@3", "another"), ("m@4", None), (None, "another")]
    versions = spark.createDataFrame([("recollection", v, t) for v, t in rows], "kind string, version_ref string, text string")
    changes = spark.createDataFrame([("w", 0, "m@1", "SELF", "TEXT", " new text ", ["e"], None), ("w", 1, "m@9", "SELF", "KEEP", "another", ["e"], None)], ch.CHANGE_SCHEMA)
    assert {r.version_ref for r in ch.concerned(changes, versions).collect()} == {"m@1", "m@2"}


def test_a_round_that_moves_nothing_writes_no_requests_again(spark, monkeypatch):
    name = lambda c: F.concat(F.lit(f"{c}-"), F.col("id")).alias(c)
    rows = spark.range(20).select(*[name(c) for c in (*intake.GROUP, "source_ref", "idempotency_key", "request_hash", "payload_hash")], F.lit("situation").alias("role"),
                                  F.col("id").alias("row"), F.col("id").alias("arrival"), F.lit(None).cast("string").alias("refusal")).withColumn("at", F.struct("arrival", "request_hash", "row"))
    written = []
    cut = intake.cut_lineage
    monkeypatch.setattr(intake, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    assert {(r.row, r.status) for r in intake.settle(rows).collect()} == {(n, "accepted") for n in range(20)}
    # the first guess, which holds
    assert sum(df.count() for df in written if "request_hash" in df.columns) == 20
