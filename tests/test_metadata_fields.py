"""Metadata reads four fields, so nested values of others are not written out for it."""

from labeltrail.config import RunConfig
from labeltrail.plans import runs


def test_event_vectors_leave_nested_values_of_other_fields(spark):
    lines = ['{"eventName": "a", "args": [{"k": 1.0}], "eventId": 7}', '{"eventName": {"x": [1]}, "syscall": null}', "cut {", None]
    events = spark.createDataFrame(list(enumerate(lines)), "idx long, raw string")
    plans, real = [], runs.fields
    try:
        runs.fields = lambda raw, **options: plans.append(options.get("names")) or real(raw, **options)
        found = runs.event_vectors(events, RunConfig(embedding_dim=4), data_type="t")
    finally:
        runs.fields = real
    assert plans == [("processName", "eventName", "syscall", "eventId")]  # before: None, so all fields were written
    got = {r.idx: r.metadata for r in found.collect()}
    every = {r.idx: r.m for r in events.select("idx", runs.event_metadata("idx", "raw", real("raw"), "t").alias("m")).collect()}
    assert {k: {n: v for n, v in m.items() if n != "text"} for k, m in got.items()} == {
        k: {n: v for n, v in every[k].items() if n != "text"} for k in got
    }
    assert got[1]["eventName"] == '{"x": [1]}' and got[0]["eventId"] == "7"
