import json

import pytest
from pyspark.sql import functions as F

from labeltrail.functions import text as tx
from labeltrail.sources.events import read_events, read_raw_events


def texts(spark, lines, prefixes, exact=True):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, raw string")
    rows = df.select("i", tx.event_text("raw", prefixes, exact).alias("t")).orderBy("i").collect()
    return [r.t for r in rows]


def test_only_string_pairs_with_kept_key_reach_the_text(spark):
    line = json.dumps({"processName": "sh", "returnValue": 3, "args": [{"name": "x", "argsKind": "deep"}],
                       "argsNum": "2", "other": "no", "syscall": None, "eventName": "open"})
    assert texts(spark, [line], ("processName", "eventName", "args", "returnValue", "syscall")) == [
        "processName=sh argsKind=deep argsNum=2 eventName=open"
    ]


def test_value_ends_at_an_escaped_quote(spark):
    assert texts(spark, [r'{"cmd": "echo \"hi\""}'], ("cmd",)) == ["cmd=echo \\"]


def test_rewriting_resolves_unicode_escapes(spark):
    bs = chr(92)
    line = '{"cmd":"a' + bs + 'u003cb"}'
    assert texts(spark, [line], ("cmd",)) == ["cmd=a<b"]
    assert texts(spark, [line], ("cmd",), exact=False) == ["cmd=a" + bs + "u003cb"]


def test_no_prefixes_and_empty_prefix(spark):
    assert texts(spark, ['{"b":"2","a":1}'], None) == ['{"b": "2", "a": 1}']
    assert texts(spark, ['{"b":"2","a":"1"}'], ("",)) == ["b=2 a=1"]


def test_default_is_for_absence_only(spark):
    df = spark.createDataFrame([('{"a": null, "c": {"x": [1, 2]}}',)], "raw string")
    row = df.select(tx.fields("raw").alias("f")).select(
        tx.field_or_default("f", "a").alias("a"), tx.field_or_default("f", "b").alias("b"),
        tx.field_or_default("f", "c").alias("c"), tx.keep_fields("f", ("a",)).alias("kept"),
    ).first()
    assert (row.a, row.b, row.c, row.kept) == (None, "N/A", '{"x": [1, 2]}', {"a": None})


def test_metadata_is_a_map_of_text(spark):
    df = spark.createDataFrame([(4, '{"eventId": 7, "processName": "sh"}')], "idx long, raw string")
    row = df.select(tx.event_metadata("idx", F.lit("t"), tx.fields("raw"), "normal").alias("m")).first()
    assert row.m == {"index": "4", "text": "t", "processName": "sh", "eventName": "N/A", "syscall": "N/A",
                     "eventId": "7", "data_type": "normal"}


def test_scan_keeps_file_order_over_splits_and_files(spark, tmp_path):
    lines = [json.dumps({"eventId": i, "pad": "x" * (i % 50)}) for i in range(3000)]
    for part in range(3):
        body = "\n".join(lines[part * 1000:(part + 1) * 1000]) + "\n"
        (tmp_path / f"part-{part}.json").write_text(body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = read_raw_events(spark, str(tmp_path)).orderBy("idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.idx for r in rows] == list(range(3000))
    assert [r.raw for r in rows] == lines


def test_scan_drops_blank_and_sets_aside_bad_lines(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"eventName":"a"}\n\n   \n{"eventName":\n12\n[1]\n{"eventName":"b"}\n')
    log = read_events(spark, str(tmp_path / "log.json"), ("eventName",), data_type="attack")
    rows = log.events.orderBy("idx").collect()
    assert [(r.idx, r.text, r.data_type) for r in rows] == [
        (0, "eventName=a", "attack"), (1, "eventName=b", "attack")
    ]
    assert sorted((r.raw, r.reason) for r in log.rejects.collect()) == [
        ("12", "not an object"), ("[1]", "not an object"), ('{"eventName":', "malformed")
    ]
    shuffled = read_events(spark, str(tmp_path / "log.json"), None, shuffle=True).events.collect()
    assert sorted(r.idx for r in shuffled) == [0, 1]


def test_missing_file_raises(spark, tmp_path):
    with pytest.raises(Exception):
        read_events(spark, str(tmp_path / "none.json")).events.count()


LINES = [
    '{"a":"x","a":"y"}', '{"a":"c"} junk', '{"a":"g"}{"a":"h"}', '{"a":1},{"b":2}', '{"a":1}] junk [1', '{"a":1}, "b":{"c":2}', '{"v":NaN}',
    '[1]', "3", '"x"', "null", "{", "{}", '{"a":"\\/b","c":"\\u003c"}', '{"k" : "v"}', '  {"a":{"b":[1,"x,y:z\\"",{}]}} ', '{"a":"t\tb"}', '{"a":-Infinity, "b": 1.5}',
]


def _kind(line):
    try:
        return "object" if isinstance(json.loads(line), dict) else "not an object"
    except ValueError:
        return "malformed"


def test_lines_count_as_python_reads_them(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "i int, raw string")
    rows = df.select("i", tx.line_kind("raw").alias("kind"), tx.event_text("raw", None).alias("text"), tx.fields("raw").alias("f")).orderBy("i").collect()
    assert [r.kind for r in rows] == [_kind(x) for x in LINES]
    for line, row in zip(LINES, rows):
        if row.kind == "object":
            value = json.loads(line)
            assert row.text == json.dumps(value, ensure_ascii=False)
            written = {k: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in value.items()}
            assert row.f == written
        elif row.kind == "malformed":
            assert row.text is None
