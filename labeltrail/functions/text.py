"""Event text from raw JSON lines, and field access on events."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: a quoted key, a colon, a quoted string without an inner quote.
PAIR_PATTERN = r'"([^"]+)":\s*"([^"]*)"'

MISSING = "N/A"
EVENT_FIELDS = ("processName", "eventName", "syscall")
METADATA_FIELDS = (*EVENT_FIELDS, "eventId")
_FIELD_MAP = "map<string,string>"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _any_prefix(key: Column, prefixes: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for prefix in prefixes:
        test = test | key.startswith(F.lit(prefix))
    return test


def text_filter(line: str | Column, keep_prefixes: tuple[str, ...] | None) -> Column:
    """``key=value`` for every string pair, at any depth, whose key has a kept prefix.

    Pairs keep document order and are joined by one blank. Numbers, booleans,
    nulls and containers never match; a value ends at its first quote, escaped or
    not. ``None`` leaves the text as it is; an empty prefix keeps every pair.
    """
    line = _col(line)
    if keep_prefixes is None:
        return line
    pairs = F.regexp_extract_all(line, F.lit(PAIR_PATTERN), F.lit(0))
    kept = F.filter(pairs, lambda pair: _any_prefix(pair, tuple(f'"{p}' for p in keep_prefixes)))
    # A pair has exactly four quotes: the key lies after the first, the value after the third.
    written = F.transform(
        F.transform(kept, lambda pair: F.split(pair, '"')),
        lambda parts: F.concat(F.get(parts, F.lit(1)), F.lit("="), F.get(parts, F.lit(3))),
    )
    return F.array_join(written, " ")


def _parsed(line: str):
    """What Python's parser reads; None if it refuses the line."""
    try:
        return json.loads(line)
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def _rewrite_json(lines: pd.Series) -> pd.Series:
    def written(line: str | None) -> str | None:
        value = None if line is None else _parsed(line)
        return None if value is None else json.dumps(value, ensure_ascii=False)

    return lines.map(written)


@F.pandas_udf(T.StringType())
def _rewrite_doubtful(lines: pd.Series) -> pd.Series:
    """Null for null, empty for a line that does not parse."""

    def written(line: str | None) -> str | None:
        value = None if line is None else _parsed(line)
        return None if line is None else "" if value is None else json.dumps(value, ensure_ascii=False)

    return lines.map(written)


@F.pandas_udf(T.StringType())
def _python_kind(lines: pd.Series) -> pd.Series:
    def kind(line: str | None) -> str | None:
        if line is None:
            return None
        try:
            return OBJECT if isinstance(json.loads(line), dict) else NOT_OBJECT
        except (ValueError, RecursionError):
            return MALFORMED

    return lines.map(kind)


OBJECT, NOT_OBJECT, MALFORMED = "object", "not an object", "malformed"
_MARK = "labeltrail: end of the line"


def line_kind(line: str | Column) -> Column:
    """Whether a line is a JSON object, as Python's parser sees it.

    Spark's parser takes text after the value. So the line is parsed once, as the first element of an array with a
    mark behind it: a line that opens an object, and without the mark in it, is one if the mark comes second.
    Python decides on the lines that are refused there, such as those with doubled keys or ``NaN``; of all
    others it gets a null, which is their verdict too, so that the parser's result is needed once.
    """
    line = _col(line)
    parsed = F.try_parse_json(F.concat(F.lit("["), line, F.lit(f',"{_MARK}"]')))
    opens = F.substring(F.ltrim(line, F.lit(" \t\r\n")), 1, 1) == "{"
    plain = opens & ~F.contains(line, F.lit(_MARK)) & (F.try_variant_get(parsed, "$[1]", "string") == _MARK)
    doubtful = F.when(F.coalesce(plain, F.lit(False)), F.lit(None).cast("string")).otherwise(line)
    return F.when(line.isNotNull(), F.coalesce(_python_kind(doubtful), F.lit(OBJECT)))


def rewrite_json(line: str | Column) -> Column:
    """The line parsed and written again, with escapes such as ``\\u003c`` resolved; null if it does not parse."""
    return _rewrite_json(_col(line))


#: What rewriting can change in a string pair: escapes with two spellings, a blank before a colon.
_TWO_SPELLINGS = r'\\u|\\/|"\s+:'


def event_text(
    line: str | Column, keep_prefixes: tuple[str, ...] | None, exact: bool = True
) -> Column:
    """Text of an event line.

    ``exact`` gives the text of the line as Python's JSON writer writes it. Only lines that it could change
    go through Arrow to be rewritten: all of them without prefixes, otherwise those with ``\\u`` or ``\\/``
    escapes, a blank before a colon, or a form that Spark's parser refuses (doubled keys, ``NaN``). Without ``exact`` the
    raw line is searched. A line that does not parse has no exact text.
    """
    line = _col(line)
    if not exact:
        return text_filter(line, keep_prefixes)
    if keep_prefixes is None:
        return rewrite_json(line)
    needs = line.rlike(_TWO_SPELLINGS) | F.try_parse_json(line).isNull()
    written = F.coalesce(_rewrite_doubtful(F.when(needs, line)), line)
    return text_filter(F.nullif(written, F.lit("")), keep_prefixes)


def _spaced(value: Column) -> Column:
    """Compact JSON with a blank after each comma and colon outside strings, as Python's writer has it."""
    marked = F.regexp_replace(value, r'("(?:[^"\\]|\\.)*+"|[^",:]++)([,:]?)', "$1$2\u0001")
    for sign in (",", ":"):
        marked = F.replace(marked, F.lit(f"{sign}\u0001"), F.lit(f"{sign} "))
    return F.replace(marked, F.lit("\u0001"), F.lit(""))


#: How a value begins that may be nested, or a number that Spark puts in quotes; a string may begin so too.
_DOUBTFUL_VALUE = r'^[\[{"]'


def fields(line: str | Column, keep_prefixes: tuple[str, ...] | None = None, names: tuple[str, ...] | None = None) -> Column:
    """Top-level fields in document order; nested values as the text of Python's JSON writer.

    Of a doubled key the last value counts. ``keep_prefixes`` or ``names`` leave out other fields before their values
    are written. Only lines with a value that looks nested are parsed a second time, for the kinds of their values.
    """
    line = _col(line)

    def chosen(every: Column) -> Column:
        keys = F.transform(every, lambda e: e["key"])
        kept = F.transform(every, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("at")))
        if names is not None:
            kept = F.filter(kept, lambda e: e["key"].isin(*names))
        elif keep_prefixes is not None:
            kept = F.filter(kept, lambda e: _any_prefix(e["key"], tuple(keep_prefixes)))
        doubled = F.size(F.array_distinct(keys)) < F.size(keys)
        later = lambda e: F.slice(keys, e["at"] + 2, F.size(keys))
        return F.filter(kept, lambda e: ~(doubled & F.array_contains(later(e), e["key"])))

    def kinds() -> Column:
        return F.transform(F.map_values(F.from_json(line, "map<string,variant>")), F.schema_of_variant)

    def one(kind: Column, e: Column) -> Column:
        text = e["value"]
        value = F.when(kind.rlike("^(OBJECT|ARRAY)"), _spaced(text)).when(kind == "DOUBLE", F.trim(text, F.lit('"'))).otherwise(text)
        return F.struct(e["key"].alias("key"), value.alias("value"))  # Spark quotes NaN

    def written(own: Column) -> Column:
        doubtful = F.exists(own, lambda e: F.coalesce(e["value"].rlike(_DOUBTFUL_VALUE), F.lit(False)))
        nested = _with(kinds(), lambda k: F.transform(own, lambda e: one(F.get(k, e["at"]), e)))
        plain = F.transform(own, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
        return F.when(doubtful, nested).otherwise(plain)

    every = F.map_entries(F.from_json(line, _FIELD_MAP))
    return F.map_from_entries(_with(_with(every, chosen), written))


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def field_or_default(field_map: str | Column, name: str, default: str = MISSING) -> Column:
    """A field's text, ``default`` only when the key is absent; JSON null stays null."""
    field_map = _col(field_map)
    value = F.try_element_at(field_map, F.lit(name))
    return F.when(F.map_contains_key(field_map, name), value).otherwise(F.lit(default))


def keep_fields(field_map: str | Column, keep_prefixes: tuple[str, ...]) -> Column:
    """Top-level fields whose name has a kept prefix, any value type."""
    return F.map_filter(_col(field_map), lambda k, _: _any_prefix(k, tuple(keep_prefixes)))


def event_metadata(
    idx: str | Column, text: str | Column, field_map: str | Column, data_type: str
) -> Column:
    """Metadata of one event as a string map of scalars; nested values as JSON text.

    Of ``field_map`` only the ``METADATA_FIELDS`` are read, so ``fields`` need not work out others.
    """

    def entries(own: Column) -> Column:
        named = [part for name in METADATA_FIELDS for part in (F.lit(name), field_or_default(own, name))]
        return F.create_map(
            F.lit("index"), _col(idx).cast("string"), F.lit("text"), _col(text), *named, F.lit("data_type"), F.lit(data_type)
        )

    return _with(_col(field_map), entries)
