"""Column functions over record texts."""

from __future__ import annotations

import datetime
import json
import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units, as long."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def utf8_length(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))


def split_part(text: Column, part: int, separator: str = "\u001f") -> Column:
    """A field of a delimited text, from 1; '' where there are fewer."""
    return F.split_part(text, F.lit(separator), F.lit(part))


def with_value(lines: DataFrame, line: str = "line", value: str = "_value") -> DataFrame:
    """Adds the line's JSON value as VARIANT; null unless the whole line is one strict JSON value.

    The parser alone ignores what follows a value; inside brackets it does not.  Each step is
    a column of its own that the next refers to, so a line is parsed once."""
    rest = [c for c in lines.columns if c != value]
    wrapped = lines.select(*rest, F.try_parse_json(F.concat(F.lit("["), F.col(line), F.lit("]"))).alias("_wrapped"))
    one = F.when(F.try_variant_get("_wrapped", "$[1]", "variant").isNull(), F.try_variant_get("_wrapped", "$[0]", "variant"))
    return wrapped.select(*rest, one.alias(value))


#: The system fields of a stored line and their types, in the order of their checks.
FIELDS = (("id", "string"), ("_oid", "number"), ("_rid", "number"), ("_seq", "number"))


def with_error(lines: DataFrame, line: str = "line", error: str = "error", value: str = "_value") -> DataFrame:
    """Adds the line's value and the first thing that is wrong with it; null where it is a record."""
    parsed = with_value(lines, line, value)
    kinds = parsed.select("*", *(F.schema_of_variant(F.try_variant_get(F.col(value), f"$['{n}']", "variant")).alias(f"_kind_{n}") for n, _ in FIELDS))
    checks = []
    for n, kind in FIELDS:
        got = F.col(f"_kind_{n}")
        right = {"string": got == "STRING", "number": got.rlike("^(BIGINT|DOUBLE|DECIMAL)"), "boolean": got == "BOOLEAN"}[kind]
        checks.append(F.when(got.isNull(), f"{n} is missing").when(~right, f"{n} must be a {kind}"))
    wrong = F.when(F.col(value).isNull(), "not one JSON value").otherwise(F.coalesce(*checks))
    return kinds.select(*(c for c in lines.columns if c not in (value, error)), value, wrong.alias(error))


def project_fields(value: Column, names: list[str]) -> Column:
    """Named top-level fields of a VARIANT as a map of JSON texts: missing ones omitted, null kept."""
    if not names:
        return F.create_map().cast("map<string,string>")
    fields = F.array(*(F.struct(F.lit(n).alias("key"), F.to_json(F.try_variant_get(value, f"$['{n}']", "variant")).alias("value")) for n in names))
    # a missing field has no text; JSON null has the text null
    return F.map_from_entries(F.filter(fields, lambda e: e["value"].isNotNull()))


def tombstone(id_: Column, rid: Column, seq: Column) -> Column:
    """A deletion's line."""
    quoted = F.to_json(F.struct(id_.alias("id")))
    return F.concat(F.expr("''"), F.regexp_replace(quoted, r"\}$", ""), F.lit(',"_oid":2,"_rid":'), rid.cast("string"), F.lit(',"_seq":'), seq.cast("string"), F.lit("}"))


def plain(value: Any, top: bool = True) -> Any:
    """A Python value as the JSON encoder of the record store sees it: NaN and infinity are
    null, dates ISO texts, callables dropped from objects and null in lists."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return int(value)
    if isinstance(value, datetime.datetime):
        at = value.astimezone(datetime.timezone.utc) if value.tzinfo else value
        return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"
    if isinstance(value, dict):
        return {str(k): plain(v, False) for k, v in value.items() if not callable(v)}
    if isinstance(value, (list, tuple)):
        return [None if callable(v) else plain(v, False) for v in value]
    if isinstance(value, (set, frozenset)):
        return {}
    return value


def encode(value: dict[str, Any]) -> str:
    return json.dumps(plain(value), ensure_ascii=False, separators=(",", ":"))
