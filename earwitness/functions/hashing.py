"""Content hashes and short identifiers."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StringType


def sha256_text(text: Column) -> Column:
    return F.sha2(text, 256)


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON of a flat record: sorted keys, nulls kept, no spaces."""
    record = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return F.to_json(record, {"ignoreNullFields": "false"})


def json_string(text: Column, ascii_only: bool = False) -> Column:
    """A JSON string literal: short escapes where there are any, ``\\u`` and four small hex digits for the rest."""
    special = r'["\\]|[^ -~]' if ascii_only else r'["\\]|[\x00-\x1f]'
    short = F.create_map(*(F.lit(x) for kv in (('"', '\\"'), ("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")) for x in kv))
    escape = lambda c: F.coalesce(F.try_element_at(short, c), F.when(c.rlike(special), F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")), c)
    escaped = F.array_join(F.transform(F.split(text, ""), escape), "")
    return F.concat(F.lit('"'), F.when(text.rlike(special), escaped).otherwise(text), F.lit('"'))


def nested_json(value: Column, kind: T.DataType, ascii_only: bool = False) -> Column:
    """Canonical JSON of a value of any nesting: keys in order, nulls kept, no spaces.

    Fractions have no text that all writers share, so they are given as strings.
    """
    if isinstance(kind, T.StructType):
        names = sorted(kind.fieldNames())
        members = [F.concat(json_string(F.lit(n), ascii_only), F.lit(":"), nested_json(value[n], kind[n].dataType, ascii_only)) for n in names]
        made = F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        made = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: nested_json(x, kind.elementType, ascii_only)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        member = lambda e: F.concat(json_string(e["key"], ascii_only), F.lit(":"), nested_json(e["value"], kind.valueType, ascii_only))
        names = F.array_sort(F.map_keys(value))
        made = F.concat(F.lit("{"), F.array_join(F.transform(names, lambda n: member(F.struct(n.alias("key"), value[n].alias("value")))), ","), F.lit("}"))
    elif isinstance(kind, T.StringType):
        made = json_string(value, ascii_only)
    elif isinstance(kind, (T.BooleanType, T.IntegralType, T.NullType)):
        made = value.cast("string")
    else:
        raise TypeError(f"{kind.simpleString()} has no canonical JSON; give it as a string")
    return F.coalesce(made, F.lit("null"))


def record_sha256(df: DataFrame, record: str, ascii_only: bool = False) -> Column:
    """Hash of the canonical JSON of the struct column ``record`` of ``df``."""
    return sha256_text(nested_json(F.col(record), df.schema[record].dataType, ascii_only))


def short_id(prefix: str, digest: Column, length: int) -> Column:
    return F.concat(F.lit(prefix), F.substring(digest, 1, length))


def candidate_id(fields: dict[str, Column]) -> Column:
    return short_id("cand-", sha256_text(canonical_json(fields)), 20)


def correction_id(fields: dict[str, Column]) -> Column:
    return short_id("corr-", sha256_text(canonical_json(fields)), 20)


def local_speaker_key(provider_code: Column, run_id: Column, chunk: Column, speaker: Column) -> Column:
    scope = {
        "provider_code": F.coalesce(provider_code, F.lit("")),
        "run_id": F.coalesce(run_id, F.lit("")),
        "chunk_filename": F.coalesce(chunk, F.lit("")),
        "provider_speaker_id": F.coalesce(speaker, F.lit("")),
    }
    return short_id("local-speaker-", sha256_text(canonical_json(scope)), 16)


def clip_id(index: Column, clip_sha256: Column) -> Column:
    return F.concat(F.format_string("clip-%05d-", index), F.substring(clip_sha256, 1, 12))


def _digest(raw: str | None, drop: str | None) -> str | None:
    if raw is None:
        return None
    try:
        value = json.loads(raw)
    except ValueError:
        return None
    if drop and isinstance(value, dict):
        value.pop(drop, None)
    text = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


@F.pandas_udf(StringType())
def foreign_json_sha256(raw: pd.Series) -> pd.Series:
    """Canonical hash of JSON written elsewhere (its float text and nesting are not ours)."""
    return raw.map(lambda s: _digest(s, None))


@F.pandas_udf(StringType())
def foreign_event_sha256(raw: pd.Series) -> pd.Series:
    """As above, leaving out the record's own ``event_sha256``."""
    return raw.map(lambda s: _digest(s, "event_sha256"))


def register_sql_functions(spark) -> None:
    """Expose the Python-backed functions to ``spark.sql``."""
    from earwitness.functions import similarity, text

    spark.udf.register("nfkc_casefold", text.nfkc_casefold)
    spark.udf.register("seq_ratio", similarity.seq_ratio)
    spark.udf.register("seq_ratio_tokens", similarity.seq_ratio_tokens)
    spark.udf.register("foreign_json_sha256", foreign_json_sha256)
    spark.udf.register("foreign_event_sha256", foreign_event_sha256)
