"""Parsing and validating what language models and requests hand in, and resolving references.

Bodies and model answers are decoded by Python's JSON decoder in Arrow batches, as the JVM's readers are
lenient where these must not be: they take the first of several values and turn values of a wrong type
into nulls. Everything behind the decoding is expressions.
"""

from __future__ import annotations

import ipaddress
import json
import re
from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import normalize_name, strip
from tessera.plans.scratch import small
from tessera.sources.views import MEMORY_TYPES

ENTITY_TYPES = "claim document event organization person project system topic".split()
MAX_BODY, MAX_INPUT, MAX_METADATA = 1 << 20, 256 << 10, 64 << 10
#: Fields of a model's extraction; lists and objects nest, numbers are float or int.
EXTRACTION = {"summary": str, "type": str, "people": [str], "topics": [str], "entities": [{"type": str, "name": str, "confidence": float}], "importance": float, "utility": float, "belief_impact": float, "confidence": float, "expires_in_days": int}
_BLANK = " \t\n\r\f\v"


def expiry(days: Column, as_of: Column) -> Column:
    """days after ``as_of``, none for 0 or less."""
    return F.when(days > 0, F.timestamp_seconds(as_of.cast("bigint") + days.cast("bigint") * 86400))


# -- JSON bodies


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


_DECODER = json.JSONDecoder(parse_constant=_no_constant)


def _fits(value, kind, strict: bool) -> bool:
    """Whether a JSON value has the given form; null fits all. Field names match without regard to case;
    unknown ones fail where ``strict``."""
    if value is None or kind is object:
        return True
    if isinstance(kind, dict):
        fields = {k.lower(): v for k, v in kind.items()}
        return isinstance(value, dict) and all(_fits(v, fields[k.lower()], strict) if k.lower() in fields else not strict for k, v in value.items())
    if isinstance(kind, list):
        return isinstance(value, list) and all(_fits(x, kind[0], strict) for x in value)
    if kind is float:
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind is int:
        return isinstance(value, int) and not isinstance(value, bool)
    return isinstance(value, kind)


def decode_body(raw: str | None, fields: dict, strict: bool = True, most: int = MAX_BODY):
    """(value, error code) of a request body: exactly one JSON value of the given form."""
    if raw is not None and len(raw) * 4 > most and len(raw.encode()) > most:
        return None, "request_too_large"
    text = (raw or "").strip(_BLANK)
    if not text:
        return None, "empty_body"
    try:
        value, end = _DECODER.raw_decode(text)
    except (ValueError, RecursionError):
        return None, "invalid_json"
    if not _fits(value, fields, strict):
        return None, "invalid_json"
    rest = text[end:].strip(_BLANK)
    if rest:
        try:
            _DECODER.raw_decode(rest)
        except (ValueError, RecursionError):
            return None, "invalid_json"
        return None, "trailing_json"
    return value, None


def request_body(raw: Column, fields: dict, strict: bool = True) -> Column:
    """struct(body, error) of HTTP bodies; the body is the one JSON value, as text, of up to 1 MiB. Error
    codes: request_too_large, empty_body, invalid_json (also unknown fields where ``strict``, and values
    of a wrong type), trailing_json."""
    kind = pa.struct([("body", pa.string()), ("error", pa.string())])

    def run(column: pa.Array) -> pa.Array:
        found = []
        for x in column.to_pylist():
            value, error = decode_body(x, fields, strict)
            found.append({"body": None if error else json.dumps(value, ensure_ascii=False, separators=(",", ":")), "error": error})
        return pa.array(found, kind)

    return F.arrow_udf(run, "struct<body:string,error:string>")(raw)


def _clamped(x) -> float:
    return min(max(float(x or 0), 0.0), 1.0)


def _distinct(xs) -> list[str]:
    seen: dict[str, str] = {}
    for x in xs or []:
        if (x or "").strip(_BLANK):
            seen.setdefault(x.strip(_BLANK).lower(), x.strip(_BLANK))
    return list(seen.values())


_FENCE = re.compile(r"^```(?:json)?\s*(.*?)\s*```$", re.DOTALL | re.IGNORECASE)


def parse_extraction(raw: str | None) -> tuple[dict | None, str | None]:
    """(extraction, error) of a model's answer, perhaps fenced. Not one JSON object, unknown fields,
    no summary, an unknown type or entity type are errors; entities without name or type are left out,
    lists and entities made distinct, scores clamped, expiries of 0 or less dropped."""
    text = (raw or "").strip(_BLANK)
    fenced = _FENCE.match(text)
    value, error = decode_body(fenced[1] if fenced else text, EXTRACTION)
    if error or value is None:
        return None, error or "summary is required"
    v = {k.lower(): x for k, x in value.items()}
    summary, kind = (v.get("summary") or "").strip(_BLANK), (v.get("type") or "").strip(_BLANK)
    if not summary:
        return None, "summary is required"
    if kind not in MEMORY_TYPES:
        return None, "unknown type"
    entities: dict[tuple[str, str], dict] = {}
    for e in v.get("entities") or []:
        e = {k.lower(): x for k, x in (e or {}).items()}
        of, name = (e.get("type") or "").strip(_BLANK), (e.get("name") or "").strip(_BLANK)
        if of and name:
            if of not in ENTITY_TYPES:
                return None, "unknown entity type"
            entities.setdefault((of, name.lower()), {"type": of, "name": name, "confidence": _clamped(e.get("confidence"))})
    days = v.get("expires_in_days") or 0
    scores = {k: _clamped(v.get(k)) for k in ("importance", "utility", "belief_impact", "confidence")}
    return {"summary": summary, "type": kind, "people": _distinct(v.get("people")), "topics": _distinct(v.get("topics")), "entities": list(entities.values()), **scores, "expires_in_days": days if days > 0 else None}, None


def extraction(raw: Column) -> Column:
    """struct(value, error) of models' answers (see ``parse_extraction``)."""
    value = "struct<summary:string,type:string,people:array<string>,topics:array<string>,entities:array<struct<type:string,name:string,confidence:double>>,importance:double,utility:double,belief_impact:double,confidence:double,expires_in_days:bigint>"
    text, score = pa.string(), pa.float64()
    kind = pa.struct([("value", pa.struct([("summary", text), ("type", text), ("people", pa.list_(text)), ("topics", pa.list_(text)), ("entities", pa.list_(pa.struct([("type", text), ("name", text), ("confidence", score)]))), *((k, score) for k in ("importance", "utility", "belief_impact", "confidence")), ("expires_in_days", pa.int64())])), ("error", text)])

    def run(column: pa.Array) -> pa.Array:
        return pa.array([dict(zip(("value", "error"), parse_extraction(x), strict=True)) for x in column.to_pylist()], kind)

    return F.arrow_udf(run, f"struct<value:{value},error:string>")(raw)


def split_valid(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Good rows and rows for the side output, by the error of a parsed column."""
    bad = F.col(f"{column}.error").isNotNull()
    return df.filter(~bad), df.filter(bad)


def _said(x: Column) -> Column:
    return strip(F.coalesce(x, F.lit(""))) != ""


def valid_pairs(pairs: Column) -> Column:
    """Observations with a person and a topic."""
    return F.filter(pairs, lambda p: _said(p["person_name"]) & _said(p["topic_name"]))


def valid_beliefs(beliefs: Column) -> Column:
    """Observations with a claim."""
    return F.filter(beliefs, lambda b: _said(b["claim"]))


def valid_edges(edges: Column) -> Column:
    """Edges without a blank field."""
    return F.filter(edges, lambda e: _said(e["source_kind"]) & _said(e["source_name"]) & _said(e["target_kind"]) & _said(e["target_name"]) & _said(e["relationship"]))


def valid_analysis(summary: Column) -> Column:
    """An analysis of an outcome has a summary."""
    return _said(summary)


# -- values of any type


def text_at(value: Column, key: str) -> Column:
    """the stripped string under a key of a variant object; '' for another type or none."""
    v = F.try_variant_get(value, f"$.{key}", "variant")
    return F.coalesce(F.when(F.schema_of_variant(v) == "STRING", strip(F.try_variant_get(v, "$", "string"))), F.lit(""))


def flag_at(value: Column, key: str) -> Column:
    """the boolean under a key; false for another type or none."""
    v = F.try_variant_get(value, f"$.{key}", "variant")
    return F.coalesce(F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean")), F.lit(False))


def texts_at(value: Column, key: str) -> Column:
    """the strings of the list under a key, others left out; empty for another type or none."""
    xs = F.try_variant_get(value, f"$.{key}", "array<variant>")
    own = F.filter(F.coalesce(xs, F.array().cast("array<variant>")), lambda x: F.schema_of_variant(x) == "STRING")
    return F.transform(own, lambda x: F.try_variant_get(x, "$", "string"))


def _content(x) -> str:
    if isinstance(x, str):
        return x.strip(_BLANK)
    if isinstance(x, list) and all(isinstance(b, dict) or b is None for b in x):
        parts = [(b or {}).get("text") for b in x]
        return "\n".join(p.strip(_BLANK) for p in parts if isinstance(p, str) and p.strip(_BLANK))
    return ""


def parse_input(instructions: str | None, raw: str | None) -> tuple[list[dict] | None, str | None]:
    """(messages, error) of polymorphic input: a string, a list of messages or one message; content is a
    string or a list of text blocks; blank messages of a list are left out; a missing role is the user's."""
    text = (raw or "").strip(_BLANK)
    head = [{"role": "system", "content": instructions.strip(_BLANK)}] if (instructions or "").strip(_BLANK) else []
    if text in ("", "null"):
        return None, "input is required"
    if text[0] not in '"[{':
        return None, "unsupported input format"
    try:
        value = _DECODER.decode(text)
    except (ValueError, RecursionError):
        return None, "invalid input"
    if isinstance(value, str):
        return ([*head, {"role": "user", "content": value.strip(_BLANK)}], None) if value.strip(_BLANK) else (None, "input must not be empty")
    items = value if isinstance(value, list) else [value]
    if not all(isinstance(x, dict) or x is None for x in items):
        return None, "invalid input"
    found = []
    for x in (x or {} for x in items):
        role = x.get("role")
        content = _content(x.get("content"))
        if content:
            found.append({"role": (role.strip(_BLANK) if isinstance(role, str) else "") or "user", "content": content})
        elif isinstance(value, dict):
            return None, "input content must not be empty"
    return ([*head, *found], None) if head or found else (None, "input produced no messages")


def messages_of(instructions: Column, raw: Column) -> Column:
    """struct(messages, error) of inputs (see ``parse_input``)."""
    kind = pa.struct([("messages", pa.list_(pa.struct([("role", pa.string()), ("content", pa.string())]))), ("error", pa.string())])

    def run(head: pa.Array, column: pa.Array) -> pa.Array:
        return pa.array([dict(zip(("messages", "error"), parse_input(a, b), strict=True)) for a, b in zip(head.to_pylist(), column.to_pylist(), strict=True)], kind)

    return F.arrow_udf(run, "struct<messages:array<struct<role:string,content:string>>,error:string>")(instructions, raw)


# -- client addresses


def _address(text: str):
    try:
        found = ipaddress.ip_address(text)
    except ValueError:
        return None
    if getattr(found, "scope_id", None):
        return None
    return getattr(found, "ipv4_mapped", None) or found


def _socket(text: str | None):
    text = (text or "").strip(_BLANK)
    bracket = re.fullmatch(r"\[([^\[\]]*)\]:([^:\[\]]*)", text)
    plain = re.fullmatch(r"([^:\[\]]*):([^:\[\]]*)", text)
    return _address((bracket or plain)[1] if bracket or plain else text)


def resolve_client(remote: str | None, forwarded: str | None, trusted: Sequence[str]) -> str:
    """the address of the client: the socket's peer, or behind trusted proxies the rightmost hop of the
    header that isn't one of them; the peer if a hop on the way is malformed; '' without a valid peer."""
    nets = _networks(tuple(trusted))
    known = lambda a: any(a.version == n.version and a in n for n in nets)
    peer = found = _socket(remote)
    if peer is None:
        return ""
    header = (forwarded or "").strip(_BLANK)
    for part in reversed(header.split(",")) if header else ():
        if not known(found):
            break
        found = _address(part.strip(_BLANK))
        if found is None:
            return str(peer)
    return str(found)


@lru_cache(maxsize=8)
def _networks(trusted: tuple[str, ...]):
    return tuple(ipaddress.ip_network(x, strict=False) for x in trusted)


def client_address(remote: Column, forwarded: Column, trusted: Sequence[str]) -> Column:
    """F34 on columns: distinct pairs of a batch are resolved once."""
    prefixes = tuple(trusted)

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        rows = list(zip(a.to_pylist(), b.to_pylist(), strict=True))
        found = {k: resolve_client(*k, prefixes) for k in set(rows)}
        return pa.array([found[k] for k in rows], pa.string())

    return F.arrow_udf(run, "string")(remote, forwarded)


# -- references


def optional_equal(df: DataFrame, column: str, wanted: str) -> DataFrame:
    """Equality, or no filter for a blank value."""
    return df.filter(F.col(column).cast("string") == wanted.strip()) if wanted.strip() else df


def resolve_keys(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(id, ids) with every key of ``keys`` replaced by its value, in order; fails on an unknown one."""
    j = rows.select("id", F.posexplode("keys").alias("pos", "key")).join(small(known), "key", "left")
    checked = F.when(F.col("value").isNull(), F.raise_error(F.concat(F.lit("unknown key "), F.col("key")))).otherwise(F.col("value"))
    return j.withColumn("value", checked.cast("bigint")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("r")).select("id", F.transform("r", lambda x: x["value"]).alias("ids"))


def single_entity(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """The entity of a list with exactly one name, if there is one."""
    key = F.when(F.size("names") == 1, normalize_name(F.col("names")[0]))
    return rows.withColumn("_k", key).join(entities.select(normalize_name(F.col("name")).alias("_k"), "value"), "_k", "left").drop("_k")


def owned(rows: DataFrame, owners: DataFrame, key: str, user: Column) -> DataFrame:
    """Rows whose owner is the user; others look as if they weren't there."""
    return rows.join(owners.filter(F.col("user_id") == user), key)


def owned_by(rows: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """The rows asked for by (key, user_id) that belong to the one who asks."""
    return rows.join(asked, [key, "user_id"], "left_semi")
