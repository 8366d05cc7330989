"""One canonical JSON: equal values have equal bytes, whoever writes them.

Keys are sorted by code point at every level, there are no spare spaces, text is not escaped beyond what JSON demands, and numbers are as
Python writes them (whole numbers in full, others in the shortest form that reads back). What isn't strict JSON has no canonical form: an object that
repeats a key, NaN or an infinity, a lone surrogate, anything after the value. The driver's records and the expressions here share the
functions, so that a seal made by either is checked by the other; a batch of texts at a time goes through Arrow.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dump(value: object) -> str:
    return _write(value)


def digest(value: object) -> str:
    return hashlib.sha256(dump(value).encode()).hexdigest()


def _object(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("an object repeats a key")
    return out


def _no(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _finite(text: str) -> float:
    value = float(text)
    if math.isinf(value):
        raise ValueError("a number overflows")
    return value


_read = json.JSONDecoder(object_pairs_hook=_object, parse_constant=_no, parse_float=_finite).decode
_write = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode


def load(text: str) -> object:
    """The value of strict JSON; a ValueError says why it isn't."""
    if text.startswith("\ufeff"):
        raise ValueError("a byte-order mark is no JSON")
    try:
        value = _read(text)
        text.encode()
        if "\\u" in text:
            dump(value).encode()  # a lone surrogate has no bytes
    except RecursionError as e:
        raise ValueError("too deep") from e
    return value


def _unread(token: str) -> None:
    raise ValueError(f"{token} is read with more care")


_read_whole = json.JSONDecoder(parse_constant=_unread, parse_float=_unread).decode


def joined(members: Mapping[str, str]) -> str:
    """An object's canonical text from those of its members."""
    return "{" + ",".join([f"{json.encoder.encode_basestring(k)}:{members[k]}" for k in sorted(members)]) + "}"


def members(text: str) -> tuple[dict, dict[str, str], str]:
    """The object that is a strict JSON text, the canonical text of each of its members, and of all; a ValueError says why there is none.

    Without floating numbers nothing is written longer than it was read, so a text as long as its canonical form has no spare space, repeats no key and
    holds no lone surrogate: it was strict. Others are read again by :func:`load`.
    """
    try:
        value = _read_whole(text)
        if not text.isascii():
            text.encode()
        if isinstance(value, dict):
            out = {k: dump(v) for k, v in value.items()}
            whole = joined(out)
            if len(whole) == len(text):
                return value, out, whole
    except ValueError:
        pass
    value = load(text)
    if not isinstance(value, dict):
        raise ValueError("not an object")
    out = {k: dump(v) for k, v in value.items()}
    return value, out, joined(out)


def mapped(kind: T.DataType, of: Callable[[object], object], read: Callable[[str], object] = load) -> Callable[[Column], Column]:
    """An expression over JSON texts: ``of`` the value (what ``read`` gives), null where the text is null, isn't strict JSON or ``of`` can't be told."""

    def one(text: str | None) -> object:
        if text is None:
            return None
        try:
            return of(read(text))
        except (ValueError, KeyError, TypeError, AttributeError, RecursionError):
            return None

    @F.pandas_udf(kind)
    def expression(texts: pd.Series) -> pd.Series:
        return pd.Series([one(x) for x in texts], dtype=object)

    return expression


#: The canonical text of a JSON text.
canonical_json = mapped(T.StringType(), dump)
#: The SHA-256 of it.
json_digest = mapped(T.StringType(), digest)


def strict_json(text: Column) -> Column:
    """Whether a text is strict JSON; a null isn't. Only what Spark's own reader takes for JSON goes through Python."""
    return F.coalesce(F.when(F.try_parse_json(text).isNotNull(), canonical_json(text).isNotNull()), F.lit(False))


SEAL = "body_sha256"


def seal(body: Mapping) -> dict:
    """The record with the digest of everything else in it."""
    rest = {k: v for k, v in body.items() if k != SEAL}
    return rest | {SEAL: digest(rest)}


def sealed(record: Mapping) -> bool:
    return seal(record) == dict(record)
