"""Canonical JSON: one text for equal values, whatever their order, spacing or escapes; what has no safe form is refused.

Keys are sorted at every depth, text is UTF-8, nothing is spaced.  Digests must not depend on how a program writes numbers, so
floats are refused (or written in whole units), as are numbers that are not finite, integers that a double cannot hold
and repeated keys.  Sorting at any depth is beyond column expressions: texts are worked on by Arrow batches, one at a time.
"""

from __future__ import annotations

import json
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the largest integer that every reader of JSON keeps.
MOST_INTEGER = 2**53 - 1
FAULTS = ("NOT_JSON", "FLOAT", "NON_FINITE", "UNSAFE_INTEGER", "REPEATED_KEY", "TOO_DEEP")


class Refused(ValueError):
    """A value without a canonical form; its text is one of FAULTS."""


def _object(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise Refused("REPEATED_KEY")
    return out


def _integer(text: str) -> int:
    if len(text.lstrip("-")) > 16 or abs(int(text)) > MOST_INTEGER:
        raise Refused("UNSAFE_INTEGER")
    return int(text)


def _not_finite(text: str) -> None:
    raise Refused("NON_FINITE")


def _float(text: str) -> None:
    raise Refused("FLOAT")


def _in_units(places: int):
    def units(text: str) -> dict[str, int]:
        x = float(text)
        if x - x != 0:
            raise Refused("NON_FINITE")
        return {"$q": _integer(str(round(x * 10**places))), "p": places}

    return units


def parse(text: str, places: int | None = None) -> Any:
    """The value of a JSON text; floats in whole units of so many decimal places, or refused."""
    try:
        return json.loads(text, object_pairs_hook=_object, parse_int=_integer, parse_constant=_not_finite, parse_float=_float if places is None else _in_units(places))
    except RecursionError as e:
        raise Refused("TOO_DEEP") from e
    except Refused:
        raise
    except ValueError as e:
        raise Refused("NOT_JSON") from e


def write(value: Any) -> str:
    """The canonical text of a parsed value."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def _at(value: Any, path: str) -> Any:
    for part in filter(None, path.split(".")):
        value = value.get(part) if isinstance(value, dict) else None
    return value


def canonical_parts(text: Column, parts: dict[str, str | tuple[str, str]], places: int | None = None) -> Column:
    """Struct of canonical texts of parts of a JSON text, and fault (of FAULTS; null if there is none).

    parts: name -> path of keys joined by dots ("" is the whole), or (path, key that is left out).  A part that is not there is
    null; where there is a fault, all are.
    """
    names = list(parts)

    @F.arrow_udf("struct<" + ", ".join(f"{n}: string" for n in [*names, "fault"]) + ">")
    def run(texts: pa.Array) -> pa.Array:
        out: dict[str, list[str | None]] = {n: [] for n in [*names, "fault"]}
        for one in texts.to_pylist():
            row: dict[str, str | None] = dict.fromkeys(out)
            try:
                whole = parse(one, places) if one is not None else None
                for name, place in parts.items():
                    path, less = place if isinstance(place, tuple) else (place, None)
                    value = _at(whole, path)
                    if isinstance(value, dict) and less is not None:
                        value = {k: v for k, v in value.items() if k != less}
                    row[name] = None if value is None else write(value).encode().decode()  # half a surrogate pair is no text
            except Refused as e:
                row = dict.fromkeys(out) | {"fault": str(e)}
            except UnicodeEncodeError:
                row = dict.fromkeys(out) | {"fault": "NOT_JSON"}
            for name, value in row.items():
                out[name].append(value)
        return pa.StructArray.from_arrays([pa.array(v, pa.string()) for v in out.values()], names=list(out))

    return run(text)


def canonical(text: Column, places: int | None = None) -> Column:
    """Struct of the canonical text (null if refused) and the fault of a JSON text."""
    return canonical_parts(text, {"text": ""}, places)
