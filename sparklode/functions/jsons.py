"""JSON that always can be written, read and found."""

from __future__ import annotations

import datetime as dt
import json
import math
import re
from typing import Any


def json_safe(value: Any, _above: tuple[int, ...] = ()) -> Any:
    """`value` with what JSON has no form for replaced: NaN, infinities, functions and cycles become null, times text, sets sorted
    lists, other keys text."""
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if callable(value) or id(value) in _above:
        return None
    above = (*_above, id(value))
    if isinstance(value, dict):
        return {str(k): json_safe(v, above) for k, v in value.items() if not callable(v)}
    if isinstance(value, (set, frozenset)):
        return sorted((json_safe(v, above) for v in value), key=repr)
    if isinstance(value, (list, tuple)):
        return [json_safe(v, above) for v in value]
    return json_safe(value.asDict(True), above) if hasattr(value, "asDict") else str(value)


def stable(value: Any) -> str:
    """One text for equal values: keys sorted, no spaces."""
    return json.dumps(json_safe(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def extract(text: str | None) -> Any:
    """The first JSON object or list in prose: a fenced block first, else what begins with a bracket; commas before a closing
    bracket are forgiven. None if there is none."""
    if not text:
        return None
    fenced = re.search(r"```(?:json)?\s*\n(.*?)```", text, re.S)
    for part in ([fenced.group(1)] if fenced else []) + [text]:
        for m in re.finditer(r"[\[{]", part):
            for candidate in (part[m.start() :], re.sub(r",\s*([\]}])", r"\1", part[m.start() :])):
                try:
                    return json.JSONDecoder().raw_decode(candidate)[0]
                except ValueError:
                    continue
    return None


def read(path: str, fallback: Any = None) -> Any:
    """A JSON file, or the fallback if it is missing or malformed."""
    try:
        with open(path, encoding="utf-8") as file:
            return json.load(file)
    except (OSError, ValueError):
        return fallback
