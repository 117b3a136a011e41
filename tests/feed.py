"""Change-feed files for tests."""

from __future__ import annotations

import json
import os
from decimal import Decimal
from pathlib import Path


def typed(value):
    """A plain value as typed JSON."""
    match value:
        case None:
            return {"NULL": True}
        case bool():
            return {"BOOL": value}
        case int() | Decimal():
            return {"N": str(value)}
        case str():
            return {"S": value}
        case set():
            return {"SS": sorted(value)}
        case list():
            return {"L": [typed(v) for v in value]}
        case dict():
            return {"M": {k: typed(v) for k, v in value.items()}}
    raise TypeError(type(value))


def record(document: dict | None, sequence: int, event: str = "INSERT", keys: dict | None = None) -> dict:
    change = {"SequenceNumber": str(sequence)}
    if keys is not None:
        change["Keys"] = {k: typed(v) for k, v in keys.items()}
    if document is not None:
        change["NewImage"] = {k: typed(v) for k, v in document.items()}
    return {"eventName": event, "dynamodb": change}


def write_feed(folder: Path, *files: list[dict]) -> str:
    folder.mkdir(parents=True, exist_ok=True)
    for i, records in enumerate(files):
        path = folder / f"{i}.json"
        path.write_text(json.dumps({"Records": records}, indent=1))
        # A stream takes the oldest file first.
        os.utime(path, (1_000_000 + i, 1_000_000 + i))
    return str(folder)


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
