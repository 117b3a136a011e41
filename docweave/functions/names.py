"""Column names: joining paths, and what to do when two paths give one name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class NameCollision(ValueError):
    """Two columns of one table would get the same name."""


def flat_name(path: Sequence[str], sep: str = "_") -> str:
    return sep.join(part.replace(".", sep) for part in path)


def strip_first_segment(name: str, sep: str = "_") -> str:
    return sep.join(name.split(".")[1:])


def unique_names(names: Sequence[str], on_collision: str = "raise", case_sensitive: bool = False) -> list[str]:
    """``names`` made unique: raise, or number the later ones ``_2``, ``_3`` …"""
    if on_collision not in ("raise", "suffix"):
        raise ValueError(f"on_collision must be 'raise' or 'suffix', not {on_collision!r}")

    def fold(name: str) -> str:
        return name if case_sensitive else name.lower()

    wanted = {fold(name) for name in names}
    taken: set[str] = set()
    out = []
    for name in names:
        chosen, number = name, 1
        while fold(chosen) in taken or (number > 1 and fold(chosen) in wanted):
            if on_collision == "raise":
                raise NameCollision(f"two columns would be named {name!r}")
            number += 1
            chosen = f"{name}_{number}"
        taken.add(fold(chosen))
        out.append(chosen)
    return out


def is_case_sensitive(df: DataFrame) -> bool:
    return df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _renamed(df: DataFrame, names: Sequence[str], on_collision: str) -> DataFrame:
    unique = unique_names(names, on_collision, is_case_sensitive(df))
    return df.select(*[F.col(quoted(old)).alias(new) for old, new in zip(df.columns, unique)])


def sanitise_names(df: DataFrame, sep: str = "_", on_collision: str = "raise") -> DataFrame:
    """Replace full stops in column names."""
    return _renamed(df, [name.replace(".", sep) for name in df.columns], on_collision)


def strip_first_segments(df: DataFrame, sep: str = "_", on_collision: str = "raise") -> DataFrame:
    """Drop everything up to the first full stop of each name and join the rest with ``sep``."""
    return _renamed(df, [strip_first_segment(name, sep) for name in df.columns], on_collision)
