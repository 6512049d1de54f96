"""Column-name mappings."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame


def camel_to_snake(name: str) -> str:
    """Underscore before each inner capital, lower case, no blanks, dots to underscores."""
    split = "".join("_" + ch if ch.isupper() and i else ch for i, ch in enumerate(name))
    squeezed = re.sub("__+", "_", split.lower())
    return "".join(squeezed.split()).replace(".", "_")


def to_snake(name: str) -> str:
    """Snake case: word boundaries at case changes and at any run of other characters."""
    spaced = re.sub(r"%", " percent ", name)
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", spaced)
    spaced = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", spaced)
    words = re.findall(r"[A-Za-z0-9]+", spaced)
    out = "_".join(words).lower()
    return out if out and not out[0].isdigit() else f"x{out}"


def unique(names: Iterable[str]) -> list[str]:
    """Later duplicates get ``_2``, ``_3``, ..."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def clean_names(df: DataFrame, style: str = "camel") -> DataFrame:
    convert = {"camel": camel_to_snake, "snake": to_snake}[style]
    return df.toDF(*unique(convert(c) for c in df.columns))
