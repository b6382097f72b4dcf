"""Path columns: virtual paths, ancestors, folders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: any URI scheme prefix of a virtual path.
SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*://"


def normalize_path(path: Column, scheme: str = SCHEME) -> Column:
    """Drop the scheme prefix and the slashes at both ends."""
    return F.btrim(F.regexp_replace(path, scheme, ""), F.lit("/"))


def ancestors(path: Column) -> Column:
    """The path itself and every ancestor, deepest first."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.size(parts), F.lit(1), F.lit(-1)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )


def first_folder(path: Column) -> Column:
    return F.regexp_extract(path, "^([^/]+)/", 1)
