"""Readable URL slugs from names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

LONGEST = 48
LAST_SUFFIX = 25


@pandas_udf(StringType())
def _without_marks(names: pd.Series) -> pd.Series:
    """Canonical decomposition without nonspacing marks; Spark has no expression for it."""
    return names.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn"))


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, "^-+|-+$", "")


def plain_slug(name: Column) -> Column:
    """The slug of a name without accents, in column expressions alone. ASCII is matched before lower-casing."""
    words = F.lower(_trimmed(F.regexp_replace(name, "[^A-Za-z0-9]+", "-")))
    cut = F.regexp_replace(F.substring(words, 1, LONGEST), "-+$", "")
    return F.when(cut == "", "org").otherwise(cut)


def slugify(name: Column) -> Column:
    """The slug of any name: accents dropped, every other run one hyphen, 48 characters at most, ``org`` if nothing is left."""
    return plain_slug(_without_marks(name))


def with_suffix(slug: Column, n: Column) -> Column:
    """``slug-n``, its stem shortened where that would exceed 48 characters."""
    tail = F.concat(F.lit("-"), n.cast("string"))
    return F.concat(F.regexp_replace(F.substring(slug, F.lit(1), F.lit(LONGEST) - F.length(tail)), "-+$", ""), tail)


def family(slug: Column) -> Column:
    """A key that a slug shares with all its suffixed forms."""
    return F.regexp_replace(F.substring(slug, 1, 40), r"(-\d*)+$", "")


def next_free(base: str, taken: set[str]) -> str | None:
    """The first of base, base-2 ... base-25 that is not taken."""
    for n in range(1, LAST_SUFFIX + 1):
        tail = f"-{n}" if n > 1 else ""
        found = base[: LONGEST - len(tail)].rstrip("-") + tail if tail else base
        if found not in taken:
            return found
    return None
