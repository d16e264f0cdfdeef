"""Language name <-> id (case-insensitive) as a map literal lookup."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanqa.constants import LANGUAGE_IDS


def _id_map() -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in LANGUAGE_IDS.items()))


def _name_map() -> Column:
    return F.create_map(*chain.from_iterable((F.lit(v), F.lit(k)) for k, v in LANGUAGE_IDS.items()))


def language_id(name) -> Column:
    """Language id; null for an unknown name (see ``language_id_strict``)."""
    c = F.col(name) if isinstance(name, str) else name
    return F.try_element_at(_id_map(), F.lower(c))


def language_id_strict(name) -> Column:
    """Language id; fails the job on an unknown name."""
    c = F.col(name) if isinstance(name, str) else name
    lid = language_id(c)
    return F.when(lid.isNull(), F.raise_error(F.concat(F.lit("Invalid language <"), c, F.lit(">")))).otherwise(lid)


def language_name(lid) -> Column:
    """Lower-case language name of an id."""
    c = F.col(lid) if isinstance(lid, str) else lid
    return F.try_element_at(_name_map(), c.cast("int"))
