"""The columns that name one target, packed into one column that is never null.

Operators join and group by whatever columns a caller calls a target. A null there must
equal a null, and a name there must not meet a name inside an operator. So the columns travel
as the fields of one struct: structs are equal when their fields are, nulls included, and
fields meet no column. At the end they are columns again.
"""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOX = "wl_target"


def is_sealed(keys: Sequence[str]) -> bool:
    return not keys or (len(keys) == 1 and BOX in keys[0])


def seal(df: DataFrame | None, keys: Sequence[str], box: str = BOX) -> DataFrame | None:
    """``df`` with the key columns as one struct; tables without them stay as they are."""
    if df is None or not set(keys) <= set(df.columns):
        return df
    return df.select(F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]).alias(box), *[F.col(f"`{c}`") for c in df.columns if c not in keys])


def unseal(df: DataFrame | None, keys: Sequence[str], box: str = BOX) -> DataFrame | None:
    """The key columns again; one whose name the table uses for something else is called ``scan_`` and its name."""
    if df is None or box not in df.columns:
        return df
    rest = [c for c in df.columns if c != box]
    taken = {c.lower() for c in rest}
    names = [f"scan_{k}" if k.lower() in taken else k for k in keys]
    return df.select(*[F.col(box)[f"k{i}"].alias(name) for i, name in enumerate(names)], *[F.col(f"`{c}`") for c in rest])


def by_target(parameter: str = "keys") -> Callable:
    """Decorator: the operator sees one key column, whatever columns its caller names in ``parameter``."""

    def wrap(operator: Callable) -> Callable:
        signature = inspect.signature(operator)

        @functools.wraps(operator)
        def run(*args, **kwargs):
            bound = signature.bind(*args, **kwargs)
            bound.apply_defaults()
            keys = list(bound.arguments[parameter] or ())
            if is_sealed(keys):
                return operator(*args, **kwargs)
            for name, value in bound.arguments.items():
                if isinstance(value, DataFrame):
                    bound.arguments[name] = seal(value, keys)
            bound.arguments[parameter] = [BOX]
            return unseal(operator(*bound.args, **bound.kwargs), keys)

        return run

    return wrap
