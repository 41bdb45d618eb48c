"""Event-token expressions.

A token looks like ``a@motion@...@p0,,p1,,p2``: the second ``@`` part is the
motion code, the last ``@`` part holds the parameters separated by ``,,``.
Splitting follows the JVM ``String.split`` contract of the original jobs:
trailing empty parts are dropped (``"a@b@"`` has the parts ``a, b``).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolevec import defaults

# Motion code -> index of the parameter used as its prefix when
# tokens are expanded (all other motions get an empty prefix).
EXPAND_PARAM_INDEX: dict[str, int] = {
    "5300100": 0,
    "5300230": 2,
    "5300105": 2,
    "5300001": 3,
    "5300005": 2,
    "5300020": 3,
    "5300025": 2,
    "5300045": 2,
    "5300040": 2,
    "5300055": 3,
    "5300060": 3,
    "5300205": 2,
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_keep_inner(text: Column | str, sep: str) -> Column:
    """``split`` that drops trailing empty parts, like ``String.split(sep)``."""
    parts = F.split(_col(text), sep, -1)
    keep = F.array_max(F.transform(parts, lambda x, i: F.when(x != F.lit(""), i + 1).otherwise(0)))
    return F.slice(parts, 1, F.coalesce(keep, F.lit(0)))


def token_motion(token: Column | str, strict: bool = False) -> Column:
    """Motion code of a token (its second ``@`` part).

    ``strict=True`` raises on a token without a motion, as the original job
    does; the default gives NULL for such tokens.
    """
    parts = split_keep_inner(token, defaults.TOKEN_SEP)
    return parts[1] if strict else F.get(parts, 1)


def token_expand(
    token: Column | str,
    param_index: Mapping[str, int] | None = None,
    strict: bool = False,
) -> Column:
    """Expanded motion: ``prefix || motion`` where the prefix is the parameter
    picked by ``param_index[motion]`` (empty for motions not in the map)."""
    mapping = EXPAND_PARAM_INDEX if param_index is None else dict(param_index)
    parts = split_keep_inner(token, defaults.TOKEN_SEP)
    motion = parts[1] if strict else F.get(parts, 1)
    params = split_keep_inner(F.element_at(parts, -1) if strict else F.try_element_at(parts, F.lit(-1)),
                              defaults.PARAM_SEP)
    if mapping:
        lookup = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
        idx = F.try_element_at(lookup, motion)
    else:
        idx = F.lit(None).cast("int")
    picked = params[idx] if strict else F.get(params, idx)
    prefix = F.when(idx.isNull(), F.lit("")).otherwise(picked)
    return F.concat(prefix, motion)


def parse_level(mark: Column | str) -> Column:
    """Level number from its text form; raises on bad text (ANSI cast)."""
    return _col(mark).cast("int")
