"""Column expressions (JVM-side built-ins only)."""

from rolevec.functions.labels import decode_label, encode_label, flag_labels
from rolevec.functions.tokens import (
    EXPAND_PARAM_INDEX,
    parse_level,
    split_keep_inner,
    token_expand,
    token_motion,
)

__all__ = [
    "EXPAND_PARAM_INDEX",
    "decode_label",
    "encode_label",
    "flag_labels",
    "parse_level",
    "split_keep_inner",
    "token_expand",
    "token_motion",
]
