"""Readers: level JSON, id lists, motion dictionary, text vectors, events adapter."""

from rolevec.sources.events import (
    event_level,
    event_motion,
    event_rows,
    event_token,
    level_records,
    positive_ids,
    read_events,
    token_rows,
)
from rolevec.sources.levels import (
    LEVEL_SCHEMA,
    REJECT_REASONS,
    judge_level_json,
    read_level_json,
    read_level_json_quarantined,
    write_level_json,
)
from rolevec.sources.lists import (
    read_id_list,
    read_motion_dictionary,
    write_id_list,
    write_motion_dictionary,
)
from rolevec.sources.vectors import parse_reduced, parse_unaligned, read_lines, vector_shape

__all__ = [
    "LEVEL_SCHEMA",
    "REJECT_REASONS",
    "event_level",
    "event_motion",
    "event_rows",
    "event_token",
    "judge_level_json",
    "level_records",
    "parse_reduced",
    "parse_unaligned",
    "positive_ids",
    "read_events",
    "read_id_list",
    "read_level_json",
    "read_level_json_quarantined",
    "read_lines",
    "read_motion_dictionary",
    "token_rows",
    "vector_shape",
    "write_id_list",
    "write_level_json",
    "write_motion_dictionary",
]
