"""Schemas, operation codes and options of the record store."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

# Operation codes, reserved fields and the block file's extension.
SET, DELETE = 1, 2
RESERVED = ("id", "_seq", "_rid", "_oid")
EXTENSION = ".block"
LARGEST_INTEGER = 9007199254740991

#: A line of a block file: the record's text and its four system fields.
LOG_SCHEMA = "id string, _oid int, _rid long, _seq long, bid string, line_no long, record string"
#: A batch of changes: `ord` orders it, `op` is SET or DELETE, `record` a JSON object's text.
OPS_SCHEMA = "ord long, id string, op int, record string"


@dataclass
class Options:
    """Options of a store.  `data_sync_delay` is accepted and has no effect: a commit is
    synchronous.  `compact_delay` is the least time between two runs of `maintain`.  `on_error`
    gets the messages of lines that are no records, which are then left out."""

    dir_path: str = ""
    max_block_size: int = 8 * 1024 * 1024
    data_sync_delay: int = 1000
    stale_data_threshold: float = 0.1
    compact_delay: int = 24 * 60 * 60 * 1000
    cached_fields: list[str] = field(default_factory=list)
    reload_rule: bool = False
    on_error: Callable[[str], None] | None = None

    @classmethod
    def of(cls, given: dict[str, Any]) -> Options:
        """Defaults overlaid with what is given and valid; falsy values keep the default."""
        out = cls()
        if not given.get("dir_path"):
            raise ValueError("dirPath is required")
        out.dir_path = given["dir_path"]
        if size := given.get("max_block_size"):
            if size < 1024 or size % 1024:
                raise ValueError("maxBlockSize must be at least 1024 KB")
            out.max_block_size = size
        delay = given.get("data_sync_delay")
        if isinstance(delay, int) and not isinstance(delay, bool):
            out.data_sync_delay = delay
        if share := given.get("stale_data_threshold"):
            if not 0 <= share <= 1:
                raise ValueError("staleDataThreshold must be between 0 and 1")
            out.stale_data_threshold = share
        out.compact_delay = given.get("compact_delay") or out.compact_delay
        if isinstance(given.get("cached_fields"), list) and given["cached_fields"]:
            out.cached_fields = list(given["cached_fields"])
        out.reload_rule = bool(given.get("reload_rule", False))
        if on_error := given.get("on_error"):
            if not callable(on_error):
                raise TypeError("onError must be a function")
            out.on_error = on_error
        return out
