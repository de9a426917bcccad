"""Tables that cut lineage, written in the folder all executors share: see loomwright.sources.steps."""

from __future__ import annotations

from loomwright.sources.steps import clear, mark, settle, shared_dir

__all__ = ["clear", "mark", "settle", "shared_dir"]
