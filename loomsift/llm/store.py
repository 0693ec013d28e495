"""Cutting lineage in the folder that all executors share."""

from loomsift.functions.store import checkpointed, shared_folder, stored

__all__ = ["checkpointed", "shared_folder", "stored"]
