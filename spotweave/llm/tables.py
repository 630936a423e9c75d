"""Intermediate tables in the folder that all executors share."""

from spotweave.tables import dropped, settled, shared_folder, written

__all__ = ["dropped", "settled", "shared_folder", "written"]
