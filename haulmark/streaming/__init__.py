"""Loads of arriving files and script transforms."""

from .loads import script_transform, stream_load

__all__ = ["script_transform", "stream_load"]
