"""Sources (driver tables, text formats) and sinks."""

from . import sinks, tables, text

__all__ = ["sinks", "tables", "text"]
