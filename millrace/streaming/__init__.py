"""An extension that the SQL dialect has no form for: its queries over files as they arrive."""

from .continuous import stream

__all__ = ["stream"]
