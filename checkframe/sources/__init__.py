"""Schemas, readers and writers."""

from .io import read, write_split
from .schema import Schema

__all__ = ["Schema", "read", "write_split"]
