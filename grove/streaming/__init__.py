"""Trees that grow while they are watched."""

from grove.streaming.lineages import LineageTable  # noqa: F401
