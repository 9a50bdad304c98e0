"""Column functions that operators share."""

from grove.functions.columns import *  # noqa: F401,F403
