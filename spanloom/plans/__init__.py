"""Queries over the driver's tables, each with the SQL that says what it returns."""

from . import interval_queries  # noqa: F401
from . import signal_queries  # noqa: F401
from . import detect_queries  # noqa: F401
from . import edit_queries, store_queries  # noqa: F401
from . import media_queries  # noqa: F401
from . import render_queries, repair_queries, sink_queries, whole_edit_queries  # noqa: F401
