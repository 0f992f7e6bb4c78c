"""All registered queries with their SQL, over the given tables."""

from __future__ import annotations

from . import calls, lake, logs, sessions, spans, streams, training

MODULES = (spans, logs, calls, training, lake, sessions, streams)

QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
