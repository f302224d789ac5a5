"""One query for each operator, with an oracle in DuckDB SQL where SQL can express it."""

from millrace.plans import catalog, lookup, network, streams, texts, usage

_PARTS = (catalog, texts, usage, lookup, network, streams)
QUERIES = {k: f for part in _PARTS for k, f in part.Q.items()}
ORACLES = {k: s for part in _PARTS for k, s in part.SQL.items()}
