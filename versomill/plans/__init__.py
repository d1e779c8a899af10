"""Registered queries of the engine's own operators, and the SQL they must equal."""
