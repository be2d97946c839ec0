"""Stage wiring and the registered queries."""
