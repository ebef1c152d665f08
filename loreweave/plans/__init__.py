"""Plan helpers and the registered queries."""
