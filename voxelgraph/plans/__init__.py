"""Methods by name, the staged pipeline, and the registered queries."""
