"""Feature sets, the engine and its queries."""
