"""End-to-end dataflows and the registered queries."""
