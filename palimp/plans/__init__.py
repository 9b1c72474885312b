"""Reports, cases, gates, reviews and the registered queries."""
