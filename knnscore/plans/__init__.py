"""End-to-end plans: configuration, scoring, the registered queries and their SQL."""
