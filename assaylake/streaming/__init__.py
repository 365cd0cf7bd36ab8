"""Event-time windows over the events table, an extension beyond batch parity."""
