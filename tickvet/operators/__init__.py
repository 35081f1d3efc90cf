"""Rules, the check and compare engines, scoring, reporting and the audit's batch summaries."""
