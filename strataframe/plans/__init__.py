"""End-to-end jobs: traits, occurrences, appearances, stages, risk, reports."""
