"""Queries over cubes: slices, consolidation, filters, grading, sweeps, replay, ledgers, writes."""
