"""Model metadata: dimensions, hierarchies, measures, rules, reference data; loading and validation."""
