"""Column functions: classes, bands, labels, dates and market predicates."""
