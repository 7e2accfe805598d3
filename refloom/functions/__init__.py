"""Column functions: ids, titles, years, small text transforms, fuzzy scores."""
