"""Query operators: each builds a DataFrame."""
