"""Query catalogue and whole pipelines."""
