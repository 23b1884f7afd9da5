"""End-to-end pipelines: weather preparation, site comparison, scenario sweep."""
