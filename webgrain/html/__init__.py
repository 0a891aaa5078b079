"""A tolerant DOM, selectors, extraction, Markdown and pruning for captured pages."""
