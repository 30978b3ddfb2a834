"""Query registry and the independent check SQL."""
