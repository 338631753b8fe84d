"""Query descriptions and whole jobs."""
