"""End-to-end flows and the catalogue of queries over the test tables."""
