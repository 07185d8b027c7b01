"""End-to-end jobs made of several operators."""
