"""Part of the parley retrieval engine."""
