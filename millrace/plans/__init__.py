"""Use-case pipelines built from the operators."""
