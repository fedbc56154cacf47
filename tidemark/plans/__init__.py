"""Composite jobs built from the operators: features, studies, event studies."""
