"""The optional REST service over an engine."""
