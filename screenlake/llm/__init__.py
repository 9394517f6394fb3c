"""Operators of a training-data pipeline, one module each; ``queries`` holds their registered queries."""
