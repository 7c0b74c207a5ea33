"""User-facing pipelines composed of the operators."""
