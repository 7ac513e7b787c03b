"""See the README for what lives in ``granary.functions``."""
