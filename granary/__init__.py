"""granary: product-graph analytics and data preparation as Spark plans."""

__version__ = "0.1.0"
