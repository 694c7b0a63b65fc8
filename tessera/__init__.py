"""tessera: table split, stack, join, clean, aggregate and reconcile operators on Spark."""

__version__ = "0.1.0"
