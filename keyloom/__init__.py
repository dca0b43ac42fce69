"""keyloom: record sorting, range partitioning and corpus queries on PySpark."""

__version__ = "0.1.0"
