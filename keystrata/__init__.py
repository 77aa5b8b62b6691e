"""Key-clustered Parquet tables, zone-map pruning and vector search on Spark."""

__version__ = "0.1.0"


def version() -> str:
    return f"keystrata {__version__}"
