"""A PySpark engine for layout-aware page, proposal and embedding data."""
