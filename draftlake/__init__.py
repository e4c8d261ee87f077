"""A PySpark engine for commercial-bill and document data."""
