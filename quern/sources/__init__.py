"""Sources: table scans, file listings, host files and strided subsets."""

from quern.sources.tables import read_table

__all__ = ["read_table"]
