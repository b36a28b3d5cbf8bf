"""medlink: medication-terminology curation and linkage as PySpark jobs."""
