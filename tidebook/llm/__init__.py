"""Training-data operators: scans, mixing, sharding, de-duplication, filters, formats."""
