"""Training-data operators: de-duplication, sharding, scans, filters and tokenizing."""
