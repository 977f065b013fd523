"""Training-data operators: deduplication, filters, extraction, tokenising, mixing and secret scans."""
