"""Training-data operators: formatting, mixing, token scans, extraction, dedup, language, quality, licences, search, packing."""
