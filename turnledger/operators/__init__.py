"""DataFrame-to-DataFrame operators: ordered scans, parsing, pricing, rollups, refresh."""
