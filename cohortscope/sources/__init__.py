"""Table scans, the JSON-list source, schema inspection and driver-table bindings."""
