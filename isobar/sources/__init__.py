"""Reading and writing observation trees, dimensions, sidecars and payloads."""
