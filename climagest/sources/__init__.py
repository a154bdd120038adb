"""Reading, writing and shared storage."""
