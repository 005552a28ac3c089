"""Part of mapsmith."""
