"""Part of loam; see README.md."""
