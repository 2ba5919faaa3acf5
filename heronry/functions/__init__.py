"""Part of heronry; see README.md."""
