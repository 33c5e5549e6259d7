"""Part of siltstone: sources."""
