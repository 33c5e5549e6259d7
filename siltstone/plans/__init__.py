"""Part of siltstone: plans."""
