"""Part of siltstone: streaming."""
