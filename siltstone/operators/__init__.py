"""Part of siltstone: operators."""
