"""Part of siltstone: functions."""
