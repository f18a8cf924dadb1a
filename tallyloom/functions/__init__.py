"""Part of tallyloom: functions."""
