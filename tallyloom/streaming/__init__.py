"""Part of tallyloom: streaming."""
