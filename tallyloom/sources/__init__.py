"""Part of tallyloom: sources."""
