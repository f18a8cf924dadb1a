"""Part of tallyloom: plans."""
