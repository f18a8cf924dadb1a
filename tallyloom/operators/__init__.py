"""Part of tallyloom: operators."""
