"""Writers with overwrite, append, upsert and guard rules."""
