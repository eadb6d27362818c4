"""User-level queries and batch merges.  Every function returns a lazy DataFrame."""
