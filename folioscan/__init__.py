"""folioscan: document search and analytics on DataFrames."""
