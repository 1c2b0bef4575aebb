"""operators of folioscan."""
