"""functions of folioscan."""
