"""Native Column expressions over HTML tokens, text, URLs and names."""
