"""Evidence operators."""
