"""Column-level building blocks: text, categories, binning, arithmetic."""
