"""Column functions: text, identifiers, arrays and arithmetic."""
