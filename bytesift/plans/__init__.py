"""From rule text to plans: syntax tree, byte patterns, diagnostics."""
