"""From SQL text to typed statements and DataFrame plans."""
