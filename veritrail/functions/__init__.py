"""Column builders: text, identity, claim, score and citation expressions."""
