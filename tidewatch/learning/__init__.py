"""Model matrix, MLlib training, evaluation protocol and attribution."""
