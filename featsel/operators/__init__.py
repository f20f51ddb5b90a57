"""Statistics, objective, search, preparation, evaluation and positions."""
