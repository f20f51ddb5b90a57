"""No operator of the library needs state over a stream. Column expressions and projections (functions.text,
evaluate.predictions) work on streaming frames as they are."""
