"""Table operators: encoders, joins, ranks and folds."""
