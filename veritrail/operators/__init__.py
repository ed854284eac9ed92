"""Stage operators: DataFrame in, DataFrame out."""
