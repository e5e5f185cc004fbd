"""Column builders: order statistics of arrays, smoothing folds, gap filling."""
