"""Market-rotation analytics on Spark: scores, labels, backtests, intraday funnel."""
