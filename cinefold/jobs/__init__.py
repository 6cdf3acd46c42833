"""Entry points for spark-submit and the order in which they run."""
