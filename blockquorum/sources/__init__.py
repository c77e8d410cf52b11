"""Reading and writing block tables, baskets, models and metrics."""
