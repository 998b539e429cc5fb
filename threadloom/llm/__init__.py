"""Training-data pipeline operators. Nothing else in threadloom imports this subpackage."""
