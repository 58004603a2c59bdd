"""Training-data pipeline operators. Nothing else in gridloom imports this subpackage."""
