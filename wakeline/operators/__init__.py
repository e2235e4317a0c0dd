"""Generic DataFrame -> DataFrame operators the survey tables are built from."""
