"""Survey and population tables: the public DataFrame -> DataFrame API."""
