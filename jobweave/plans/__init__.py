"""Every operator as a registered query over the given tables, with DuckDB SQL for the same answer."""
