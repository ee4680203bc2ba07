"""Queries composed of operators, each with its DuckDB SQL."""
