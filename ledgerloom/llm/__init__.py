"""Operators for preparing training text at corpus scale; nothing outside this subpackage imports them."""
