"""E-commerce analytics as Spark DataFrame queries."""

from basketry.session import apply_settings, build_session

__all__ = ["apply_settings", "build_session"]
