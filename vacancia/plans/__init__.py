"""End-to-end plans put together from sources and operators."""
