"""Part of ctxloom."""
