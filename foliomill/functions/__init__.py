"""Part of foliomill."""
