"""End-to-end query plans and their registry."""
