"""Feature declarations and the planner that fuses them."""
