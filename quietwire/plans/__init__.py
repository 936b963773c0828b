"""Composed plans: the views over the driver's tables, the routing plan and the registered queries."""
