"""Query representation, builder, planner and predicate algebra."""
