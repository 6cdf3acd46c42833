"""Physical-plan helpers: checked broadcasts and joins that survive hot keys."""
