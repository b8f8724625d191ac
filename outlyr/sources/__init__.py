"""Where events come from, and where scores and states go."""
