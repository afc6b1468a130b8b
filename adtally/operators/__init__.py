"""Single operators, each a function from frames to a frame."""
