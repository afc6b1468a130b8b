"""The reports users ask for, composed of functions and operators."""
