from .traversal import FailStep, Traversal, __

__all__ = ["FailStep", "Traversal", "__"]
