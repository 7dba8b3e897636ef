from .predicates import P, Predicate

__all__ = ["P", "Predicate"]
