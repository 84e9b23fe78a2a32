from . import exprs, money

__all__ = ["exprs", "money"]
