from quern.functions.values import TypedColumn, ValueTypeError, typed

__all__ = ["TypedColumn", "ValueTypeError", "typed"]
