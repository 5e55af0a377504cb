from . import crosssection, elementwise, recursive, timeseries

__all__ = ["crosssection", "elementwise", "recursive", "timeseries"]
