"""Data-driven windows ("frames") and time windows over keyed events, on Spark."""

import sys

from pyspark import cloudpickle

from framewise.functions.spec import FrameSpec, parse_window_params
from framewise.operators.keyed import KeyedEvents, frames
from framewise.plans.layout import KeyLayout

# Tasks get the library's functions with the job; executors need no install of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["FrameSpec", "KeyLayout", "KeyedEvents", "frames", "parse_window_params"]
