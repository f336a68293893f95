"""larder: marketplace analytics and demand forecasting as Spark DataFrame operators.

Layout
------
sources/    readers and writers (driver tables, CSV/JSON settings, model bundles)
functions/  Column-level helpers (rounding, display ids, JS-style coercions)
operators/  DataFrame -> DataFrame operators (analytics, billing, reviews,
            catalogue, features, evaluation, chat, event folds, models)
plans/      named queries wired to the bound tables, plus their SQL oracles
streaming/  Structured Streaming forms of the event folds
"""

from larder.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
