"""sparkwright: template-driven business analytics expressed as Spark DataFrame plans.

One table in, any size: prepare it with replayable steps, profile it, score its quality,
map its columns to a business template and compute KPI, trend, ranking and segment tables.
Every operator returns a lazy DataFrame; nothing is collected to the driver except
bounded one-row aggregates and schemas.
"""

from sparkwright.session import get_session, scratch_root

__all__ = ["get_session", "scratch_root"]
