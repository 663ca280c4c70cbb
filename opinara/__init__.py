"""Review-opinion analytics expressed as Spark DataFrame transformations."""

from opinara.config import EnhanceConfig, RunConfig, TfidfConfig

__all__ = ["EnhanceConfig", "RunConfig", "TfidfConfig"]
