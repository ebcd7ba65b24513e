"""texelyard: texture-asset analytics as Spark DataFrame plans."""

from texelyard.spec import JobSpec, Step

__all__ = ["JobSpec", "Step"]
