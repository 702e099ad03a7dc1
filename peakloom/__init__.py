"""peakloom: tandem mass-spectrometry analytics as PySpark DataFrame jobs."""

from peakloom.session import build_session

__all__ = ["build_session"]
