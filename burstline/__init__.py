"""Burst-topic detection over streams of short posts, written as Spark DataFrame operators."""

from burstline.params import TopicParams

__all__ = ["TopicParams"]
