"""A document knowledge base on Spark: ingestion, retrieval and context assembly."""

from lorekeep.session import KnowledgeBase, Settings, build_session

__all__ = ["KnowledgeBase", "Settings", "build_session"]
