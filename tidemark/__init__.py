"""tidemark: a Spark-native engine for social-record change streams."""

from tidemark.session import local_session, shared_folder, stage_table

__all__ = ["local_session", "shared_folder", "stage_table"]
